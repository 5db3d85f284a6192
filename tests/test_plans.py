"""Plans that must hold at scale."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagemill.operators import chunking, encode, graph, html, knn
from pagemill.sources import targets

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_scan_reads_only_what_it_needs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    links = html.extract_links(pages.select("url", "html")).filter("src_url > 'http://b'").select("abs_url")
    plan = executed(links)
    assert "ReadSchema: struct<url:string,html:string>" in plan and "GreaterThan(url,http://b)" in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_chunking_and_cleaning_neither_shuffle_nor_leave_the_jvm(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(
        F.lit("t").alias("target"), F.col("page_id").alias("doc_ord"), "url", "html"
    )
    plan = executed(chunking.retrieval_chunks(html.pages_to_documents(pages)).select("chunk_id", "document"))
    # the page scan runs in Python, once; nothing after it does
    assert "Exchange" not in plan and len(re.findall(r"ArrowEvalPython \[", plan)) == 1 and "Batch" not in plan.replace("Batched", "")
    # the cleaner appears once: filters on its result do not repeat it
    assert plan.count("table of contents") <= 2
    documents = pages.select("target", "doc_ord", F.col("html").alias("markdown"), F.struct(F.col("url").alias("source_url")).alias("metadata"))
    assert "Python" not in executed(chunking.retrieval_chunks(documents).select("chunk_id", "document"))


def test_search_shuffles_results_not_vectors(spark):
    stored = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.lit("t").alias("target"), F.col("vec_id").alias("chunk_id"), "embedding", F.lit("x").alias("document")
    )
    plan = executed(knn.knn(stored, stored.withColumnRenamed("chunk_id", "query_id")))
    below_kernel = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below_kernel and "document" not in below_kernel
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


def test_only_the_text_column_enters_the_encoder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("text", "document")
    plan = executed(encode.embed(docs.filter("lang = 'en'"), encode.hashing_encoder()).filter(F.size("embedding") > 0))
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1
    assert "EqualTo(lang,en)" in plan


def test_rules_need_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("lang").alias("target"), F.col("doc_id").alias("doc_ord"), F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk_id"), "text"
    )
    config = {"targets": {"en": {"patterns": [{"label": "A", "pattern": "([A-Z][a-z]+)"}]}}}
    assert "Exchange" not in executed(graph.rule_entities(docs, targets.patterns_df(spark, config)))


def test_merges_combine_before_the_shuffle(spark):
    mentions = spark.createDataFrame([("t", 1, 0, "c", "e", "l", 0)], ", ".join(
        ["target string", "doc_ord long", "chunk_idx int", "chunk_id string", "entity string", "label string", "priority int"]
    ))
    plan = executed(graph.merge_nodes(mentions))
    assert plan.count("partial_min") == 2 and "Window" not in plan
