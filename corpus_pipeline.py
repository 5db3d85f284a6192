"""From raw documents to token counts: each stage is one operator of ``pagemill.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, langid, paragraphs, simhash
from pagemill.llm.queries import table
from pagemill.operators.scale import stage

REMEMBERED = 40_000  # pre-tokens kept, in each of two generations, by a Python worker that serves other stages as well
LEAST_LANGUAGE_SCORE = 0.4  # a single ambiguous word stays; texts without letters go


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from the labelled ones among them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return langid.keep_identified(docs, langid.train(docs.select("text", "lang")), LEAST_LANGUAGE_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_first(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that stand elsewhere; ``n_chars`` follows."""
    return paragraphs.remove(docs)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with their count and whether they decode to the text."""
    # decoded by the worker that encodes: a second one in the same task would double the memory of Python
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.encode(docs, path, remembered=REMEMBERED, decoded="decoded")
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark_items),
    ("byte_level_bpe", token_ids),
]

# XXH64 fingerprints, learned models and byte-pair merges have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
