"""Ranked hits to responses and answer context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scale import join_dimension, stage

# Texts of the answer format.
SEPARATOR = "\n\n---\n\n"
NO_SOURCE = "N/A"
NOTHING_FOUND = ("No relevant information found in the '", "' knowledge base for your query.")
NO_SUCH_TARGET = ("Error: The knowledge base for the target '", "' does not exist. Please try a different target.")


def attach_documents(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add the stored (cleaned) document and its source to hits of a target.

    Ranking carries ids only, so texts are read for the hits alone.  Every hit
    is a stored vector, hence the inner join, in which the hits are the side
    that is broadcast when measured small.
    """
    stored = vectors.select("target", "chunk_id", "document", "source_url")
    return join_dimension(stored, hits, ["target", "chunk_id"]).select(*hits.columns, "document", "source_url")


def attach_raw_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the raw chunk behind each hit, null when the store no longer holds it.

    The store is first cut down to the chunks hit, then joined outer; a chunk
    that a third of the hits share is spread like any dimension.
    """
    keys = ["target", "chunk_id"]
    needed = join_dimension(chunks.select(*keys, "text", "header"), hits.select(*keys).distinct(), keys, "left_semi")
    return join_dimension(hits, stage(needed, "chunks-hit"), keys, "left")


def _in_rank_order(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("rank", *fields)))


def to_response(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: documents, metadatas and distances in rank order, empty without hits."""
    lists = hits.groupBy("query_id").agg(_in_rank_order("document", "source_url", "distance").alias("_hits"))
    ranked = F.coalesce(F.col("_hits"), F.filter(F.col("_hits"), lambda h: F.lit(False)))
    none = lambda t: F.array().cast(t)
    return queries.select("query_id").join(lists, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("_hits.document"), none("array<string>")).alias("documents"),
        F.coalesce(
            F.transform(ranked, lambda h: F.struct(h["source_url"].alias("source_url"))),
            none("array<struct<source_url:string>>"),
        ).alias("metadatas"),
        F.coalesce(F.col("_hits.distance"), none("array<double>")).alias("distances"),
    )


def result_block(source_url: Column, document: Column) -> Column:
    return F.concat(F.lit("Source: "), F.coalesce(source_url, F.lit(NO_SOURCE)), F.lit("\nContent: "), document)


def _naming(texts: tuple[str, str], target: Column) -> Column:
    return F.concat(F.lit(texts[0]), target, F.lit(texts[1]))


def format_context(hits: DataFrame, queries: DataFrame, known_targets: DataFrame | None = None) -> DataFrame:
    """Answer context per query: (query_id, target, context).

    Queries without hits keep a row with a message; with ``known_targets``
    given, those naming another target get an error text instead.
    """
    blocks = hits.select("query_id", "rank", result_block(F.col("source_url"), F.col("document")).alias("_block"))
    joined = blocks.groupBy("query_id").agg(
        F.array_join(F.transform(_in_rank_order("_block"), lambda h: h["_block"]), SEPARATOR).alias("_context")
    )
    out = queries.select("query_id", "target").join(joined, "query_id", "left")
    message = _naming(NOTHING_FOUND, F.col("target"))
    if known_targets is not None:
        known = known_targets.select("target").distinct().withColumn("_known", F.lit(True))
        out = join_dimension(out, known, ["target"], "left")
        message = F.when(F.col("_known"), message).otherwise(_naming(NO_SUCH_TARGET, F.col("target")))
    return out.select("query_id", "target", F.coalesce(F.col("_context"), message).alias("context"))
