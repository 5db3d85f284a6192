"""Batches of queries against packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.operators import encode
from pagemill.operators.ivf import Index
from pagemill.operators.knn import knn, knn_approx
from pagemill.operators.retrieve import attach_documents, format_context, to_response
from pagemill.operators.scale import stage
from pagemill.settings import CONTEXT_RESULTS, DEFAULT_RESULTS


def check_encoder(metadata: DataFrame, queries: DataFrame, encoder: encode.EncoderFactory) -> None:
    """Raise an error if a queried pack names another encoder than ``encoder``; one without a name is taken at its word."""
    name = getattr(encoder, "model_name", None)
    if name is None:
        return
    asked = queries.select(F.col("target").alias("framework")).distinct()
    other = metadata.filter(F.col("embedding_model") != name).join(asked, "framework", "left_semi")
    found = other.select("framework", "embedding_model").orderBy("framework").limit(5).collect()
    if found:
        packs = ", ".join(f"{r.framework} ({r.embedding_model})" for r in found)
        raise ValueError(f"queries are encoded by {name}, but not these packs: {packs}")


def search(
    vectors: DataFrame,
    queries: DataFrame,
    encoder: encode.EncoderFactory,
    k: int = DEFAULT_RESULTS,
    *,
    clean_query: bool = False,
    index: Index | None = None,
    metadata: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Hits of ``queries(query_id, target, query_text[, n_results])`` with documents and sources.

    Query text is encoded as it stands unless ``clean_query``.  With an ``index``
    of the vectors the search visits its lists.  With the packs' ``metadata``
    queries must be encoded as the packs that they ask were.
    """
    if metadata is not None:
        check_encoder(metadata, queries, encoder)
    asked = text.clean_text(F.col("query_text")) if clean_query else F.col("query_text")
    encoded = stage(encode.embed(queries.withColumn("_asked", asked), encoder, "_asked").drop("_asked"), "queries")
    found = knn(vectors, encoded, k, **options) if index is None else knn_approx(index, encoded, k, **options)
    hits = stage(found.join(encoded.select("query_id", "target"), "query_id"), "hits")
    return attach_documents(hits, vectors)


def query_packs(vectors: DataFrame, queries: DataFrame, encoder: encode.EncoderFactory, k: int = DEFAULT_RESULTS, **options) -> DataFrame:
    """Response lists per query, in rank order."""
    return to_response(search(vectors, queries, encoder, k, **options), queries)


def answer_context(vectors: DataFrame, queries: DataFrame, encoder: encode.EncoderFactory, k: int = CONTEXT_RESULTS, **options) -> DataFrame:
    """Answer context per query; an unknown target gets an error text."""
    hits = search(vectors, queries.drop("n_results"), encoder, k, **options)
    return format_context(hits, queries, vectors.select("target"))
