"""Landed pages and alternate document feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.html import METADATA_FIELDS
from pagemill.operators.scale import join_dimension, number_rows
from pagemill.sources.targets import with_default_limit


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page table (Parquet), spread over the cluster if its files would leave cores idle."""
    return spread(spark.read.parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """Repartition only an input with fewer splits than cores, which is small by that very fact.

    Page and text operators are bound by CPU, not by the bytes moved here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_fallback(primary: DataFrame, fallback: DataFrame, enabled: bool = True, targets: DataFrame | None = None) -> DataFrame:
    """Primary documents, plus the fallback's for targets without any.

    With ``targets`` a target's ``page_limit`` holds for the fallback too: its
    first documents by ``doc_ord``, which must be unique within a target.
    """
    if not enabled:
        return primary
    covered = primary.select("target").distinct()
    if targets is not None:
        numbered = number_rows(fallback, ["target"], ["doc_ord"], "_n")
        limits = with_default_limit(targets).select("target", "page_limit")
        fallback = join_dimension(numbered, limits, ["target"]).filter(F.col("_n") <= F.col("page_limit")).select(*fallback.columns)
    return primary.unionByName(join_dimension(fallback, covered, ["target"], "left_anti"))


def normalize_feed(feed: DataFrame) -> DataFrame:
    """Rows of another crawler as documents.

    ``metadata`` is a map; known keys fill the metadata struct, the others stay
    in ``extra``.  A null map counts as empty.
    """
    given = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    known = F.array(*[F.lit(f) for f in METADATA_FIELDS])
    return (
        feed.withColumn("_given", given)
        .withColumn(
            "metadata",
            F.struct(*[F.try_element_at(F.col("_given"), F.lit(f)).alias(f) for f in METADATA_FIELDS]),
        )
        .withColumn("extra", F.map_filter("_given", lambda k, _: ~F.array_contains(known, k)))
        .drop("_given")
    )
