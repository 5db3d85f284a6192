"""Scrape cache: documents kept between the crawl and the build."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.html import METADATA_TYPE
from pagemill.operators.scale import join_dimension

_DOCUMENT = f"markdown string, metadata {METADATA_TYPE}"
_CACHED = f"target string, doc_ord bigint, {_DOCUMENT}"


def no_such_path(error: Exception) -> bool:
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not no_such_path(error):
            raise
        return spark.createDataFrame([], schema)


def read_scrape_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached documents: (target, doc_ord, markdown, metadata); a missing cache is empty."""
    return read_or_empty(spark, path, _CACHED)


def read_json_cache(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Interchange form, one JSON array of documents per file; unreadable files give nothing."""
    try:
        raw = (
            spark.read.schema(_DOCUMENT + ", _corrupt string")
            .option("multiLine", True)
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(path)
        )
    except AnalysisException as error:
        if not no_such_path(error):
            raise
        return spark.createDataFrame([], _CACHED)
    # reading a data column besides keeps Spark from refusing a scan of the corrupt column alone
    readable = F.col("_corrupt").isNull() & (F.length(F.coalesce("markdown", F.lit(""))) >= 0)
    return raw.filter(readable).select(
        F.lit(target).alias("target"), F.monotonically_increasing_id().alias("doc_ord"), "markdown", "metadata"
    )


def write_scrape_cache(docs: DataFrame, path: str, force: bool = False) -> None:
    """Write documents partitioned by target.

    Targets already cached are skipped unless ``force``; forcing replaces only
    targets that yielded documents, so an empty crawl keeps the old cache.
    """
    spark = docs.sparkSession
    columns = docs.select("target", "doc_ord", "markdown", F.col("metadata").cast(METADATA_TYPE).alias("metadata"))
    if not force:
        cached = read_scrape_cache(spark, path).select("target").distinct()
        columns = join_dimension(columns, cached, ["target"], "left_anti")
    write_by_target(columns, path)


def write_by_target(
    df: DataFrame, path: str, *more: str, mode: str = "overwrite", codec: str | None = None, balanced: bool = False
) -> None:
    """Partitioned write that replaces only partitions present in ``df``.

    The rebalance hint sizes output files: a hot target is split over tasks,
    small ones share a task.  Where tasks are known to hold enough rows of each target
    (``balanced``) nothing is moved for that.  ``codec`` packs large texts tighter than the session does.
    """
    placed = df if balanced else df.hint("rebalance", "target", *more)
    writer = placed.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.option("compression", codec) if codec else writer).partitionBy("target", *more).parquet(path)
