"""Records that say which written data count: one file per commit, appended last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pagemill.sources.cache import no_such_path


def append(records: DataFrame, path: str) -> None:
    """Commit the records: they come as one file, so readers see all of them or none."""
    records.coalesce(1).write.mode("append").json(path)


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All records committed so far; none where nothing was."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as error:
        if not no_such_path(error):
            raise
        return spark.createDataFrame([], schema)
