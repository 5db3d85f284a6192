"""Run settings and the Spark options the jobs are written for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

# Defaults of the knowledge-pack format.
DEFAULT_OUTPUT_DIR = "repository"
DEFAULT_CACHE_DIR = ".cache"
DEFAULT_PAGE_LIMIT = 1000
DEFAULT_RESULTS = 5
CONTEXT_RESULTS = 3


@dataclass(frozen=True)
class Settings:
    output_dir: str = DEFAULT_OUTPUT_DIR
    cache_dir: str = DEFAULT_CACHE_DIR
    embedding_model: str = "hashing-64"

    @classmethod
    def from_config(cls, config: dict) -> "Settings":
        """Settings from a parsed configuration mapping, absent keys defaulted."""
        pipeline = config.get("pipeline", {})
        store = config.get("vector_store", {})
        return cls(
            output_dir=pipeline.get("output_dir", cls.output_dir),
            cache_dir=pipeline.get("cache_dir", cls.cache_dir),
            embedding_model=store.get("embedding_model_name", cls.embedding_model),
        )


def tune(spark: SparkSession) -> SparkSession:
    """Session options every job here assumes; all are runtime-settable."""
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    return spark
