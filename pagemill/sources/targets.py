"""Crawl targets and trigger requests."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.scale import join_dimension
from pagemill.settings import DEFAULT_PAGE_LIMIT

_MAX_LISTED = 1000
_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def check_name(target: str) -> str:
    """Target names become path parts; anything else is refused."""
    if not _NAME.fullmatch(target) or target in (".", ".."):
        raise ValueError(f"invalid target name: {target!r}")
    return target


def _local(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    # an Arrow table becomes a local relation, whose size the planner knows
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def targets_df(spark: SparkSession, config: dict) -> DataFrame:
    """Targets of a parsed configuration: (target, url, page_limit), limit defaulted."""
    rows = [
        {"target": check_name(name), "url": spec.get("url"), "page_limit": spec.get("page_limit", DEFAULT_PAGE_LIMIT)}
        for name, spec in config.get("targets", {}).items()
    ]
    return _local(spark, rows, pa.schema([("target", pa.string()), ("url", pa.string()), ("page_limit", pa.int32())]))


def patterns_df(spark: SparkSession, config: dict) -> DataFrame:
    """Entity patterns: (target, label, pattern)."""
    rows = [
        {"target": name, "label": p["label"], "pattern": p["pattern"]}
        for name, spec in config.get("targets", {}).items()
        for p in spec.get("patterns", [])
    ]
    return _local(spark, rows, pa.schema([(c, pa.string()) for c in ("target", "label", "pattern")]))


def ontology_df(spark: SparkSession, config: dict) -> DataFrame:
    """Ontology for triples: (target, entity_types, predicates)."""
    rows = [
        {"target": name, "entity_types": spec.get("entity_types", []), "predicates": spec.get("predicates", [])}
        for name, spec in config.get("targets", {}).items()
    ]
    names = pa.list_(pa.string())
    return _local(spark, rows, pa.schema([("target", pa.string()), ("entity_types", names), ("predicates", names)]))


def with_default_limit(targets: DataFrame) -> DataFrame:
    return targets.withColumn("page_limit", F.coalesce(F.col("page_limit"), F.lit(DEFAULT_PAGE_LIMIT)).cast("int"))


def select_targets(targets: DataFrame, name: str) -> DataFrame:
    """One named target, or every target for ``all`` in any case."""
    return targets if name.lower() == "all" else targets.filter(F.col("target") == name)


def of_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of the given targets; a short list of names prunes the partitions of a stored table."""
    names = [r.target for r in targets.select("target").distinct().limit(_MAX_LISTED + 1).collect()]
    if len(names) <= _MAX_LISTED:
        return df.filter(F.col("target").isin(names))
    return join_dimension(df, targets.select("target").distinct(), ["target"], "left_semi")


def resolve_targets(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Requests joined with their target; unknown names drop out."""
    return join_dimension(requests, targets, ["target"])


def unknown_targets(requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Requests naming no known target."""
    return join_dimension(requests, targets.select("target"), ["target"], "left_anti")
