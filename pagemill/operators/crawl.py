"""Breadth-first crawl order over landed pages, level by level."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators.scale import number_rows, stage, staging_root

_LEVEL = ["target", "url", "page_limit", "host", "rank", "ok", "emits"]
_VISITED = "target string, url string, page_limit int, host string, rank bigint, ok boolean, emits boolean, depth int"
# A level counted to be at most this long is ranked by a plain window.
_WINDOW_ROWS = 200_000


def _unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    """``found`` minus ``visited``.

    The visited table is first cut down to what was found again, which a small
    level does by broadcast; the table itself, which grows with the crawl, is
    then not shuffled.
    """
    keys = ["target", "url"]
    again = visited.select(*keys).join(found.select(*keys), keys, "left_semi")
    return found.join(again, keys, "left_anti")


def linked_urls(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct same-host URLs linked from fetched frontier pages, at their first position.

    Position is (rank of the linking page, place of the link in it), which is
    the order a queue would have discovered them in.
    """
    return (
        frontier.filter("ok")
        .select("target", "page_limit", "host", "rank", F.col("url").alias("src_url"))
        .join(links.select("src_url", "pos", F.col("abs_url").alias("url")), "src_url")
        .filter(urls.netloc(F.col("url")) == F.col("host"))
        .groupBy("target", "url")
        .agg(F.min(F.struct("rank", "pos", "page_limit", "host")).alias("_at"))
        .select(
            "target", "url", "_at.page_limit", "_at.host",
            F.col("_at.rank").alias("parent_rank"), F.col("_at.pos").alias("pos"),
        )
    )


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and the number of its rows, known when a job has written it."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def next_frontier(frontier: DataFrame, pages: DataFrame, links: DataFrame, visited: DataFrame) -> DataFrame:
    """Next level, ranked: landed pages among the linked URLs that were not visited yet.

    URLs that never landed yield neither documents nor links and drop out.
    """
    found, seen = _counted(linked_urls(frontier, links), "found")
    found = stage(found, "found")
    fresh = _unvisited(found, visited).join(pages, "url")
    if seen.get["n"] <= _WINDOW_ROWS:
        order = Window.partitionBy("target").orderBy("parent_rank", "pos")
        return fresh.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return number_rows(fresh, ["target"], ["parent_rank", "pos"], "rank")


def crawl_order(targets: DataFrame, pages: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Documents of each target in crawl order: (target, url, depth, doc_ord).

    ``targets(target, url, page_limit)``, ``pages(url, ok, has_content)``,
    ``links(src_url, pos, abs_url)``.  Only pages with content count towards
    ``page_limit``; failed ones are visited and yield nothing.  The driver loops
    over levels; each level is a table in the shared folder, so lineage stays
    short and joins are planned by real sizes.  A level takes three writes: the
    links that it finds, the pages among them that are new, and how many
    documents each target has by then.  Of earlier levels only the keys are read, to tell what is new.
    """
    spark = targets.sparkSession
    landed = stage(
        pages.groupBy("url")
        .agg(F.max(F.struct("ok", "has_content")).alias("_p"))
        .select("url", "_p.ok", (F.col("_p.ok") & F.col("_p.has_content")).alias("emits")),
        "landed",
    )
    edges = stage(links.select("src_url", "pos", "abs_url").filter(urls.netloc(F.col("abs_url")) != ""), "links")
    root = f"{staging_root(spark)}/pagemill-stage/crawl-{uuid.uuid4().hex}"

    def visit(level: DataFrame, depth: int) -> tuple[DataFrame, int]:
        """Write a level; its table and size."""
        path = f"{root}/depth={depth}"
        counted, seen = _counted(level.select(*_LEVEL), "level")
        counted.write.parquet(path)
        return spark.read.schema(counted.schema).parquet(path), seen.get["n"]

    def visited() -> DataFrame:
        return spark.read.schema(_VISITED).parquet(root)

    def emitted(level: DataFrame, before: DataFrame | None) -> DataFrame:
        """Documents of each target so far."""
        own = level.filter("emits").groupBy("target", "page_limit").agg(F.count(F.lit(1)).alias("n"))
        every = own if before is None else before.unionByName(own).groupBy("target", "page_limit").agg(F.sum("n").alias("n"))
        return stage(every, "emitted")

    seeds = targets.select(
        "target", "url", "page_limit", urls.netloc(F.col("url")).alias("host"), F.lit(1).cast("bigint").alias("rank")
    )
    (level, size), depth = visit(seeds.join(landed, "url"), 0), 0
    counts = None
    while size and (max_depth is None or depth < max_depth):
        counts = emitted(level, counts)
        frontier = level.join(counts.filter("n >= page_limit").select("target"), "target", "left_anti")
        depth += 1
        level, size = visit(next_frontier(frontier, landed, edges, visited()), depth)
    return limit_emitted(number_rows(visited().filter("emits"), ["target"], ["depth", "rank"], "doc_ord")).select(
        "target", "url", "depth", "doc_ord"
    )


def limit_emitted(df: DataFrame, limit_col: str = "page_limit") -> DataFrame:
    """Keep each target's first ``limit_col`` documents in crawl order."""
    return df.filter(F.col("doc_ord") <= F.col(limit_col))
