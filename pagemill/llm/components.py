"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scale import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of a node to the smallest node about it.

    With ``larger`` a node moves its larger neighbours (edges seen from both
    ends); otherwise its smaller ones and itself.  Only minima are kept per
    node, so a hub is an aggregate and a join that can be split, never a list.
    """
    if larger:
        seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = seen.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        around = edges.unionByName(least.select("a", F.col("a").alias("b")))
        moved = around.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.filter("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Every node of the undirected ``edges`` (a, b) with ``root``, the smallest node it can reach.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edges are stars, which takes a logarithmic number of rounds; each round's
    edges are a table in the shared folder, so lineage stays short.  Null ends,
    loops and repeated edges are ignored; no edges give no rows.
    """
    ends = edges.select("a", "b").filter("a is not null and b is not null and a != b")
    now = stage(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        now = stage(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
