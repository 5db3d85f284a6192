"""Inverted file over vectors: fitted centres, a list of vectors per centre, and bounds that say which lists can matter.

Every vector belongs to the list of its nearest centre.  Per target and list
the index knows how many vectors there are and the least and greatest distance
to the centre; by the triangle inequality those bound a query's distance to all
of them.  A query needs no list whose bound is above the distance within which
enough vectors are certain to lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.scale import stage

SAMPLE = 20_000  # vectors of one width that its centres are fitted on
LEAST, MOST = 4, 256  # centres of one width
WIDTHS = 16  # most frequent widths that have centres; others make one list each
ROUNDS = 8
OUT_OF_BOUNDS = 1_000_000  # rows of list bounds that the driver reads for one batch of queries


class Index(NamedTuple):
    """Vectors with ``_list``, sorted by it within files; bounds (_block, _list, n, near, far); centres by width."""

    rows: DataFrame
    lists: DataFrame
    centres: dict[int, np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def k_means(points: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's rounds from a random start; a centre that loses all its points stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n]].copy()
    for _ in range(rounds):
        own = distances(points, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def fit(vectors: DataFrame, *, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centres by width, from a bounded sample chosen by a hash of the vectors themselves.

    About the square root of a width's number of vectors, LEAST to MOST.  Vectors
    are finite and not null.
    """
    sizes = vectors.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    widths = sizes.orderBy(F.desc("n"), "width").limit(WIDTHS).collect()
    draw = F.xxhash64("embedding").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    out = {}
    for width, n in widths:
        of = vectors.filter((F.size("embedding") == width) & (draw <= min(1.0, sample / n))).select("embedding")
        drawn = of.orderBy(F.xxhash64("embedding")).limit(2 * sample).toArrow()
        if drawn.num_rows:
            out[width] = k_means(matrix(drawn.column("embedding")), int(np.clip(np.sqrt(n), LEAST, MOST)))
    return out


def nearest(points: np.ndarray, centres: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance to it; list 0 and nothing known without centres."""
    if centres is None:
        return np.zeros(len(points), np.int32), np.zeros(len(points))
    own, away = np.empty(len(points), np.int32), np.empty(len(points))
    for at in range(0, len(points), 4096):
        d = distances(points[at : at + 4096], centres)
        own[at : at + 4096] = d.argmin(1)
        away[at : at + 4096] = d.min(1)
    return own, away


def assign(vectors: DataFrame, centres: dict[int, np.ndarray], column: str = "embedding") -> DataFrame:
    """``vectors`` with ``_list`` and ``_away``, the distance to the list's centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*vectors.schema.fields, T.StructField("_list", T.IntegerType()), T.StructField("_away", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(column)
            widths = np.diff(held.offsets.to_numpy())
            own, away = np.zeros(len(held), np.int32), np.zeros(len(held))
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                own[rows], away[rows] = nearest(matrix(held.take(pa.array(rows))), shared.value.get(int(width)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(away)], [*batch.schema.names, "_list", "_away"]
            )

    return vectors.mapInArrow(run, schema)


def build(vectors: DataFrame, *, sample: int = SAMPLE) -> Index:
    """Index of vectors (_block, chunk_id, embedding, ...).

    One pass writes them with their lists, sorted within each task, so that no
    vector is shuffled and a reader of few lists skips the row groups of others.
    """
    centres = fit(vectors, sample=sample)
    rows = stage(assign(vectors, centres).sortWithinPartitions("_list"), "vector-lists")
    lists = rows.groupBy("_block", "_list").agg(F.count(F.lit(1)).alias("n"), F.min("_away").alias("near"), F.max("_away").alias("far"))
    return Index(rows.drop("_away"), stage(lists, "list-bounds"), centres)


def needed(queries: np.ndarray, k: int, centres: np.ndarray, own: np.ndarray, n: np.ndarray, near: np.ndarray, far: np.ndarray, reach: float = 1.0) -> np.ndarray:
    """Which lists (columns: ``own`` of the centres, with their bounds) each query must visit for its ``k`` nearest.

    The lists taken by their farthest member until they hold ``k`` vectors say
    how far the k-th can be; no list whose nearest possible member is farther
    than ``reach`` times that is visited, except those lists themselves.  With
    ``reach`` 1 nothing is lost.
    """
    d = distances(queries, centres[own])
    slack = 1e-6 * (1.0 + d.max(initial=0.0))
    order = np.argsort(d + far, axis=1, kind="stable")
    held = np.cumsum(n[order], axis=1)
    enough = (held >= k).argmax(1)
    enough[held[:, -1] < k] = len(own) - 1
    rows = np.arange(len(queries))
    kth = (d + far)[rows, order[rows, enough]]
    wanted = np.maximum(d - far, near - d) <= reach * kth[:, None] + slack
    sure = np.arange(len(own))[None, :] <= enough[:, None]
    wanted[rows[:, None], order] |= sure
    return wanted
