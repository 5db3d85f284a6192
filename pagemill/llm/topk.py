"""Exact top-k inner products over quantised vectors, pruned block by block.

Each dimension is a term, of a vector with that dimension negative another.
Vectors lie in blocks of neighbours; a block stores its vectors (the forward
index) and the extremes of each term.  The sum of a query's best terms bounds
every score in a block, so blocks are scored from the highest bound down until
the bounds fall below the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.scale import stage

SCALE = 256
BLOCK = 256  # vectors of a block
CENTRES = 64  # around which vectors are put in order
SAMPLE = 4096  # vectors that the centres are fitted on
QUERIES = 4096  # queries answered in one pass over the blocks
SEED_BLOCKS = 64  # blocks that give each query its first k-th score

_BLOCKS = "dims int, ids array<long>, vectors binary, high array<long>, low array<long>"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, v): components as floor(256 x); rows with a null vector, id or component, or a non-finite one, drop out."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~bad)
    return kept.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * SCALE)).alias("v")
    )


def _centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres by width, from a bounded sample: the vectors of the smallest id hashes."""
    some = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"]
    out = {}
    for dims in {len(v) for v in some if len(v)}:
        data = np.array([v for v in some if len(v) == dims], float)
        centres = data[:CENTRES].copy()
        for _ in range(8):
            near = (data @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            for c in np.unique(near):
                centres[c] = data[near == c].mean(0)
        out[dims] = centres
    return out


def build(rows: DataFrame) -> DataFrame:
    """Blocks of vectors near to one another, a stored table; equal rows count once.

    A range partitioning on (width, centre, id) puts a centre of any number of
    vectors in as many partitions as it needs.
    """
    centres = _centres(rows)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), np.int32)
            sizes = batch.map(len).to_numpy()
            for dims in np.unique(sizes):
                if dims in centres:
                    c, at = centres[dims], np.flatnonzero(sizes == dims)
                    out[at] = (np.array([batch.iat[i] for i in at], float) @ c.T - (c**2).sum(1) / 2).argmax(1)
            yield pd.Series(out)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            made = []
            for i, v in zip(batch["vec_id"], batch["v"]):
                if held and (len(held) == BLOCK or len(held[0][1]) != len(v)):
                    made.append(_packed(held))
                    held = []
                if not (held and held[-1][0] == i and np.array_equal(held[-1][1], v)):
                    held.append((i, np.asarray(v, np.int64)))
            if made:
                yield pd.DataFrame(made, columns=[c.split()[0] for c in _BLOCKS.split(", ")])
        if held:
            yield pd.DataFrame([_packed(held)], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    placed = rows.withColumns({"dims": F.size("v"), "centre": nearest("v")})
    keys = ["dims", "centre", "vec_id"]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys, "v")
    return stage(ordered.select("vec_id", "v").mapInPandas(pack, _BLOCKS), "vector-blocks")


def _packed(held: list[tuple[int, np.ndarray]]) -> tuple:
    matrix = np.array([v for _, v in held], np.int64).reshape(len(held), -1)
    return matrix.shape[1], [i for i, _ in held], matrix.tobytes(), matrix.max(0, initial=-(1 << 62)), matrix.min(0, initial=1 << 62)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b.T: in floating point where that is exact, which is faster."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b.T


class Best:
    """The k best (score, smaller id first) of each query so far; scores below ``floor`` are of no use."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray):
        self.query, self.vectors, self.k, self.floor = ids, vectors, k, floor.copy()
        self.score = np.full((len(ids), k), -(1 << 63), np.int64)
        self.id = np.full((len(ids), k), (1 << 63) - 1, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _product(self.vectors[rows], vectors)
        own = ids[None, :] == self.query[rows][:, None]
        scores[own] = -(1 << 63)
        every = np.hstack([self.score[rows], scores])
        named = np.hstack([self.id[rows], np.where(own, (1 << 63) - 1, ids[None, :])])
        order = np.lexsort((named, ~every), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(every, order, 1)
        self.id[rows] = np.take_along_axis(named, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])

    def scan(self, blocks: pd.DataFrame) -> int:
        """Score the blocks, each query's from the highest bound down; returns how many (query, block) it scored."""
        high, low = (np.array([np.asarray(x, np.int64) for x in blocks[c]]) for c in ("high", "low"))
        bounds = _product(np.maximum(self.vectors, 0), high) + _product(np.minimum(self.vectors, 0), low)
        order = np.argsort(-bounds, 1, kind="stable")
        matrices, scored = {}, 0
        alive = np.arange(len(self.query))
        for step in range(len(blocks)):
            at = order[alive, step]
            keep = bounds[alive, at] >= self.floor[alive]
            alive, at = alive[keep], at[keep]
            if not len(alive):
                break
            for b in np.unique(at):
                if b not in matrices:
                    ids = np.asarray(blocks["ids"].iat[b], np.int64)
                    matrices[b] = ids, np.frombuffer(blocks["vectors"].iat[b], np.int64).reshape(len(ids), -1)
                self.add(alive[at == b], *matrices[b])
                scored += int((at == b).sum())
        return scored

    def rows(self) -> pd.DataFrame:
        q, j = np.nonzero((self.id != (1 << 63) - 1) & (self.score >= self.floor[:, None]))
        return pd.DataFrame({"query_id": self.query[q], "vec_id": self.id[q, j], "score": self.score[q, j]})


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of the highest inner product for every query.

    ``rows`` and ``queries`` are (vec_id, v).  Returns (query_id, rank from 1, vec_id, score); ties go to
    the smaller id, and fewer rows than ``k`` give fewer.  A row with the
    query's id is the query itself; only vectors as wide as the query are compared; equal
    rows count once.  Queries are taken in batches of bounded size, each in one
    pass over the blocks, which stay where they are; tasks return what can
    still be among the best.  Scores must fit 64 bits.
    """
    spark = rows.sparkSession
    blocks = build(rows)
    asked = stage(queries.select("vec_id", "v").distinct(), "queries")
    widths = [r["dims"] for r in asked.select(F.size("v").alias("dims")).distinct().collect()]
    answers = None
    for dims in widths:
        mine = blocks.filter(F.col("dims") == dims)
        seeds = mine.orderBy(F.xxhash64("ids")).limit(SEED_BLOCKS).toPandas()
        of_width = asked.filter(F.size("v") == dims)
        parts = max(1, math.ceil(of_width.count() / QUERIES))
        for part in range(parts):
            batch = of_width.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toPandas()
            if not len(batch) or not len(seeds):
                continue
            ids = batch["vec_id"].to_numpy(np.int64)
            vectors = np.array([np.asarray(v, np.int64) for v in batch["v"]]).reshape(len(batch), -1)
            first = Best(ids, vectors, k, np.full(len(ids), -(1 << 63), np.int64))
            first.scan(seeds)
            shared = spark.sparkContext.broadcast((ids, vectors, first.floor))

            def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                best = Best(*shared.value[:2], k, shared.value[2])
                for some in batches:
                    best.scan(some)
                yield best.rows()

            found = stage(mine.mapInPandas(run, "query_id long, vec_id long, score long"), "best")
            shared.unpersist()
            answers = found if answers is None else answers.union(found)
    if answers is None:
        answers = spark.createDataFrame([], "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.distinct().withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
