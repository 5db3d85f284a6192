"""Exact and approximate nearest neighbours within a target.

Distance is squared L2.  Tasks keep the best ``k`` per query while they stream
over their vectors, so neither query-vector pairs nor a whole target are ever
gathered; what is shuffled is ``k`` rows per query and task.  Vectors are never
shuffled, however many queries there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.ivf import OUT_OF_BOUNDS, SAMPLE, Index, assign, build, matrix, needed
from pagemill.operators.scale import number_rows, stage, staging_root, top_per_key
from pagemill.settings import DEFAULT_RESULTS

MAX_BROADCAST_QUERIES = 8192
MAX_BROADCAST_BYTES = 64 << 20
MAX_RESULT_ROWS = 500_000_000
QUERY_BLOCK = 4096
_MAX_LISTED = 1000
_MAX_HELD = 1 << 20  # candidates that wait to be ranked
MOST_WANTED = 0.5  # part of the vectors, from which on all are met


class _Met:
    """Vectors that queries meet, with a column of their squared lengths, so that one product gives distances."""

    def __init__(self, vectors: np.ndarray):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.vectors, self.longest = vectors, norms.max()
        self.extended = np.ascontiguousarray(np.column_stack([vectors, norms]).T)


class _Best:
    """The best ``k`` rows seen so far for a block of queries."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.einsum("ij,ij->i", queries, queries)
        self.extended = np.column_stack([-2.0 * queries, np.ones(len(queries))])
        self.q = np.empty(0, np.int64)
        self.dist = np.empty(0)
        self.ids = np.empty(0, object)
        self.worst = np.full(len(queries), np.inf)

    def add(self, met: _Met, ids: np.ndarray, some: np.ndarray | None = None) -> None:
        """Let all queries, or those numbered in ``some``, meet the vectors."""
        some = np.arange(len(self.queries)) if some is None else some
        n = len(met.vectors)
        slack = 1e-9 * (1.0 + met.longest + self.norms.max())
        found_q, found_d, found_i, held = [], [], [], 0
        step = max(1, (1 << 20) // n)
        for start in range(0, len(some), step):
            rows = some[start : start + step]
            rough = self.extended[rows] @ met.extended  # less the query's own squared length
            bar = self.worst[rows] - self.norms[rows]
            fresh = np.flatnonzero(np.isinf(bar))  # of the others, few vectors come below the bar
            if n > self.k and len(fresh):
                bar[fresh] = np.partition(rough[fresh], self.k - 1, axis=1)[:, self.k - 1]
            # the product is only a sieve: candidates within rounding of the bar are measured exactly,
            # so that equal vectors get equal distances and ties fall to the id
            qi, vi = np.divmod(np.flatnonzero((rough <= bar[:, None] + slack).ravel()), n)
            if held > _MAX_HELD:
                self._keep(*map(np.concatenate, (found_q, found_d, found_i)))
                found_q, found_d, found_i, held = [], [], [], 0
            for at in range(0, len(qi), 1 << 16):
                a, b = rows[qi[at : at + (1 << 16)]], vi[at : at + (1 << 16)]
                dist = np.square(met.vectors[b] - self.queries[a]).sum(axis=1)
                near = dist <= self.worst[a]
                held += int(near.sum())
                found_q.append(a[near])
                found_d.append(dist[near])
                found_i.append(ids[b[near]])
        if held:
            self._keep(*map(np.concatenate, (found_q, found_d, found_i)))

    def _keep(self, q: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Let new rows compete with those held for the same queries; rows of other queries stay untouched."""
        changed = np.zeros(len(self.queries), bool)
        changed[q] = True
        again = changed[self.q]
        q, dist, ids = (np.concatenate([old[again], new]) for old, new in ((self.q, q), (self.dist, dist), (self.ids, ids)))
        by = _in_order(q, dist, ids)
        q, dist, ids = q[by], dist[by], ids[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        inside = place < self.k
        last = place == self.k - 1
        self.worst[q[last]] = dist[last]
        self.q, self.dist, self.ids = (
            np.concatenate([old[~again], new[inside]]) for old, new in ((self.q, q), (self.dist, dist), (self.ids, ids))
        )


def _in_order(q: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by query, distance and id; ids, which are objects, are compared only where distances are equal."""
    by = np.lexsort((dist, q))
    same = (q[by][1:] == q[by][:-1]) & (dist[by][1:] == dist[by][:-1])
    tied = np.r_[same, False] | np.r_[False, same]
    rows = by[tied]
    by[tied] = rows[np.lexsort((ids[rows], dist[rows], q[rows]))] if len(rows) else rows
    return by


def _first_of_equal(vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors those of the ``k`` smallest ids; no others can be among the best ``k`` of a query."""
    whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    _, code, count = np.unique(whole, return_inverse=True, return_counts=True)
    if count.max() <= k:
        return vectors, ids
    crowded = np.flatnonzero(count[code] > k)
    order = crowded[np.lexsort((ids[crowded], code[crowded]))]
    place = np.arange(len(order)) - np.searchsorted(code[order], code[order])
    kept = np.ones(len(vectors), bool)
    kept[order[place >= k]] = False
    return vectors[kept], ids[kept]


def _objects(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _present(by: Sequence[str]) -> tuple[Column, Column]:
    """Whether a row takes part, and its block: the key values and the width, as vectors meet only those of their own width."""
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    present = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound
    for c in by:  # a null key equals nothing
        present = present & F.col(c).isNotNull()
    return present, F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by], F.size("embedding").cast("string")).alias("_block")


def _sound(vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    present, block = _present(by)
    return vectors.filter(present).select(*by, block, "chunk_id", "embedding")


def _asked(queries: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    present, block = _present(by)
    limit = F.coalesce(F.col("n_results"), F.lit(k)) if "n_results" in queries.columns else F.lit(k)
    return queries.filter(present).select(
        "query_id", *by, block, limit.cast("int").alias("n_results"), F.col("embedding").cast("array<double>").alias("_vector")
    )


def _result_type(vectors: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("n_results", T.IntegerType()),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _rows(best: _Best, query_ids: np.ndarray, limits: np.ndarray, arrow: pa.Schema) -> dict:
    return {
        "query_id": pa.array(query_ids[best.q].tolist(), arrow.field("query_id").type),
        "n_results": pa.array(limits[best.q], pa.int32()),
        "chunk_id": pa.array(best.ids.tolist(), arrow.field("chunk_id").type),
        "distance": pa.array(best.dist, pa.float64()),
    }


class _Asked(NamedTuple):
    """Queries of one target and width: ids, own limits, vectors, and the lists each must visit (all, if not told)."""

    ids: np.ndarray
    limits: np.ndarray
    vectors: np.ndarray
    wanted: np.ndarray | None = None
    column: dict[int, int] | None = None  # of a list in ``wanted``


def _grouped(table: pa.Table) -> dict[str, _Asked]:
    blocks = np.array(table.column("_block").to_pylist(), object)
    ids, limits = _objects(table.column("query_id")), table.column("n_results").to_numpy()
    held = table.column("_vector").combine_chunks()
    per_block = {b: np.flatnonzero(blocks == b) for b in set(blocks.tolist())}
    return {b: _Asked(ids[rows], limits[rows], matrix(held.take(pa.array(rows)))) for b, rows in per_block.items()}


def _scan(v: DataFrame, asked: dict[str, _Asked], k: int, schema: T.StructType, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Ship queries to the vectors, which stay where they are; with lists, each meets only the queries that want it."""
    shipped = v.sparkSession.sparkContext.broadcast(asked)
    lists = [set(a.column) for a in asked.values() if a.column is not None]
    wanted = v.filter(F.col("_block").isin(list(asked))) if len(asked) <= _MAX_LISTED else v
    if lists and len(lists) == len(asked) and len(every := set.union(*lists)) <= _MAX_LISTED:
        wanted = wanted.filter(F.col("_list").isin(sorted(every)))
    # every task returns up to k rows per query; on a very wide scan fewer, longer tasks keep that sum in
    # bounds, and merging splits within a task needs no shuffle
    cores = v.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, MAX_RESULT_ROWS // max(1, sum(len(a.ids) for a in asked.values()) * k))
    listed = "_list" if "_list" in v.columns else F.lit(0).alias("_list")
    wanted = wanted.select("_block", listed, "chunk_id", "embedding")
    if wanted.rdd.getNumPartitions() > tasks:
        wanted = wanted.coalesce(tasks)
    arrow = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[np.ndarray, _Best]]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column("_block").dictionary_encode()
            codes, chunk_ids, own = coded.indices.to_numpy(), _objects(batch.column("chunk_id")), batch.column("_list").to_numpy()
            for code, name in enumerate(coded.dictionary.to_pylist()):
                asks = shipped.value.get(name)
                if asks is None:
                    continue
                if name not in best:
                    cuts = [np.arange(a, min(a + query_block, len(asks.ids))) for a in range(0, len(asks.ids), query_block)]
                    best[name] = [(rows, _Best(asks.vectors[rows], k)) for rows in cuts]
                mine = codes == code
                for number in np.unique(own[mine]) if asks.column is not None else [None]:
                    rows = np.flatnonzero(mine if number is None else mine & (own == number))
                    if number is not None and number not in asks.column:
                        continue
                    vectors, ids = _first_of_equal(matrix(batch.column("embedding").take(pa.array(rows))), chunk_ids[rows], k)
                    met = _Met(vectors)
                    for queries, found in best[name]:
                        some = None if number is None else np.flatnonzero(asks.wanted[queries, asks.column[number]])
                        if some is None or len(some):
                            found.add(met, ids, some)
        for name, blocks in best.items():
            asks = shipped.value[name]
            for queries, found in blocks:
                yield pa.RecordBatch.from_pydict(_rows(found, asks.ids[queries], asks.limits[queries], arrow), schema=arrow)

    return wanted.mapInArrow(scan, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _with_lists(asked: dict[str, _Asked], index: Index, k: int, reach: float) -> dict[str, _Asked]:
    """Queries with the lists that they must visit.

    Without bounds, where the driver would read too many, these are all of them; and also where
    most vectors are wanted, which are met in larger numbers at once if their lists are not told apart.
    """
    bounds = index.lists.filter(F.col("_block").isin(list(asked))) if len(asked) <= _MAX_LISTED else index.lists
    if bounds.count() > OUT_OF_BOUNDS:
        return asked
    told = bounds.toPandas()
    out = {}
    for name, rows in told.groupby("_block"):
        if name not in asked:
            continue
        asks, own = asked[name], rows["_list"].to_numpy()
        centres = index.centres.get(asks.vectors.shape[1])
        if centres is not None:
            most = int(np.max(asks.limits, initial=1))
            wanted = needed(asks.vectors, max(1, min(k, most)), centres, own, *[rows[c].to_numpy() for c in ("n", "near", "far")], reach)
            seen = wanted.any(0)
            if reach < 1 or np.average(wanted, weights=np.broadcast_to(rows["n"].to_numpy(), wanted.shape)) < MOST_WANTED:
                asks = asks._replace(wanted=wanted[:, seen], column={int(c): i for i, c in enumerate(own[seen])})
        out[name] = asks
    return out


def _stationary(index: Index, q: DataFrame, k: int, schema: T.StructType, max_queries: int, query_block: int, reach: float) -> DataFrame:
    """Many queries: batch after batch goes to the vectors, which never move.

    Queries are ordered by their own lists, so that a batch wants few of them.
    The vectors of a batch's lists are read once per batch; only the best ``k``
    of each task are written.
    """
    listed = stage(assign(q, index.centres, "_vector").drop("_away"), "query-lists")
    order = ["_block", "_list", "_key"]
    placed = number_rows(listed.withColumn("_key", F.xxhash64("query_id", "_vector")), [], order, "_at")
    whole = placed.withColumn("_batch", F.floor((F.col("_at") - 1) / max_queries)).drop("_list", "_key", "_at")
    whole = stage(whole.repartitionByRange("_batch").sortWithinPartitions("_batch"), "query-batches")
    batches = whole.agg(F.max("_batch")).first()[0]
    spark = q.sparkSession
    if batches is None:
        return spark.createDataFrame([], schema)
    path = f"{staging_root(spark)}/pagemill-stage/nearest-{uuid.uuid4().hex}"
    for batch in range(batches + 1):
        asked = _with_lists(_grouped(whole.filter(F.col("_batch") == batch).toArrow()), index, k, reach)
        _scan(index.rows, asked, k, schema, query_block).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_RESULTS,
    *,
    by: Sequence[str] = ("target",),
    max_queries: int = MAX_BROADCAST_QUERIES,
    query_block: int = QUERY_BLOCK,
    batch: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Nearest vectors per query: (query_id, rank, chunk_id, distance).

    ``vectors(target, chunk_id, embedding)``, ``queries(query_id, target,
    embedding[, n_results])``.  A query's own ``n_results`` overrides ``k``.
    Ties are ranked by ``chunk_id``.  Rows with a null key, without an embedding, or
    with a null, NaN or infinite component take no part; a query meets vectors of its own width only.

    Up to ``max_queries`` queries of bounded size are searched at once.  More
    are searched in batches over an inverted file of the vectors, which are
    written once and never shuffled; the bounds of its lists lose nothing.
    """
    v, q = _sound(vectors, by), _asked(queries, by, k)
    schema = _result_type(vectors, queries)
    count, most, width = _measure(q, k)
    if count <= max_queries and width <= MAX_BROADCAST_BYTES:
        table = q.toArrow()
        for c in by:  # partitions of other keys are not read
            values = table.column(c).unique().to_pylist()
            if len(values) <= _MAX_LISTED:
                v = v.filter(F.col(c).isin(values))
        found = _scan(v, _grouped(table), most, schema, query_block)
    else:
        found = _stationary(build(v), q, most, schema, _batch_size(count, width, batch), query_block, 1.0)
    return _ranked(found, most)


def _measure(q: DataFrame, k: int) -> tuple[int, int, int]:
    count, most, width = q.agg(
        F.count(F.lit(1)), F.coalesce(F.max("n_results"), F.lit(k)), F.coalesce(F.sum(F.size("_vector") * 8), F.lit(0))
    ).first()
    return count, max(int(most), 1), width


def _batch_size(count: int, width: int, batch: int) -> int:
    """Queries of a batch: ``batch``, or as many as the bound on bytes allows of the average width."""
    return max(1, min(batch, MAX_BROADCAST_BYTES * max(1, count) // max(1, width)))


def _ranked(found: DataFrame, most: int) -> DataFrame:
    ranked = top_per_key(found, ["query_id"], ["distance", "chunk_id"], most)
    return ranked.filter(F.col("rank") <= F.col("n_results")).select("query_id", "rank", "chunk_id", "distance")


def index(vectors: DataFrame, *, by: Sequence[str] = ("target",), sample: int = SAMPLE) -> Index:
    """Inverted file of ``vectors(target, chunk_id, embedding)``, to be searched by ``knn_approx``."""
    return build(_sound(vectors, by), sample=sample)


def knn_approx(
    stored: Index, queries: DataFrame, k: int = DEFAULT_RESULTS, *, by: Sequence[str] = ("target",), reach: float = 1.0,
    query_block: int = QUERY_BLOCK, batch: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Neighbours by the index: lists are visited until no other can hold a vector nearer than ``reach`` times the k-th.

    With ``reach`` 1 that is proved, and the result exact; with less, fewer lists are visited and
    some neighbours may be missed.  A query always has its ``k`` rows where the target has them.
    """
    q = _asked(queries, by, k)
    schema = _result_type(stored.rows, queries)
    count, most, width = _measure(q, k)
    return _ranked(_stationary(stored, q, most, schema, _batch_size(count, width, batch), query_block, reach), most)
