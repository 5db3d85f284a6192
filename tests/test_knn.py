from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import vectors
from pagemill.operators import encode, ivf, knn


def made(spark, n: int, nq: int, dim: int = 8, seed: int = 0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype(np.float32)
    v[: n // 3] = v[0]  # a third of all vectors are copies
    q = np.vstack([v[: nq // 2], rng.standard_normal((nq - nq // 2, dim)).astype(np.float32)])
    targets = np.where(rng.random(n) < 0.6, "hot", "cold")
    rows = [(str(targets[i]), f"c{i:05d}", v[i].tolist()) for i in range(n)]
    asked = [(i, ("hot", "cold", "none")[i % 3], q[i].tolist(), 1 + i % 7) for i in range(nq)]
    stored = spark.createDataFrame(rows, "target string, chunk_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, target string, embedding array<float>, n_results int")
    want = []
    for qid, target, vec, k in asked:
        near = sorted(
            (float(np.square(v[i].astype(float) - np.array(vec)).sum()), f"c{i:05d}") for i in range(n) if targets[i] == target
        )
        want += [(qid, r + 1, cid, round(d, 9)) for r, (d, cid) in enumerate(near[:k])]
    return stored, queries, want


@pytest.mark.parametrize("options", [{}, {"query_block": 7}, {"max_queries": 0, "query_block": 7, "batch": 11}, {"max_queries": 0}])
def test_exact_search_matches_brute_force(spark, options):
    stored, queries, want = made(spark, 900, 40)
    got = knn.knn(stored, queries, **options).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id, round(r.distance, 9)) for r in got) == sorted(want)


def test_wide_scans_run_in_fewer_tasks(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_RESULT_ROWS", 1)
    stored, queries, want = made(spark, 300, 10)
    found = knn.knn(stored.repartition(40), queries)
    assert "Coalesce 8" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in found.collect()) == sorted(w[:3] for w in want)


def test_fewer_vectors_than_asked_and_bad_rows(spark):
    stored = spark.createDataFrame([("t", "a", [0.0, 1.0]), ("t", "b", [1.0, 0.0]), ("t", "n", None)], "target string, chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, "t", [0.0, 0.9]), (2, "t", None), (3, "x", [1.0, 1.0])], "query_id int, target string, embedding array<float>")
    assert [(r.query_id, r.rank, r.chunk_id) for r in knn.knn(stored, queries, 5).orderBy("rank").collect()] == [(1, 1, "a"), (1, 2, "b")]


def test_index_search_is_exact_at_full_reach(spark):
    stored, queries, want = made(spark, 900, 40)
    for options in ({}, {"query_block": 5, "batch": 13}):
        got = knn.knn_approx(knn.index(stored, sample=200), queries, **options).collect()
        assert sorted((r.query_id, r.rank, r.chunk_id, round(r.distance, 9)) for r in got) == sorted(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_a_shorter_reach(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    stored = rows.select(F.lit("all").alias("target"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.lit("all").alias("target"), "embedding")
    vectors = {r.chunk_id: np.array(r.embedding, float) for r in stored.collect()}
    ids = np.array(sorted(vectors))
    every = np.stack([vectors[i] for i in ids])
    recall = {}
    for reach in (1.0, 0.6, 0.0):
        got = {}
        for r in knn.knn_approx(knn.index(stored), asked, 10, reach=reach).collect():
            got.setdefault(str(r.query_id), set()).add(r.chunk_id)
        assert all(len(hits) == 10 for hits in got.values()) and len(got) == len(ids)
        met = []
        for i, v in vectors.items():
            d = np.square(every - v).sum(1)
            met.append(len(got[i] & set(ids[np.lexsort((ids, d))[:10]].tolist())) / 10)
        recall[reach] = np.mean(met)
    print("recall by reach", sf, recall)
    assert recall[1.0] == 1.0 and recall[0.6] >= 0.9


def test_lists_needed_lose_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 3)) * 5
    points = np.concatenate([c + rng.normal(size=(rng.integers(1, 40), 3)) for c in centres])
    own, away = ivf.nearest(points, centres)
    lists = np.unique(own)
    n = np.array([(own == c).sum() for c in lists])
    near, far = (np.array([f(away[own == c]) for c in lists]) for f in (np.min, np.max))
    queries = rng.normal(size=(60, 3)) * 6
    for k in (1, 5, 50, 10_000):
        wanted = ivf.needed(queries, k, centres, lists, n, near, far)
        for q, row in zip(queries, wanted):
            best = np.argsort(np.square(points - q).sum(1), kind="stable")[:k]
            assert set(own[best]) <= set(lists[row])
        assert k > 5 or wanted.mean() < 0.9


def test_vectors_are_not_shuffled(spark, tmp_path):
    stored, queries, _ = made(spark, 300, 30)
    stored.write.partitionBy("target").parquet(str(tmp_path / "v"))
    kept = spark.read.parquet(str(tmp_path / "v"))
    index = knn.index(kept)
    assert sorted(index.rows.columns) == sorted(["target", "_block", "chunk_id", "embedding", "_list"])
    assigned = ivf.assign(knn._sound(kept, ["target"]), index.centres).sortWithinPartitions("_list")
    asks = knn._with_lists(knn._grouped(knn._asked(queries, ["target"], 5).toArrow()), index, 5, 1.0)
    scanned = knn._scan(index.rows, asks, 5, knn._result_type(kept, queries))
    for plan in (assigned, scanned):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    pruned = knn.knn(kept, queries.filter("target = 'cold'"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [target" in pruned or "target#" in pruned.split("PartitionFilters:")[1][:60]


def test_encoder_and_vector_functions(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "a b a")], "i int, document string")
    got = {r.i: np.array(r.embedding) for r in encode.embed(df, encode.hashing_encoder(16)).collect()}
    assert np.allclose(np.linalg.norm(got[1]), 1) and not got[2].any() and not got[3].any() and (got[1] == got[4]).all()
    pair = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = pair.select(
        vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("b")).alias("z"), vectors.squared_l2(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert row.u == [0.6, 0.8] and row.z == [0.0, 0.0] and row.d == 25.0


def test_keys_widths_and_components_that_take_no_part(spark):
    vectors = [("a", "1", [1.0, 0.0]), ("a", "2", [1.0, 0.0, 5.0]), ("a", "3", [7.0]), (None, "4", [1.0, 0.0]), ("a", "5", [1.0, None]),
               ("a", "6", [float("nan"), 0.0]), ("a", "10", [float("inf"), 0.0]), ("a", "11", [0.0, float("-inf")]), ("a", "7", []), ("a", "8", None), ("a", "9", [0.0, 0.0])]
    queries = [(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "a", [7.0]), (4, "a", [None, 1.0]), (5, "a", [float("inf"), 1.0])]
    v = spark.createDataFrame(vectors, "target string, chunk_id string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id int, target string, embedding array<double>")
    for bound in (100, 0):  # scanned, and paired in blocks
        got = [tuple(r) for r in knn.knn(v, q, 3, max_queries=bound).orderBy("query_id", "rank").collect()]
        assert got == [(1, 1, "1", 0.0), (1, 2, "9", 1.0), (3, 1, "3", 0.0)]
    for rows, asked in ((v.limit(0), q), (v, q.limit(0)), (v.limit(0), q.limit(0))):
        assert knn.knn(rows, asked, 3, max_queries=0).count() == knn.knn(rows, asked, 3).count() == 0


def test_ids_are_compared_only_among_equal_distances_and_full_queries_meet_no_partition(monkeypatch):
    import numpy as np

    from pagemill.operators import knn as module

    rng = np.random.default_rng(3)
    points = rng.integers(-2, 3, (900, 4)).astype(float)
    ids = np.array([f"v{i}" for i in rng.permutation(900)], object)
    asked = np.vstack([points[:40], rng.normal(size=(20, 4))])
    best, partitions = module._Best(asked, 5), []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **o: partitions.append(len(a[0])) or partition(*a, **o))
    for at in range(0, 900, 100):
        best.add(module._Met(points[at : at + 100]), ids[at : at + 100])
    best.add(module._Met(points[:3]), np.array(["z0", "z1", "z2"], object), np.array([7]))
    assert partitions == [60]
    for q, vector in enumerate(asked):
        every = sorted(zip(np.square(points - vector).sum(1), ids))
        more = [(d, n) for d, n in zip(np.square(points[:3] - vector).sum(1), ("z0", "z1", "z2")) if q == 7]
        got = sorted(zip(best.dist[best.q == q], best.ids[best.q == q]))
        assert [tuple(x) for x in got] == [tuple(x) for x in sorted(every + more)[:5]]


def test_equal_vectors_leave_few_candidates(monkeypatch):
    import numpy as np

    from pagemill.operators import knn as module

    points = np.repeat(np.array([[0.0, 1.0], [2.0, 3.0], [9.0, 9.0]]), [700, 3, 300], axis=0)
    ids = np.array([f"v{i % 997:03}" for i in range(1003)], object)
    vectors, names = module._first_of_equal(points, ids, 4)
    assert len(vectors) == 4 + 3 + 4 and sorted(names[:4]) == ["v000", "v001", "v002", "v003"]
    ranked = []
    keep = module._Best._keep
    monkeypatch.setattr(module._Best, "_keep", lambda self, q, d, i: ranked.append(len(q)) or keep(self, q, d, i))
    monkeypatch.setattr(module, "_MAX_HELD", 10_000)
    best = module._Best(np.zeros((3000, 2)), 4)
    best.add(module._Met(points), ids)
    assert max(ranked) < 1_500_000 and len(ranked) > 1 and sorted(best.ids[best.q == 2999].tolist()) == ["v000", "v001", "v002", "v003"]
