from __future__ import annotations

import math
import random

import numpy as np

from pagemill.llm import topk


def plain(rows, asked, k):
    def q(v):
        return [math.floor(256 * x) for x in v]

    good = {(i, tuple(q(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v in good:
        if asked(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


def run(spark, rows, k, asked="vec_id % 3 = 0"):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", topk.F.lit(1))
    v = topk.quantised(table)
    return [tuple(r) for r in topk.search(v, v.filter(asked), k).collect()]


def test_against_all_pairs_with_ties_and_batches(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 6) for i in range(80)] + rows[:20]
    want = plain(rows, lambda i: i % 3 == 0, 5)
    assert (got := run(spark, rows, 5)) and set(got) == want and len(got) == len(want)
    monkeypatch.setattr(topk, "QUERIES", 17)
    monkeypatch.setattr(topk, "SEED_BLOCKS", 1)
    monkeypatch.setattr(topk, "BLOCK", 8)
    assert set(run(spark, rows, 5)) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (3, None), (6, [1.0, None]), (9, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (1, [-3.0, 0.1]), (2, [4.0]), (15, [5.0]), (18, []), (19, []), (4, [1e6, -1e6]), (21, [1e6, 1.0])]
    assert set(run(spark, rows, 5)) == plain(rows, lambda i: i % 3 == 0, 5)
    assert run(spark, rows[:1], 5) == [] and run(spark, rows[1:3], 5) == []


def test_blocks_are_skipped():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 200
    blocks, every = [], []
    for c, centre in enumerate(centres):
        held = [(c * 100 + i, (centre + rng.normal(size=16) * 5).astype(np.int64)) for i in range(50)]
        every += held
        blocks.append(topk._packed(held))
    table = topk.pd.DataFrame(blocks, columns=["dims", "ids", "vectors", "high", "low"])
    ids, vectors = np.array([i for i, _ in every[::25]]), np.array([v for _, v in every[::25]])
    best = topk.Best(ids, vectors, 5, np.full(len(ids), -(1 << 63)))
    assert best.scan(table) < 0.2 * len(ids) * len(blocks)
    got = {(r.query_id, r.vec_id, r.score) for r in best.rows().itertuples()}
    for i, v in zip(ids, vectors):
        scores = sorted((-int(v @ w), j) for j, w in every if j != i)[:5]
        assert {(i, j, -s) for s, j in scores} <= got
