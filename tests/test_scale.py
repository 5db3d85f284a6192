from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import scale


def test_numbering_spans_partitions(spark):
    rng = random.Random(1)
    # one group holds most rows
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", i) for i in rng.sample(range(10**6), 5000)]
    df = spark.createDataFrame(rows, "g string, o long").repartition(13)
    placed = scale.number_rows(df, ["g"], ["o"], "n")
    expect: dict = {}
    counters: dict = {}
    for g, o in sorted(rows):
        counters[g] = counters.get(g, 0) + 1
        expect[(g, o)] = counters[g]
    assert {(r.g, r.o): r.n for r in placed.collect()} == expect


def test_salted_join_equals_broadcast_join(spark):
    facts = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id"
    )
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = scale.join_dimension(facts, dim, ["k"], how)
        large = scale.join_dimension(facts, dim, ["k"], how, max_rows=0)
        assert small.columns == large.columns
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str), how


def test_heavy_keys_are_spread_in_proportion(spark):
    rows = [("hot", i) for i in range(4000)] + [(None, i) for i in range(2000)] + [(f"k{i}", i) for i in range(6000)]
    facts = spark.createDataFrame(rows, "k string, n long").withColumn("_salt", F.lit("own"))
    heavy = scale.heavy_keys(facts, ["k"])
    assert set(heavy) == {'{"k0":"hot"}', "{}"} and 80 <= heavy['{"k0":"hot"}'] <= 90 and 40 <= heavy["{}"] <= 46
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("hot", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = scale.join_dimension(facts, dim, ["k"], how, max_rows=0)
        want = facts.join(dim, ["k"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = scale.join_dimension(facts, dim.hint("merge"), ["k"], "inner", max_rows=0).filter("v = 1").groupBy(F.spark_partition_id().alias("p")).count()
        counts = [r["count"] for r in parts.collect()]
        assert len(counts) == 8 and max(counts) < 4000 / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # keys of two types, and without a heavy one
    whole = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1)], "k int, n long")
    other = spark.createDataFrame([(1, "x"), (2, "y"), (3_000_000_000, "z")], "k long, v string")
    assert scale.join_dimension(whole, other, ["k"], max_rows=0).count() == 501
    assert scale.heavy_keys(spark.range(5000).withColumnRenamed("id", "k"), ["k"]) == {} == scale.heavy_keys(whole.limit(0), ["k"])


def test_dedupe_last_and_compute_once(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    got = sorted(map(tuple, scale.dedupe_last(df, ["k"], ["o"]).collect()))
    assert got == [("a", 3, "z"), ("b", 1, None)]
    once = scale.compute_once(df, "u", F.upper("v")).filter("u <> 'X'")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert sorted(r.u for r in once.collect()) == ["Y", "Z"]


def test_stage_uses_the_shared_folder(spark):
    staged = scale.stage(spark.range(5), "unit")
    root = scale.staging_root(spark)
    assert all(f.startswith(root if "://" in root or root.startswith("file:") else "file:") for f in staged.inputFiles())
    assert staged.count() == 5 and scale.stage(spark.range(0), "none").count() == 0


def test_keep_last_keeps_one_row_per_key(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), ("b", 1, "x"), ("b", 1, "x"), ("c", None, None), (None, 1, "n")]
    df = scale.stage(spark.createDataFrame(rows, "k string, o int, v string"), "unit")
    got = sorted(map(tuple, scale.keep_last(df.filter("k is not null"), ["k"], ["o"]).collect()))
    assert [r[0] for r in got] == ["a", "b", "c"] and got[0][1] == 1 and got[1:] == [("b", 1, "x"), ("c", None, None)]
    assert sorted(map(tuple, scale.keep_last(df.filter("k is not null"), ["k"], ["o"]).collect())) == got


def test_null_keys_are_one_key_and_names_may_clash(spark):
    rows = [(None, 1, "a", 1), (None, 2, "b", 1), (None, 2, "b", 1), (None, 2, "c", 1), ("k", 1, "x", 1)]
    df = spark.createDataFrame(rows, "k string, o int, v string, _key int").withColumnsRenamed({"_key": "_hash"}).withColumn("_last", F.lit(1))
    got = [sorted(map(str, scale.dedupe_last(df.repartition(n), ["k"], ["o"]).collect())) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 2 and "o=2" in got[0][1] + got[0][0]
    assert scale.unused(df, "_HASH") == "_HASH_"


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scale.staging_root(Session)
