from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return {(ids[i], min(ids[j] for j in range(len(fps)) if find(j) == find(i))) for i in range(len(fps))}


def test_fingerprints_of_odd_texts():
    for text in [None, "", "  \n", "A", "one Two", "É one\x0btwo three", "a b c a b c a b c", "x " * 200_000, " a b c"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_across_runs(monkeypatch):
    text = " ".join(str(i) for i in range(5000))
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == plain_components(fps, [r.doc_id for r in rows], 2)
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == {(r.doc_id, f) for r, f in zip(rows, fps)}


def test_links_connect_crowds_and_loners(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:30]]
    for _ in range(400):  # a crowd that fills its cells
        values.append(values[0] ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(set(values))
    table = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for bits in (0, 1, 2):
        pairs = [(a % 2**64, b % 2**64) for a, b in simhash.links(table, bits).collect()]
        assert all((a ^ b).bit_count() <= bits for a, b in pairs)
        near = {v: {v} for v in values}
        for a, b in pairs:
            joined = near[a] | near[b]
            for v in joined:
                near[v] = joined
        assert {(v, min(near[v])) for v in values} == plain_components(values, values, bits)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b c d", "z"), (9, "a b c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 9), (1, 1), (2, 1), (2, 1), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    other = "quite another text with words of its own that nothing here resembles at all"
    base = "one two three four five six seven eight nine ten"
    rows = [(5, base), (3, base.upper()), (5, other), (7, other), (5, "third text here, with nothing in common with those before it"),
            (None, base), (None, "nobody named this text, which nevertheless is a text like others"), (None, "nobody named this text, which nevertheless is a text like others"),
            (9, None), (4, ""), (4, ""), (11, "written twice in full, and so twice the same row of the table"), (11, "written twice in full, and so twice the same row of the table")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, fingerprint int, _fp int, _k1 int, `_stays` int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([
        (3, base.upper()), (5, other), (5, rows[4][1]), (-1, rows[6][1]), (4, ""), (11, rows[11][1])])
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_no_side_that_an_explode_repeats_is_broadcast(spark):
    distinct = spark.range(1000).select(F.xxhash64("id").alias("fp"))
    for bits in (0, 2):
        plan = simhash.links(distinct, bits)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [cell" in plan and "SortMergeJoin [value" in plan
        # all that is broadcast is the stored list of crowded cells
        assert plan.count("BroadcastHashJoin") == plan.count("LeftAnti") + plan.count("LeftSemi")
