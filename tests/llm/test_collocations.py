from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import collocations, queries
from pagemill.llm import quotient as Q
from tests.oracle_check import differences, oracle

SCHEMA = "doc_id long, text string, lang string, words string, hash long"


def plain(rows, least, longest=5, share=100, first=2000):
    """The same phrases by counting tuples of words."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = {}
    for _, text, lang, *_ in rows:
        of = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            of.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(a for g, a in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    around[g[i : i + k]] = max(around[g[i : i + k]], a)
        scored = []
        for g, a in candidates.items():
            if 100 * around[g] >= share * a and around[g]:
                continue
            score, _, l, r = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r, n))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r, n) in enumerate(scored[:first])]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "of", "ÄRA", "é", "a-b", "x y", "\x00", "日本", "q" * 40]
    passage = "the of a-b é of"
    rows = []
    for i in range(n):
        parts = [rng.choice(words + [passage, "w%d" % rng.randrange(60)]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "! ?"]) for _ in range(rng.randrange(40))]
        rows.append((i % 50, "".join(parts), rng.choice([None, "und", "de", "en", "en", "en"]), "x", 1))
    return rows + [(1, None, "en", None, None), (None, "", None, "", 0), (2, " . ", "fr", "", 0), (3, passage.upper() * 1, "xx", "", 0)]


@pytest.mark.parametrize("dictionary", [collocations.DICTIONARY, 0, 20])
def test_against_plain_counts(spark, dictionary):
    rows = made(1)
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), least=4, dictionary=dictionary)
    want = plain(rows, 4)
    assert sorted(map(tuple, got.collect())) == want and len({x[0] for x in want}) >= 3 and any(x[2].count(" ") == 4 for x in want)


def test_first_rows_shares_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 64)
    monkeypatch.setattr(collocations, "CHUNK", 7)
    monkeypatch.setattr(collocations, "BLOCK", 50)
    rng = random.Random(3)
    rows = [(0, " ".join(rng.choice(["a", "bb", "c" * 200, "d."]) for _ in range(4000)), "en", "", 0), (1, "e f " * 9, "en", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    # settings of the driver reach its tasks in the functions that tokenise only if they run in this process: compare those directly
    column = collocations.pa.array([r[1] for r in rows])
    data, heads = collocations._bytes(column)
    found = list(collocations._tokens(data, heads, np.zeros(2, np.uint64), 0))
    assert len(found) > 10 and [bytes(data[a:b]).decode() for t in found for a, b in zip(t.start, t.end)] == re.findall(r"[^ .]+", " ".join(r[1] for r in rows))
    whole = np.concatenate([t.fresh for t in found])
    want = [i == 0 for text in [r[1] for r in rows] for piece in text.split(".") for i, _ in enumerate(piece.split())]
    assert whole.tolist() == want
    for share, first in ((100, 5), (50, 2000)):
        got = collocations.mine(docs, least=3, longest=4, share=share, first=first)
        assert sorted(map(tuple, got.collect())) == plain(rows, 3, 4, share, first)


def test_hot_phrase_over_many_partitions(spark):
    rows = [(i, "new york city is big. " * 3 + f"u{i} v{i}", "en", "", 0) for i in range(300)]
    got = collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(16), least=100).collect()
    assert sorted(map(tuple, got)) == plain(rows, 100) and got[0].a == 900 and got[0].phrase == "new york city is big"


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for docs in (empty, spark.createDataFrame([(1, None, None, "", 0), (2, "one two", "en", "", 0)], SCHEMA)):
        got = collocations.mine(docs)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**14, 10**16, 10**14, 3 * 10**14)], "a long, n long, l long, r long")
    score = big.select(collocations._exact_score(*[collocations.F.col(c) for c in ("a", "n", "l", "r")]).alias("s")).first().s
    assert score == 1000 * 10**14 * 10**16 // (10**14 * 3 * 10**14)


@pytest.mark.parametrize("bits", [1, 7, 13, 21, 32, 47, 64])
@pytest.mark.parametrize("k", [2, 3, 5])
def test_filters_lose_nothing(bits, k):
    rng = np.random.default_rng(bits * k)
    high = rng.integers(0, 2, (k, 2000)).astype(np.uint64) << np.uint64(bits - 1)
    ids = list(rng.integers(0, min(1 << bits, 20), (k, 2000)).astype(np.uint64) | high)
    mixed = Q.permuted(ids, bits)
    assert all((a == b).all() for a, b in zip(Q.restored(mixed, bits), ids))
    counts = Q.counted(Q.packed(mixed, bits))
    told = Q.restored(Q.unpacked(counts.limbs, k, bits), bits)
    want = Counter(zip(*[x.tolist() for x in ids]))
    assert dict(zip(zip(*[x.tolist() for x in told]), counts.n.tolist())) == want
    assert (np.lexsort(counts.limbs.T[::-1]) == np.arange(len(counts.n))).all()
    for top in (0, min(4, k * bits)):
        place, parts = Q.ranges(counts, top), []
        for g in np.unique(place):
            mine = Q.Counts(counts.limbs[place == g], counts.n[place == g] * 40)
            data = Q.to_bytes(mine, k * bits, top, int(g))
            again = Q.from_bytes(data)
            assert (again.limbs == mine.limbs).all() and (again.n == mine.n).all()
            parts.append(again)
        whole = Q.merged([*parts, counts])
        assert (whole.limbs == counts.limbs).all() and (whole.n == 41 * counts.n).all()


def test_equal_first_limbs():
    limbs = np.array([[5, 9], [5, 1], [2, 2], [5, 9], [5, 1], [7, 0]], np.uint64)
    found = Q.counted(limbs)
    assert found.limbs.tolist() == [[2, 2], [5, 1], [5, 9], [7, 0]] and found.n.tolist() == [1, 2, 2, 1]
    found = Q.merged([found, found])
    assert found.limbs.tolist() == [[2, 2], [5, 1], [5, 9], [7, 0]] and found.n.tolist() == [2, 4, 4, 2]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(spark, oracle(sf), "op13_collocations", sf) == []
    assert "op13_collocations" in queries.oracle_sql()
