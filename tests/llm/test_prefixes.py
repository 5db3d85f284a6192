from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm import prefixes
from tests.oracle_check import differences, oracle

SCHEMA = "conv_id long, turn long, role string, text string, depth string, at string, h int, a string"


def plain(rows):
    """The trie from rebuilt conversations as lists of turns."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        value = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += value
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    got = prefixes.trie(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def made(seed, ids, most, words=("", "hi", "a b", "a\tb \n c", "ü", None)):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randrange(1, most)):
            turn = rng.choice([t, t, t, None, 0, -t])
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(words), "x", None, 1, ""))
    return rows


def test_against_lists(spark):
    rows = made(1, [*range(0, 90), -1, -20, -27, 20_000, 20_019, 10**15 + 7], 7) + [(None, 0, "user", "lost", "", "", 0, "")]
    rows += rows[:9]
    want = plain(rows)
    assert found(spark, rows) == want and any(n > 5 and d > 2 for _, d, _, n, *_ in want)


def test_absent_bases_and_turnless(spark):
    # conversations without a base, shorter than their head, and single turns with nulls in every column
    rows = [(c, None, None, None, None, None, None, None) for c in range(21, 60)] + [(c, 1, "u", "same words here", "", "", 1, "") for c in range(61, 99)]
    want = plain(rows)
    assert found(spark, rows) == want and any(d == 0 and s != hashlib.sha256(b"").hexdigest() for _, d, *_, s in want)


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BITS", 3)
    rng = random.Random(5)
    long = [(rng.choice(["u", "b"]), rng.choice(["yes", "no no"])) for _ in range(70)]
    rows = [(c, t, *long[t], "", "", 0, "") for c in range(40, 60) for t in range(70 if c % 3 else 33)]
    rows += [(c, t, "u", "the same", "", "", 0, "") for c in range(1000, 1120) for t in range(2)]
    assert found(spark, rows) == plain(rows)


def test_colliding_hashes_are_noticed(spark, monkeypatch):
    real = prefixes._hashes

    def weak(seed):
        if seed:
            return real(seed)
        return [prefixes.F.xxhash64(prefixes.F.length("text")).alias(f"h{i}") for i in (1, 2)]

    monkeypatch.setattr(prefixes, "_hashes", weak)
    rows = made(7, range(40), 5, ("aa", "bb", "c d", "e"))
    assert prefixes._colliding(spark.createDataFrame(rows, SCHEMA), 0) and not prefixes._colliding(spark.createDataFrame(rows, SCHEMA), 1)
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "x", "", "", 0, "")]) == []


def test_powers():
    exponents = np.array([0, 1, 2, 5, 63, 10**9])
    for p in prefixes.PRIMES:
        assert prefixes.powers(123456, p, exponents).tolist() == [pow(123456, int(e), p) for e in exponents]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_against_sql(spark, sf):
    assert differences(spark, oracle(f"/root/testdata/{sf}"), "op12_prefix_trie", f"/root/testdata/{sf}") == []
