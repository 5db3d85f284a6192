from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers as public

from pagemill.llm import bpe, queries, token_counts as C

PATH = public.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(bpe.rules(PATH))
PIECES = ["word", " the", "  ", "\n\n", "'s", "'", "é", "12", "!?", " ", "don't", "\t", "日本", "aaaa"]


def plain(text, edits):
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def check(text, tree):
    n = len(CODEC.encode([text])[0])
    assert tree.total == n == tree.tokens.sum() and tree.chars.sum() == len(text)
    at = 0
    for k in range(len(tree.chars)):
        assert tree.prefix(k) == len(CODEC.encode([text[:at]])[0]) if k % 5 == 0 else True
        piece = text[at : at + tree.chars[k]]
        assert len(CODEC.encode([piece])[0]) == tree.tokens[k]
        at += tree.chars[k]


def test_random_edits_equal_encoding_anew(monkeypatch):
    monkeypatch.setattr(C, "LEAF", 3)
    rng = random.Random(11)
    for _ in range(150):
        text = "".join(rng.choices(PIECES, k=rng.randrange(0, 60)))
        tree = C.grow(CODEC, [text])[0]
        for _ in range(3):  # edits upon edits
            places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(1, 5))))
            places = places[: len(places) // 2 * 2]
            edits = [(a, b, "".join(rng.choices(PIECES, k=rng.randrange(3)))) for a, b in zip(places[::2], places[1::2])]
            want = plain(text, edits)
            text, tree, _ = C.edit(CODEC, text, tree, [dict(zip(("start", "end", "text"), e)) for e in edits])
            assert text == want
            check(text, tree)


def test_small_edit_reads_little():
    text = "Some words of a text, one after another. " * 5000
    tree = C.grow(CODEC, [text])[0]
    new, after, read = C.edit(CODEC, text, tree, [{"start": 100_000, "end": 100_004, "text": "12"}])
    assert read < 2000 and after.total == len(CODEC.encode([new])[0]) and tree.total == len(CODEC.encode([text])[0])
    grown = C.edit(CODEC, "a", C.grow(CODEC, ["a"])[0], [{"start": 1, "end": 1, "text": " b c" * 9000}])
    assert len(grown[1].chars) > 100 and grown[1].total == 18001
    joined = C.edit(CODEC, "a " * 5000, C.grow(CODEC, ["a " * 5000])[0], [{"start": 3, "end": 9_000, "text": ""}])
    assert joined[1].total == len(CODEC.encode([joined[0]])[0])


def test_odd_edits(spark):
    rows = [(1, None, [(0, 0, "new")]), (2, "abc", None), (3, "abc", []), (4, "abc def", [(-5, 2, "X"), (1, 3, None), (90, 99, "!"), (None, None, "_")]), (4, "", [(0, 5, "")])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits array<{C.EDIT}>").withColumn("sums", C.F.lit("x"))
    got = C.apply_edits(C.count(docs, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "new"), (2, "abc"), (3, "abc"), (4, ""), (4, "X_ def!")]
    assert all(r.sums[1] == len(CODEC.encode([r.text])[0]) for r in got)
    assert C.apply_edits(C.count(docs.limit(0), PATH), PATH).count() == 0
    table = spark.createDataFrame([(2, 1, 2, "b"), (2, 0, 1, "a")], "doc_id long, start long, end long, text string")
    assert [[tuple(e) for e in r.edits] for r in C.listed(table).collect()] == [[(0, 1, "a"), (1, 2, "b")]]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys() and sum(r.n_edits > 0 for r in got.values()) > 10
    for i, t in texts.items():
        edits = [(m.start(), m.end(), queries.CLEANING[m.lastindex - 1][1]) for m in re.finditer("|".join(f"({p})" for p, _ in queries.CLEANING), t)]
        new = plain(t, edits)
        assert (got[i].n_edits, got[i].n_tokens, got[i].n_tokens_edited) == (len(edits), len(CODEC.encode([t])[0]), len(CODEC.encode([new])[0]))
        assert got[i].n_chars_edited == len(new)


def test_rules_that_match_only_whole_or_empty_texts(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "a1 b22 @x"), (5, "zz")], "doc_id long, text string")
    rules = [(r"\A\Z", "none"), (r"\d+", "0"), (r"[@\d]", "!")]
    got = docs.select("doc_id", C.replacements(C.F.col("text"), rules).alias("edits")).collect()
    assert {r.doc_id: [tuple(e) for e in r.edits] for r in got} == {
        1: [], 2: [(0, 0, "none")], 3: [(0, 0, "none")], 4: [(1, 2, "0"), (4, 6, "0"), (7, 8, "!")], 5: [],
    }
