from __future__ import annotations

import random
import re

import pandas as pd
import pytest

from pagemill.llm import decontaminate as D
from pagemill.llm import queries

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(words, n=5):
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_finds_what_whole_texts_show(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontaminate(spark, SF).collect()}
    for d in docs:
        have, said = grams(plain_words(d.text)), set(plain_words(d.text))
        for i in items:
            want = grams(plain_words(i.text))
            share = len(have & want) / len(want)
            if share >= 0.9:
                assert (d.doc_id, i.item_id) in got
            if share < 0.6:
                assert (d.doc_id, i.item_id) not in got


def test_bounds_lose_nothing(monkeypatch):
    """Retrieval through postings and block bounds equals scoring every passage against every entry."""
    rng = random.Random(1)
    names = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(names, weights=range(60, 0, -1), k=rng.randrange(3, 40))) for _ in range(50)]
    rows = []
    for i, t in enumerate(texts):
        hashes, _, _ = D.W.hashed_words(D.W.codepoints(t))
        terms, counts = D.np.unique(hashes, return_counts=True)
        rows.append((i, 0, len(hashes), terms.view("int64"), counts, terms.view("int64"), terms.view("int64")))
    table = pd.DataFrame(rows, columns=["item_id", "part", "n_words", "terms", "counts", "shingles", "answer_terms"])
    df = {t: sum(t in r for r in table["terms"]) for r in table["terms"] for t in r}
    table["df"] = [[df[t] for t in r] for r in table["terms"]]
    table["first_term"] = [min(r) for r in table["terms"]]
    index = D.Index.build(table, len(table), 20.0, 0.5)
    long = " ".join(rng.choices(names + texts, k=900))
    for block in D.W.overlapping([long, texts[3], "", None, "nothing here"], D.PASSAGE):
        start, end, last = D._passages(block.text)
        assert all(start[p] <= i < end[p] for i, p in enumerate(last))
        want = {}
        for p in range(len(start)):
            have = set(index.numbers(block.hash[start[p] : end[p]]).tolist())
            for e in range(len(index.items)):
                at = slice(index.bounds[e], index.bounds[e + 1])
                s = sum(w for t, w in zip(index.forward[at], index.weights[at]) if t in have)
                if s >= 0.5:
                    want[p, e] = s
        got = {(p, e): s for p, e, s, _, _ in D.search(block, index, 0.5)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_long_items_shards_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(400)) + "? " + " ".join(f"a{i}" for i in range(30)) + "."
    half = item[: len(item) // 2]
    filler = " ".join(f"z{rng.randrange(1000)}" for _ in range(3000))
    docs = spark.createDataFrame(
        [(1, f"{filler} {item} {filler}", 0), (2, f"{filler} {half} {filler}", 0), (3, None, 0), (4, "", 0), (None, item, 0),
         (5, "yes no", 0), (5, "yes no", 0), (6, filler, 0)], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(7, item), (8, item), (9, "Yes, no!"), (10, None), (11, ""), (12, "?!")], "item_id long, text string")
    want = {(1, 7), (1, 8), (None, 7), (None, 8), (5, 9)}
    assert {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()} == want
    monkeypatch.setattr(D, "SHARD_WORDS", 300)
    assert {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()} == want
    kept = D.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert D.find(docs, bench.limit(0)).count() == 0 and D.find(docs.limit(0), bench).count() == 0
    assert D.remove(docs, bench.limit(0)).count() == 8


def test_near_copies_at_the_threshold(spark):
    """Items without a question: every copy with 0.8 or more of the item's shingles counts, and none with less."""
    items = [(r.item_id, plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if "?" not in r.text]
    items.append((1000, [f"n{i}" for i in range(29)]))  # 25 shingles: 20 are exactly 0.8
    copies = []
    for item, words in items:
        copies += [(item, words[:n]) for n in range(len(words) * 7 // 10, len(words))]
        copies += [(item, words[:i] + ["otherword"] + words[i + 1 :]) for i in range(len(words))]
    docs = spark.createDataFrame([(i, "fresh words stand here . " + " ".join(w) + " . and some here") for i, (_, w) in enumerate(copies)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w[:-9]) + ". " + " ".join(w[-9:]) + ".") for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find(docs, bench).collect()}
    wanted = dict(items)
    share = {(i, item): len(grams(w) & grams(wanted[item])) / len(grams(wanted[item])) for i, (item, w) in enumerate(copies)}
    missed = [p for p, x in share.items() if x >= 0.8 and p not in got]
    print(f"{sum(x >= 0.8 for x in share.values())} copies at 0.8 or more, {len(missed)} missed")
    assert any(x == 0.8 for x in share.values())
    assert not missed and not [p for p, x in share.items() if x < 0.8 and p in got]


def test_clashing_columns(spark):
    item = "What is the name of the river that flows through the old town of Prague? The river is called the Vltava by all."
    docs = spark.createDataFrame([(1, f"x {item} y", 7), (2, "a clean text of some words about rivers", 7)], "doc_id long, text string, _text_hash int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = D.remove(docs, bench)
    assert kept.columns == docs.columns and [(r.doc_id, r._text_hash) for r in kept.collect()] == [(2, 7)]
