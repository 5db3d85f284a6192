from __future__ import annotations

import zlib

import pytest

from pagemill.llm import langid, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def answers(spark):
    return queries.op4_language_id(spark, SF).collect()


def test_held_out_accuracy(spark, answers):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in answers} == set(truth) and len(answers) == len(truth)
    for r in answers:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in answers if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_backoff_to_shorter_grams():
    import numpy as np

    table = np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.8, 0.2], [0.3, 0.7]], np.float32))
    model = langid.Model(["a", "b"], {"known": 0}, {"xyz>": 1, "x": 2, "q": 3}, table)
    scorer = langid.Scorer(model)
    assert scorer("known")[0] == "a" and scorer("qxyz")[0] == "b" and scorer("mx")[0] == "a" and scorer("Q")[0] == "b"
    assert scorer("known")[1] == pytest.approx(0.9)
    assert scorer(None) == scorer("12 !") == ("und", 0.0)
    assert scorer("ww") == ("a", 0.5) and scorer("qxyz qxyz mx")[0] == "b"


def test_remembered_words_have_a_bound(monkeypatch):
    import numpy as np

    monkeypatch.setattr(langid, "REMEMBERED", 3)
    model = langid.Model(["a", "b"], {"w": 0}, {"x": 1, "y": 2}, np.log(np.array([[0.5, 0.5], [0.9, 0.1], [0.2, 0.8]], np.float32)))
    scorer = langid.Scorer(model)
    want = [langid.Scorer(model)(t) for t in ("xa xb xc xd ya w", "ya yb", "xa")]
    assert [scorer(t) for t in ("xa xb xc xd ya w", "ya yb", "xa")] == want and len(scorer.table) == 6


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 1), (3, None, "en", 1), (4, "x", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert (got[1], got[2], got[3]) == ("en", "fr", "und")
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {1, 2} <= {r.doc_id for r in kept.collect()} <= {1, 2, 4}
    empty = langid.train(docs.limit(0))
    assert [r.lang_pred for r in langid.predict(docs, empty).collect()] == ["und"] * 4
    assert langid.predict(docs.limit(0), model).count() == 0


def test_texts_without_letters():
    import numpy as np

    model = langid.Model(["a"], {"x": 0}, {}, np.zeros((1, 1), np.float32))
    scorer = langid.Scorer(model)
    for text in ("½ ²", "Ⅷ", "① 2 ¾", "_ 12 ٣", "", "  "):
        assert scorer(text) == ("und", 0.0)
    assert scorer("x²")[0] == "a" and langid._letters("ab²c_d9é") == ["ab", "c", "d", "é"]


def test_against_plain_counts(spark):
    """The model counted and the texts scored letter by letter, without the operator's tables."""
    import math
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    words, grams = {}, {}
    for r in rows:
        for w in "".join(c if c.isalpha() else " " for c in r.text.lower()).split():
            if len(w) <= 100:
                words.setdefault(r.lang, Counter())[w] += 1
    for lang, counted in words.items():
        for w, n in counted.items():
            e = f"<{w}>"
            for k in (1, 2, 3, 4):
                for i in range(len(e) - k + 1):
                    grams.setdefault((lang, k), Counter())[e[i : i + k]] += n
    languages = sorted(words)

    def logs(counted):
        keys = set().union(*counted)
        totals = [sum(c.values()) + 0.1 * len(keys) for c in counted]
        return lambda key: [math.log((c[key] + 0.1) / t) for c, t in zip(counted, totals)] if key in keys else None

    word = logs([words[x] for x in languages])
    gram = {k: logs([grams[x, k] for x in languages]) for k in (1, 2, 3, 4)}

    def odds(w):
        if word(w):
            return word(w)
        for k in (4, 3, 2, 1):
            e = f"<{w}>"
            found = [g for i in range(len(e) - k + 1) if (g := gram[k](e[i : i + k]))]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(languages)

    model = langid.train(docs, words=10**6, grams=10**6)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.unionByName(spark.createDataFrame([(-1, "zzyq ünheard wordle", "en")], docs.schema)), model).collect()}
    for doc_id, text in [(r.doc_id, r.text) for r in rows] + [(-1, "zzyq ünheard wordle")]:
        told = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        if not told:
            assert got[doc_id] == ("und", 0.0)
            continue
        total = [sum(x) for x in zip(*map(odds, told))]
        total = [x * min(1.0, langid.ENOUGH / len(told)) for x in total]
        shares = [math.exp(x - max(total)) for x in total]
        assert got[doc_id][0] == languages[shares.index(1.0)] and got[doc_id][1] == pytest.approx(1 / sum(shares), rel=1e-3)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 1, 2)], "doc_id long, text string, lang string, _language int, _LANGUAGE_ int")
    model = langid.train(docs)
    assert langid.predict(docs, model).columns == [*docs.columns, "lang_pred", "score"] and langid.keep_identified(docs, model).columns == docs.columns
