from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pagemill.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    rows = queries.op9_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    print("auc", auc, "recall", np.mean([s >= 0.5 for s in bad]), "false", np.mean([s >= 0.5 for s in good]), len(bad), len(good))
    assert auc > 0.8 and np.mean([s >= 0.5 for s in good]) < 0.02


def test_subwords_by_hand():
    def grams(text):
        number, bucket, hashes, _ = toxicity.subwords(toxicity.W.codepoints(text))
        return [sorted(bucket[number == i].tolist()) for i in range(len(hashes))]

    one, two, three = grams("Idiot"), grams("an idiot, idiot"), grams("ab")
    assert len(one[0]) == 1 + 5 + 4 + 3 and two[1] == two[2] == one[0]
    assert len(three[0]) == 1 + 2 + 1 and len(grams("x")[0]) == 2 and grams("") == grams("!?") == []
    shared = set(grams("idiot")[0]) & set(grams("idioot")[0])
    assert len(shared) >= 4


def test_unseen_misspellings():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(400)]
    labels = np.arange(400) % 2
    for i in np.flatnonzero(labels):
        at = texts[i].split()
        for _ in range(3):
            at.insert(rng.randrange(60), rng.choice(["worthless", "pathetic"]))
        texts[i] = " ".join(at)
    model = toxicity.fit(texts, labels, np.ones(400))
    clean = " ".join(rng.choices(words, k=200))
    odds = model.odds([f"{clean} wortthless {clean} wortthless pathetiic", clean, None, "!?"])
    assert odds[0] > 0 > odds[1] and odds[2] == odds[3] == 0 and (model.prior == 0)


def test_odd_rows(spark):
    rows = [(i, "you worthless clown " + "and so it goes " * i if i % 2 else "a fine day " * i) for i in range(1, 40)]
    docs = spark.createDataFrame([*rows, (None, None), (50, ""), (50, "")], "doc_id long, text string").withColumn("score", toxicity.F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 42 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id and r.doc_id < 40)
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_nothing_to_learn_from():
    model = toxicity.fit(["", "!?", ""], np.array([0, 1, 0]), np.ones(3))
    assert np.allclose(model.odds(["anything", None]), np.log(0.5))


def test_scores_against_a_plain_scorer(spark):
    """Every text of a table scored word by word, n-gram by n-gram, from the model's table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    W, known = toxicity.W, {}

    def word_score(word):
        if word not in known:
            _, bucket, _, _ = toxicity.subwords(W.codepoints(word))
            padded = f"\0{word}\0"
            assert len(bucket) == 1 + sum(max(0, len(padded) - k + 1) for k in toxicity.GRAMS)
            known[word] = sum(float(model.table[b]) for b in bucket) / len(bucket)
        return known[word]

    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        words = "".join(c if c.isalnum() else " " for c in r.text).split()
        if not words:
            odds = model.prior
        else:
            size = min(toxicity.PASSAGE, len(words))
            scores = [word_score(w) for w in words]
            top = max(sum(scores[i : i + size]) / size for i in range(len(words) - size + 1))
            odds = (top + model.bias) * model.slope + model.offset
        assert got[r.doc_id][0] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-4)
