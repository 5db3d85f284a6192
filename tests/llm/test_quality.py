from __future__ import annotations

import random
import re
import zlib

import numpy as np

from pagemill.llm import quality, queries

SF = "/root/testdata/sf0.1"


def plain_counts(text):
    """The counts of one text, character by character and word by word."""
    kinds = [
        "letter" if c.isalpha() else "digit" if c.isnumeric() else "space" if c.isspace() else "cry" if c == "!" else "mark" if c in quality._MARKS else "symbol"
        for c in text
    ]
    words = ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in re.findall(r"(?:(?![_])\w)+", text)]
    raw = re.findall(r"(?:(?![_])\w)+", text)
    near = [any(i >= b and words[i - b] == w for b in (1, 2, 3)) for i, w in enumerate(words)]
    odd = [k in ("cry", "symbol") for k in kinds]
    return {
        "chars": len(text), "letters": kinds.count("letter"), "upper": sum(c.isalpha() and c.isupper() for c in text), "digits": kinds.count("digit"),
        "spaces": kinds.count("space"), "marks": kinds.count("mark"), "cries": kinds.count("cry"), "symbols": kinds.count("symbol"),
        "symbol_runs": sum(a and b for a, b in zip(odd, odd[1:])), "lines": text.count("\n"), "words": len(words), "word_chars": sum(map(len, words)),
        "word_squares": sum(len(w) ** 2 for w in words), "short_words": sum(len(w) <= 3 for w in words), "capitals": sum(w[0].isalpha() and w[0].isupper() for w in raw),
        "repeats": sum(i > 0 and words[i - 1] == w for i, w in enumerate(words)), "near_repeats": sum(near),
    }


def test_counts_by_hand():
    rng = random.Random(4)
    texts = ["", None, "The the THE cat!! $$ 42", "a\n\nb_c — “Ünï”", " ", "x" * 5000]
    texts += ["".join(rng.choice("aBé1 .!$%\n_“日") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = quality.counts(texts)
    for text, row in zip(texts, got):
        assert dict(zip(quality.NAMES, row.tolist())) == plain_counts(text or "")


def test_long_text_is_read_whole():
    text = ("A word, a $ and 7 more! \n" * 40_000) + "the the"
    got = dict(zip(quality.NAMES, quality.counts(["x", text])[1].tolist()))
    assert len(text) > 3 * quality.W.BLOCK and got == plain_counts(text)


def test_density_against_the_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, quality.WIDTH))
    means, spread = rng.normal(size=(2, quality.WIDTH)), rng.normal(size=(2, quality.WIDTH, quality.WIDTH))
    covariances = np.stack([s @ s.T + np.eye(quality.WIDTH) for s in spread])
    one = np.ones(quality.WIDTH)
    model = quality.Model(np.ones(len(quality.NAMES)), 0 * one, one, means, covariances, 1.0, 0.0, 0.0)

    def density(row, y):
        away = row - means[y]
        return -0.5 * (away @ np.linalg.inv(covariances[y]) @ away + np.linalg.slogdet(covariances[y])[1])

    assert np.allclose(np.sinh(model.difference(x)), [density(r, 1) - density(r, 0) for r in x])
    assert model.factors is model.factors


def test_shrinkage():
    rng = np.random.default_rng(1)
    for n in (5, 50, 50_000):
        x = rng.normal(size=(n, 8)) * np.arange(1, 9)
        x -= x.mean(0)
        got = quality.shrunk(x.T @ x / n, ((x**2).sum(1) ** 2).mean(), n)
        assert np.linalg.eigvalsh(got).min() > 0 and np.isclose(np.trace(got), np.trace(x.T @ x / n))
    assert np.abs(got - x.T @ x / n).max() < 2 and np.linalg.cholesky(quality.shrunk(np.zeros((3, 3)), 0.0, 4)).shape == (3, 3)


def test_training_equals_one_pass_in_memory(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").select("text", "quality").toPandas()
    found, y = quality.counts(list(rows["text"])), rows["quality"].to_numpy()
    assert (model.totals == found.sum(0)).all()
    x = quality.statistics(found, model.totals)
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.scale, x.std(0), atol=1e-3)
    z = model.standard(found)
    for label in (0, 1):
        mine = z[y == label]
        assert np.allclose(model.means[label], mine.mean(0))
        away = mine - mine.mean(0)
        assert np.allclose(model.covariances[label], quality.shrunk(away.T @ away / len(away), ((away**2).sum(1) ** 2).mean(), len(away)), atol=1e-6)
    assert np.isclose(model.prior, np.log((y == 1).sum() / (y == 0).sum()))


def test_held_out_documents(spark):
    rows = queries.op11_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (b == g) for b in bad for g in good])
    kept, junk = np.mean([s >= 0.3 for s in good]), np.mean([s >= 0.3 for s in bad])
    print("auc", auc, "good kept", kept, "junk kept", junk, len(good), len(bad))
    assert auc > 0.99 and kept > 0.99 and junk < 0.05


def test_odd_rows(spark):
    rng = random.Random(2)
    words = ["word", "good", "Text", "of", "a", "language"]
    rows = [(i, " ".join(rng.choices(words, k=30)) + "." if i % 2 else "$$$ " * 20 + rng.choice(words)) for i in range(1, 60)]
    docs = spark.createDataFrame([*rows, (None, None), (70, ""), (70, ""), (71, "x" * 300_000)], "doc_id long, text string")
    docs = docs.withColumns({"score": quality.F.lit("s"), "label": quality.F.lit(7), "counts": quality.F.lit(1)})
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (3, None), (4, 1), (5, 9)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 63 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id and r.doc_id < 60)
    assert {r.label for r in got} == {7} and len({r.score for r in got if not r.text}) == 1
    for none in (labels.limit(0), labels.filter("quality = 1")):
        assert {r.predicted for r in quality.score(docs, quality.train(docs, none)).collect()} == {0 if none.isEmpty() else 1}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
