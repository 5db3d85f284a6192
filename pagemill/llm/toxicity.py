"""Toxicity by bags of subwords: averaged embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean over the hashed n-grams of 3 to 5 characters
(with word ends) and the word itself, so a misspelling shares most of its
parts with what it imitates.  A passage is the mean of its words; a text is as
toxic as its most toxic passage, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.operators.scale import join_dimension, stage

SAMPLE_DOCS = 2000  # labelled documents of each class that the model is fitted on
SAMPLE_CHARS = 5_000_000  # characters of all of them together
BITS = 17  # of the table of subword vectors
WIDTH = 8
PASSAGE = 6  # words averaged
GRAMS = (3, 4, 5)
_BASE = np.uint64(0xD1342543DE82EF95)


def subwords(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subwords of all words in some code points.

    Returns the word number and bucket of each, in word order within one
    n-gram size, then the words' hashes and first places.
    """
    hashes, start, end = W.hashed_words(points)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = W.word_table()[points]
    values = np.zeros(len(points) + 2, np.uint64)
    values[1:-1] = W.mix(W.lower_table()[points].astype(np.uint64) + np.uint64(1))
    values[~inside] = 0
    owner = np.full(len(points) + 2, -1, np.int64)
    owner[1:-1][inside[1:-1]] = np.repeat(np.arange(len(start)), end - start)
    shift = np.uint64(64 - BITS)
    number, bucket = [np.arange(len(hashes))], [(W.mix(hashes + np.uint64(99)) >> shift).astype(np.int64)]
    total, power = np.zeros(len(values), np.uint64), np.uint64(1)
    sums = np.r_[0, np.cumsum(inside)]
    for j in range(max(GRAMS)):
        total = total[: len(values) - j] + values[j:] * power
        power = np.uint64(int(power) * int(_BASE) % (1 << 64))
        if j + 1 in GRAMS:
            first = np.arange(len(total))
            whole = np.flatnonzero(sums[first + j] - sums[first + 1] == j - 1)
            number.append(owner[whole + 1])
            bucket.append((W.mix(total[whole] + np.uint64(j)) >> shift).astype(np.int64))
    return np.concatenate(number), np.concatenate(bucket), hashes, start


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's share in the log odds, the bias, the calibration of a text's highest log odds, the log odds of a label."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float

    def odds(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated log odds; those of any label for a text without words."""
        top = highest(texts, self.table, self.bias)
        return np.where(np.isnan(top), self.prior, np.nan_to_num(top) * self.slope + self.offset)


def _constant(odds: float) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, odds, odds)


def _passage_means(word_scores: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and mean score of every run of PASSAGE words; a shorter text is one run."""
    heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    sizes = np.diff(np.r_[heads, len(text)])
    size = np.minimum(sizes, PASSAGE)
    count = sizes - size + 1
    own = np.repeat(np.arange(len(heads)), count)
    start = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + heads[own]
    sums = np.r_[0.0, np.cumsum(word_scores)]
    return text[heads][own], (sums[start + size[own]] - sums[start]) / size[own]


def highest(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of each text's most toxic passage; NaN for a text without words."""
    out = np.full(len(texts), -np.inf)
    for parts in W.parts(texts):
        points = W.codepoints("\n".join([p for _, _, p in parts]))
        number, bucket, hashes, start = subwords(points)
        if not len(hashes):
            continue
        n = np.bincount(number, minlength=len(hashes))
        scores = np.bincount(number, table[bucket], len(hashes)) / n
        first = np.zeros(len(parts), np.int64)
        first[1:] = np.cumsum([len(p) + 1 for _, _, p in parts])[:-1]
        part = np.searchsorted(first, start, "right") - 1
        where, means = _passage_means(scores, part)
        np.maximum.at(out, np.array([t for t, _, _ in parts])[where], means)
    return np.where(np.isinf(out), np.nan, out + bias)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.first, self.second, self.step = rate, {}, {}, 0

    def __call__(self, values: dict[str, np.ndarray], slopes: dict[str, np.ndarray]) -> None:
        self.step += 1
        for key, slope in slopes.items():
            m = self.first[key] = 0.9 * self.first.get(key, 0.0) + 0.1 * slope
            v = self.second[key] = 0.999 * self.second.get(key, 0.0) + 0.001 * slope**2
            values[key] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, *, epochs: int = 60, rate: float = 0.1, seed: int = 1) -> Model:
    """Train vectors and softmax together, in full batches.

    In the first third of the epochs every passage has its text's label; from
    then on the text's most toxic passage alone, which is how texts are scored.
    ``weights`` restore the class sizes of which the texts are a sample when
    the score is calibrated.
    """
    rng = np.random.default_rng(seed)
    owner, words = [], []
    known: dict[int, int] = {}
    gram_word, gram_bucket = [], []
    for parts in W.parts(texts):
        points = W.codepoints("\n".join([p for _, _, p in parts]))
        number, bucket, hashes, start = subwords(points)
        first = np.zeros(len(parts), np.int64)
        first[1:] = np.cumsum([len(p) + 1 for _, _, p in parts])[:-1]
        part = np.searchsorted(first, start, "right") - 1
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        fresh = np.array([int(h) not in known for h in distinct], bool)
        for h in distinct[fresh]:
            known[int(h)] = len(known)
        local = np.full(len(hashes), -1)
        ids = np.array([known[int(h)] for h in distinct], np.int64)
        local[at[fresh]] = ids[fresh]
        new = local[number] >= 0
        gram_word.append(local[number][new])
        gram_bucket.append(bucket[new])
        owner.append(np.array([t for t, _, _ in parts])[part])
        words.append(ids[back])
    prior = float(np.log(max(weights[labels == 1].sum(), 0.5) / max(weights[labels == 0].sum(), 0.5)))
    owner, words = np.concatenate(owner), np.concatenate(words)
    if not len(owner):
        return _constant(prior)
    gram_word, gram_bucket = np.concatenate(gram_word), np.concatenate(gram_bucket)
    used, gram_bucket = np.unique(gram_bucket, return_inverse=True)
    n_words = len(known)
    per_word = np.bincount(gram_word, minlength=n_words)[:, None]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.r_[heads, len(owner)]))
    cut = np.flatnonzero(place % (PASSAGE // 2) == 0)  # passages of half the length: two make one that is scored
    passage = np.cumsum(place % (PASSAGE // 2) == 0) - 1
    of = owner[cut]
    sizes = np.bincount(passage)[:, None]
    values = {"E": rng.normal(0, 0.1, (len(used), WIDTH)), "W": rng.normal(0, 0.3, (WIDTH, 2)), "b": np.zeros(2)}
    adam = _Adam(rate)
    spread = lambda at, x, n: np.stack([np.bincount(at, x[:, d], n) for d in range(x.shape[1])], 1)
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    even = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for epoch in range(epochs):
        vectors = spread(gram_word, values["E"][gram_bucket], n_words) / per_word
        means = spread(passage, vectors[words], len(cut)) / sizes
        logits = means @ values["W"] + values["b"]
        share = np.zeros(len(cut))
        if epoch < epochs // 3:
            share = even[of] / np.bincount(of, minlength=len(texts))[of]
        else:
            odds = logits[:, 1] - logits[:, 0]
            top = np.maximum.reduceat(odds, firsts)
            best = np.flatnonzero(odds == np.repeat(top, np.diff(np.r_[firsts, len(of)])))
            best = best[np.unique(of[best], return_index=True)[1]]
            share[best] = even[of[best]]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(of)), labels[of]] -= 1
        p *= share[:, None]
        to_means = p @ values["W"].T / sizes
        to_words = spread(words, to_means[passage], n_words) / per_word
        adam(values, {"W": means.T @ p, "b": p.sum(0), "E": spread(gram_bucket, to_words[gram_word], len(used))})
    direction = values["W"][:, 1] - values["W"][:, 0]
    table = np.zeros(1 << BITS)
    table[used] = values["E"] @ direction
    bias = float(values["b"][1] - values["b"][0])
    top = highest(texts, table, bias)
    told = ~np.isnan(top)
    slope, offset = _calibrate(top[told], labels[told], weights[told])
    return Model(table.astype(np.float32), bias, slope, offset, prior)


def _calibrate(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Logistic regression of the labels on one number, slightly regularised, by damped Newton steps."""
    centre, scale = float(odds.mean()), float(odds.std()) or 1.0
    x = np.stack([(odds - centre) / scale, np.ones(len(odds))], 1)
    w, beta = weights / weights.sum(), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (w * (p - labels)) + 1e-3 * beta * [1, 0]
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(curve, slope), -1, 1)
    beta[0] = max(beta[0], 0.0)
    return beta[0] / scale, beta[1] - beta[0] * centre / scale


def train(docs: DataFrame, labels: DataFrame, *, docs_per_class: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the labelled documents (doc_id, text) and (doc_id, toxic).

    Rows are drawn per class by a hash of their id, and thinned further if
    their texts are long.  An id labelled twice counts as toxic if either is;
    null ids, labels and texts are not learned from.  With fewer than two
    classes the model is constant.
    """
    told = stage(
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")),
        "labels",
    )
    totals = {r["toxic"]: r["n"] for r in told.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return _constant(20.0 if 1 in totals else -20.0)
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, min(1.0, docs_per_class / totals[1])).otherwise(min(1.0, docs_per_class / totals[0]))
    picked = stage(told.filter("toxic in (0, 1)").filter(draw <= share), "labels-drawn")
    texts = docs.filter(F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id", "text")
    drawn = stage(join_dimension(texts, picked, ["doc_id"]), "labelled-texts")
    held = drawn.agg(F.sum(F.length("text"))).first()[0] or 0
    thin = F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    rows = drawn.filter(thin <= min(1.0, chars / max(1, held))).orderBy("doc_id", F.xxhash64("text")).toPandas()
    if rows["toxic"].nunique() < 2:
        return _constant(20.0 if (rows["toxic"] == 1).any() else -20.0)
    y = rows["toxic"].to_numpy()
    weights = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    return fit(list(rows["text"]), y, weights)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from 0.5 on), from the whole text only.

    A null, empty or wordless text scores as often as labels are toxic.  Columns of
    the two names are replaced; rows are neither added nor lost.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(own.odds(list(batch)), -30, 30))))

    marked = docs.drop("score", "predicted").withColumn("score", run(F.col(text)))
    return marked.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
