"""Text quality by a regularised quadratic discriminant over transformed document statistics.

A text is described by counts of characters, words and repetitions.  Counts
become smoothed log rates, so a short text is drawn towards the corpus rate
and not to an extreme.  Each class is a Gaussian whose covariance is shrunk
towards a multiple of the identity; a score is the calibrated difference of
the two log densities, read off triangular solves with the classes' cached
Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.operators.scale import join_dimension, stage

THRESHOLD = 0.3
NAMES = [
    "chars", "letters", "upper", "digits", "spaces", "marks", "cries", "symbols", "symbol_runs", "lines", "words",
    "word_chars", "word_squares", "short_words", "capitals", "repeats", "near_repeats",
]
RATES = [  # a count, what it is counted among, and how much of the corpus rate is mixed in
    ("letters", "chars", 40), ("upper", "letters", 40), ("digits", "chars", 40), ("spaces", "chars", 40), ("marks", "words", 10),
    ("cries", "words", 10), ("symbols", "chars", 40), ("symbol_runs", "chars", 40), ("lines", "words", 10), ("word_chars", "words", 10),
    ("word_squares", "words", 10), ("short_words", "words", 10), ("capitals", "words", 10), ("repeats", "words", 10), ("near_repeats", "words", 10),
]
WIDTH = len(RATES) + 1
_INDEX = {name: i for i, name in enumerate(NAMES)}
_MARKS = ".,;:'\"-()?¿¡«»„“”‘’…–—"
LETTER, UPPER, DIGIT, SPACE, MARK, CRY, SYMBOL = 1, 2, 4, 8, 16, 32, 64
LEAST_SHRINKAGE = 0.02
SPREAD = 6.0  # standard deviations beyond which a statistic is cut off
SLICES = 64  # slices of the calibration curve


@cache
def _kinds() -> np.ndarray:
    """What each code point is, as bits."""
    table = np.zeros(W.POINTS, np.uint8)
    for i in range(W.POINTS):
        c = chr(i)
        if c.isalpha():
            table[i] = LETTER | (UPPER if c.isupper() else 0)
        elif c.isnumeric():
            table[i] = DIGIT
        elif c.isspace():
            table[i] = SPACE
        else:
            table[i] = CRY if c == "!" else MARK if c in _MARKS else SYMBOL
    return table


def _added(where: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of[where], minlength=n)


def counts(texts: list[str | None]) -> np.ndarray:
    """The counts of each text, one column per name; nothing for a null or empty text.

    Texts are read in blocks of bounded size.  A text longer than a block is
    cut between words; a repetition across a cut is not seen.
    """
    out = np.zeros((len(texts), len(NAMES)), np.int64)
    held: list[tuple[int, str]] = []
    size = 0
    for number, text in enumerate(texts):
        for _, piece in W.pieces(text or ""):
            if held and size + len(piece) > W.BLOCK:
                _count(held, out)
                held, size = [], 0
            held.append((number, piece))
            size += len(piece) + 1
    if held:
        _count(held, out)
    return out


def _count(held: list[tuple[int, str]], out: np.ndarray) -> None:
    points = W.codepoints("\n".join([p for _, p in held]))
    n = len(held)
    lengths = np.array([len(p) for _, p in held])
    heads = np.cumsum(lengths + 1) - lengths - 1
    of = np.repeat(np.arange(n), lengths + 1)[: len(points)]
    kind = _kinds()[points]
    joins = (heads + lengths)[:-1]
    kind[joins] = 0
    found = np.zeros((n, len(NAMES)), np.int64)
    found[:, 0] = lengths
    for name, bit in (("letters", LETTER), ("upper", UPPER), ("digits", DIGIT), ("spaces", SPACE), ("marks", MARK), ("cries", CRY), ("symbols", SYMBOL)):
        found[:, _INDEX[name]] = _added((kind & bit) != 0, of, n)
    odd = (kind & (SYMBOL | CRY)) != 0
    found[:, _INDEX["symbol_runs"]] = _added(np.flatnonzero(odd[1:] & odd[:-1]), of, n)
    found[:, _INDEX["lines"]] = _added((points == 10) & (kind != 0), of, n)
    hashes, start, end = W.hashed_words(points)
    if len(hashes):
        owner, long = of[start], end - start
        found[:, _INDEX["words"]] = np.bincount(owner, minlength=n)
        found[:, _INDEX["word_chars"]] = np.bincount(owner, long, n)
        found[:, _INDEX["word_squares"]] = np.bincount(owner, np.minimum(long, 1 << 20) ** 2, n)
        found[:, _INDEX["short_words"]] = _added(long <= 3, owner, n)
        found[:, _INDEX["capitals"]] = _added((kind[start] & UPPER) != 0, owner, n)
        again = np.zeros(len(hashes), bool)
        for back in (1, 2, 3):
            same = np.zeros(len(hashes), bool)
            same[back:] = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
            again |= same
            if back == 1:
                found[:, _INDEX["repeats"]] = _added(same, owner, n)
        found[:, _INDEX["near_repeats"]] = _added(again, owner, n)
    np.add.at(out, [t for t, _ in held], found)


def statistics(found: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Transformed statistics of texts: the log of their length, and log rates smoothed by those of ``totals``."""
    x = np.empty((len(found), WIDTH))
    x[:, 0] = np.log1p(found[:, 0])
    for j, (part, whole, weight) in enumerate(RATES, 1):
        a, b = found[:, _INDEX[part]], found[:, _INDEX[whole]]
        rate = max(totals[_INDEX[part]], 0.5) / max(totals[_INDEX[whole]], 1.0)
        # half a case more keeps the log of an absent thing within reach of one that is rare
        x[:, j] = np.log((a + weight * rate + 0.5) / (b + weight + 0.5))
    return x


@dataclass(frozen=True)
class Model:
    """Totals of the counts, centre and scale of the statistics, mean and covariance of both classes, the calibration curve, the log odds of label 1."""

    totals: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    slope: float
    offset: float
    prior: float

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """Per class the inverse of the covariance's Cholesky factor, and half the log determinant."""
        lower = [np.linalg.cholesky(c) for c in self.covariances]
        return [(np.linalg.inv(m), float(np.log(np.diag(m)).sum())) for m in lower]

    def standard(self, found: np.ndarray) -> np.ndarray:
        return np.clip((statistics(found, self.totals) - self.centre) / self.scale, -SPREAD, SPREAD)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under label 1 less that under label 0, of standardised statistics; compressed, as far ends run to thousands."""
        density = []
        for mean, (inverse, half) in zip(self.means, self.factors):
            away = (x - mean) @ inverse.T
            density.append(-0.5 * (away**2).sum(1) - half)
        return np.arcsinh(density[1] - density[0])

    def odds(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of label 1; those of any label for a text without characters."""
        found = counts(texts)
        told = self.difference(self.standard(found)) * self.slope + self.offset
        return np.where(found[:, 0] > 0, told, self.prior)


def _constant(odds: float) -> Model:
    one = np.ones(WIDTH)
    return Model(np.ones(len(NAMES)), 0 * one, one, np.zeros((2, WIDTH)), np.stack([np.eye(WIDTH)] * 2), 0.0, odds, odds)


def shrunk(moment: np.ndarray, fourth: float, n: float) -> np.ndarray:
    """A covariance drawn to a multiple of the identity, by the weight that makes the expected error least (Ledoit and Wolf).

    ``moment`` is the mean outer product of centred rows, ``fourth`` the mean of their squared norms' squares.
    """
    width = len(moment)
    level = np.trace(moment) / width
    apart = ((moment - level * np.eye(width)) ** 2).sum()
    noise = max(0.0, (fourth - (moment**2).sum()) / max(n, 1.0))
    weight = 1.0 if apart <= 0 else min(1.0, max(LEAST_SHRINKAGE, noise / apart))
    return (1 - weight) * moment + weight * max(level, 1e-3) * np.eye(width)


def calibrated(middle: np.ndarray, ones: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the shares ``ones / n`` at ``middle``, slightly regularised."""
    centre = float(np.average(middle, weights=n))
    scale = float(np.sqrt(np.average((middle - centre) ** 2, weights=n))) or 1.0
    x, beta = np.stack([(middle - centre) / scale, np.ones(len(middle))], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * p - ones) / n.sum() + 1e-4 * beta * [1, 0]
        curve = (x * (n * p * (1 - p))[:, None]).T @ x / n.sum() + np.diag([1e-4, 1e-9])
        beta -= np.clip(np.linalg.solve(curve, slope), -1, 1)
    beta[0] = max(beta[0], 0.0)
    return beta[0] / scale, beta[1] - beta[0] * centre / scale


def _sums(rows: DataFrame, of, width: int) -> np.ndarray:
    """Column sums per label of what ``of`` makes of the counts of each batch, added up over all rows: (label, column)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.stack(batch["counts"].to_numpy()).astype(np.int64) if len(batch) else np.zeros((0, len(NAMES)), np.int64)
            label = batch["label"].to_numpy()
            parts = [(y, of(found[label == y], y).sum(0).tolist()) for y in (0, 1) if (label == y).any()]
            yield pd.DataFrame(parts, columns=["label", "sums"])

    partial = rows.mapInPandas(run, "label int, sums array<double>")
    added = partial.select("label", F.posexplode("sums").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((2, width))
    for r in added.collect():
        out[r["label"], r["at"]] = r["x"]
    return out


def count_column(texts: str):
    @F.pandas_udf("array<long>", F.PandasUDFType.SCALAR)
    def run(batch):
        return pd.Series(list(counts(list(batch))))

    return run(F.col(texts))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality") -> Model:
    """Fit on all labelled documents (doc_id, text) and (doc_id, ``label``).

    Only sums travel to the driver, of a size that the number of statistics
    sets.  An id labelled twice counts as 0 if either label is; null ids and
    labels, other labels, and null and empty texts are not learned from.  With fewer than
    two classes the model is constant.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
    met = join_dimension(texts, stage(told, "quality-labels"), ["doc_id"])
    rows = stage(met.select("label", count_column("text").alias("counts")), "quality-counts")
    counted = _sums(rows, lambda c, _: np.concatenate([c, np.ones((len(c), 1), np.int64)], 1), len(NAMES) + 1)
    n = counted[:, -1]
    if not n.all():
        return _constant(20.0 if n[1] else -20.0)
    totals = counted[:, :-1].sum(0)
    prior = float(np.log(n[1] / n[0]))

    def moments(c: np.ndarray, _: int) -> np.ndarray:
        x = statistics(c, totals)
        return np.concatenate([x, x**2], 1)

    first = _sums(rows, moments, 2 * WIDTH)
    centre = first.sum(0)[:WIDTH] / n.sum()
    scale = np.sqrt(np.maximum(first.sum(0)[WIDTH:] / n.sum() - centre**2, 1e-6))
    blank = Model(totals, centre, scale, np.zeros((2, WIDTH)), np.stack([np.eye(WIDTH)] * 2), 1.0, 0.0, prior)
    means = _sums(rows, lambda c, _: blank.standard(c), WIDTH) / n[:, None]

    def second(c: np.ndarray, y: int) -> np.ndarray:
        x = blank.standard(c) - means[y]
        outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return np.concatenate([outer, ((x**2).sum(1) ** 2)[:, None]], 1)

    around = _sums(rows, second, WIDTH * WIDTH + 1) / n[:, None]
    covariances = np.stack([shrunk(around[y, :-1].reshape(WIDTH, WIDTH), around[y, -1], n[y]) for y in (0, 1)])
    fitted = Model(totals, centre, scale, means, covariances, 1.0, 0.0, prior)
    # the curve is fitted to the shares of label 1 in slices of the differences
    edges = np.linspace(-8, 8, SLICES - 1)

    def curve(c: np.ndarray, y: int) -> np.ndarray:
        d = fitted.difference(fitted.standard(c))
        slot = np.searchsorted(edges, d)
        out = np.zeros((len(c), 2 * SLICES))
        out[np.arange(len(c)), slot] = 1
        out[np.arange(len(c)), SLICES + slot] = d
        return out

    shares = _sums(rows, curve, 2 * SLICES)
    seen = shares[:, :SLICES].sum(0)
    used = seen > 0
    middle = shares[:, SLICES:].sum(0)[used] / seen[used]
    slope, offset = calibrated(middle, shares[1, :SLICES][used], seen[used])
    return Model(totals, centre, scale, means, covariances, slope, offset, prior)


def score(docs: DataFrame, model: Model, text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on), from the whole text only.

    A null or empty text scores as often as labels are 1.  Columns of the two
    names are replaced; rows are neither added nor lost.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double", F.PandasUDFType.SCALAR)
    def run(batch):
        return pd.Series(1 / (1 + np.exp(-np.clip(shared.value.odds(list(batch)), -30, 30))))

    marked = docs.drop("score", "predicted").withColumn("score", run(F.col(text)))
    return marked.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
