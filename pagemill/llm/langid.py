"""Language identification: whole words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scale import join_dimension, stage, unused

SAMPLE_DOCS = 1500  # labelled documents per language that the model is fitted on
SAMPLE_CHARS = 6_000_000  # and their characters, over all of a language's documents
WORDS = 100_000  # words in the model, over all languages
GRAMS = 60_000  # n-grams in the model
MAX_N = 4
ENOUGH = 20  # words of evidence beyond which a score gains no more
REMEMBERED = 100_000  # unseen words whose score a Python worker keeps
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
# what that takes for letters though it is none, as ² and Ⅷ: numbers without being digits
_NOT_LETTERS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
_NUMBERS = re.compile("[" + "".join(_NOT_LETTERS) + "]")
_SUSPECTS = re.compile("[" + "".join(c for c in _NOT_LETTERS if c < "\U00010000") + "]")  # quick to search for, unlike sets that reach
_BEYOND = re.compile("[\U00010000-\U0010ffff]")  # beyond the first plane


@dataclass(frozen=True)
class Model:
    """Log frequencies by language: a table, and the rows in it of words and of n-grams (with ``<`` and ``>`` as word ends)."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray


def sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Rows (text, lang) chosen by a hash of the text, in number bounded per language.

    Each language keeps the share of its rows that is expected to meet both
    bounds; a single text longer than ``chars`` is not learned from.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & (F.length("text") <= chars)).select("text", "lang")
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    rate = F.least(F.lit(1.0), docs_per_language / F.col("n"), chars / F.col("chars"))
    share = stage(share.select("lang", rate.alias("share")), "language-shares")
    draw = (F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).alias("draw")
    return join_dimension(rows.select("text", "lang", draw), share, ["lang"]).filter("draw <= share").select("text", "lang")


def _logs(counts: pd.DataFrame, key: str, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Keys and the smoothed log frequency of each by language."""
    row, keys = pd.factorize(counts[key])
    table = np.full((len(keys), len(languages)), 0.1)
    np.add.at(table, (row, pd.Index(languages).get_indexer(counts["lang"])), counts["n"].to_numpy())
    return list(keys), np.log(table / np.maximum(table.sum(0), 1e-9))


def train(labelled: DataFrame, *, words: int = WORDS, grams: int = GRAMS, **bounds: int) -> Model:
    """Fit on ``labelled`` (text, lang): counts are Spark aggregates over a bounded sample.

    The most frequent ``words`` and ``grams`` of the sample make the model, so
    its size has a fixed bound.  Null languages and texts are ignored; ties in
    frequency go by the word.
    """
    lowered = F.lower("text")
    tokens = sample(labelled, **bounds).select("lang", F.explode(F.regexp_extract_all(lowered, F.lit(r"(\p{L}+)"))).alias("word"))
    counted = tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), "word", "lang"]
    top = counted.filter(F.length("word") <= 100).orderBy(*order).limit(words).toPandas()
    edged = F.concat(F.lit("<"), "word", F.lit(">"))
    spots = F.transform(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1), lambda i: F.substring("w", i, F.col("k")))
    short = (
        counted.filter(F.length("word") <= 100)
        .select("lang", "n", edged.alias("w"), F.explode(F.array(*map(F.lit, range(1, MAX_N + 1)))).alias("k"))
        .filter(F.length("w") >= F.col("k"))
        .select("lang", "n", F.explode(spots).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "gram", "lang")
        .limit(grams)
        .toPandas()
    )
    languages = sorted(set(top["lang"]) | set(short["lang"]))
    logs = [_logs(top, "word", languages), *[_logs(g, "gram", languages) for _, g in short.groupby(short["gram"].str.len())]]
    keys = [k for part, _ in logs for k in part]
    n = len(logs[0][0])
    table = np.concatenate([t for _, t in logs]).astype(np.float32)
    return Model(languages, {k: i for i, k in enumerate(keys[:n])}, {k: i for i, k in enumerate(keys[n:], n)}, table)


def _letters(text: str) -> list[str]:
    """Runs of letters."""
    if not text.isascii() and (_SUSPECTS.search(text) or _BEYOND.search(text)):
        text = _NUMBERS.sub(" ", text)
    return _WORD.findall(text)


class Scorer:
    """Scores texts; unseen words met are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, n = model, len(model.table)
        self.table = np.concatenate([model.table, np.zeros((REMEMBERED, len(model.languages)), np.float32)])
        self.first = self.free = n
        self.known = dict(model.words)

    def unseen(self, word: str) -> np.ndarray | float:
        """Mean log frequency of the longest n-grams known at all, from four letters down to one."""
        edged, grams = f"<{word}>", self.model.grams
        for k in range(MAX_N, 0, -1):
            found = [r for i in range(len(edged) - k + 1) if (r := grams.get(edged[i : i + k])) is not None]
            if found:
                return self.model.table[found].mean(0)
        return 0.0

    def _row(self, word: str) -> int:
        row = self.known[word] = self.free
        self.table[row] = self.unseen(word)
        self.free += 1
        return row

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_letters((text or "").lower()))
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        total, words = np.zeros(len(self.model.languages)), list(counts)
        for at in range(0, len(words), REMEMBERED):
            part = words[at : at + REMEMBERED]
            if self.free + len(part) > len(self.table):
                self.known, self.free = dict(self.model.words), self.first
            known = self.known
            rows = [r if (r := known.get(w)) is not None else self._row(w) for w in part]
            total += np.fromiter((counts[w] for w in part), float, len(part)) @ self.table[rows]
        total *= min(1.0, ENOUGH / sum(counts.values()))
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def _judged(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame([scorer(t) for t in batch], columns=["lang_pred", "score"])

    return docs.withColumn(out, run(F.col(text)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the winner's posterior, 0 to 1), from the whole text only.

    A text that is null or has no letter is ``und`` with score 0, and so is any
    text if nothing was learned.  Equal scores go to the first language A-Z.
    Columns of the two names are replaced; rows are neither added nor lost.
    """
    rest = docs.drop("lang_pred", "score")
    out = unused(rest, "_language")
    return _judged(rest, model, text, out).select(*[f"`{c}`" for c in rest.columns], f"{out}.lang_pred", f"{out}.score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, columns as they were."""
    out = unused(docs, "_language")
    known = (F.col(f"{out}.lang_pred") != UNKNOWN) & (F.col(f"{out}.score") >= least)
    return _judged(docs, model, "text", out).filter(known).drop(out)


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of an id, written as text, by ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
