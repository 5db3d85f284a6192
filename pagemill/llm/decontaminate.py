"""Training passages that hold benchmark items: BM25 retrieval with block-max bounds, then overlap checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.operators.scale import join_dimension, stage, unused

SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.6  # retrieved: this share of the score that the item has against itself
PART = 128  # words of an item that are indexed as one entry
PASSAGE, STEP = 2 * PART, PART  # so every run of PART words lies whole in a passage
BLOCK_ENTRIES = 16
SHARD_WORDS = 2_000_000  # words of items in one broadcast index
K1, B = 1.2, 0.75
_FILTER = 1 << 22


def _answer_start(text: str) -> int | None:
    """Code point where the answer begins, after the last question mark; None for items that are not question and answer."""
    body = text.rstrip()
    asked = body.rfind("?") + 1
    return asked if 0 < asked < len(body) else None


def entries(benchmark: DataFrame) -> DataFrame:
    """Items cut into entries of at most PART words.

    Rows (item_id, part, n_words, terms, counts, shingles, answer_terms): hashes of the
    distinct words and how often they occur, of the word shingles, and of the words of the answer.  An item
    without question and answer has the shingles of the whole and no answer.  An item
    with fewer words than a shingle has one shingle of all; a null, empty or
    wordless item has no entry.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                hashes, first, _ = W.hashed_words(W.codepoints(text or ""))
                n = len(hashes)
                begins = _answer_start(text or "")
                answer = n if begins is None else max(0, min(int(np.searchsorted(first, begins)), n - SHINGLE))
                for part, at in enumerate(range(0, n, PART)):
                    own = hashes[at : at + PART]
                    run_on = W.Words(np.zeros(len(hashes[at : at + PART + SHINGLE - 1]), np.int64), hashes[at : at + PART + SHINGLE - 1], first, first)
                    grams, _ = W.shingles(run_on, min(SHINGLE, n)) if n else (own, None)
                    terms, counts = np.unique(own, return_counts=True)
                    said = np.unique(own[max(0, answer - at) :]) if answer < at + PART else own[:0]
                    question = np.unique(grams[: max(0, answer - at)] if answer > 0 else grams)
                    rows.append((item, part, len(own), *[x.view(np.int64) for x in (terms,)], counts, question.view(np.int64), said.view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "part", "n_words", "terms", "counts", "shingles", "answer_terms"])

    kind = dict(benchmark.dtypes)["item_id"]
    return benchmark.select("item_id", "text").mapInPandas(
        run,
        f"item_id {kind}, part int, n_words int, terms array<long>, counts array<int>, shingles array<long>, answer_terms array<long>",
    )


@dataclass
class Index:
    """Inverted index of entries, in blocks of entries that follow one another.

    Weights are BM25 weights over the entry's score against itself.  Of each
    entry the most frequent terms, up to half the threshold in weight, are left
    out of the postings: what they add is bounded by ``rest``.
    """

    items: list
    parts: np.ndarray
    vocabulary: np.ndarray  # sorted hashes of all terms
    forward: np.ndarray  # term numbers, entry by entry
    weights: np.ndarray
    bounds: np.ndarray  # where each entry begins in ``forward``
    heads: np.ndarray  # by term: where its block postings begin
    blocks: np.ndarray  # block of each posting
    maxima: np.ndarray  # largest weight of the term in that block
    rest: np.ndarray  # by block: the most that terms without postings can add
    shingles: list[np.ndarray]
    answers: list[np.ndarray]
    filter: np.ndarray

    @classmethod
    def build(cls, rows: pd.DataFrame, n_entries: int, mean_words: float, threshold: float) -> "Index":
        rows = rows.sort_values(["first_term", "item_id", "part"]).reset_index(drop=True)
        vocabulary = np.unique(np.concatenate([np.asarray(t, np.int64).view(np.uint64) for t in rows["terms"]]))
        forward, weights, bounds, postings, rest = [], [], [0], {}, np.zeros(-(-len(rows) // BLOCK_ENTRIES))
        for i, row in enumerate(rows.itertuples()):
            tf, df = np.asarray(row.counts, float), np.asarray(row.df, float)
            idf = np.log1p((n_entries - df + 0.5) / (df + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * row.n_words / mean_words))
            w /= w.sum()
            terms = np.searchsorted(vocabulary, np.asarray(row.terms, np.int64).view(np.uint64))
            common = np.lexsort((terms, -df))
            left_out = common[np.cumsum(w[common]) <= threshold / 2]
            block = i // BLOCK_ENTRIES
            rest[block] = max(rest[block], w[left_out].sum())
            for t in np.setdiff1d(np.arange(len(terms)), left_out):
                key = (int(terms[t]), block)
                postings[key] = max(postings.get(key, 0.0), w[t])
            forward.append(terms)
            weights.append(w)
            bounds.append(bounds[-1] + len(terms))
        keys = sorted(postings)
        listed = np.array([k[0] for k in keys], np.int64)
        mask = np.zeros(_FILTER, bool)
        mask[vocabulary[np.unique(listed)] % np.uint64(_FILTER)] = True
        return cls(
            list(rows["item_id"]), rows["part"].to_numpy(), vocabulary, np.concatenate(forward), np.concatenate(weights),
            np.array(bounds), np.searchsorted(listed, np.arange(len(vocabulary) + 1)), np.array([k[1] for k in keys], np.int64),
            np.array([postings[k] for k in keys]), rest, [np.asarray(s, np.int64).view(np.uint64) for s in rows["shingles"]],
            [np.asarray(s, np.int64).view(np.uint64) for s in rows["answer_terms"]], mask,
        )

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words in no entry."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated, and the members of the ranges start..end."""
    size = end - start
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]


def _passages(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over the words of each text: first and end word, and by word the number of the last window with it."""
    heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    sizes = np.diff(np.r_[heads, len(text)])
    count = np.maximum(1, -(-(sizes - STEP) // STEP))
    base = np.cumsum(count) - count
    own, window = _expand(np.zeros(len(count), np.int64), count)
    start = heads[own] + window * STEP
    end = np.minimum(start + PASSAGE, (heads + sizes)[own])
    group = np.repeat(np.arange(len(heads)), sizes)
    last = base[group] + np.minimum((np.arange(len(text)) - heads[group]) // STEP, count[group] - 1)
    return start, end, last


def search(block: W.Words, index: Index, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """Every (passage, entry) of a block that reaches the threshold, with its score and the passage's words."""
    start, end, last = _passages(block.text)
    maybe = np.flatnonzero(index.filter[block.hash % np.uint64(_FILTER)])
    term = index.numbers(block.hash[maybe])
    maybe, term = maybe[term >= 0], term[term >= 0]
    size = len(index.vocabulary)
    keys = last[maybe] * size + term
    earlier = last[maybe] - 1
    in_both = (earlier >= 0) & (start[earlier] <= maybe) & (end[earlier] > maybe)
    keys = np.unique(np.r_[keys, earlier[in_both] * size + term[in_both]])
    passage, term = keys // size, keys % size
    row, posting = _expand(index.heads[term], index.heads[term + 1])
    n_blocks = len(index.rest)
    pairs, place = np.unique(passage[row] * n_blocks + index.blocks[posting], return_inverse=True)
    bound = np.bincount(place, index.maxima[posting], len(pairs)) + index.rest[pairs % n_blocks]
    pairs = pairs[bound >= threshold - 1e-9]
    if not len(pairs):
        return
    chosen, local = np.unique(pairs // n_blocks, return_inverse=True)
    row, word = _expand(start[chosen], end[chosen])
    held = index.numbers(block.hash[word])
    present = np.unique(row[held >= 0] * size + held[held >= 0])
    first = (pairs % n_blocks) * BLOCK_ENTRIES
    pair, entry = _expand(first, np.minimum(first + BLOCK_ENTRIES, len(index.items)))
    row, at = _expand(index.bounds[entry], index.bounds[entry + 1])
    wanted = local[pair[row]] * size + index.forward[at]
    spot = np.minimum(np.searchsorted(present, wanted), len(present) - 1)
    score = np.bincount(row, index.weights[at] * (present[spot] == wanted), len(entry))
    for i in np.flatnonzero(score >= threshold - 1e-9):
        p = chosen[local[pair[i]]]
        yield int(p), int(entry[i]), float(score[i]), int(start[p]), int(end[p])


def _overlaps(texts: list[str | None], index: Index, threshold: float) -> Iterator[tuple]:
    """Per text and entry: score, shingles and answer words found, and where, in the best passage."""
    for block in W.overlapping(texts, PASSAGE):
        for _, entry, score, first, end in search(block, index, threshold):
            # an entry's last shingles run on into the next entry, so its passage does too
            stop = first + np.count_nonzero(block.text[first : end + SHINGLE - 1] == block.text[first])
            seen = W.Words(*[x[first:stop] for x in block])
            asked, said = index.shingles[entry], index.answers[entry]
            grams, place = W.shingles(seen, SHINGLE)
            size = SHINGLE
            if len(index.forward[index.bounds[entry] : index.bounds[entry + 1]]) < SHINGLE and not np.isin(asked, grams).any():
                size = max(1, min(SHINGLE, int(index.bounds[entry + 1] - index.bounds[entry])))
                grams, place = W.shingles(seen, size)
            met = np.flatnonzero(np.isin(grams, asked))
            answered = int(np.isin(said, seen.hash).sum())
            span = (seen.start[place[met[0]]], seen.end[place[met[-1]] + size - 1]) if len(met) else (None, None)
            yield block.text[first], entry, score, len(np.unique(grams[met])), answered, *span


def _shards(benchmark: DataFrame, threshold: float) -> Iterator[tuple[Index, DataFrame]]:
    """Indexes over bounded shares of the items, with statistics over all of them."""
    cut = stage(entries(benchmark), "benchmark-entries")
    n, n_words = cut.agg(F.count(F.lit(1)), F.sum("n_words")).first()
    if not n:
        return
    shards = math.ceil(n_words / SHARD_WORDS)
    terms = cut.select("item_id", "part", "terms", F.posexplode("terms").alias("at", "term"))
    df = cut.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = terms.join(df, "term").groupBy("item_id", "part", "terms").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("df")
    )
    shard = F.pmod(F.xxhash64("terms"), F.lit(shards))
    full = stage(
        cut.distinct().join(counted.distinct(), ["item_id", "part", "terms"]).withColumn("shard", shard).withColumn("first_term", F.array_min("terms")),
        "benchmark-index",
    )
    for i in range(shards):
        rows = full.filter(F.col("shard") == i).toPandas()
        if len(rows):
            yield Index.build(rows, n, n_words / n, threshold)


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Columns: doc_id, text_hash, item_id, score (share of the item's BM25 score
    against itself), question_overlap, answer_overlap, start, end (code points
    of the matching words in the document).  Every passage of every text is a
    query; all entries that reach ``threshold`` are retrieved, and a pair counts
    if ``overlap`` of the question's five-word shingles and of the answer's words
    are in it, or of the five-word shingles of an item that is not question and answer.  Null, empty and wordless texts and items match nothing; equal
    items each have their row; repeated documents give one row per id.
    """
    kind = dict(docs.dtypes)[doc_id]
    item_kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, text_hash long, item_id {item_kind}, part int, score double, n_question int, met_question int, n_answer int, met_answer int, start long, end long"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    found = None
    for index in _shards(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            for batch in batches:
                made = [
                    (batch["doc_id"].iat[t], batch["text_hash"].iat[t], own.items[e], own.parts[e], s, len(own.shingles[e]), q, len(own.answers[e]), a, *span)
                    for t, e, s, q, a, *span in _overlaps(list(batch["text"]), own, threshold)
                ]
                if made:
                    yield pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])

        part = rows.mapInPandas(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    best = stage(
        found.groupBy("doc_id", "text_hash", "item_id", "part").agg(
            F.max(F.struct("met_question", "met_answer", "score", "n_question", "n_answer", "start", "end")).alias("m")
        ),
        "benchmark-hits",
    )
    items = entries(benchmark).distinct().groupBy("item_id").agg(F.sum(F.size("shingles")).alias("nq"), F.sum(F.size("answer_terms")).alias("na"))
    return (
        best.groupBy("doc_id", "text_hash", "item_id")
        .agg(
            F.max("m.score").alias("score"), F.sum("m.met_question").alias("q"), F.sum("m.met_answer").alias("a"),
            F.min("m.start").alias("start"), F.max("m.end").alias("end"),
        )
        .join(items, "item_id")
        .select(
            "doc_id", "text_hash", "item_id", "score",
            F.when(F.col("nq") > 0, F.col("q") / F.col("nq")).otherwise(1.0).alias("question_overlap"),
            F.when(F.col("na") > 0, F.col("a") / F.col("na")).otherwise(1.0).alias("answer_overlap"), "start", "end",
        )
        .filter((F.col("question_overlap") >= overlap) & (F.col("answer_overlap") >= overlap))
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, columns as they were; judged by text, so null ids too."""
    name = unused(docs, "_text_hash")
    hits = stage(find(docs, benchmark, text=text, doc_id=doc_id).select(F.col("text_hash").alias(name)).distinct(), "leaks")
    return join_dimension(docs.withColumn(name, F.xxhash64(text)), hits, [name], "left_anti").drop(name)
