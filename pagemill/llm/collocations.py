"""Phrases whose words stand together more often than their parts foretell.

Words are counted first.  A phrase is counted only where all its words are
frequent enough for it, and from three words on only where both its shorter
phrases are, which loses none.  Phrases are numbers made of word ids, counted
in quotient filters (``quotient``): tasks build sorted filters, filters of one
range of numbers meet in one task and are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import quotient as Q
from pagemill.llm import words as W
from pagemill.operators.scale import join_dimension, stage

SLICE = 1 << 20  # bytes of text tokenised at once
CHUNK = 1 << 13  # word ids of a row
BLOCK = 1 << 18  # word ids whose phrases are made at once
HELD = 1 << 20  # distinct phrases that a task holds before it hands them on
RANGE = 1 << 21  # phrases, at most, of one range of a filter
LEAST_RANGES = 5  # as a power of two
DICTIONARY = 4_000_000  # frequent words, or phrases, known to every task; beyond, ids are hashes and phrases are not thinned out
SEEDS = 16
SALTS = 64
_GRAMS = T.StructType([T.StructField("words", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("mark", T.LongType())])
_WORD, _GAP, _BREAK = 0, 1, 2


@cache
def _classes() -> np.ndarray:
    """What each byte is: part of a word, between words or the end of a piece."""
    table = np.full(256, _WORD, np.uint8)
    table[list(b" \t")] = _GAP
    table[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
    return table


@cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@cache
def _values(seed: int) -> np.ndarray:
    return W.mix(np.arange(256, dtype=np.uint64) + np.uint64(W.mix(np.uint64([seed + 1]))[0]))


@dataclass
class _Tokens:
    """Words of a slice: text number, first and end byte, hash, and whether a piece begins with the word."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    fresh: np.ndarray


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts of an Arrow column, and where each begins (one more at the end)."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return _lower()[raw], at - at[0]


def _tokens(data: np.ndarray, heads: np.ndarray, langs: np.ndarray, seed: int) -> Iterator[_Tokens]:
    """Words of the texts that begin at ``heads``, slice by slice; slices cut no word."""
    at, last = 0, -1
    pieces = 0  # piece and text ends so far
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            # go on to the end of the word that the cut falls into
            rest = data[end - 1 : end + SLICE]
            gap = np.flatnonzero(_classes()[rest] != _WORD)
            text_end = heads[np.searchsorted(heads, end)]
            stop = min(end - 1 + int(gap[0]) if len(gap) else end + SLICE, int(text_end), len(data))
            end = max(stop, end)
            if len(gap) or end in (text_end, len(data)):
                break
        part = data[at:end]
        kind = _classes()[part]
        inside = kind == _WORD
        first = heads[np.searchsorted(heads, at) : np.searchsorted(heads, end)] - at
        before = np.r_[False, inside[:-1]]
        before[first] = False
        follows = np.r_[inside[1:], False]
        follows[first[first > 0] - 1] = False
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~follows) + 1
        ends = np.cumsum(kind == _BREAK)
        number = np.searchsorted(heads, start + at, "right") - 1
        piece = pieces + ends[start] + number
        power, inverse = W.powers(1 << max(20, int(len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_values(seed)[part] * power[: len(part)], out=sums[1:])
        hashes = W.mix((sums[stop] - sums[start]) * inverse[start] + langs[number])
        yield _Tokens(number, start + at, stop + at, hashes, np.r_[last, piece[:-1]] != piece if len(piece) else np.zeros(0, bool))
        if len(piece):
            last = int(piece[-1])
        pieces += int(ends[-1]) if len(ends) else 0
        at = end


def _language_values(column: pa.Array) -> np.ndarray:
    return W.mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, heads = _bytes(batch.column(1))
            for t in _tokens(data, heads, _language_values(batch.column(2)), seed):
                if not len(t.hash):
                    continue
                values, at, back, n = np.unique(t.hash, return_index=True, return_inverse=True, return_counts=True)
                if not _same_bytes(data, t, at[back], batch.column(0)):
                    # two words under one hash: tell them apart, so that the check over all words finds them
                    named = np.array([f"{batch.column(0)[int(i)]}\0" for i in t.text], object)
                    told = [name.encode() + data[a:b].tobytes() for name, a, b in zip(named, t.start, t.end)]
                    _, at, n = np.unique(np.array(told, object), return_index=True, return_counts=True)
                    values = t.hash[at]
                spelled = [data[a:b].tobytes().decode() for a, b in zip(t.start[at].tolist(), t.end[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t.text[at])).cast(pa.string()), pa.array(spelled), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "word", "hash", "n"],
                )

    rows = docs.mapInArrow(run, "lang string, word string, hash long, n long")
    return rows.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def _same_bytes(data: np.ndarray, t: _Tokens, other: np.ndarray, lang: pa.Array) -> bool:
    """Whether every word is the very word, of the very language, that stands at place ``other``."""
    size = t.end - t.start
    if (size != size[other]).any():
        return False
    langs = lang.dictionary_encode().indices.to_numpy()
    if (langs[t.text] != langs[t.text[other]]).any():
        return False
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return bool((data[np.repeat(t.start, size) + inner] == data[np.repeat(t.start[other], size) + inner]).all())


def _vocabulary(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """All words with their counts, and the first seed whose hashes tell every frequent word from all others."""
    for seed in range(SEEDS):
        counted = stage(_counted_words(docs, seed), "words")
        shared = counted.groupBy("hash").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
        if not shared.filter((F.col("n") >= least) & ((F.col("words") > 1) | (F.col("hash") == 0))).limit(1).count():
            return counted, seed
    raise RuntimeError(f"no seed of {SEEDS} tells the words apart")


def _id_rows(docs: DataFrame, known: Broadcast | None, seed: int, look: int) -> DataFrame:
    """(own, ids): the texts as word ids, 0 for a place that no phrase crosses.

    A phrase belongs to the row that has its first word among its ``own`` ids;
    the up to ``look`` ids after them are the next row's.
    """
    kind = np.uint64 if known is None else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, heads = _bytes(batch.column(1))
            found = [np.zeros(0, kind)]
            for t in _tokens(data, heads, _language_values(batch.column(2)), seed):
                ids = t.hash
                if known is not None and len(ids):
                    table = known.value
                    place = np.minimum(np.searchsorted(table, ids), len(table) - 1)
                    ids = np.where(table[place] == ids, place + 1, 0)
                found.append(np.insert(ids.astype(kind), np.flatnonzero(t.fresh), 0))
            stream = np.concatenate(found)
            # of several breaks in a row one is enough
            stream = stream[np.r_[stream[1:] != 0, False] | (stream != 0)]
            cuts = range(0, len(stream), CHUNK)
            own = [min(CHUNK, len(stream) - c) for c in cuts]
            rows = [stream[c : c + CHUNK + look].tobytes() for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(rows, pa.binary())], ["own", "ids"])

    return docs.mapInArrow(run, "own int, ids binary")


def _marks(ids: list[np.ndarray]) -> np.ndarray:
    """One hash per phrase, by which a task knows frequent ones; two phrases with one hash only cost work."""
    total = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        total = W.mix(total + x + np.uint64(1))
    return total


def _phrases(rows: Iterable[tuple[int, bytes]], kind: type, k: int, frequent: np.ndarray | None) -> Iterator[list[np.ndarray]]:
    """The ids of all phrases of ``k`` words that can be frequent, in blocks."""

    def block(held: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        x = np.concatenate([np.r_[ids, np.zeros(1, kind)] for _, ids in held]).astype(np.uint64)
        mine = np.concatenate([np.arange(len(ids) + 1) < own for own, ids in held])
        n = len(x) - k + 1
        if n <= 0:
            return [np.zeros(0, np.uint64)] * k
        nulls = np.r_[0, np.cumsum(x == 0)]
        usable = mine[:n] & (nulls[k:] == nulls[: len(nulls) - k])
        if frequent is not None:
            at = np.flatnonzero(nulls[k - 1 :] == nulls[: len(nulls) - k + 1])
            marks = _marks([x[at + j] for j in range(k - 1)])
            place = np.minimum(np.searchsorted(frequent, marks), max(0, len(frequent) - 1))
            known = np.zeros(n + 1, bool)
            known[at] = frequent[place] == marks if len(frequent) else False
            usable &= known[:-1] & known[1:]
        at = np.flatnonzero(usable)
        return [x[at + j] for j in range(k)]

    held, size = [], 0
    for own, data in rows:
        held.append((own, np.frombuffer(data, kind)))
        size += len(held[-1][1])
        if size >= BLOCK:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def _filters(coded: DataFrame, kind: type, bits: int, k: int, frequent: Broadcast | None, top: int) -> DataFrame:
    """(range, filter): counters of the phrases of ``k`` words, several for one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Q.Counts] = []
        size = 0

        def out(counts: Q.Counts) -> pa.RecordBatch:
            place = Q.ranges(counts, top)
            heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
            ends = np.r_[heads[1:], len(place)]
            data = [Q.to_bytes(Q.Counts(*(x[a:b] for x in counts)), k * bits, top, int(place[a])) for a, b in zip(heads, ends)]
            return pa.RecordBatch.from_arrays([pa.array(place[heads].astype(np.int32)), pa.array(data, pa.binary())], ["range", "filter"])

        rows = ((own, ids.as_buffer()) for batch in batches for own, ids in zip(batch.column(0).to_pylist(), batch.column(1)))
        for ids in _phrases(rows, kind, k, frequent.value if frequent else None):
            held.append(Q.counted(Q.packed(Q.permuted(ids, bits), bits)))
            size += len(held[-1].n)
            if size > HELD:
                held = [Q.merged(held)]
                size = len(held[0].n)
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(Q.merged(held))

    return coded.mapInArrow(run, "range int, filter binary")


def _merged(filters: DataFrame, known: Broadcast | None, bits: int, k: int, least: int) -> DataFrame:
    """(words, n, mark): the phrases seen at least ``least`` times, as hashes of their words."""

    def answer(held: list[Q.Counts]) -> Iterator[pa.RecordBatch]:
        limbs, n = Q.merged(held)
        limbs, n = limbs[n >= least], n[n >= least]
        for a in range(0, len(n), BLOCK):
            ids = Q.restored(Q.unpacked(limbs[a : a + BLOCK], k, bits), bits)
            named = [x if known is None else known.value[x.astype(np.int64) - 1] for x in ids]
            flat = pa.array(np.stack(named, 1).ravel().view(np.int64))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(ids[0]) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([words, pa.array(n[a : a + BLOCK]), pa.array(_marks(ids).view(np.int64))], ["words", "n", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Q.Counts] = []
        size, current = 0, None
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if place != current and held:
                    yield from answer(held)
                    held, size = [], 0
                current = place
                held.append(Q.from_bytes(data.as_buffer()))
                size += len(held[-1].n)
                if size > RANGE:
                    held = [Q.merged(held)]
                    size = 0
        if held:
            yield from answer(held)

    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(run, _GRAMS)


def _known(rows: DataFrame, column: str, bound: int) -> np.ndarray | None:
    """All values of a column of hashes, sorted, if no more than ``bound`` rows hold them."""
    if rows.count() > bound:
        return None
    return np.unique(rows.select(column).toPandas()[column].to_numpy(np.int64).view(np.uint64))


def _exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in whole numbers of up to 38 digits."""
    wide = "decimal(19,0)"
    above = F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(15,0)") * n.cast(wide)
    return F.call_function("div", above, left.cast(wide) * right.cast(wide))


def mine(
    docs: DataFrame, *, least: int = 100, longest: int = 5, share: int = 100, first: int = 2000,
    text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY,
) -> DataFrame:
    """The ``first`` best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts, A-Z lower-cased, are split into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs.  A phrase has 2 to ``longest`` words
    of one piece and is seen ``a`` >= ``least`` times, overlaps included.  Of
    its cuts in two, that with the lowest floor(1000 a n / (l r)) counts (the
    earliest of equal ones): ``l`` and ``r`` are the counts of the two parts, ``n``
    that of all words of the language.  A phrase goes if a longer one that
    contains it is seen at least ``share`` percent as often.  Ranked by score,
    then ``a``, descending, then by the phrase's bytes.

    A null text is empty, a null language is ``und``; a row that repeats counts
    again.  Without phrases, as for an empty table, there are no rows.  Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    tongue = F.coalesce(F.col(lang), F.lit("und"))
    read = docs.select(tongue.alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(tongue).alias("key"))
    counted, seed = _vocabulary(read, least)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    common = stage(counted.filter(F.col("n") >= least).select("lang", "word", "hash", "n"), "frequent-words")
    table = _known(common, "hash", dictionary)
    known = None if table is None else spark.sparkContext.broadcast(table)
    bits, kind = (64, np.uint64) if table is None else (max(1, len(table).bit_length()), np.uint32)
    words = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = [common.select(F.array("hash").alias("words"), "n")]
    if table is None or len(table):
        coded = stage(_id_rows(read, known, seed, longest - 1), "word-ids")
        frequent = None
        for k in range(2, longest + 1):
            top = min(k * bits, max(LEAST_RANGES, int(words // RANGE).bit_length()))
            made = _merged(_filters(coded, kind, bits, k, frequent, top), known, bits, k, least)
            made = stage(made, "phrases")
            levels.append(made.select("words", "n"))
            marks = _known(made, "mark", dictionary)
            if marks is not None and not len(marks):
                break
            frequent = None if marks is None else spark.sparkContext.broadcast(marks)
    phrases = levels[1] if len(levels) > 1 else spark.createDataFrame([], _GRAMS).select("words", "n")
    for more in levels[2:]:
        phrases = phrases.unionByName(more)
    best = _scored(phrases, phrases.unionByName(levels[0]), common, totals)
    best = stage(_without_parts(best, phrases, share), "scored-phrases")
    return _ranked(_spelled(best, common), first)


def _scored(phrases: DataFrame, parts: DataFrame, common: DataFrame, totals: DataFrame) -> DataFrame:
    """(words, lang, a, l, r, n, score) by each phrase's lowest cut."""
    tongues = common.select(F.col("hash").alias("head"), "lang").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    own = join_dimension(phrases.withColumn("head", F.element_at("words", 1)), stage(tongues, "word-languages"), ["head"])
    cuts = own.select("words", "lang", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("at"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("at")), "right": F.slice("words", F.col("at") + 1, F.size("words"))})
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    scored = cuts.withColumn("score", _exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("words", "lang", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("best"))
    return best.select("words", "lang", "a", "best.l", "best.r", "n", "best.score")


def _without_parts(scored: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """The phrases that no longer one nearly always contains."""
    size = F.size("words")
    places = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda at: F.slice("words", at, k)),
    ))
    inner = phrases.filter(size > 2).select("n", F.explode(places).alias("words")).groupBy("words").agg(F.max("n").alias("around"))
    met = scored.join(inner, "words", "left")
    return met.filter(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(share) * F.col("a"))).drop("around")


def _spelled(scored: DataFrame, common: DataFrame) -> DataFrame:
    """``scored`` with the phrase in letters in place of the words' hashes."""
    each = scored.select("words", F.posexplode("words").alias("at", "hash"))
    each = join_dimension(each, common.select("hash", "word"), ["hash"])
    told = each.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("told"))
    told = told.select("words", F.array_join(F.transform("told", itemgetter("word")), " ").alias("phrase"))
    return scored.join(told, "words").drop("words")


def _ranked(rows: DataFrame, first: int) -> DataFrame:
    """The first rows of each language; parts of a language are cut to that many before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = F.row_number()
    few = salted.withColumn("rank", place.over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    last = few.withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
