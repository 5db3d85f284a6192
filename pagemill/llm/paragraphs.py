"""Repeated passages: MinHash banding of paragraphs, exact Jaccard checks, removal by components.

Paragraphs are the lines of a text.  Because passages are also pasted into the
middle of lines, where no line resembles another, runs of LENGTH words count as
paragraphs too, beginning where the content says so: at the smallest three-word
hash among any GAP neighbouring places.  Copies of a run of GAP + LENGTH - 1 =
50 words hold the same such run, wherever they stand.  Runs overlap, and a run
shifted by a word resembles its neighbour, so runs have no bands: only equal ones meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.llm.components import connected_components
from pagemill.operators.scale import join_dimension, stage, unsized, unused

SHINGLE = 5
SIMILARITY = 0.8
LENGTH = 24  # words of a paragraph inside a line, and the fewest of a line
GAP = 27
REACH = GAP - 1  # words of a copied passage that can lie beyond its first or last run
BANDS, ROWS = 6, 2  # of lines: two with Jaccard 0.8 meet with probability 0.998
BUCKET = 16  # contents under a band beyond which its pairs are not written out
BLOCK = 1 << 18  # shingles of a crowded band that are searched at once; larger bands are split first
_ODD = [int(x) | 1 for x in W.mix(np.arange(1, 65, dtype=np.uint64))]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors(text: np.ndarray, values: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word places at which paragraphs inside lines begin: content-defined ones, each text's first and its last."""
    usable = sizes >= LENGTH
    found = [heads[usable], (heads + sizes - LENGTH)[usable]]
    n = len(values) - GAP + 1
    if n > 0:
        place = np.arange(len(values), dtype=np.uint64)
        low = _sliding_min((values >> np.uint64(24) << np.uint64(24)) | place, GAP)
        group = np.repeat(np.arange(len(heads)), sizes)
        end = (heads + sizes - LENGTH)[group]  # last place of the text at which a paragraph fits
        first = np.arange(n)
        found.append((low[first + GAP - 1 <= end[:n]] & np.uint64((1 << 24) - 1)).astype(np.int64))
    return np.unique(np.concatenate(found))


def _block(parts: list[tuple[int, int, str]]) -> pd.DataFrame:
    """Paragraphs of a block: text number, start, end, content hash and band keys."""
    joined = "\n".join([p for _, _, p in parts])
    points = W.codepoints(joined)
    hashes, start, end = W.hashed_words(points)
    first = np.zeros(len(parts), np.int64)
    first[1:] = np.cumsum([len(p) + 1 for _, _, p in parts])[:-1]
    part = np.searchsorted(first, start, "right") - 1
    frames = []
    if len(hashes):
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[heads, len(part)])
        flat = np.zeros(len(hashes), np.int64)
        grams = [np.zeros(0, np.uint64)] * 2
        for i, size in enumerate((3, SHINGLE)):
            grams[i] = W.shingles(W.Words(flat, hashes, start, end), size)[0]
        at = _anchors(part, np.r_[grams[0], np.full(2, ~np.uint64(0))][: len(hashes)], heads, sizes)
        if len(at):
            run = W.shingles(W.Words(flat, hashes, start, end), LENGTH)[0][at]
            frames.append((at, at + LENGTH, run, [np.zeros(0, np.uint64)] * len(at)))
        breaks = np.flatnonzero(points == 10)
        line = np.searchsorted(breaks, start)
        at = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        stop = np.r_[at[1:], len(line)]
        long = stop - at >= LENGTH
        at, stop = at[long], stop[long]
        if len(at):
            inside = np.stack([at, stop - SHINGLE + 1], 1).ravel()
            low = [np.minimum.reduceat(np.r_[grams[1] * np.uint64(m), [~np.uint64(0)] * SHINGLE], inside)[::2] for m in _ODD[: BANDS * ROWS]]
            keys = [W.mix(low[b * ROWS] + W.mix(low[b * ROWS + 1] + np.uint64(b + 1))) for b in range(BANDS)]
            sums = np.cumsum(np.r_[[np.uint64(0)], W.mix(hashes)])
            order = np.cumsum(np.r_[[np.uint64(0)], W.mix(grams[1])])
            content = W.mix(sums[stop] - sums[at] + W.mix(order[stop - SHINGLE + 1] - order[at] + grams[1][at]))
            frames.append((at, stop, content, list(np.stack(keys, 1))))
    out = []
    for at, stop, content, keys in frames:
        shift = np.array([o for _, o, _ in parts], np.int64)[part[at]] - first[part[at]]
        number = np.array([n for n, _, _ in parts])[part[at]]
        out.append(pd.DataFrame({"text": number, "start": start[at] + shift, "end": end[stop - 1] + shift, "content": content.view(np.int64), "keys": [k.view(np.int64) for k in keys]}))
    return pd.concat(out) if out else pd.DataFrame()


def paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc, doc_id, start, end, content, keys) of all paragraphs; ``doc`` names a document by id and text."""
    rows = docs.select(F.xxhash64(doc_id, text).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for parts in W.parts(list(batch["text"])):
                found = _block(parts)
                if len(found):
                    found = found.drop_duplicates(["text", "start", "end"])
                    place = found.pop("text").to_numpy()
                    found["doc"], found["doc_id"] = batch["doc"].to_numpy()[place], batch["doc_id"].array[place]
                    yield found[["doc", "doc_id", "start", "end", "content", "keys"]]

    kind = dict(docs.dtypes)[doc_id]
    return rows.mapInPandas(run, f"doc long, doc_id {kind}, start long, end long, content long, keys array<long>")


def _texts_of(docs: DataFrame, places: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc, text, ...): the texts of the documents that ``places`` names, the only ones that are shuffled."""
    named = docs.select(F.xxhash64(doc_id, text).alias("doc"), F.col(text).alias("text"))
    return join_dimension(named, places.select("doc"), ["doc"], "left_semi").join(places, "doc")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(content, shingles): the distinct shingle hashes of one occurrence of each wanted content."""
    places = wanted.groupBy("doc").agg(F.collect_list(F.struct("content", "start", "end")).alias("places"))
    rows = _texts_of(docs, stage(places, "passages-read"), text, doc_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for whole, places in zip(batch["text"], batch["places"]):
                for p in places:
                    hashes, first, last = W.hashed_words(W.codepoints(whole[p["start"] : p["end"]]))
                    grams, _ = W.shingles(W.Words(np.zeros(len(hashes), np.int64), hashes, first, last), SHINGLE)
                    out.append((p["content"], np.unique(grams).view(np.int64)))
            yield pd.DataFrame(out, columns=["content", "shingles"])

    return rows.mapInPandas(run, "content long, shingles array<long>").dropDuplicates(["content"])


def _forest(names: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all members whose Jaccard similarity is SIMILARITY or more, directly or over others.

    Every member is compared with all that are not yet joined to it.  Two sets
    that are similar share one of the rarest members of each (prefix filter), so
    only sets with such a one in common are counted through.
    """
    sizes = np.array([len(x) for x in sets])
    heads = np.r_[0, np.cumsum(sizes)]
    _, flat, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((flat, df[flat], owner))
    place = np.arange(len(flat)) - heads[owner]  # in the order of rarity, within the set
    rare = order[place < (sizes - np.ceil(SIMILARITY * sizes - 1e-9) + 1)[owner]]
    prefix, of = flat[rare], owner[rare]
    starts = np.searchsorted(of, np.arange(len(sets) + 1))
    by = np.argsort(prefix, kind="stable")
    posted, bounds = of[by], np.searchsorted(prefix[by], np.arange(len(df) + 1))
    free, marked, out = np.ones(len(sets), bool), np.zeros(len(df), bool), []
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], waiting = False, [first]
        while waiting and free.any():
            one = waiting.pop()
            near = np.unique(np.concatenate([posted[bounds[t] : bounds[t + 1]] for t in prefix[starts[one] : starts[one + 1]]]))
            near = near[free[near]]
            near = near[np.minimum(sizes[near], sizes[one]) >= SIMILARITY * np.maximum(sizes[near], sizes[one]) - 1e-9]
            if not len(near):
                continue
            mine = flat[heads[one] : heads[one + 1]]
            marked[mine] = True
            both = np.array([np.count_nonzero(marked[flat[heads[i] : heads[i + 1]]]) for i in near])
            marked[mine] = False
            met = near[both >= SIMILARITY * (sizes[near] + sizes[one] - both)]
            free[met] = False
            waiting.extend(met.tolist())
            out.extend((int(names[one]), int(names[i])) for i in met)
    return out


def _crowded(bands: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) that join all similar contents of each band (content, key, n, weight), in pairs of blocks."""
    n = F.ceil(F.col("weight") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("content"), n).cast("int")
    dealt = bands.select("content", "key", n.alias("blocks"), own.alias("own"))
    # a band of one block meets itself; with more, any two blocks meet, and so the contents of each
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own"))
    ))
    dealt = dealt.withColumn("other", other).select(
        "content", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("content")
        found = _forest(group["content"].to_numpy(), list(group["shingles"]))
        return pd.DataFrame(found, columns=["a", "b"])

    return unsized(dealt).join(sets, "content").groupBy("key", "low", "high").applyInPandas(run, "a long, b long").distinct()


def _near(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Verified links (a, b) between different contents that share a band."""
    lines = found.filter(F.size("keys") > 0)
    banded = lines.select("content", F.explode("keys").alias("key"))
    mixed = banded.groupBy("key").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low != high")
    mixed = stage(mixed.select("key"), "bands")
    shared = stage(banded.join(mixed, "key", "left_semi").distinct(), "banded")
    one = F.min(F.struct("doc", "start", "end")).alias("at")
    wanted = lines.join(stage(shared.select("content").distinct(), "contents"), "content", "left_semi")
    wanted = wanted.groupBy("content").agg(one).select("content", "at.*")
    sets = stage(_shingle_sets(docs, wanted, text, doc_id), "shingle-sets")
    held = shared.join(sets.select("content", F.size("shingles").alias("size")), "content")
    size = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    sized = stage(shared.join(size, "key"), "sized-bands")
    wide = sized.filter((F.col("n") > BUCKET) & (F.col("weight") > BLOCK)).select("content", "key").join(sets, "content")

    def lowest(seed: int):
        # the seed is no parameter of the lambda: as a second one it would be given the place in the array
        return F.array_min(F.transform("shingles", lambda x: F.xxhash64(x, F.lit(seed))))

    finer = [F.xxhash64("key", F.lit(b), *[lowest(b * 3 + r) for r in range(3)]) for b in range(2 * BANDS)]
    split = wide.select("content", F.size("shingles").alias("size"), F.explode(F.array(*finer)).alias("key")).distinct()
    split = stage(split, "finer-bands")
    split_size = split.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    split = stage(split.drop("size").join(split_size.filter("n > 1"), "key"), "sized-finer-bands")
    every = sized.filter((F.col("n") <= BUCKET) | (F.col("weight") <= BLOCK)).unionByName(split)
    few = every.filter((F.col("n") <= BUCKET) & (F.col("n") > 1)).select("content", "key")
    pairs = few.select(F.col("content").alias("a"), "key").join(few.select(F.col("content").alias("b"), "key"), "key").filter("a < b")
    pairs = stage(pairs.select("a", "b").distinct(), "passage-pairs")
    left, right = (sets.select(F.col("content").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb") - both
    linked = pairs.join(left, "a").join(right, "b").filter(both >= SIMILARITY * whole).select("a", "b")
    return linked.union(_crowded(every.filter(F.col("n") > BUCKET), sets))


def repeated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Occurrences of every passage that occurs more than once.

    Rows (doc, doc_id, start, end, component_id, kept_doc_id, kept_start,
    removed): code points of the paragraph in its text, the class of paragraphs
    linked by a Jaccard similarity of 0.8 or more over five-word shingles, and
    the one occurrence that stays, that of the smallest (doc_id, doc, start),
    null ids last; all others are ``removed``.  A passage of 50 words is always
    found.  Null and empty texts, and lines and texts of fewer than 24 words, have no
    paragraphs.  Rows equal in id and text are copies of one document: they repeat
    nothing of each other, and each has its rows.
    """
    found = stage(paragraphs(docs, text, doc_id), "paragraphs")
    links = stage(_near(docs, found, text, doc_id), "passage-links")
    roots = stage(connected_components(links).select(F.col("node").alias("content"), "root"), "passage-roots")
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "start", "end"))
    place = F.struct("doc", "start", "end")
    alike = found.groupBy("content").agg(kept.alias("kept"), (F.min(place) != F.max(place)).alias("again"))
    classes = stage(
        alike.join(roots, "content", "left").filter("again or root is not null").withColumn("root", F.coalesce("root", "content")),
        "passage-classes",
    )
    keepers = classes.groupBy("root").agg(F.min("kept").alias("kept"))
    answer = classes.select("content", "root").join(keepers, "root")
    rows = found.drop("keys").join(stage(answer, "passage-keepers"), "content")
    stays = (F.col("doc") == F.col("kept.doc")) & (F.col("start") == F.col("kept.start")) & (F.col("end") == F.col("kept.end"))
    return rows.select(
        "doc", "doc_id", "start", "end", F.col("root").alias("component_id"),
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), (~stays).alias("removed"),
    )


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, the marks that end them and the white space after those."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        while end < len(text) and not text[end].isspace() and not text[end].isalnum():
            end += 1
        while end < len(text) and text[end].isspace():
            end += 1
        out.append(text[at : max(at, start)])
        at = end
    return "".join(out) + text[at:]


def _around(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per span up to REACH words before and after it, nearest first: hashes and starts, hashes and ends."""
    whole = W.hashed_words(W.codepoints(text)) if len(text) <= W.BLOCK else None
    for start, end in spans:
        low, high = (0, len(text)) if whole else (max(0, start - W.OVERLAP), min(len(text), end + W.OVERLAP))
        hashes, first, last = whole or W.hashed_words(W.codepoints(text[low:high]))
        short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
        i, j = np.searchsorted(first, [start - low, end - low])
        # a word cut by the window's edge is left out
        before = slice(max(int(low > 0), i - REACH), i)
        after = slice(j, min(j + REACH, len(first) - int(high < len(text))))
        yield short[before][::-1], first[before][::-1] + low, short[after], last[after] + low


def _edges(docs: DataFrame, stays: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(component_id, before, after): hashes of the words around the occurrence of each class that stays, as 32-bit numbers in bytes."""
    places = stays.groupBy("doc").agg(F.collect_list(F.struct("component_id", "start", "end")).alias("places"))
    flat = [F.col(f"places.{c}").alias(c) for c in ("component_id", "start", "end")]
    rows = _texts_of(docs, stage(places.select("doc", *flat), "passages-kept"), text, doc_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for whole, names, starts, ends in zip(batch["text"], batch["component_id"], batch["start"], batch["end"]):
                around = _around(whole, list(zip(starts.tolist(), ends.tolist())))
                out = [(name, before.tobytes(), after.tobytes()) for name, (before, _, after, _) in zip(names, around)]
                yield pd.DataFrame(out, columns=["component_id", "before", "after"])

    return rows.mapInPandas(run, "component_id long, before binary, after binary").dropDuplicates(["component_id"])


def _extended(text: str, spans: list[tuple[int, int]], before: list[bytes], after: list[bytes]) -> list[tuple[int, int]]:
    """The spans with the words on either side that equal those beside the occurrence that stays."""

    def same(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        return int(np.argmin(np.r_[a[:n] == b[:n], False]))

    out = []
    for (start, end), kept_before, kept_after, (own_before, starts, own_after, ends) in zip(spans, before, after, _around(text, spans)):
        left, right = same(own_before, np.frombuffer(kept_before, np.int32)), same(own_after, np.frombuffer(kept_after, np.int32))
        out.append((int(starts[left - 1]) if left else start, int(ends[right - 1]) if right else end))
    return out


def remove(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut from their texts, save the occurrence that stays.

    A cut reaches as far as the words on either side equal those beside the occurrence that stays.
    No row is lost, though a text may become empty; columns are as they were,
    but for ``length``, where there is such a column, which is set to the new length of a cut text.
    """
    rows = stage(repeated(docs, text=text, doc_id=doc_id).select("doc", "start", "end", "component_id", "removed").distinct(), "passages")
    edges = stage(_edges(docs, rows.filter("not removed"), text, doc_id), "passage-edges")
    spans = rows.filter("removed").join(edges, "component_id")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "before", "after")).alias("spans"))
    fields = ("start", "end", "before", "after")
    names = {c: unused(docs, f"_{c}") for c in ("doc", "cut", *fields)}
    cuts = stage(spans.select(F.col("doc").alias(names["doc"]), *[F.col(f"spans.{c}").alias(names[c]) for c in fields]), "passage-cuts")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, starts, ends, before, after in batches:
            made = []
            for whole, a, b, *around in zip(texts, starts, ends, before, after):
                made.append(_cut(whole, _extended(whole, list(zip(a.tolist(), b.tolist())), *around)))
            yield pd.Series(made)

    # texts without a cut are not shuffled, as long as the names of those with one are few enough to be told
    marked = docs.withColumn(names["doc"], F.xxhash64(doc_id, text))
    marked = join_dimension(marked, cuts.select(names["doc"], F.lit(True).alias(names["cut"])), [names["doc"]], "left")
    touched = marked.filter(names["cut"]).join(cuts, names["doc"])
    touched = touched.withColumn(text, cut(F.col(text), *[F.col(names[c]) for c in fields]))
    if length in docs.columns:
        touched = touched.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    columns = [f"`{c}`" for c in docs.columns]
    return marked.filter(F.col(names["cut"]).isNull()).select(*columns).unionByName(touched.select(*columns))
