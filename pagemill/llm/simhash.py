"""Near-duplicate groups by 64-bit SimHash, found with tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.operators.scale import join_dimension, stage, unsized, unused

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CELL = 16  # fingerprints in a cell beyond which neighbours are enumerated instead of compared
_STEP = 1 << 16

# Reference fingerprints: one base, the base with one of its 16 half-bytes inverted, and some unrelated ones.
BASE = 0x5A17C3E98B264DF0
BLOCKS = [BASE ^ (0xF << (4 * j)) for j in range(16)]
OTHERS = [xxhash.xxh64_intdigest(str(j), 7) for j in range(15)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """Words in runs of bounded size, cut between words."""
    at, size = 0, 1 << 22
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text.

    Words are runs of other than ASCII white space, A-Z lower-cased; all
    shingles count as often as they occur; fewer words than a shingle make one
    of them all.  Null or no words: zero.
    """
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for run in _word_runs((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + run
        for at in range(0, max(0, len(words) - shingle + 1), _STEP):
            part = words[at : at + _STEP + shingle - 1]
            joined = map(b" ".join, zip(*[part[j:] for j in range(shingle)]))
            hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
            n += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(texts: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint column, as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_signed(fingerprint(t, shingle)) for t in batch], dtype="int64")

    return run(texts)


def _apart(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)).cast("long") if isinstance(b, int) else b))


def cells(distinct: DataFrame) -> DataFrame:
    """Place fingerprints ``fp`` in the cells of the distance table: rows (cell, fp).

    The distances to the base and to a base with half-byte j inverted differ by
    4 - 2 c, where c counts the bits by which the fingerprint differs from the
    base in that half-byte.  Fingerprints at most two bits apart have counts
    that differ by two in all at most, so they share their own cell or one that
    a single count, moved by one, leads to.
    """
    base = _apart(F.col("fp"), BASE)
    counts = [((base - _apart(F.col("fp"), b) + 4) / 2).cast("long") for b in BLOCKS]
    own = sum((c * 5**j for j, c in enumerate(counts)), F.lit(0).cast("long"))
    table = distinct.select("fp", F.array(*counts).alias("c"), own.alias("own"))
    near = [F.col("own")]
    for j in range(16):
        near.append(F.when(F.col("c")[j] < 4, F.col("own") + F.lit(5**j)))
        near.append(F.when(F.col("c")[j] > 0, F.col("own") - F.lit(5**j)))
    return table.select("fp", F.explode(F.array(*near)).alias("cell")).filter("cell is not null")


def _within_pivots(a: Column, b: Column, bits: int) -> Column:
    """True unless some reference's distances differ by more than ``bits``: then the pair cannot be near."""
    gaps = [F.abs(_apart(a, p) - _apart(b, p)) for p in [BASE, *BLOCKS, *OTHERS]]
    return F.greatest(*gaps) <= bits


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``bits`` (0 to 2) apart.

    Pairs come from shared cells, lose those with too large a coordinate
    difference and are verified by their Hamming distance.  In a crowded cell
    no pairs are formed: each fingerprint names all values one bit from it, and
    those naming the same value, 65 at most, are linked to their smallest;
    these links are verified as well, and where only nearer ones count the
    value itself must be one of them.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the cells serve distances of 0 to 2 bits")
    placed = cells(distinct)
    crowded = stage(
        placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select("cell"), "cells"
    )
    free = placed.join(crowded, "cell", "left_anti")
    pairs = (
        free.withColumnRenamed("fp", "a")
        .join(unsized(free.withColumnRenamed("fp", "b")), "cell")
        .filter(F.col("a") < F.col("b"))
        .filter(_within_pivots(F.col("a"), F.col("b"), bits))
        .filter(_apart(F.col("a"), F.col("b")) <= bits)
        .select("a", "b")
        .distinct()
    )
    members = placed.join(crowded, "cell", "left_semi").select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << j)).cast("long")) for j in range(64)]
    named = members.select("fp", F.explode(F.array(*near)).alias("value"))
    if bits == 2:
        least = named.groupBy("value").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    else:
        least = members.select(F.col("fp").alias("value"), F.col("fp").alias("b"))
    dense = named.join(unsized(least), "value").select(F.col("fp").alias("a"), "b").filter("a != b")
    return pairs.union(dense.filter(_apart(F.col("a"), F.col("b")) <= bits).distinct())


def near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = MAX_BITS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id that can be reached over links of at
    most ``bits`` differing bits.  Null and empty texts have fingerprint zero
    and link like any other; repeated rows are answered row by row; null ids
    belong to a component but never name it (a component of null ids only has
    null).  Other columns, whatever their names, are not read.  No rows give
    no rows.
    """
    marked = stage(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp")), "fingerprints")
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = _rooted(groups, bits)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = rooted.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(answer, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _rooted(groups: DataFrame, bits: int) -> DataFrame:
    """Distinct fingerprints ``fp`` with the ``root`` of their component."""
    roots = stage(connected_components(links(groups.select("fp"), bits)).select(F.col("node").alias("fp"), "root"), "roots")
    return groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs`` less all but one row of each near-duplicate group.

    The row of the smallest id stays, with all its columns, in any group; a null
    id comes after all others, and of several rows with that id in one group, the one
    of the smallest fingerprint and content hash stays.  An id that stands in several groups
    is judged in each.  Texts of groups of one row are not shuffled.
    """
    key = [F.xxhash64(F.lit(i), doc_id, text).alias(f"k{i}") for i in (1, 2)]
    marked = stage(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp"), *key), "fingerprints")
    rooted = marked.join(_rooted(marked.groupBy("fp").agg(F.lit(1)).select("fp"), bits), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "k1", "k2")
    groups = stage(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1").drop("n"), "groups")
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    told = rooted.join(groups, "root").groupBy("k1", "k2", stays.alias("stays")).agg(F.count(F.lit(1)).alias("n"))
    told = stage(told.filter("not stays or n > 1").drop("n"), "duplicates")
    names = {c: unused(docs, f"_{c}") for c in ("k1", "k2", "stays")}
    judged = join_dimension(
        docs.withColumns({names["k1"]: key[0], names["k2"]: key[1]}), told.withColumnsRenamed(names), [names["k1"], names["k2"]], "left"
    )
    kept = judged.filter(F.col(names["stays"]).isNull())
    if told.filter("stays").limit(1).count():  # rows alike in id and text
        kept = kept.unionByName(judged.filter(F.col(names["stays"])).dropDuplicates([names["k1"], names["k2"]]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
