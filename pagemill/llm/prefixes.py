"""Prefix trie of conversations that are rebuilt from the head of one and the rest of another.

No rebuilt text is ever made.  A turn is known by a hash and by its place in
its conversation; a sequence of turns by the sum of its hashes times the powers
of a base, modulo primes.  Such fingerprints form a monoid: the fingerprint of
a head followed by a rest is that of the head plus that of the rest, moved to
its new place by a power, so the fingerprints of all prefixes of a rebuilt
conversation follow from those of the two conversations that it is made of.

Prefixes of one depth and fingerprint are one node.  That they are equal is
verified: their parents must have one fingerprint and their last turns one
hash, and turns of one hash, looked up where they are stored, one role and text.
If a check fails, everything is done again under another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.scale import join_dimension, number_rows, stage

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # the largest below 2^31
BITS = 12  # of the number of turns, or conversation ids, whose sums or texts are made at once
PERIOD = 20  # a conversation's head is taken from the last one whose id this divides
HEADS = 4  # a head has fewer turns than this
SEEDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def _bases(seed: int) -> list[int]:
    rng = np.random.default_rng(seed)
    return [int(rng.integers(1 << 20, p - 1)) for p in PRIMES]


def powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to the power of each exponent, modulo ``prime``."""
    out, rest = np.ones(len(exponents), np.int64), exponents.astype(np.int64).copy()
    while rest.any():
        out = np.where(rest & 1, out * base % prime, out)
        base, rest = base * base % prime, rest >> 1
    return out


def head_length(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from another one."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, at, h1, h2, words): turns numbered from 1 in each conversation."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # role and text decide between turns of one number, and are carried for those alone
    tied = rows.groupBy("conv_id", "told", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = join_dimension(rows, stage(tied.withColumn("tied", F.lit(True)), "tied-turns"), ["conv_id", "told", "turn"], "left")
    narrow = marked.select(
        "conv_id", "told", "turn", F.when(F.col("tied"), F.col("role")).alias("tied_role"), F.when(F.col("tied"), F.col("text")).alias("tied_text"),
        *_hashes(seed), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["told", "turn", "tied_role", "tied_text"]
    return number_rows(narrow, ["conv_id"], order, "at").select("conv_id", "at", "h1", "h2", "words")


def _hashes(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + i), "role", "text").alias(f"h{i}") for i in (1, 2)]


def _colliding(conversations: DataFrame, seed: int) -> bool:
    """Whether turns of different role or text have one hash; only turns whose hash repeats are read."""
    rows = conversations.filter("conv_id is not null").select(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select(*_hashes(seed), "role", "text")
    again = stage(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-turns")
    told = F.struct("role", "text")
    met = join_dimension(rows, again, ["h1", "h2"], "left_semi")
    return met.groupBy("h1", "h2").agg((F.min(told) != F.max(told)).alias("differ")).filter("differ").limit(1).count() > 0


def _prefix_sums(turns: DataFrame, seed: int) -> DataFrame:
    """``turns`` with each turn's own share (c0..c3) and the fingerprint of the turns up to it (s0..s3)."""
    bases = _bases(seed)

    @F.pandas_udf("c0 long, c1 long, c2 long, c3 long", F.PandasUDFType.SCALAR)
    def shares(h1, h2, at):
        hashes, place = [x.to_numpy(np.int64).view(np.uint64) for x in (h1, h1, h2, h2)], at.to_numpy()
        out = {}
        for i, (h, base, p) in enumerate(zip(hashes, bases, PRIMES)):
            out[f"c{i}"] = (h % np.uint64(p)).astype(np.int64) * powers(base, p, place) % p
        return pd.DataFrame(out)

    cs, names = [f"c{i}" for i in range(len(PRIMES))], [f"s{i}" for i in range(len(PRIMES))]
    shared = turns.withColumn("c", shares("h1", "h2", "at")).select("*", "c.*").drop("c")
    blocked = stage(shared.withColumn("block", F.shiftright(F.col("at") - 1, BITS)), "turn-shares")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation of one block, as nearly all are, has nothing to add
    totals = blocked.groupBy("conv_id", "block").agg(*[F.pmod(F.sum(c), F.lit(p)).alias(c) for c, p in zip(cs, PRIMES)])
    many = totals.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id")
    starts = totals.join(many, "conv_id").select("conv_id", "block", *[F.sum(c).over(earlier).alias(f"o{c}") for c in cs]).filter("oc0 is not null")
    within = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumns({s: F.sum(c).over(within) for s, c in zip(names, cs)})
    placed = join_dimension(summed, stage(starts, "block-starts"), ["conv_id", "block"], "left")
    whole = {s: F.pmod(F.col(s) + F.coalesce(f"oc{i}", F.lit(0)), F.lit(p)) for i, (s, p) in enumerate(zip(names, PRIMES))}
    return placed.withColumns(whole).select("conv_id", "at", "h1", "h2", "words", *cs, *names)


def _two(values: list[Column]) -> list[Column]:
    """Four residues as the two numbers of a fingerprint."""
    return [values[i] * F.lit(1 << 31) + values[i + 1] for i in (0, 2)]


def _members(sums: DataFrame, seed: int) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, h1, h2, words, last): every prefix of every rebuilt conversation.

    ``a`` and ``b`` are its fingerprint, ``pa`` and ``pb`` that of the prefix one turn shorter;
    the hashes and words are those of its last turn.
    """
    names = [f"s{i}" for i in range(len(PRIMES))]
    head = F.when(F.col("at") < HEADS, F.struct("at", *names, "h1", "h2", "words"))
    heads = F.array_sort(F.array_compact(F.collect_list(head))).alias("heads")
    convs = stage(sums.groupBy("conv_id").agg(F.max("at").alias("own_length"), heads), "conversation-heads")
    bases = convs.filter(F.col("conv_id") % PERIOD == 0).select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    taken = F.least("h", F.coalesce(F.size("base_heads"), F.lit(0)))
    built = convs.withColumns({"h": head_length(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % PERIOD}).join(bases, "base", "left")
    built = built.withColumn("base_heads", F.coalesce("base_heads", F.array().cast(convs.schema["heads"].dataType))).withColumn("taken", taken)
    at = lambda array, place, s: F.coalesce(F.try_element_at(array, F.nullif(place, F.lit(0)))[s], F.lit(0))
    built = built.withColumns({
        **{f"own{i}": at(F.col("heads"), F.col("h"), s) for i, s in enumerate(names)},
        **{f"from{i}": at(F.col("base_heads"), F.col("taken"), s) for i, s in enumerate(names)},
        "length": F.col("taken") + F.greatest(F.col("own_length") - F.col("h"), F.lit(0)),
    })
    built = stage(built.drop("base", "heads", "own_length"), "rebuilt")
    columns = ["conv_id", "depth", "a", "b", "pa", "pb", "h1", "h2", "words", "last"]

    def row(frame: DataFrame, depth: Column, own: list[Column], parent: list[Column], turn: list[Column]) -> DataFrame:
        a, b, pa, pb = [*_two(own), *_two(parent)]
        return frame.select("conv_id", depth.cast("long"), a, b, pa, pb, *turn, depth == F.col("length")).toDF(*columns)

    none = [F.lit(0).cast("long")] * len(PRIMES)
    roots = row(built, F.lit(0), none, none, [F.lit(0).cast("long")] * 3)
    first = built.filter("taken > 0").withColumn("d", F.explode(F.sequence(F.lit(1), F.col("taken"))))
    turn = F.element_at("base_heads", F.col("d"))
    before = [at(F.col("base_heads"), F.col("d") - 1, s) for s in names]
    first = row(first, F.col("d"), [turn[s] for s in names], before, [turn[c] for c in ("h1", "h2", "words")])
    # a rest that moves to the front by some turns is divided by that power of the base
    moved = F.col("h") - F.col("taken")
    own, parent = [], []
    for i, (base, p) in enumerate(zip(_bases(seed), PRIMES)):
        back = F.element_at(F.array(*[F.lit(pow(base, -k, p)).cast("long") for k in range(HEADS)]), moved + 1)
        own.append(F.pmod(F.col(f"from{i}") + F.pmod(F.col(f"s{i}") - F.col(f"own{i}"), F.lit(p)) * back, F.lit(p)))
        parent.append(F.pmod(own[i] - F.pmod(F.col(f"c{i}") * back, F.lit(p)), F.lit(p)))
    rest = sums.join(built.drop("base_heads"), "conv_id").filter("at > h")
    rest = row(rest, F.col("taken") + F.col("at") - F.col("h"), own, parent, [F.col(c) for c in ("h1", "h2", "words")])
    return roots.unionByName(first).unionByName(rest)


def _nodes(members: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes (depth, a, b) with their members counted, and whether every node's members are proved equal."""
    same = ["pa", "pb", "h1", "h2", "words"]
    found = members.groupBy("depth", "a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"max_{c}") for c in same],
    )
    found = stage(found, "prefix-nodes")
    alike = found.filter(" or ".join(f"{c} <> max_{c}" for c in same)).limit(1).count() == 0
    return found.drop(*[f"max_{c}" for c in same]), alike


def _subtree_sums(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens).

    What a node adds stands at its smallest member, at its depth.  The sum over
    a subtree is then the sum, over the members of its top, of what stands at
    that depth or deeper: no walk over the levels of the trie.
    """
    value = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    met = members.select("conv_id", "depth", "a", "b").join(value.filter("leaf > 0 or saved > 0"), ["conv_id", "depth"], "left")
    met = stage(met.fillna(0, ["leaf", "saved"]).withColumn("block", F.shiftright("depth", BITS)), "member-values")
    totals = met.groupBy("conv_id", "block").agg(F.sum("leaf").alias("later_leaf"), F.sum("saved").alias("later_saved"))
    many = totals.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv_id")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.join(many, "conv_id").select("conv_id", "block", *[F.sum(c).over(later).alias(c) for c in ("later_leaf", "later_saved")])
    below = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = met.withColumns({c: F.sum(c).over(below) for c in ("leaf", "saved")})
    whole = join_dimension(summed, stage(after.filter("later_leaf is not null"), "blocks-below"), ["conv_id", "block"], "left")
    return whole.groupBy("depth", "a", "b").agg(
        F.sum(F.col("leaf") + F.coalesce("later_leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("saved") + F.coalesce("later_saved", F.lit(0))).alias("saved_tokens"),
    )


def _ends(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end.

    Ids are written block by block; a node's blocks pass through the digest one
    after the other, so no list of all its ids is ever held.
    """
    blocks = members.filter("last").groupBy("depth", "a", "b", F.shiftright("conv_id", BITS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    node = ["depth", "a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *key, ids in batch[[*node, "ids"]].itertuples(index=False, name=None):
                if key != current:
                    if current is not None:
                        out.append((*current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=[*node, "ends_sha256"])
        if current is not None:
            yield pd.DataFrame([(*current, digest.hexdigest())], columns=[*node, "ends_sha256"])

    return blocks.repartition(*node).sortWithinPartitions(*node, "block").mapInPandas(run, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    ``conversations`` has (conv_id, turn, role, text).  Turns are ordered by
    number, nulls first, then by role and text; a null role or text is empty.
    Rebuilt conversation c has the first h turns of conversation c - c % 20
    (all, if it has fewer; none, if there is no such one), h being the CRC-32 of
    the id's digits modulo 4, then its own turns after the first h.

    Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), one per distinct sequence of first turns,
    the empty one included.  Rows with a null id belong to no conversation;
    a row that repeats is a turn again.  An empty table has no nodes.  Other
    columns, whatever their names, are not read.
    """
    read = conversations.select("conv_id", "turn", "role", "text")
    for seed in range(SEEDS):
        members = stage(_members(stage(_prefix_sums(_turns(read, seed), seed), "prefix-sums"), seed), "prefix-members")
        nodes, alike = _nodes(members)
        if alike and not _colliding(read, seed):
            return _described(members, nodes)
    raise RuntimeError(f"no seed of {SEEDS} tells the turns apart")


def _described(members: DataFrame, nodes: DataFrame) -> DataFrame:
    node = ["depth", "a", "b"]
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    full = stage(nodes.join(children, node, "left").fillna(0, ["n_children"]), "prefix-tree")
    above = full.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    told = full.join(above, ["depth", "pa", "pb"], "left").join(_subtree_sums(members, full), node).join(_ends(members), node, "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
