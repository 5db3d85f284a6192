"""Token counts that follow edits: only the touched parts of a text are encoded again.

A document carries a segment tree over its pre-tokens.  A leaf covers up to LEAF pre-tokens
and knows its code points and tokens; inner nodes hold sums.  After an
edit, the leaves that it touches, with some context, are encoded anew.  Where a
pre-token begins, what follows does not depend on what went before, so the
counts right of that region stand as soon as its end is such a place again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import bpe

LEAF = 64
CONTEXT = 4  # code points on which the place of a boundary can depend
EDIT = "struct<start:long,end:long,text:string>"

_TREE = [
    T.StructField("leaf_chars", T.ArrayType(T.LongType())),
    T.StructField("leaf_tokens", T.ArrayType(T.LongType())),
    T.StructField("sums", T.ArrayType(T.LongType())),
]


class Tree:
    """Leaves of a text and the token sums above them: node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, sums: np.ndarray | None = None):
        self.chars, self.tokens = chars, tokens
        self.size = 1 << max(0, int(len(chars) - 1).bit_length())
        if sums is None:
            sums = np.zeros(2 * self.size, np.int64)
            sums[self.size : self.size + len(tokens)] = tokens
            at = self.size
            while at > 1:
                sums[at // 2 : at] = sums[at : 2 * at].reshape(-1, 2).sum(1)
                at //= 2
        self.sums = sums

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def prefix(self, leaves: int) -> int:
        """Tokens of the first leaves, from one node per level."""
        out, low, high = 0, self.size, self.size + leaves
        while low < high:
            if high & 1:
                high -= 1
                out += int(self.sums[high])
            if low & 1:
                out += int(self.sums[low])
                low += 1
            low, high = low // 2, high // 2
        return out

    def put(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Replace leaves from ``first`` on and update the sums above them only."""
        last = first + len(chars)
        self.chars[first:last], self.tokens[first:last] = chars, tokens
        low, high = self.size + first, self.size + last - 1
        self.sums[low : high + 1] = tokens
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2].reshape(-1, 2).sum(1)


def _leaves(lengths: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and tokens between the pre-token numbers in ``bounds``."""
    return tuple(np.diff(np.r_[0, np.cumsum(x)][bounds]).astype(np.int64) for x in (lengths, counts))


def grow(codec: bpe.Codec, texts: list[str]) -> list[Tree]:
    """A tree for every text."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for number, counts, lengths in codec.sizes(texts):
        parts[number].append((lengths, counts))
    out = []
    for own in parts:
        lengths, counts = (np.concatenate(x) for x in zip(*own)) if own else (np.zeros(0, np.int64),) * 2
        n = max(1, -(-len(lengths) // LEAF))
        out.append(Tree(*_leaves(lengths, counts, np.minimum(np.arange(n + 1) * LEAF, len(lengths)))))
    return out


def _clean(edits: list[dict] | None, size: int) -> list[tuple[int, int, str]]:
    """Edits in order of place, inside the text and apart from one another."""
    out, at = [], 0
    listed = [(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["text"] or "") for e in edits or [] if e is not None]
    for start, end, text in sorted(listed):
        start = min(max(start, at), size)
        at = min(max(end, start), size)
        out.append((start, at, text))
    return out


def _pretokens(codec: bpe.Codec, region: str, after: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Lengths and token counts of the region's pre-tokens; None if none begins at its end, given what follows."""
    whole = region + after
    if not whole:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts, lengths = (np.concatenate(x) for x in list(zip(*codec.sizes([whole])))[1:])
    ends = np.r_[0, np.cumsum(lengths)]
    stop = int(np.searchsorted(ends, len(region)))
    return (lengths[:stop], counts[:stop]) if ends[stop] == len(region) else None


def edit(codec: bpe.Codec, text: str, tree: Tree, edits: list[dict] | None) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many code points were encoded for it.

    The tree keeps its number of leaves: those of a region share its new
    pre-tokens evenly.  Only when a text has outgrown it, with more than eight LEAFs in a leaf on average, is it grown again.
    """
    todo = _clean(edits, len(text))
    if not todo:
        return text, tree, 0
    tree = Tree(tree.chars.copy(), tree.tokens.copy(), tree.sums.copy())
    starts = np.r_[0, np.cumsum(tree.chars)]
    n, out, done, read, i = len(tree.chars), [], 0, 0, 0
    while i < len(todo):
        low = max(0, int(np.searchsorted(starts[1:], max(0, todo[i][0] - CONTEXT), "right")))
        low = min(low, n - 1)
        high, j = low, i
        while True:
            while j < len(todo) and todo[j][0] - CONTEXT <= starts[high + 1]:
                high = max(high, min(n - 1, int(np.searchsorted(starts[1:], todo[j][1] + CONTEXT))))
                j += 1
            made, at = [], int(starts[low])
            for start, end, new in todo[i:j]:
                made += [text[at:start], new]
                at = end
            region = "".join(made) + text[at : starts[high + 1]]
            follow = text[starts[high + 1] : starts[high + 1] + CONTEXT]
            read += len(region)
            found = _pretokens(codec, region, follow)
            if found is not None:
                break
            high += 1
        bounds = np.linspace(0, len(found[0]), high - low + 2).astype(np.int64)
        tree.put(low, *_leaves(*found, bounds))
        out += [text[done : starts[low]], region]
        done, i = int(starts[high + 1]), j
    made = "".join(out) + text[done:]
    if len(made) > 8 * LEAF * 8 * n:
        return made, grow(codec, [made])[0], read + len(made)
    return made, tree, read


def count(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with the tree of each text: ``leaf_chars``, ``leaf_tokens`` and ``sums`` (node 1, the root, is the count).

    A null text is empty: one leaf of nothing.  Columns of these names are
    replaced; rows are neither added nor lost.
    """

    shared = docs.sparkSession.sparkContext.broadcast(bpe.rules(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(shared)
        for batch in batches:
            trees = grow(codec, [t or "" for t in batch.column(text).to_pylist()])
            yield bpe._with(batch, _columns(trees))

    return docs.mapInArrow(run, bpe._schema(docs, _TREE))


def _columns(trees: list[Tree]) -> dict[str, pa.Array]:
    made = {"leaf_chars": [t.chars for t in trees], "leaf_tokens": [t.tokens for t in trees], "sums": [t.sums for t in trees]}
    return {k: bpe._lists(v, pa.int64()) for k, v in made.items()}


def apply_edits(counted: DataFrame, path: str, edits: str = "edits", text: str = "text") -> DataFrame:
    """Counted documents after their edits, with ``n_encoded``, the code points encoded for it.

    ``edits`` is an array of (start, end, text) in code points of the text as it
    was, null for none; places outside the text move to its ends, an edit that begins
    inside the one before it begins at that one's end, a null text inserts
    nothing.  Null documents are edited as empty ones.
    """

    shared = counted.sparkSession.sparkContext.broadcast(bpe.rules(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(shared)
        for batch in batches:
            held = [batch.column(f.name) for f in _TREE]
            texts, trees, read = [], [], []
            for i, (t, e) in enumerate(zip(batch.column(text).to_pylist(), batch.column(edits).to_pylist())):
                tree = Tree(*[c[i].values.to_numpy() for c in held])
                new, tree, n = edit(codec, t or "", tree, e)
                texts.append(t if not e else new)
                trees.append(tree)
                read.append(n)
            kind = batch.schema.field(text).type
            yield bpe._with(batch, {text: pa.array(texts, kind), **_columns(trees), "n_encoded": pa.array(read, pa.int64())})

    fields = [counted.schema[text], *_TREE, T.StructField("n_encoded", T.LongType())]
    return counted.mapInArrow(run, bpe._schema(counted, fields))


def listed(edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """An edit table (doc_id, start, end, text) as one array ``edits`` per document, to be joined to the documents."""
    return edits.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))


def replacements(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Edits that replace every match of the patterns, given as (pattern, replacement); earlier rules win."""
    alone = [re.compile(p) for p, _ in rules]
    joined = re.compile("|".join(f"({p})" for p, _ in rules))

    @F.pandas_udf(f"array<{EDIT}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            # most texts match no rule, which each alone tells sooner than all at every place
            some = (joined.finditer(t or "") if any(p.search(t or "") for p in alone) else () for t in batch)
            found = ([(m.start(), m.end(), rules[m.lastindex - 1][1]) for m in matches] for matches in some)
            yield pd.Series([[dict(zip(("start", "end", "text"), e)) for e in es] for es in found])

    return run(text)
