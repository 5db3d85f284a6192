"""Byte-level BPE: texts to token ids and back, without a regex.

Places where a pre-token begins are found for a million code points at once:
code points become symbols, symbols become transitions of a small automaton,
and transitions are composed by an associative scan.  The pre-tokens are those
of ``PATTERN``, under the Unicode version that the tokenizer library knows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemill.llm.words import BLOCK, POINTS, codepoints

REMEMBERED = 200_000  # pre-tokens that a Python worker keeps, in each of two generations; some 80 MB with their ids, 50 MB with their number
# The public pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHORT = 48  # bytes up to which merges scan the piece instead of keeping a heap
_FEW = 64  # pieces that are merged one by one
_CELLS = 1 << 17  # bytes that are merged side by side, in pieces of about one length
_NONE = np.iinfo(np.int32).max  # rank of a pair that has none

# Classes of code points.
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
# Symbols: classes, with what must be known of the code points after them.
_L, _N, _O, _QUOTE1, _QUOTE2, _BLANK, _LAST_SPACE, _LAST_BLANK, _RESET = range(9)
# States: what the token at hand is after a code point.
_CLOSED, _IN_L, _IN_N, _IN_O, _IN_BLANK, _PREFIX, _ONE_MORE, _TWO_MORE = range(8)


_shared: list[np.ndarray] = []  # the driver's table, in its tasks


def class_table() -> np.ndarray:
    """Class of every code point: in a task, as the driver told."""
    return _shared[0] if _shared else own_classes()


@cache
def own_classes() -> np.ndarray:
    """Classes by the Unicode version of the tokenizer library, or of Python where that is not installed."""
    try:
        import tiktoken
    except ImportError:
        table = _python_classes()
    else:
        table = _library_classes(tiktoken)
    table[ord(" ")] = SPACE
    return table


def _python_classes() -> np.ndarray:
    table = np.zeros(POINTS, np.uint8)
    for i in range(POINTS):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        table[i] = LETTER if kind == "L" else NUMBER if kind == "N" else BLANK if c.isspace() else OTHER
    table[0x1C:0x20] = OTHER  # separators that Python, but not Unicode, counts as white space
    return table


def _library_classes(tiktoken) -> np.ndarray:
    """What the library joins to a letter, a digit or a full stop: ranks in which those merge with any byte show it."""
    heads = b"a1."
    ranks = {bytes([i]): i for i in range(256)} | {bytes([h, i]): 256 * (n + 1) + i for n, h in enumerate(heads) for i in range(256)}
    probe = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = np.r_[0:0xD800, 0xE000:POINTS]
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    text = "".join([f"\na{c}\n1{c}\n.{c}" for c in map(chr, points.tolist())])
    lengths = 1 + (np.array(probe.encode_ordinary(text)) >= 256)
    joined = np.zeros(int(lengths.sum()) + 1, bool)
    joined[np.cumsum(lengths) - lengths] = lengths == 2
    first = np.cumsum(3 * (2 + sizes)) - 3 * (2 + sizes) + 1
    letter, number, other = (joined[first + n * (2 + sizes)] for n in range(3))
    table = np.zeros(POINTS, np.uint8)
    table[points] = np.select([letter, number, other], [LETTER, NUMBER, OTHER], BLANK)
    return table


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state by [state, symbol], and whether the code point begins a token."""
    to = np.empty((8, 9), np.uint8)
    begins = np.ones((8, 9), bool)
    for symbol, fresh in {_L: _IN_L, _N: _IN_N, _O: _IN_O, _QUOTE1: _ONE_MORE, _QUOTE2: _TWO_MORE}.items():
        to[:, symbol] = fresh
        run = min(fresh, _IN_O)
        for state in (run, _PREFIX):  # a run goes on, a space takes it in
            to[state, symbol], begins[state, symbol] = run, False
    to[_ONE_MORE, _L], begins[_ONE_MORE, _L] = _CLOSED, False
    to[_TWO_MORE, _L], begins[_TWO_MORE, _L] = _ONE_MORE, False
    to[:, _BLANK], begins[_IN_BLANK, _BLANK] = _IN_BLANK, False
    to[:, _LAST_SPACE] = _PREFIX
    to[:, _LAST_BLANK] = _CLOSED
    to[:, _RESET] = _CLOSED
    return to, begins


def _symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    kinds = class_table()[points]
    kinds[resets] = 5
    after = np.append(kinds[1:], np.uint8(5))
    out = np.array([_O, _L, _N, _BLANK, _BLANK, _RESET], np.uint8)[kinds]
    blank = (kinds == BLANK) | (kinds == SPACE)
    last = blank & (after <= NUMBER)
    out[last & (kinds == SPACE)] = _LAST_SPACE
    out[last & (kinds == BLANK)] = _LAST_BLANK
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        one, two = (np.append(points, [0, 0]).astype(np.uint32)[quote + j] for j in (1, 2))
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = _QUOTE1
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        out[quote[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = _QUOTE2
    out[resets] = _RESET
    return out


def _scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """True where a code point begins a token.

    Rows of ``width`` symbols are reduced to functions of the state, all rows
    side by side; the functions are composed over the rows by doubling; then
    each row runs from its own first state.
    """
    to, begins = automaton()
    flat, rows = to.ravel(), -(-len(symbols) // width)
    padded = np.full(rows * width, _RESET, np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, 1)
    for column in columns:
        whole = flat[whole * np.uint8(9) + column]
    step = 1
    while step < rows:
        whole[:, step:] = np.take_along_axis(whole[:, step:], whole[:, :-step].astype(np.intp), 0)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[_CLOSED, :-1]
    out = np.empty((width, rows), bool)
    marks = begins.ravel()
    for place, column in zip(out, columns):
        key = state * np.uint8(9) + column
        place[:] = marks[key]
        state = flat[key]
    return out.T.ravel()[: len(symbols)]


def safe_pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    """Cut a long text where a token begins whatever surrounds it: at white space after anything else."""
    at, kinds = 0, class_table()
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (kinds[ord(text[cut])] >= BLANK > kinds[ord(text[cut - 1])]):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, where their pre-tokens begin and end in that string, in order."""
    joined = "\n".join(texts)
    points = codepoints(joined)
    if not len(points):
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    resets = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
    symbols = _symbols(points, resets.astype(np.int64))
    begin = _scan(symbols)
    begin[resets.astype(np.int64)] = False
    first = np.flatnonzero(begin)
    bounds = np.sort(np.concatenate([first, resets, [len(points)]]))
    return joined, first, bounds[np.searchsorted(bounds, first, "right")]


@dataclass(frozen=True)
class Rules:
    """What tasks need of a tokenizer: the lines of its rank file, and the classes of code points."""

    lines: bytes
    classes: np.ndarray

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, self.lines.splitlines()))}


@cache
def rules(path: str) -> Rules:
    """Read on the driver, whose files executors need not have."""
    with open(path, "rb") as file:
        return Rules(file.read(), own_classes())


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a pre-token: join the adjacent pair of lowest rank, the leftmost of equals, until none has one."""
    if piece in ranks:
        return (ranks[piece],)
    if len(piece) > _SHORT:
        return _merge_long(piece, ranks)
    rank, none = ranks.get, 1 << 60
    cuts = list(range(len(piece) + 1))
    pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
    return tuple([ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap of pairs and links between the parts left."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Pairs:
    """Merges of many short pieces side by side: each round joins one pair of every piece that still has one."""

    def __init__(self, ranks: dict[bytes, int]):
        rank, found = ranks.get, {}
        for token, made in ranks.items():
            for cut in range(1, len(token)):
                left, right = rank(token[:cut]), rank(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = made
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.made = np.append(np.fromiter(found.values(), np.int32, len(found))[order], np.int32(_NONE))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.two = self.of(np.repeat(self.single, 256), np.tile(self.single, 256))
        self.own = {i: i for i in ranks.values()}  # one object per id, for all tuples

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(_NONE))

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, as ``merge`` tells them."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        for part, ids, alive in self._blocks(pieces):
            flat = [self.own[i] for i in ids[alive].tolist()]
            ends = np.cumsum(alive.sum(1)).tolist()
            for i, a, b in zip(part, [0, *ends], ends):
                out[i] = tuple(flat[a:b])
        return out

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many ids each piece has."""
        out = np.zeros(len(pieces), np.int64)
        for part, _, alive in self._blocks(pieces):
            out[part] = alive.sum(1)
        return out

    def _blocks(self, pieces: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of pieces of about one length, what stands at each of their bytes, and where an id begins."""
        alike: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            alike.setdefault(-(-len(p) // 8) * 8, []).append(i)
        for width, places in alike.items():
            rows = _CELLS // (width + 1) + 1
            for at in range(0, len(places), rows):
                part = places[at : at + rows]
                yield part, *self._joined([pieces[i] for i in part])

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(lengths.max()) + 1  # the last column stands for both ends
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        place = np.arange(width)
        alive = place < lengths[:, None]
        ids = self.single[raw]
        pair = np.full((n, width), _NONE, np.int32)
        pair[:, :-1] = self.two[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        pair[place >= lengths[:, None] - 1] = _NONE
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            best = pair[rows]
            at = best.argmin(1)  # the leftmost of equals
            low = best[np.arange(len(rows)), at]
            if (low == _NONE).any():
                left = low != _NONE
                rows, at, low = rows[left], at[left], low[left]
            gone = after[rows, at]
            end = after[rows, gone]
            ids[rows, at] = low
            alive[rows, gone], pair[rows, gone] = False, _NONE
            after[rows, at], before[rows, end] = end, at
            inside = end < lengths[rows]
            pair[rows, at] = np.where(inside, self.of(low.astype(np.int64), ids[rows, end]), _NONE)
            front = before[rows, at]
            some = np.flatnonzero(front >= 0)
            own, front = rows[some], front[some]
            pair[own, front] = self.of(ids[own, front], low[some].astype(np.int64))
        return ids, alive


class Codec:
    """Encoder and decoder over one rank file; ids of pre-tokens met are remembered up to a bound."""

    def __init__(self, own: Rules, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks = own.ranks()
        self.pairs = Pairs(self.ranks) if all(bytes([i]) in self.ranks for i in range(256)) else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.counted: dict[str, int] = {}  # the same for those that are only counted
        self.counted_before: dict[str, int] = {}
        size = max(self.ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.bytes = np.zeros(int(lengths.sum()), np.uint8)
        for token, rank in self.ranks.items():
            at = self.first[rank]
            self.bytes[at : at + len(token)] = np.frombuffer(token, np.uint8)

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, ...]], np.ndarray]]:
        """Per text, perhaps in several parts: its number, ids of its pre-tokens, their code point lengths."""
        for tokens, lengths, places in self._blocks(texts):
            ids = self._ids(tokens)
            for number, a, b in places:
                yield number, ids[a:b], lengths[a:b]

    def sizes(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As ``pieces``, with the number of ids of each pre-token in their place."""
        for tokens, lengths, places in self._blocks(texts):
            counts = self._counts(tokens)
            for number, a, b in places:
                yield number, counts[a:b], lengths[a:b]

    def _blocks(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, list[tuple[int, int, int]]]]:
        """Pre-tokens of some texts, their code point lengths, and which are those of each text."""
        part: list[tuple[int, str]] = []
        held = 0
        for number, text in enumerate(texts):
            for piece in safe_pieces(text) if len(text) > BLOCK else (text,):
                if part and held + len(piece) > BLOCK:
                    yield self._part(part)
                    part, held = [], 0
                part.append((number, piece))
                held += len(piece) + 1
        yield self._part(part)

    def _part(self, part: list[tuple[int, str]]) -> tuple[list[str], np.ndarray, list[tuple[int, int, int]]]:
        joined, first, last = starts([p for _, p in part])
        tokens = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        ends = np.searchsorted(first, np.cumsum([len(p) + 1 for _, p in part])).tolist()
        return tokens, last - first, [(number, a, b) for (number, _), a, b in zip(part, [0, *ends], ends)]

    def _ids(self, tokens: list[str]) -> list[tuple[int, ...]]:
        """Ids by pre-token, from two generations of memory, so that frequent ones outlive a change."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for t in set(tokens).difference(known):
            if ids := older.get(t):
                known[t] = ids
            else:
                new.append(t)
        known.update(zip(new, self._merged([t.encode("utf-8") for t in new])))
        return [known[t] for t in tokens]

    def _counts(self, tokens: list[str]) -> np.ndarray:
        """Number of ids by pre-token, from two generations of memory as well."""
        if len(self.counted) > self.remembered:
            self.counted, self.counted_before = {}, self.counted
        known, older, new = self.counted, self.counted_before, []
        out = np.fromiter(map(known.get, tokens, repeat(0)), np.int64, len(tokens))
        missed = np.flatnonzero(out == 0).tolist()
        for t in dict.fromkeys([tokens[i] for i in missed]):
            if n := older.get(t):
                known[t] = n
            else:
                new.append(t)
        pieces = [t.encode("utf-8") for t in new]
        short = self._short(pieces)
        made = dict(zip(short, self.pairs.count([pieces[i] for i in short]).tolist())) if short else {}
        known.update((t, made[i] if i in made else len(merge(p, self.ranks))) for i, (t, p) in enumerate(zip(new, pieces)))
        out[missed] = [known[tokens[i]] for i in missed]
        return out

    def _merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens that are not remembered."""
        short = self._short(pieces)
        made = dict(zip(short, self.pairs.merge([pieces[i] for i in short]))) if short else {}
        return [made[i] if i in made else merge(p, self.ranks) for i, p in enumerate(pieces)]

    def _short(self, pieces: list[bytes]) -> list[int]:
        """Numbers of the pieces that are merged side by side: short ones without a rank, where they are many."""
        short = [i for i, p in enumerate(pieces) if len(p) <= _SHORT and p not in self.ranks]
        return short if self.pairs and len(short) >= _FEW else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for number, ids, _ in self.pieces(texts):
            out[number].append(np.fromiter(chain.from_iterable(ids), np.int32))
        return [np.concatenate(x) if len(x) != 1 else x[0] for x in (x or [np.zeros(0, np.int32)] for x in out)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token ends."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """Bytes of the tokens, gathered from one table at the places that the offsets give."""
        if not len(ids):
            return b""
        ends = self.offsets(ids) if ends is None else ends
        lengths = np.diff(ends, prepend=0)
        shift = np.repeat(self.first[ids] - (ends - lengths), lengths)
        return self.bytes[np.arange(len(shift)) + shift].tobytes()


_codecs: dict[tuple[bytes, int], Codec] = {}


def codec(shared: Broadcast, remembered: int = REMEMBERED) -> Codec:
    """One codec per rank file and Python worker."""
    own = shared.value
    key = hashlib.sha256(own.lines).digest(), remembered
    if key not in _codecs:
        _codecs[key] = Codec(own, remembered)
    _shared[:] = [own.classes]
    return _codecs[key]


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    old = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in new]
    return pa.RecordBatch.from_arrays([c for _, c in old] + list(new.values()), [n for n, _ in old] + list(new))


def _schema(docs: DataFrame, new: list[T.StructField]) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([f for f in docs.schema.fields if f.name not in names] + new)


def _lists(values: Iterable[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    values = list(values)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    ends = np.array([0, *accumulate(map(len, values))], np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, path: str, text: str = "text", remembered: int = REMEMBERED, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (token ids of the whole text) and ``ends`` (byte offset where each token ends).

    No special tokens are made: their names are ordinary text.  Null and empty
    texts have empty lists.  Columns of these two names are replaced, others
    kept; rows are neither added nor lost.  With ``decoded`` the ids are also
    decoded, into a column of that name, by the same worker.
    """

    shared = docs.sparkSession.sparkContext.broadcast(rules(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, remembered)
        for batch in batches:
            ids = own.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = [own.offsets(x) for x in ids]
            made = {"ids": _lists(ids, pa.int32()), "ends": _lists(ends, pa.int64())}
            if decoded:
                made[decoded] = pa.array([own.decode(x, e) for x, e in zip(ids, ends)], pa.binary())
            yield _with(batch, made)

    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.LongType()))]
    new += [T.StructField(decoded, T.BinaryType())] if decoded else []
    return docs.mapInArrow(run, _schema(docs, new))


def decode(encoded: DataFrame, path: str, out: str = "decoded", remembered: int = REMEMBERED) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` in column ``out``, placed by ``ends``; null ids give null."""

    shared = encoded.sparkSession.sparkContext.broadcast(rules(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared, remembered)
        for batch in batches:
            made = []
            for ids, ends in zip(batch.column("ids"), batch.column("ends")):
                flat = [x.values.to_numpy() if x.is_valid else None for x in (ids, ends)]
                made.append(None if flat[0] is None else own.decode(*flat))
            yield _with(batch, {out: pa.array(made, pa.binary())})

    return encoded.mapInArrow(run, _schema(encoded, [T.StructField(out, T.BinaryType())]))
