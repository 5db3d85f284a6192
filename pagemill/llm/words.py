"""Words of many texts at once, as numpy arrays.

A word is a longest run of letters and digits, lower-cased code point by code
point, so offsets stay those of the text as it was given.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np

POINTS = 0x110000
OVERLAP = 8192  # code points that pieces of a long text share in ``parts``
BLOCK = 1 << 18  # code points handled at once; only a longer single word exceeds it


class Words(NamedTuple):
    """Words of some texts in order: the text's number, the hash, first and end code point in that text."""

    text: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def lower_table() -> np.ndarray:
    """Each code point's lower case where that is one code point, else itself."""
    table = np.arange(POINTS, dtype=np.uint32)
    for i in range(POINTS):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


@cache
def word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(POINTS)), bool, POINTS)


@cache
def _value_table() -> np.ndarray:
    return mix(lower_table().astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    out = np.empty((2, size), np.uint64)
    for row, b in zip(out, (base, pow(base, -1, 1 << 64))):
        row[0], done = 1, 1
        while done < size:
            n = min(done, size - done)
            row[done : done + n] = row[:n] * np.uint64(pow(b, done, 1 << 64))
            done += n
    return out[0], out[1]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end position of every word: a polynomial hash read off prefix sums."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = word_table()[points]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = powers(1 << max(18, int(len(points)).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_value_table()[points] * power[: len(points)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start]), start, end


def pieces(text: str, size: int = BLOCK) -> Iterator[tuple[int, str]]:
    """Cut a text into (offset, piece) at places between words, so memory stays bounded."""
    at, table = 0, word_table()
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and table[ord(text[cut])] and table[ord(text[cut - 1])]:
            cut += 1
        yield at, text[at:cut]
        at = cut
    if at < len(text) or at == 0:
        yield at, text[at:]


def blocks(texts: Iterable[str | None], size: int = BLOCK) -> Iterator[Words]:
    """Words of the texts in blocks of about ``size`` code points.

    A null is an empty text.  A text longer than ``size`` spans several blocks;
    its words come in order, with positions in the whole text.
    """
    parts: list[tuple[int, int, str]] = []
    held = 0
    for number, text in enumerate(texts):
        for offset, piece in pieces(text or "", size):
            if held and held + len(piece) > size:
                yield _block(parts)
                parts, held = [], 0
            parts.append((number, offset, piece))
            held += len(piece) + 1
    if parts:
        yield _block(parts)


def _block(parts: list[tuple[int, int, str]]) -> Words:
    hashes, start, end = hashed_words(codepoints("\n".join([p for _, _, p in parts])))
    first = np.zeros(len(parts), np.int64)
    first[1:] = np.cumsum([len(p) + 1 for _, _, p in parts])[:-1]
    part = np.searchsorted(first, start, "right") - 1
    shift = np.array([o for _, o, _ in parts], np.int64) - first
    return Words(np.array([n for n, _, _ in parts], np.int64)[part], hashes, start + shift[part], end + shift[part])


def overlapping(texts: Iterable[str | None], keep: int, size: int = BLOCK) -> Iterator[Words]:
    """As ``blocks``, each block beginning with the last ``keep`` words of a text that it continues."""
    tail: Words | None = None
    for block in blocks(texts, size):
        if tail is not None and len(block.text) and block.text[0] == tail.text[0]:
            block = Words(*map(np.concatenate, zip(tail, block)))
        if len(block.text):
            same = block.text[-keep:] == block.text[-1]
            tail = Words(*[x[-keep:][same] for x in block])
            yield block


def parts(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """(text number, offset, piece) in blocks of bounded size; pieces of one long text overlap, and each holds whole words."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for offset, piece in pieces(text or ""):
            back = max(0, offset - OVERLAP)
            piece = text[back:offset] + piece if offset else piece
            if held and size + len(piece) > BLOCK:
                yield held
                held, size = [], 0
            held.append((number, back if offset else 0, piece))
            size += len(piece) + 1
    if held:
        yield held


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a text, and the place of its first word in ``words``."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = (total + words.hash[j : j + n]) * np.uint64(0xD1342543DE82EF95)
    place = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    return mix(total)[place], place
