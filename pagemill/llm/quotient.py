"""Counting quotient filters over packed n-grams of word ids: lossless, sorted, compact, merged across shards.

An n-gram of ``k`` ids of ``bits`` bits is a number of ``k * bits`` bits.  An
invertible permutation spreads these numbers evenly; the first bits of the
result say which range of the whole filter it belongs to, the next ones are the
quotient, and everything after them is kept as the remainder.  No bit is lost,
so a filter holds exact n-grams with exact counts, and the permutation read
backwards gives the ids.

Numbers are arrays of 64-bit limbs, the first bit of the number being the
highest bit of the first limb.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from pagemill.llm.words import mix

CYCLES = 2  # of the permutation
_HEAD = struct.Struct("<HBBIBQQ")
_STEP = 0x9E3779B97F4A7C15


class Counts(NamedTuple):
    """Distinct numbers in ascending order, one row of limbs each, and how often each was seen."""

    limbs: np.ndarray
    n: np.ndarray


def _masked(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits == 64 else x & np.uint64((1 << bits) - 1)


def permuted(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Mix two or more ids of ``bits`` bits each: every id in turn is combined with a hash of the one after it."""
    ids, k = list(ids), len(ids)
    for cycle in range(CYCLES):
        for j in range(k - 1, -1, -1):
            salt = np.uint64((cycle * k + j + 1) * _STEP % (1 << 64))
            ids[j] = ids[j] ^ _masked(mix(ids[(j + 1) % k] + salt), bits)
    return ids


def restored(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The ids that ``permuted`` was given."""
    ids, k = list(ids), len(ids)
    for cycle in range(CYCLES - 1, -1, -1):
        for j in range(k):
            salt = np.uint64((cycle * k + j + 1) * _STEP % (1 << 64))
            ids[j] = ids[j] ^ _masked(mix(ids[(j + 1) % k] + salt), bits)
    return ids


def packed(ids: list[np.ndarray], bits: int) -> np.ndarray:
    """Ids side by side as limbs, one row per n-gram."""
    out = np.zeros((len(ids[0]), -(-len(ids) * bits // 64)), np.uint64)
    for j, x in enumerate(ids):
        limb, at = divmod(j * bits, 64)
        free = 64 - at - bits
        if free >= 0:
            out[:, limb] |= x << np.uint64(free)
        else:
            out[:, limb] |= x >> np.uint64(-free)
            out[:, limb + 1] |= x << np.uint64(64 + free)
    return out


def unpacked(limbs: np.ndarray, k: int, bits: int) -> list[np.ndarray]:
    out = []
    for j in range(k):
        limb, at = divmod(j * bits, 64)
        free = 64 - at - bits
        if free >= 0:
            x = limbs[:, limb] >> np.uint64(free)
        else:
            x = (limbs[:, limb] << np.uint64(-free)) | (limbs[:, limb + 1] >> np.uint64(64 + free))
        out.append(_masked(x, bits))
    return out


def _shifted(limbs: np.ndarray, by: int) -> np.ndarray:
    """All numbers moved ``by`` bits to the left, or to the right if negative; less than a limb."""
    if not by:
        return limbs.copy()
    near, far = np.uint64(abs(by)), np.uint64(64 - abs(by))
    if by > 0:
        out = limbs << near
        out[:, :-1] |= limbs[:, 1:] >> far
    else:
        out = limbs >> near
        out[:, 1:] |= limbs[:, :-1] << far
    return out


def counted(limbs: np.ndarray, n: np.ndarray | None = None) -> Counts:
    """Sort numbers and add up the counts (one each, if not given) of equal ones."""
    if not len(limbs):
        return Counts(limbs, np.zeros(0, np.int64))
    if limbs.shape[1] == 1 and n is None:
        values, found = np.unique(limbs[:, 0], return_counts=True)
        return Counts(values[:, None], found)
    order = np.argsort(limbs[:, 0], kind="stable")
    limbs = limbs[order]
    if limbs.shape[1] > 1:
        # first limbs are spread evenly: few of different numbers are equal, and only those are sorted by the others
        tied = limbs[1:, 0] == limbs[:-1, 0]
        odd = tied & (limbs[1:, 1:] != limbs[:-1, 1:]).any(1)
        if odd.any():
            group = np.cumsum(np.r_[0, ~tied])
            mixed = np.unique(group[1:][odd])
            rows = np.flatnonzero(np.isin(group, mixed))
            rows_order = np.lexsort([*[limbs[rows, c] for c in range(limbs.shape[1] - 1, 0, -1)], group[rows]])
            order[rows], limbs[rows] = order[rows][rows_order], limbs[rows][rows_order]
    first = np.flatnonzero(np.r_[True, (limbs[1:] != limbs[:-1]).any(1)])
    sums = np.diff(np.r_[first, len(limbs)]) if n is None else np.add.reduceat(n[order], first)
    return Counts(limbs[first], sums)


def merged(parts: list[Counts]) -> Counts:
    """One sorted run of several."""
    if len(parts) == 1:
        return parts[0]
    return counted(np.concatenate([p.limbs for p in parts]), np.concatenate([p.n for p in parts]))


def ranges(counts: Counts, top: int) -> np.ndarray:
    """The range, the first ``top`` bits, of each number."""
    return (counts.limbs[:, 0] >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(counts.n), np.int64)


def to_bytes(counts: Counts, width: int, top: int, place: int) -> bytes:
    """The filter of range ``place``: all numbers have ``width`` bits, of which the first ``top`` are ``place``.

    Head; one bit per quotient that occurs; one bit per remainder that ends its
    quotient's run; the remainders in whole bytes; one byte per counter, with
    those of 255 and more in full at the end.
    """
    n = len(counts.n)
    quotient_bits = min(max(0, int(n - 1).bit_length()), width - top, 30)
    head = top + quotient_bits
    quotient = counts.limbs[:, 0] >> np.uint64(64 - head) if head else np.zeros(n, np.uint64)
    quotient = (quotient - np.uint64(place << quotient_bits)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    ends = np.r_[quotient[1:] != quotient[:-1], True][:n]
    size = -(-(width - head) // 8)
    remainders = _shifted(counts.limbs, head).astype(">u8").view(np.uint8).reshape(n, -1)[:, :size]
    small = np.minimum(counts.n, 255).astype(np.uint8)
    large = counts.n[counts.n >= 255].astype("<i8")
    body = [np.packbits(occupied), np.packbits(ends), np.ascontiguousarray(remainders), small, large]
    return _HEAD.pack(width, top, quotient_bits, place, size, n, len(large)) + b"".join(x.tobytes() for x in body)


def from_bytes(data: bytes) -> Counts:
    """What ``to_bytes`` was given."""
    width, top, quotient_bits, place, size, n, n_large = _HEAD.unpack_from(data)
    raw, at = np.frombuffer(data, np.uint8), _HEAD.size

    def take(length: int) -> np.ndarray:
        nonlocal at
        at += length
        return raw[at - length : at]

    occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits))
    ends = np.unpackbits(take(-(-n // 8)), count=n).astype(np.int64)
    full = np.zeros((n, -(-width // 64) * 8), np.uint8)
    full[:, :size] = take(n * size).reshape(n, size)
    small = take(n).astype(np.int64)
    small[small == 255] = take(8 * n_large).view("<i8") if n_large else []
    head = top + quotient_bits
    limbs = _shifted(full.view(">u8").astype(np.uint64), -head)
    if head:
        run = np.cumsum(ends) - ends
        quotient = occupied[run].astype(np.uint64) + np.uint64(place << quotient_bits)
        limbs[:, 0] |= quotient << np.uint64(64 - head)
    return Counts(limbs, small)
