"""Text to vectors: a batch hook for any encoder, and a model-free default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scale import compute_once

# Called once per task; returns the function that encodes a batch of texts.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


REMEMBERED = 100_000  # words whose bucket a worker keeps
TEXTS = 256  # encoded at once


class _Slots(dict):
    """Signed bucket of a word, computed on first use: twice the bucket, plus one if negative."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).digest()
        slot = 2 * (int.from_bytes(digest[:4], "big") % self.dim) + (digest[4] >> 7)
        self[word] = slot
        return slot


def hashing_encoder(dim: int = 64) -> EncoderFactory:
    """Feature hashing: every word adds +1 or -1 to one of ``dim`` buckets.

    Bucket and sign come from the word's MD5, so vectors are the same in any run.
    """

    def factory() -> Callable[[list[str]], np.ndarray]:
        slots = _Slots(dim)

        def encode(texts: list[str]) -> np.ndarray:
            if len(slots) > REMEMBERED:
                slots.clear()
            coded = [np.fromiter(map(slots.__getitem__, t.split()), np.int64) for t in texts]
            flat = np.concatenate(coded) if coded else np.empty(0, np.int64)
            rows = np.repeat(np.arange(len(texts)), [len(c) for c in coded])
            sums = np.bincount(rows * dim + flat // 2, weights=1 - 2 * (flat % 2), minlength=len(texts) * dim)
            return sums.reshape(len(texts), dim)

        return encode

    factory.model_name = f"hashing-{dim}"
    return factory


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.square(matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def embed(df: DataFrame, encoder: EncoderFactory, col: str = "document", out: str = "embedding") -> DataFrame:
    """Add unit vectors of ``col``.

    Only that column crosses into Python, in Arrow batches; the encoder is
    loaded once per task.  Filter first: a filter on the result is not pushed
    through.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            rows: list[np.ndarray] = []
            for at in range(0, len(batch), TEXTS):
                texts = batch.iloc[at : at + TEXTS].fillna("").tolist()
                rows.extend(_unit_rows(np.asarray(encode(texts), dtype=np.float64)).astype(np.float32))
            yield pd.Series(rows, index=batch.index, dtype=object)

    return compute_once(df, out, vectors(F.col(col)))
