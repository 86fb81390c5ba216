"""Tokenising helpers that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to a-z, and every other ASCII byte but digits and letters to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else (c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


class WordIds(dict):
    """Word (bytes) -> a value computed once; emptied when full, so that a task's memory is bounded."""

    def __init__(self, make: Callable[[bytes], object], most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.make(word)
        return out


def two_hashes(bits: int) -> Callable[[bytes], int]:
    """Two independent hashes of a word, bits wide each, in one integer."""
    mask = (1 << 2 * bits) - 1
    return lambda word: xxhash.xxh3_64_intdigest(word) & mask


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """UTF-8 bytes of a text column's rows; null as empty."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


def hash_ids(words: list[bytes], ids: WordIds) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
