"""Words and n-gram hashes of whole texts, in NumPy over Arrow batches.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r: what bytes.split() gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text taken at once, and words remembered with their hashes, by one worker.
SLICE_BYTES, MEMO_WORDS = 2_000_000, 200_000
#: Odd multipliers of the two polynomial hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_memo = _Memo()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text; one longer text is one piece."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 of each text; None counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def hashed(words: list) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def word_hashes(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text starts (one more at the end)."""
    words: list = []
    at = [0]
    for text in texts:
        words += (text.lower() if lower else text).split()
        at.append(len(words))
    return hashed(words), np.array(at, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, k: int, base: int = BASE_A) -> np.ndarray:
    """Hash of each k consecutive numbers of h."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    power = {1: h}
    size, wide = 1, None
    done = 0
    left = k
    while left:
        if left & 1:
            block = power[size]
            if wide is None:
                wide, done = block, size
            else:
                factor = np.uint64(pow(base, size, 1 << 64))
                n = len(h) - done - size + 1
                wide = wide[:n] * factor + block[done : done + n]
                done += size
        left >>= 1
        if left:
            block, factor = power[size], np.uint64(pow(base, size, 1 << 64))
            power[2 * size] = block[:-size] * factor + block[size:]
            size *= 2
    return mix(wide)


def inside(at: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of k words that lie within one text."""
    sizes = np.diff(at)
    n = np.maximum(sizes - k + 1, 0)
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return first + np.arange(int(n.sum()))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
