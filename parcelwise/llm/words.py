"""Words of a text and 64-bit hashes of words and word windows, with numpy.

Hashes are polynomial over strong word hashes and then mixed; two different windows agree with a
probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MUL1 = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D; ``lower`` changes A-Z only."""
    raw = encoded(text)
    return (raw.translate(UPPER_TO_LOWER) if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` words, by its first position."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _MUL1 + hashes[k : k + n]
    return mix(out)


def shingle_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of a text by position; a shorter text is one shingle."""
    if 0 < len(hashes) < width:
        return mix(window_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))
    return window_hashes(hashes, width)


def repeated_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words found at least twice, the first one included."""
    covered = np.zeros(len(hashes), bool)
    windows = window_hashes(hashes, width)
    if len(windows):
        _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        for k in range(width):
            covered[k : k + len(twice)] |= twice
    return covered


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[list[list]]:
    """Columns of at most ``size`` rows at a time, as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield [c.to_pylist() for c in batch.slice(start, size).columns]


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
