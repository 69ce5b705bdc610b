"""Whole texts in Arrow batches: words, and hashes of words and word runs, without a Python loop per word.

A word is a longest run of bytes other than space and \\t\\n\\v\\f\\r. None of these bytes occurs inside a
multi-byte UTF-8 character, so working on bytes gives the words of `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows in an Arrow batch. Spark's default of 10,000 long texts would not fit a small worker.
BATCH_ROWS = 512

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}
U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to BATCH_ROWS, unless the session has set fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if kind not in _TABLES or len(_TABLES[kind][0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = _BASE[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _TABLES[kind] = (both[0], both[1])
    return _TABLES[kind]


def _prefix(values: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    p, inv = _powers(kind, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return sums, inv


@dataclass
class Chunk:
    """Some consecutive texts of a batch."""

    rows: np.ndarray  # their row numbers in the batch
    data: np.ndarray  # their bytes
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # words of text i are first[i]:first[i + 1]

    def byte_hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes (not mixed) of the byte runs lo:hi, equal for equal runs anywhere."""
        sums, inv = _prefix(self.data.astype(U) + U(1), "byte")
        return (sums[hi] - sums[lo]) * inv[lo]

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; the same word has the same hash in every chunk."""
        sums, inv = _prefix((LOWER[self.data] if lower else self.data).astype(U) + U(1), "byte")
        return mix((sums[self.end] - sums[self.start]) * inv[self.start])


def chunks(column: pa.Array, least: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column (null: empty), in order, a few at a time."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    if column.null_count:
        filled = column.fill_null(b"")
        yield from chunks(filled, least)
        return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + least, "right")) - 1)
        yield _chunk(np.arange(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _chunk(rows: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> Chunk:
    m = len(data)
    inside = ~SPACE[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < m)]
    begin[cut] = inside[cut]
    stop[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Chunk(rows, data, bounds, start, end, np.searchsorted(start, bounds))


def runs(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the word sequences words[lo:hi], equal for equal sequences anywhere."""
    sums, inv = _prefix(words, "word")
    return mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(U) + U(seed))


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of k words inside one text, and the run's hash."""
    counts = np.diff(first)
    many = np.maximum(counts - k + 1, 0)
    at = np.arange(int(many.sum())) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many)
    return at, runs(words, at, at + k)
