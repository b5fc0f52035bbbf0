"""Words of whole texts as numpy arrays: spans, 64-bit hashes and rolling window hashes.

A word is a run of bytes other than space and 0x09-0x0D. All functions work on the UTF-8 buffer of an Arrow
batch, cut into slices of whole texts, so no Python object is made per word. NULL counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective finaliser (splitmix64) of unsigned 64-bit values."""
    z = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < size:
        length = max(size, SLICE_BYTES + 1)
        inverse = pow(base, -1, 2**64)
        up = np.full(length, np.uint64(base))
        down = np.full(length, np.uint64(inverse))
        up[0] = down[0] = 1
        known = (np.cumprod(up), np.cumprod(down))
        if length <= 2 * SLICE_BYTES:
            _POWERS[base] = known
    return known


def _span_hashes(digits: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of digits[start:end] for many spans, by prefix sums."""
    up, down = _powers(base, len(digits) + 1)
    sums = np.empty(len(digits) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(digits * up[: len(digits)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """Words of a slice of rows ``first`` to ``last``; ``row`` counts from ``first``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        digits = self.data.astype(np.uint64) + np.uint64(1)
        base = (_BYTE_BASE + 2 * 0x5851F42D4C957F2D * seed) & (2**64 - 1)
        return mix64(_span_hashes(digits, self.starts, self.ends, base), seed)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def some(self, index: np.ndarray) -> pa.Array:
        """The chosen words as an Arrow binary array."""
        lengths = (self.ends - self.starts)[index]
        offsets = np.zeros(len(index) + 1, dtype=np.int32)
        np.cumsum(lengths, out=offsets[1:])
        data = self.data[ranges(self.starts[index], lengths)]
        return pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each span, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows hold whole texts here, so fewer of them in an Arrow batch bound what a task holds on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give freed memory back at the end of a task; the worker stays for later ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; NULL becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind) if column.type != kind else column
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    width = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_slices(column: pa.Array, *, lower: bool = False, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 20) -> Iterator[Words]:
    """Slices of whole texts with at most ``max_bytes``, or one longer text."""
    data, offsets = text_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), rows, first + max_rows)
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = _LOWER[part]
        yield find_words(part, offsets[first : last + 1] - offsets[first], first, last)
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, first: int = 0, last: int | None = None) -> Words:
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | border))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border))
    return Words(first, len(offsets) - 1 + first if last is None else last, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every run of ``width`` words inside one row.

    All seeds share one base, whose powers a worker keeps; independent hashes come from hashes of words with
    another seed.
    """
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    starts = ranges(bounds[:-1], counts)
    return starts, mix64(_span_hashes(hashes, starts, starts + width, _WORD_BASE), seed)
