"""Vectorised word scanning over Arrow string columns: word spans and 64-bit word hashes without a Python loop per word.

A word is a run of bytes other than space and the controls 9 to 13, which in UTF-8 equals ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; bounds the scratch memory of a batch.
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []
try:
    _libc = ctypes.CDLL("libc.so.6")  # where there is another C library, nothing is trimmed
except OSError:
    _libc = None


@dataclass
class Words:
    """Spans (byte offsets into ``data``) of all words of a batch; ``first[d]`` to ``first[d + 1]`` are document d's."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def batches_by_bytes(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text (one longer text makes a slice of its own) and at most ``rows`` rows.

    What a slice leaves behind is given back to the system, so that a worker waiting to be used again holds little.
    """
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1), at + rows)
        yield batch.slice(at, min(end, batch.num_rows) - at)
        at = end
        give_back()


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def scan(column: pa.Array, lower_ascii: bool = False) -> Words:
    data, offsets = utf8(column)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[1:-1][edges]
    stops[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(_LOWER[data] if lower_ascii else data, offsets, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (two multiply-xorshift rounds)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT) + 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U64), np.full(size - 1, x, _U64)])) for x in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def hash_words(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of a running polynomial sum, segment by segment."""
    out = np.empty(len(words.starts), _U64)
    at = 0
    while at < len(out):
        base = words.starts[at]
        end = max(at + 1, int(np.searchsorted(words.ends, base + SEGMENT, "right")))
        stop = words.ends[end - 1]
        up, down = _power_tables(int(stop - base) + 1)
        total = np.zeros(stop - base + 1, _U64)
        np.cumsum((words.data[base:stop].astype(_U64) + _U64(1)) * up[: stop - base], out=total[1:])
        s, e = words.starts[at:end] - base, words.ends[at:end] - base
        out[at:end] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U64) * _U64(0xD6E8FEB86659FD93))
        at = end
    return out
