"""Vectorised word work on Arrow text columns, for the operators that run in Python.

A word is a maximal run of code points other than U+0020 and U+0009..U+000D. Those separators are
single bytes in UTF-8, so words are cut on bytes without decoding. A whole column slice is handled at
once: byte classes, word bounds and 64-bit word hashes come from a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

#: Bytes handled in one numpy pass; bounds a worker's memory to a small multiple of it or of the longest text.
CHUNK_BYTES = 1 << 20

_POSITIONS = 64
_TABLE = np.random.default_rng(0x5EED).integers(0, 1 << 64, size=_POSITIONS * 256, dtype=np.uint64)
_FAR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of a run of documents: byte bounds in `buf`, 64-bit hashes, and where each document's words begin."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(documents) + 1
    hashes: np.ndarray


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of about `limit` bytes; one long text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, to, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def cut(buf: np.ndarray, offs: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Cut the bytes of several documents into words."""
    if lower:
        buf = LOWER_ASCII[buf]
    inside = _IS_WORD[buf]
    n = len(buf)
    if n == 0 or not inside.any():
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(offs), np.int64), np.zeros(0, np.uint64))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < n]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edge = offs[1:][offs[1:] > 0] - 1
    closes[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offs)
    hashes = _hashes(buf, inside, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(buf, starts, ends, first, hashes)


def _hashes(buf: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of one random 64-bit value per (byte, place): two words agree by chance once in 2**64."""
    at = np.flatnonzero(inside).astype(np.int32)
    lengths = (ends - starts).astype(np.int32)
    place = at - np.repeat(starts.astype(np.int32), lengths)
    values = _TABLE[((place & (_POSITIONS - 1)) << 8) | buf[at]]
    if (far := place >= _POSITIONS).any():
        values[far] = mix(values[far] + _FAR * (place[far] // _POSITIONS).astype(np.uint64))
    begins = np.cumsum(lengths) - lengths
    return mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64))


def pair_up(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each of h (the last n - 1 starts have none)."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + h[k : len(h) - n + 1 + k] * np.uint64(2 * k + 0x9E3779B1)
    return mix(out)
