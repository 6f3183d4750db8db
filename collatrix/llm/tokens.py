"""Whole Arrow string columns to word hashes with numpy, a few million bytes at a time.

Word separators of all our word patterns are ASCII, so UTF-8 bytes can be classified one by one.
A word's hash is a polynomial over a random 64-bit value per byte, modulo 2**64, then mixed; all
words of a chunk come from one running sum. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and lower-case letters; applied after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        steps = np.full(size, base & _MASK, U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and len+1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


class Words:
    """Words of a chunk of texts. ``first[i]:first[i+1]`` are the words of text i; ``start`` and
    ``end`` are byte positions in the chunk."""

    __slots__ = ("data", "end", "first", "hash", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool = True):
        self.offsets = offsets
        self.data = data = LOWER[data] if lower else data
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, U), np.zeros(len(offsets), np.int64)
            return
        inside = ~separator[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[edge] = inside[edge]
        ends[edge[1:] - 1] = inside[edge[1:] - 1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, U)
        np.cumsum(_VALUES[data] * powers(_BASE, n), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * powers(_INVERSE, n)[self.start] + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)


def grams(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries (across texts too; the caller masks those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, (k * 0x632BE59BD9B4E019 + salt) & _MASK, U)
    for j in range(k):
        total = total * U(_BASE) + hashes[j : j + n]
    return mix(total)


def owner(first: np.ndarray, n: int) -> np.ndarray:
    """The text that each of n words belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or that field of the column ``_row``."""
    return batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("_row"), "text")


def texts_in(batches: Iterator[pa.RecordBatch], separator: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches with the words of their texts."""
    for batch in batches:
        data, offsets = utf8(text_of(batch))
        for lo, hi in chunks(offsets, limit):
            yield batch.slice(lo, hi - lo), Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], separator)
