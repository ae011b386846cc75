"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so working on UTF-8 bytes is exact. Hashes are polynomials over
Z / 2^64 of random byte codes, mixed afterwards; a window's hash is a difference of two prefix sums (Rabin-Karp).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Text that is handled at once; half of it where a task holds much else.
CHUNK_BYTES, SLICE_BYTES = 1 << 20, 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_draw = np.random.Generator(np.random.PCG64(20240131))
_CODE = _draw.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_BASE, _WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        size = max(n + 1, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[: n + 1]


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of codes[start:end] for every pair; equal ranges hash alike wherever they stand."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes))[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(pow(base, -1, 2**64), len(codes))[starts]


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray  # of each word
    ends: np.ndarray
    first: np.ndarray  # text i has the words first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        codes = (_CODE[_LOWER] if lower else _CODE)[self.data]
        return mix(range_hashes(codes, self.starts, self.ends, _BYTE_BASE) + (self.ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one text."""
        last = np.repeat(self.first[1:], self.counts) - k
        at = np.flatnonzero(np.arange(len(hashes)) <= last)
        return at, mix(range_hashes(hashes, at, at + k, _WORD_BASES[which]) + np.uint64(k))

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, offsets) of an Arrow string array; a null text is empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n and raw[1] else np.zeros(n + 1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array) -> Words:
    """The words of an Arrow string array; a null text has none."""
    data, offsets = bytes_of(texts)
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before, after = border[:-1].copy(), border[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of few bytes of ``column``, so that temporary arrays stay small; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
        ends = np.cumsum(pa.compute.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def longs(column: pa.Array, missing: int = 0) -> np.ndarray:
    return pa.compute.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


def packed(lengths: np.ndarray, values: bytes) -> pa.Array:
    """A binary array of consecutive slices of ``values`` with these lengths in bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values)])
