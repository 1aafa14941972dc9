"""Vectorised text arithmetic on Arrow string columns.

Words and n-grams are never Python objects: a column's UTF-8 bytes are one ``uint8`` array, words are (start, end)
positions in it, and a word's 64-bit hash is a difference of prefix sums of a polynomial over the bytes. A batch is cut
into blocks of whole texts of about ``BLOCK`` bytes, so memory stays bounded whatever the batch holds.

Hashes depend on the bytes alone: equal words hash equally in every task, run and machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2, _M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93)

#: White space: U+0020 and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is no letter and no digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FOLD = LOWER.tobytes()

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, BLOCK + 4096), base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * _M1
    h ^= h >> U64(27)
    h = h * _M2
    h ^= h >> U64(31)
    return h


@dataclass
class Words:
    """The words of a block of texts. ``first[i]:first[i+1]`` are the words of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges [start, end); only the bytes and the length count."""
        _, inverse = _power_tables(len(self.data) + 1)
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(U64) * _M3)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null text is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes each; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True) -> Words:
    """Words of texts that lie one after another in ``data``; ``lower`` folds A-Z."""
    raw = data.tobytes()  # bytes.translate looks up single bytes much faster than an index does
    if lower:
        raw = raw.translate(_FOLD)
        data = np.frombuffer(raw, np.uint8)
    n = len(data)
    power, inverse = _power_tables(n + 1)
    gap = np.frombuffer(raw.translate(separators.tobytes()), bool)
    #: Whether a word may begin at a byte, or end before it: after, or at, a separator and where a text begins or ends.
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:], after[:n] = gap, gap
    before[offsets] = after[offsets] = True
    start = np.flatnonzero(before[:n] & ~gap)
    end = np.flatnonzero(after[1:] & ~gap) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(np.multiply(data, power[:n], dtype=U64), out=sums[1:])
    out = Words(data, start, end, np.zeros(0, U64), np.searchsorted(start, offsets), sums)
    out.hash = out.hash_of(start, end)
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; run i starts at word i. Runs may cross texts: see ``gram_range``."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    last = len(hashes) - n + 1
    h = np.full(last, n, U64)
    for j in range(n):
        h = (h ^ hashes[j : j + last]) * _M3
        h ^= h >> U64(29)
    return mix(h)


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    if len(sorted_values) < 2:
        return sorted_values
    return sorted_values[np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))]


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; a text of fewer words is one shingle, one without
    words the empty set."""
    every = grams(w.hash, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            s = every[a : b - n + 1].copy()
            s.sort()
            yield distinct(s)
        elif b > a:
            yield grams(w.hash[a:b], b - a)
        else:
            yield every[:0]


def batches(table: pa.RecordBatch, column: str, lower_unicode: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) of the blocks of rows i..j of a batch."""
    import pyarrow.compute as pc

    text = table.column(column)
    if lower_unicode:
        text = pc.utf8_lower(text)
    data, offsets = text_bytes(text)
    for i, j in blocks(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def list_column(arrays: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """An Arrow list column of NumPy arrays."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays).view(kind) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def list_values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list column of integers without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def whole(column: pa.ChunkedArray) -> pa.Array:
    """A table's column as one array."""
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
