"""Vectorised words, word hashes and word shingles over Arrow string columns.

A batch's text buffer is treated as one byte array: separators are found with
a lookup table, and every word's 64-bit hash comes from prefix sums of a
polynomial hash, so no Python object is made per word.  Buffers are handled in
slices of ``SLICE_BYTES`` (a longer text is a slice of its own), which bounds a
worker's memory whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Rows of the pieces that batches are worked off in.
PIECE_ROWS = 1000

_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _SALT)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, SLICE_BYTES), _BASE if kind == "up" else _UNBASE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """Words of a run of texts: byte bounds in ``data``, text index, hash; ``count`` by text."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes."""
        return _spans(self.data, begin, end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text index and first word of every run of k words; a text with fewer words gives one of all its words."""
        h, n = self.hash, len(self.hash)
        at = np.arange(n)
        left = np.cumsum(self.count)[self.text] - at if n else at
        full = at[left >= k]
        out = h[full].copy()
        for j in range(1, k):
            out = mix(out * _SALT + h[full + j])
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            begin = (np.cumsum(self.count) - self.count)[short]
            some = h[begin].copy()
            for j in range(1, k - 1):
                more = self.count[short] > j
                some[more] = mix(some[more] * _SALT + h[begin[more] + j])
            out, full = np.concatenate([out, some]), np.concatenate([full, begin])
            order = np.argsort(full, kind="stable")
            out, full = out[order], full[order]
        return out, self.text[full], full


def plain(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of ``PIECE_ROWS`` rows; what Arrow holds unused is given back behind it, since idle workers stay."""
    for at in range(0, batch.num_rows, PIECE_ROWS):
        yield batch.slice(at, PIECE_ROWS)
    pa.default_memory_pool().release_unused()


def hashes_of(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The 64-bit values in each row of a binary column, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, at = plain(column)
    data = np.ascontiguousarray(raw).view(np.int64)
    return [data[a:b] for a, b in zip((at[:-1] >> 3).tolist(), (at[1:] >> 3).tolist(), strict=True)]


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column, slice by slice."""
    raw, at = plain(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield _slice(raw[at[i] : at[j]], at[i : j + 1] - at[i], i, lower)
        i = j


def _slice(data: np.ndarray, offsets: np.ndarray, first: int, lower: bool) -> Words:
    size, texts = len(data), len(offsets) - 1
    bound = np.zeros(size + 1, bool)
    bound[offsets] = True
    inside = ~_SEPARATOR[data]
    before = np.empty(size + 1, bool)
    before[0] = True
    before[1:] = ~inside
    before |= bound
    after = np.empty(size + 1, bool)
    after[:-1] = ~inside
    after[-1] = True
    after |= bound
    start = np.flatnonzero(inside & before[:-1])
    end = np.flatnonzero(inside & after[1:]) + 1
    h = _spans(_LOWER[data] if lower else data, start, end)
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(first, data, offsets, start, end, text, h, np.bincount(text, minlength=texts))


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=total[1:])
    return mix((total[end] - total[begin]) * _power("down", len(data) + 1)[begin] + (end - begin).astype(np.uint64))


def byte_hashes(values: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The values as bytes, and the hashes that words have which are one of them."""
    data, at = plain(pa.array(values))
    return data, _spans(data, at[:-1], at[1:])


def word_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for part in words(column, lower):
        h, text, _ = part.shingles(k)
        at = np.searchsorted(text, np.arange(len(part) + 1))
        for i in range(len(part)):
            yield part.first + i, np.unique(h[at[i] : at[i + 1]])


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a set of hashes, the same in any order."""
    if not len(tokens):
        return 0
    s = np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))])
    return int(mix(s).view(np.int64)[0])
