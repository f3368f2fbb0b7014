"""Word splitting and hashing of many texts at once with numpy.

A *word* is a maximal run of bytes other than space and ``\\x09``-``\\x0D``,
which over UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``.  Texts are laid end
to end, separated by one space, so a handful of array passes treats a whole
slice of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one pass; the arrays of a pass stay within some tens of MB.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for i, base in enumerate((_MULT, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of some texts: bounds in ``data``, the text each belongs to, and 64-bit hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    doc_start: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def words(texts: list[bytes], lower: bool = False, hashes: bool = True) -> Words:
    blob = b" ".join(texts) + b" "
    if lower:
        blob = blob.translate(_LOWER)
    data = np.frombuffer(blob, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc_start = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.searchsorted(doc_start, start, side="right") - 1
    h = np.zeros(0, np.uint64)
    if hashes and len(start):
        power, inverse = _power_arrays(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1])))
            h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, doc, h, doc_start, len(texts))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values, in order; fewer values give an empty array."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * _MULT + h[i : len(h) - n + 1 + i])
    return out


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together; a larger text stands alone."""
    i, n = 0, len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes)))
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Of a batch, (offset of the first row, UTF-8 texts); a null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
    for i, j in slices(sizes, limit):
        yield i, [x or b"" for x in col.slice(i, j - i).to_pylist()]
