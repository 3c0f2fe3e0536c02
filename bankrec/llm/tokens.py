"""Words and word windows of a batch of texts as numpy arrays.

A batch keeps its UTF-8 bytes in one buffer; a word is a start and an end in it and a
64-bit hash. Nothing here loops over words or bytes in Python. The arrays made per byte
are bounded by ``SLICE`` bytes (or one word, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = b" \t\n\x0b\x0c\r"      # [\x20\x09-\x0D]
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15      # any odd number; hashes are polynomials in it modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x51_7C_C1_B7))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1 at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of text, a row at least; nothing is copied.
    What is made from a slice stays small whatever the number and length of the rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


@dataclass
class Words:
    data: np.ndarray     # the bytes of all texts
    starts: np.ndarray   # of each word, in ``data``
    ends: np.ndarray
    doc: np.ndarray      # row of each word
    first: np.ndarray    # rows + 1: the first word of each row
    hashes: np.ndarray   # of each word

    def position(self) -> np.ndarray:
        """Number of each word within its text."""
        return np.arange(len(self.doc)) - self.first[self.doc]


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower`` hashes A-Z as a-z."""
    offsets, data = text_buffer(column)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets - lo
    solid = np.ones(256, bool)
    solid[list(WHITE)] = False
    inside = solid[data]
    edge = np.zeros(len(data) + 1, bool)   # a text begins here
    edge[offsets] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[-1] = False
    after[:-1] = inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets, "left")
    return Words(data, starts, ends, doc, first, _hashes(data, starts, ends, _byte_values(lower)))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``size`` neighbours; runs across texts are not left out."""
    n = max(0, len(hashes) - size + 1)
    factor = np.uint64((_BASE + 2 * seed * 0x6C62272E07BB0142) % (1 << 64) | 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= factor
        total += hashes[k:k + n]
    return mix(total)


def whole_windows(words: Words, size: int) -> np.ndarray:
    """Which of the runs of ``size`` neighbours lie in one text."""
    n = max(0, len(words.doc) - size + 1)
    return words.doc[:n] == words.doc[size - 1:size - 1 + n]
