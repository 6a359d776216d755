"""Words of many texts at once, as NumPy arrays over Arrow's own text buffers.

A batch is cut into blocks of whole texts of about a megabyte, so that the
temporary arrays stay small however many rows a batch has; only a text that is
longer than that makes a larger block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: a word is a longest run of anything but these
SPACES = (0x20, *range(0x09, 0x0E))

_IS_SPACE = np.isin(np.arange(256), SPACES)
_IS_NEWLINE = np.arange(256) == 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_BACK = pow(_STEP, -1, 2**64)
#: powers are kept for the places in a stretch, and for the beginnings of stretches
_STRETCH_BITS = 14
_STRETCH = 1 << _STRETCH_BITS


def _powers(factor: int, n: int) -> np.ndarray:
    steps = np.full(n, factor % 2**64, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_STEP, _STRETCH), _powers(_STEP_BACK, _STRETCH)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(0x2545F4914F6CDD1D))


@dataclass
class Block:
    """Texts ``first`` to ``last`` (exclusive) of a batch: their bytes and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first

    def lowered(self) -> Block:
        """A-Z made small; all other bytes stay."""
        return Block(self.first, self.last, _LOWER[self.data], self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and text number of every word."""
        return self._runs(_IS_SPACE)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for lines that are not empty."""
        return self._runs(_IS_NEWLINE)

    def _runs(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[self.data]
        begins = inside[1:] & ~inside[:-1]
        ends = ~inside[1:] & inside[:-1]
        # a text's end cuts a run that would go on into the next text
        cut = self.offsets[1:-1]
        joint = cut[inside[cut] & inside[cut + 1]]
        begins[joint] = True
        ends[joint] = True
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        return starts, stops, np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span; equal bytes give equal hashes wherever they stand."""
        n = len(self.data)
        far = n // _STRETCH + 1
        up, down = _powers(pow(_STEP, _STRETCH, 2**64), far), _powers(pow(_STEP_BACK, _STRETCH, 2**64), far)
        sums = np.zeros(n + 1, np.uint64)
        for k, first in enumerate(range(0, n, _STRETCH)):
            last = min(first + _STRETCH, n)
            own = sums[first + 1 : last + 1]
            np.cumsum(_BYTE_VALUE[self.data[first:last]] * _UP[: last - first] * up[k], out=own)
            own += sums[first]
        h = (sums[stops] - sums[starts]) * _DOWN[starts & (_STRETCH - 1)] * down[starts >> _STRETCH_BITS]
        return mix(h + (stops - starts).astype(np.uint64))

    def per_text(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum a byte-wise flag over each text."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a batch's texts into blocks; a missing text counts as an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a worker holds of texts that it gives back."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def count_words(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    out = np.zeros(len(texts), np.int64)
    for b in blocks(texts):
        _, _, owner = b.words()
        out[b.first : b.last] = np.bincount(owner, minlength=b.n)
    return out


def hash_texts(texts: pa.Array, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each text; with ``fold``, of its words alone: case of A-Z and kind of space don't count."""
    out = np.zeros(len(texts), np.uint64)
    for b in blocks(texts):
        if not fold:
            out[b.first : b.last] = b.hashes(b.offsets[:-1], b.offsets[1:])
            continue
        b = b.lowered()
        starts, stops, owner = b.words()
        h = b.hashes(starts, stops)
        place = np.arange(len(h)) - np.searchsorted(owner, owner, "left")
        total = np.zeros(b.n, np.uint64)
        np.add.at(total, owner, pair_hash(place.astype(np.uint64), h))
        out[b.first : b.last] = mix(total)
    return out
