"""Vectorised helpers on Arrow string batches: words, rolling hashes, anchors.

All functions work on one flat byte array with row offsets, so a task touches
no Python object per word.  Batches are cut into chunks of about ``CHUNK_BYTES``
to bound memory; a row longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15 | 5
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 5

#: White space between words: the six ASCII white-space bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII capitals to small letters, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the output."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 7)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and the inverse powers, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int):
        self._up, self._down = _powers(base, len(values))
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self._up[: len(values)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64), 1)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and the row offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that no chunk with several rows has more than CHUNK_BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and (held + size > CHUNK_BYTES or row - start >= 32_000):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


class Words:
    """Words of a chunk: ``start`` and ``end`` in bytes, ``first`` word of each row (and one past)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, dtype=bool)
        np.logical_not(gap[data], out=inside[:-1])
        edge = np.zeros(len(data) + 1, dtype=bool)  # a row begins here
        edge[offsets] = True
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (edge | ~before))
        self.end = np.flatnonzero(before & (edge | ~inside))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self._bytes: Rolling | None = None

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def byte_hashes(self) -> Rolling:
        if self._bytes is None:
            self._bytes = Rolling(_BYTE_VALUES[self.data], _BYTE_BASE)
        return self._bytes

    def hashes(self) -> np.ndarray:
        return self.byte_hashes().of(self.start, self.end)


def word_rolling(word_hashes: np.ndarray) -> Rolling:
    return Rolling(word_hashes, _WORD_BASE)


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE_VALUES[data], _BYTE_BASE)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """For every window of ``length`` units of one row, the anchor: its leftmost least ``gram``.

    Equal windows have their anchor at the same offset, wherever they stand.
    A span is a maximal run of windows (``first`` .. ``first + count - 1``) with
    one anchor; ``key`` hashes the anchor's gram, ``whole`` the span and the
    anchor's place in it.
    """

    _LOW = 28  # bits for the place in a chunk

    def __init__(self, rolling: Rolling, row_start: np.ndarray, length: int, gram: int):
        n = int(row_start[-1])
        none = np.zeros(0, dtype=np.int64)
        self.first = self.count = self.at = none
        self.key = self.whole = none.astype(np.uint64)
        if n < length:
            return
        here = np.arange(n - gram + 1)
        grams = rolling.of(here, here + gram)
        low = _U((1 << self._LOW) - 1)
        least = sliding_min((grams & ~low) | here.astype(np.uint64), length - gram + 1)
        at = (least & low).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int32)  # windows that stay in their row
        last = np.maximum(row_start[1:] - length + 1, row_start[:-1])
        np.add.at(inside, row_start[:-1], 1)
        np.add.at(inside, last, -1)
        where = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
        if not len(where):
            return
        at = at[where]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.at = where[begin], at[begin]
        self.count = np.diff(np.append(begin, len(at)))
        self.key = grams[self.at]
        stretch = rolling.of(self.first, self.first + self.count + length - 1)
        self.whole = mix(stretch ^ mix((self.at - self.first).astype(np.uint64), 3), 4)
