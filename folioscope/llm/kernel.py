"""Vectorised text primitives over Arrow string columns.

A batch of texts is viewed, without copying, as one byte buffer with offsets;
words, shingles and k-byte windows are then found for all its texts at once.
Hashes are 64-bit fingerprints of exact byte ranges, mixed word by word so that
no arrangement of few letters makes unlike ranges alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a chunk of its own.
CHUNK = 1 << 20

U = np.uint64
_SEED, _STEP = U(0xD6E8FEB86659FD93), U(0x9FB21C651E98DF25)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one little-endian number; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


class Fingerprints:
    """Fingerprints of byte ranges of one buffer.

    A range of up to ``SHORT`` bytes is read eight bytes at a time and mixed word
    by word with its length; a longer one is digested by BLAKE2b.
    """

    SHORT = 64

    def __init__(self, buf: np.ndarray):
        self.buf, self.words = buf, words_at(buf)

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        size = end - start
        bits = np.minimum(size, 8).astype(U) * U(8)
        mask = np.where(bits == 64, ~U(0), (U(1) << (bits & U(63))) - U(1))
        h = mix(mix((self.words[start] & mask) ^ _SEED ^ U(seed << 8)) + size.astype(U) * _STEP)
        left, at = np.flatnonzero((size > 8) & (size <= self.SHORT)), 8
        while len(left):  # the last eight bytes of a range may overlap those before
            place = np.minimum(start[left] + at, end[left] - 8)
            h[left] = mix(h[left] * _STEP + self.words[place])
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > self.SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[start[i]: end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
        return h


class Rolling:
    """Fingerprints of ranges of eight bytes or more, from those of every place by doubling.

    A range is described by its length and the longest power-of-two blocks that
    start and end it, which cover it.
    """

    def __init__(self, buf: np.ndarray, longest: int):
        level = mix(words_at(buf)[: max(0, len(buf) - 7)] ^ _SEED)
        self.levels, width = {8: level}, 8
        while 2 * width <= longest and len(level) > width:
            level = mix(level[:-width] * _STEP + level[width:])
            width *= 2
            self.levels[width] = level

    def every(self, width: int) -> np.ndarray:
        """Fingerprints of the ``width`` bytes from every place."""
        block = max(k for k in self.levels if k <= width)
        level = self.levels[block]
        if block == width:
            return level
        return mix(mix(level[: len(level) - (width - block)] * _STEP + level[width - block:]) + U(width))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size, out = end - start, np.zeros(len(start), U)
        for block, level in self.levels.items():
            top = block == max(self.levels)
            rows = np.flatnonzero((size >= block) & ((size < 2 * block) | top))
            out[rows] = mix(mix(level[start[rows]] * _STEP + level[end[rows] - block]) + size[rows].astype(U))
        return out


def string_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive row ranges; null counts as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32, n + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, n)
        yield slice(at, to), data[offs[at]: offs[to]], offs[at: to + 1] - offs[at]
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of maximal runs; a run never crosses texts."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_text(weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte weight within each text."""
    total = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])  # these follow one another without a gap
    if len(full):
        total[full] = np.add.reduceat(weights, offsets[full], dtype=np.int64)
    return total


def shingles(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the n words from each place, and whether they are one text's."""
    if len(words) < n:
        return np.zeros(0, U), np.zeros(0, bool)
    last = len(words) - n + 1
    h = words[:last].copy()
    for k in range(1, n):
        h = mix(h * _STEP + words[k: k + last])
    return h, doc[:last] == doc[n - 1: n - 1 + last]


def batched(batch: pa.RecordBatch, rows: slice) -> pa.RecordBatch:
    return batch.slice(rows.start, rows.stop - rows.start)
