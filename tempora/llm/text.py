"""Vectorised words and hashes of Arrow text batches.

A word is a maximal run of bytes other than space and 0x09-0x0D (all of them
single UTF-8 bytes, so bytes and code points give the same words).  Null texts
count as empty.  A batch is walked in slices of about ``SLICE_BYTES``, so that the
arrays of one slice stay small however long the batch is; one longer text is a
slice of its own and is never cut.

Hashes are 64 bits: a polynomial over random byte values, then a finaliser.  Two
different words (shingles, lines) of one pair of texts collide with a chance of
about 2^-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES_LOWER = BYTE_VALUES[LOWER]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Texts:
    """One slice: ``buf`` holds the bytes of documents ``first..first+n`` of the
    batch, ``off`` their n + 1 byte offsets."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        up, down = _powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        values = (BYTE_VALUES_LOWER if lower else BYTE_VALUES)[self.buf]
        np.cumsum(values * up[: len(self.buf)], out=total[1:], dtype=np.uint64)
        return mix((total[end] - total[start]) * down[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the n + 1 word offsets of the
        documents."""
        inside = ~SEPARATOR[self.buf]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[self.off[:-1][self.off[:-1] < len(inside)]] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[self.off[1:][self.off[1:] > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, self.off)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Texts]:
    """The texts of a string column as slices of about ``SLICE_BYTES``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Texts(at, buf[off[at]: off[to]], off[at: to + 1] - off[at])
        at = to


def window_hashes(hashes: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie inside a document, and the n + 1
    window offsets of the documents."""
    counts = np.maximum(np.diff(woff) - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    first = np.repeat(woff[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    total = np.zeros(int(offsets[-1]), np.uint64)
    factor = 2 * k + 1
    for j in range(k):
        factor = (factor * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1E) % 2**64
        total += hashes[first + j] * np.uint64(factor | 1)
    return mix(total), offsets


def shingle_sets(texts: Texts, k: int = 5) -> list[np.ndarray]:
    """Per document its sorted distinct k-word shingle hashes; with fewer words the
    whole sequence is one shingle, without words the set is empty."""
    start, end, woff = texts.words()
    hashes = texts.span_hashes(start, end, lower=True)
    win, offsets = window_hashes(hashes, woff, k)
    out = []
    for d in range(texts.n):
        if offsets[d + 1] > offsets[d]:
            out.append(np.unique(win[offsets[d]: offsets[d + 1]]))
        elif woff[d + 1] > woff[d]:
            own = hashes[woff[d]: woff[d + 1]]
            whole, _ = window_hashes(own, np.array([0, len(own)]), len(own))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
