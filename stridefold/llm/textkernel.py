"""Numpy text kernel shared by the word-based operators.

It works straight on the byte buffers of Arrow string columns: one pass finds
words (maximal runs of bytes other than ASCII white space), and byte ranges are
hashed eight bytes at a time, all ranges of a block together, so no Python
object is made per word. Every eight bytes go through a bijective, nonlinear
mixer under a seed; ranges over LONG bytes go to BLAKE2b under the same seed.
Where a hash stands for identity, either the seed is drawn at random for the
run or process, so that no text can be made to collide, or the bytes themselves
are compared (``identities``, ``equal_ranges``). Blocks are bounded in bytes and
documents; one longer document makes a block of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 1024
LONG = 256
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def give_back() -> None:
    """Return freed memory to the system (glibc keeps it otherwise, and a worker lives on between tasks)."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as little-endian integers (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def equal_ranges(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of so many bytes of ``a`` and ``b`` are equal, byte for byte."""
    left, right, same = eights(a), eights(b), np.ones(len(size), bool)
    for i in np.flatnonzero(size > LONG):
        same[i] = bool(np.array_equal(a[a_start[i] : a_start[i] + size[i]], b[b_start[i] : b_start[i] + size[i]]))
    at, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(at):
        differ = (left[a_start[at] + k] ^ right[b_start[at] + k]) & _MASK[np.minimum(size[at] - k, 8)]
        same[at[differ != 0]] = False
        k += 8
        at = at[(differ == 0) & (size[at] > k)]
    return same


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def cuts(offsets: np.ndarray, most_bytes: int = BLOCK_BYTES, most_docs: int = BLOCK_DOCS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes and documents (one document at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_docs, n)
        yield lo, hi
        lo = hi


class Block:
    """Some whole documents: their bytes, words and hashes of byte ranges.

    ``first[d]:first[d + 1]`` are the words of document ``d``; ``start`` and
    ``end`` are byte positions in ``data``; ``at`` are the documents' offsets.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False, space: np.ndarray = SPACE, seed: int = 0):
        self.lo, self.hi, self.docs = lo, hi, hi - lo
        self.raw = data[offsets[lo] : offsets[hi]]
        self.data = LOWER[self.raw] if lower else self.raw
        self.at = offsets[lo : hi + 1] - offsets[lo]
        n = len(self.data)
        gap = space[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        word = ~gap
        start, end = word.copy(), word
        if n:
            start[1:] &= gap[:-1] | edge[1:n]
            end[:-1] &= gap[1:] | edge[1:n]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.seed = seed
        self._eights = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        if self._eights is None:
            self._eights = eights(self.data)
        eight, size = self._eights, end - start
        out = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(self.seed)))
        at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(at):
            left = size[at] - k
            out[at] = mix((out[at] ^ (eight[start[at] + k] & _MASK[np.minimum(left, 8)])) * _U(0x9E3779B97F4A7C15))
            k += 8
            at = at[left > 8]
        key = self.seed.to_bytes(8, "little")
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        return out

    def identities(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
        """A number for each byte range, the same for equal bytes only, and how many numbers there are."""
        _, first, number = np.unique(self.hashes(start, end), return_index=True, return_inverse=True)
        count = len(first)
        if not count:
            return number, 0
        model = first[number]
        size = end - start
        same = size == size[model]
        same[same] = equal_ranges(self.data, start[same], self.data, start[model[same]], size[same])
        others: dict[bytes, int] = {}  # ranges whose hash is another's
        for i in np.flatnonzero(~same):
            number[i] = others.setdefault(self.data[start[i] : end[i]].tobytes(), count + len(others))
        return number, count + len(others)

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.count)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a document, and how many each document has."""
        per_doc = np.maximum(self.count - k + 1, 0)
        if len(hashes) < k:
            return np.zeros(0, _U), per_doc
        run = hashes[: len(hashes) - k + 1].copy()
        for j in range(1, k):
            run = run * _U(0xC2B2AE3D27D4EB4F) + hashes[j : len(hashes) - k + 1 + j]
        doc = self.doc_of_word()
        inside = doc[: len(run)] == doc[k - 1 :]
        return mix(run[inside]), per_doc


def blocks(column: pa.Array, lower: bool = False, space: np.ndarray = SPACE, seed: int = 0) -> Iterator[Block]:
    """Whole documents in bounded blocks; ``space`` marks the bytes between words."""
    data, offsets = buffers(column)
    for lo, hi in cuts(offsets):
        yield Block(data, offsets, lo, hi, lower, space, seed)
    if len(offsets) > 1 and offsets[-1] - offsets[0] >= BLOCK_BYTES:
        give_back()


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, end to end, and their bounds.

    A document of fewer than k words has its whole sequence as one shingle;
    one without words has none.
    """
    hashes = block.words()
    runs, per_doc = block.windows(hashes, k)
    short = np.flatnonzero((block.count > 0) & (block.count < k))
    if len(short):
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        extra = np.empty(len(short), _U)
        for i, d in enumerate(short):
            own = hashes[block.first[d] : block.first[d + 1]]
            value = np.array([len(own)], _U)
            for h in own:
                value = mix(value * _U(0xC2B2AE3D27D4EB4F) + h)
            extra[i] = value[0]
        runs = np.insert(runs, bounds[short], extra)
        per_doc = per_doc.copy()
        per_doc[short] = 1
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    for d in np.flatnonzero(per_doc > 1):
        runs[bounds[d] : bounds[d + 1]].sort()
    if len(runs):
        fresh = np.ones(len(runs), bool)
        fresh[1:] = runs[1:] != runs[:-1]
        fresh[bounds[:-1][per_doc > 0]] = True
        kept = np.concatenate([[0], np.cumsum(fresh)])
        return runs[fresh], kept[bounds]
    return runs, bounds
