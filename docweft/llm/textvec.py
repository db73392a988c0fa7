"""Whole-batch text kernels in numpy: words, word hashes and shingles of many documents at once.

A batch of texts is one byte buffer with document offsets.  Words are maximal runs
of bytes other than 0x20 and 0x09-0x0D, which never split a UTF-8 character.  A
word's 64-bit name is a polynomial hash over a random byte table, finished with a
mixing step; it depends on the word alone, so equal words have equal names in every
task and no dictionary is exchanged.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass covers, so that scratch arrays stay near 60 MB.
SLICE_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        fill = np.full(size, base, dtype=np.uint64)
        fill[0] = 1
        have = _powers[base] = np.multiply.accumulate(fill)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text (one row at least)."""
    _, offs = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give memory that numpy and Arrow keep for reuse back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: Bytes that belong to a word's core: ASCII letters and digits, and all of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trimmed(found: Words, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without up to ``most`` punctuation bytes at either end (one byte stays at least)."""
    start, end = found.start.copy(), found.end.copy()
    for _ in range(most):
        start += ~ALNUM[found.data[start]] & (start < end - 1)
        end -= ~ALNUM[found.data[end - 1]] & (start < end - 1)
    return start, end


@dataclass
class Words:
    """Words of a batch: byte spans, names, and the index of each document's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> Words:
    """Find the words of every document; ``lower`` maps A-Z to a-z first."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    solid = ~_SEP[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    stop[:-1] &= ~solid[1:] | cut[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Words(data, start, end, np.searchsorted(start, offs))


class Spans:
    """64-bit names of spans of one sequence of bytes, or of 64-bit names; equal for equal content."""

    def __init__(self, data: np.ndarray):
        values = _TABLE[data] if data.dtype == np.uint8 else data
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values * _pow(_P, len(data)), out=self.total[1:])
        self.inverse = _pow(_P_INV, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        name = self.total[end] - self.total[start]
        name *= self.inverse[start]
        name += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64(name)


def word_names(found: Words) -> np.ndarray:
    return Spans(found.data)(found.start, found.end)


def shingle_names(name: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all ``width``-word shingles and each document's first; shorter texts give one shingle of all words."""
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(per)])
    if not out_first[-1]:
        return np.zeros(0, np.uint64), out_first
    padded = np.concatenate([name, np.zeros(width, np.uint64)])
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], per)
    left = np.repeat(first[1:], per) - at
    out = np.full(len(at), 0x51ED270B, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0xA0761D6478BD642F) + np.where(left > i, padded[at + i], np.uint64(0))
        out ^= out >> np.uint64(29)
    return mix64(out), out_first


def distinct_sorted(name: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct names in ascending order, and each document's first."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    keep = np.ones(len(name), dtype=bool)
    keep[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return name[keep], np.searchsorted(doc[keep], np.arange(len(first)))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and list starts."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))


def joined(found: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each document's words (those with ``keep``) joined by one blank, and byte offsets.

    Every document's bytes end in a blank too many; offsets give its first byte, and
    its text is ``out[offs[i] : offs[i + 1] - 1]`` (or empty when both are equal).
    """
    start, end = found.start, found.end
    count = found.count if keep is None else np.diff(np.concatenate([[0], np.cumsum(keep)])[found.first])
    if keep is not None:
        start, end = start[keep], end[keep]
    size = end - start + 1
    stop = np.cumsum(size)
    out = np.concatenate([found.data, np.zeros(1, np.uint8)])[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)]
    out[stop - 1] = 32
    return out, np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
