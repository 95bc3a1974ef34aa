"""Words of whole texts as numpy columns, read straight from Arrow string buffers.

A word is a maximal run of bytes other than space and tab..carriage return
(``[^\\x20\\x09-\\x0D]+``).  UTF-8 continuation bytes never equal those, so byte runs are the
same as character runs.  Every word gets a 64-bit hash; a run of ``k`` words gets one too.
Two different words collide with a probability of about 2**-57.

Nulls count as empty texts.  Texts of any length are taken whole: batches are cut between
documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 2_000_000
#: Bytes of words that are hashed at once; a longer word alone.
HASHED_BYTES = 1 << 17


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd_factors(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt)) * _GOLDEN) | np.uint64(1)


_factors = _odd_factors(256, 0)


def _byte_factors(n: int) -> np.ndarray:
    global _factors
    if len(_factors) < n:
        _factors = _odd_factors(max(n, 2 * len(_factors)), 0)
    return _factors


@dataclass
class Words:
    """Words of the documents of one chunk, in order of the text."""

    data: np.ndarray  # bytes of all texts, one after the other
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # document of each word, counted from 0 in the chunk
    first: np.ndarray  # first word of each document; one more entry at the end
    text_start: np.ndarray  # where each document's text starts in data; one more at the end

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, block by block: each byte of a block takes several numbers."""
        upto = np.cumsum(self.end - self.start)
        out = np.zeros(len(upto), np.uint64)
        low = 0
        while low < len(out):
            done = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, done + HASHED_BYTES, side="right")))
            out[low:high] = self._hashed(low, high)
            low = high
        return out

    def _hashed(self, low: int, high: int) -> np.ndarray:
        size = self.end[low:high] - self.start[low:high]
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
        take = inside + np.repeat(self.start[low:high], size)
        with np.errstate(over="ignore"):
            value = (self.data[take].astype(np.uint64) + np.uint64(1)) * _byte_factors(int(size.max()))[inside]
            return mix64(np.add.reduceat(value, at) + size.astype(np.uint64) * _GOLDEN)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words in an array; the caller drops those that cross documents."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j, c in enumerate(_odd_factors(k, 1000 + k)):
            total += word_hash[j : j + n] * c
    return mix64(total)


def _text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of every text; ``lower`` maps A-Z to a-z and nothing else."""
    raw, at = _text_buffers(texts)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    head = np.zeros(len(raw) + 1, dtype=bool)
    head[at] = True
    starts = inside.copy()
    if len(raw):
        starts[1:] &= ~inside[:-1] | head[1:-1]
    start = np.flatnonzero(starts)
    stops = inside.copy()
    if len(raw):
        stops[:-1] &= ~inside[1:] | head[1:-1]
    end = np.flatnonzero(stops) + 1
    first = np.searchsorted(start, at, side="left")
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(raw, start, end, doc, first, at)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, a longer document alone in its slice."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        _, at = _text_buffers(texts)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + size, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
