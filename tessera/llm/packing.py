"""Sum-of-squares online packing of documents into training sequences (operator 8).

Documents come one by one; full windows are cut off at once.  What remains goes to the fill level
that minimises the sum of squared counts of partially filled windows, or to a new window.  Counts
by level are one array of ``capacity`` numbers.  Past ``max_open`` open windows, and at the end of a
partition, the emptiest window is taken apart and its pieces are placed by the same rule, cut where
they fill a window; one window is left at the end of a partition, and its ids are cut into powers of two,
which need no padding.  So all windows but a few for each partition come from the rule, and none is padded.

Every Spark partition packs its own documents: no shuffle, no key, memory of one document and the
open windows.  A lost task is run again from its input and gives the same sequences: their ids are
the partition's number and a counter.

Token ids come from the tokenizers library, word by word between white space, each different word
once (the library pre-splits at white space, so the ids are those of the whole text).  Words are told
apart by 64-bit hashes: among n different words of a task two get one id with odds of n * n / 2**65.
Defined results: a null or empty text is one end token; a null id stays null; repeated rows are packed one
by one; texts of any length are taken whole, in full windows; of levels that the rule likes equally the
fullest is taken; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .words import Words, chunks, split

CAPACITY = 4096
END_ID = 2
#: Open windows of a task: one for each fill level on average, 16 KB each.
MAX_OPEN = CAPACITY
KEPT_WORDS, KEPT_IDS = 1_000_000, 8_000_000
#: Words that go to the library at once.
LEARNED_WORDS = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Windows of ``capacity`` ids; ``place`` takes a document's ids, ``flush`` empties what is open.

    Both yield finished windows: lists of (tag, start, ids, document size).
    """

    def __init__(self, capacity: int = CAPACITY, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # of open windows, by fill level
        self.at: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.open = 0

    def place(self, tag: object, ids: np.ndarray) -> Iterator[list]:
        n, cap = len(ids), self.capacity
        whole = n - n % cap
        for low in range(0, whole, cap):
            yield [(tag, low, ids[low : low + cap], n)]
        rest = ids[whole:]
        r = len(rest)
        if not r:
            return
        # The sum of squares changes by 2 * (N[level + r] - N[level]) + 2 when a window moves up;
        # a full window counts no more, and a new one comes from nowhere.
        count = self.count
        gain = 2 * (count[r : cap + 1] - count[: cap + 1 - r]) + 2
        gain[cap - r] = 1 - 2 * count[cap - r]
        gain[0] = 2 * count[r] + 1 if r < cap else 0
        gain[1:][count[1 : cap + 1 - r] == 0] = np.iinfo(np.int64).max
        level = int(np.flatnonzero(gain == gain.min())[-1])
        yield from self._put(level, (tag, whole, rest, n))
        while self.open > self.max_open:
            yield from self._take_apart()

    def _put(self, level: int, piece: tuple) -> Iterator[list]:
        """Puts a piece that fits into a window of that level, or a new one at 0."""
        if level:
            window = self.at[level].pop()
            self.count[level] -= 1
            self.open -= 1
            window.append(piece)
        else:
            window = [piece]
        level += len(piece[2])
        if level == self.capacity:
            yield window
            return
        self.at[level].append(window)
        self.count[level] += 1
        self.open += 1

    def _take_apart(self) -> Iterator[list]:
        """The emptiest window goes: its pieces are placed by the same rule, cut where they fill a window.

        No new window is opened, so there is one less afterwards.  A piece that reaches the end of a
        window fills it, and its rest goes on.
        """
        cap, count = self.capacity, self.count
        level = int(np.flatnonzero(count)[0])
        window = self.at[level].pop()
        count[level] -= 1
        self.open -= 1
        for tag, start, ids, n in window:
            while len(ids):
                r, levels = len(ids), np.flatnonzero(count)
                reached = np.minimum(levels + r, cap)
                gain = np.where(reached < cap, 2 * (count[reached] - count[levels]) + 2, 1 - 2 * count[levels])
                level = int(levels[np.flatnonzero(gain == gain.min())[-1]]) if len(levels) else 0
                room = min(r, cap - level)
                yield from self._put(level, (tag, start, ids[:room], n))
                start, ids = start + room, ids[room:]

    def flush(self) -> Iterator[list]:
        """Takes windows apart until one is open; its ids are cut into powers of two, which need no padding."""
        while self.open > 1:
            yield from self._take_apart()
        line = [p for level in np.flatnonzero(self.count) for window in self.at[level] for p in window][::-1]
        self.at = [[] for _ in range(self.capacity + 1)]
        self.count[:] = 0
        self.open = 0
        rest = sum(len(p[2]) for p in line)
        for size in (1 << b for b in range(self.capacity.bit_length(), -1, -1) if rest >> b & 1):
            window, left = [], size
            while left:
                tag, start, ids, n = line.pop()
                window.append((tag, start, ids[:left], n))
                if len(ids) > left:
                    line.append((tag, start + left, ids[left:], n))
                left -= len(window[-1][2])
            yield window


def _pieces(word: str) -> int:
    """Pre-split words of a plain Latin word: 1, or 2 with a sign behind it; 0 for anything else."""
    if word.isalpha():
        return 1 if word.isascii() or max(word) < "\u0100" else 0
    if word[-1] in ".,;:!?" and word[:-1].isalpha():
        return 2 if word.isascii() or max(word) < "\u0100" else 0
    return 0


class LibraryIds:
    """Token ids by the tokenizers library.  A word's ids are kept by its hash, up to ``KEPT_WORDS`` words and ``KEPT_IDS`` ids.

    A Python worker keeps them for its later tasks, so they lie in arrays: 24 bytes a word (the hash in sorted order, its slot,
    where the slot's ids begin) and 4 an id.
    """

    split = staticmethod(split)

    def __init__(self, path: str):
        # One thread: Spark runs a task on each core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        suffix = self.library.model.end_of_word_suffix
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each).

        Plain words, with a sign behind them or not, go to the library as one text: the token that
        ends a pre-split word is known by its suffix.  All others go one by one.
        """
        pieces = np.array([_pieces(w) for w in words], np.int64)
        plain = np.flatnonzero(pieces)
        count = np.zeros(len(words), np.int64)
        line = np.zeros(0, np.uint32)
        if len(plain):
            line = np.array(self.library.encode_batch_fast([" ".join([words[k] for k in plain])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.final[line]) + 1
            last = ends[np.cumsum(pieces[plain]) - 1]
            count[plain] = np.diff(np.r_[0, last])
        rest = np.flatnonzero(pieces == 0)
        found = [e.ids for e in self.library.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        count[rest] = [len(i) for i in found]
        out = np.zeros(int(count.sum()), np.uint32)
        mine = np.repeat(pieces > 0, count)
        out[mine] = line
        out[~mine] = np.fromiter(chain.from_iterable(found), np.uint32)
        return out, count

    def _learn(self, w: Words, at: np.ndarray, hashes: np.ndarray) -> None:
        """Keeps the ids of the words at these places; ``hashes`` are sorted, and none is known yet."""
        ids, count = [], []
        for low in range(0, len(at), LEARNED_WORDS):
            i, c = self._encode([w.bytes_of(k).decode() for k in at[low : low + LEARNED_WORDS]])
            ids.append(i)
            count.append(c)
        place = np.searchsorted(self.known, hashes)
        self.slot = np.insert(self.slot, place, len(self.known) + np.arange(len(hashes)))
        self.known = np.insert(self.known, place, hashes)
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(count))])
        self.flat = np.concatenate([self.flat, *ids])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        w = self.split(texts)
        if not len(w.start):
            return [self.flat[:0]] * w.docs
        u, at, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(u) > KEPT_WORDS or len(self.flat) > KEPT_IDS:
            self._forget()
        place = np.searchsorted(self.known, u)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != u[~new]
        if new.any():
            self._learn(w, at[new], u[new])
        slot = self.slot[np.searchsorted(self.known, u)][back]
        size = self.begin[slot + 1] - self.begin[slot]
        end = np.cumsum(size)
        out = self.flat[np.repeat(self.begin[slot] - (end - size), size) + np.arange(end[-1])]
        cut = np.r_[0, end][w.first]
        return [out[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]


@cache
def library_ids(path: str) -> LibraryIds:
    """One for each Python worker and tokenizer file."""
    return LibraryIds(path)


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows by piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end = library_ids(path), np.array([end_id], dtype="<u4")
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        packer, out = Packer(capacity), []

        def keep(windows: Iterator[list]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for doc_id, start, ids, n in window:
                    out.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids).tobytes()), n, sequence, offset))
                    offset += len(ids)
                sequence += 1

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * len(NAMES))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in chunks(batches, text):
            found = library.ids(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                keep(packer.place(doc_id, np.concatenate([ids, end])))
            if len(out) > 10_000:
                yield rows()
        keep(packer.flush())
        yield rows()

    return df.select(id_column, text).mapInArrow(run, SCHEMA)
