"""Substring dedup by suffix automata of reference shards (operator 9).

A window is ``LENGTH`` consecutive words of one document.  Words in a window whose word sequence
starts earlier (a smaller id, or earlier in the same document) are removed.

1. Every window has a minimiser: the smallest hash among its runs of ``RUN`` words.  Equal
   windows have equal minimisers, so only windows whose minimiser comes twice in the corpus can
   repeat.  Spark counts minimisers (pre-aggregated within documents and tasks).
2. Such a window goes to the shard of the document that first holds its minimiser: equal windows
   meet in one shard.  Consecutive windows for one shard travel as one segment.
3. A shard streams its segments in order through a suffix automaton of what came before.  The
   matching statistics tell which windows came before; only what is new is added, so copies cost
   a pass over their words and no memory.  Shards are sized by the number of minimisers found.
   Each task builds its shards' automata where their segments arrive: they are never collected
   and sent to all, as the reference grows with the corpus.
   Equal segments are collapsed before that: only the earliest goes to its shard, and all words of
   the others are repeats at once, wherever they are.  A text that a large share of all documents
   equals is thus one segment of a shard, however often it comes.
4. A passage that many documents hold in unlike surroundings has hot minimisers.  Their windows are
   told apart by the whole window's hash instead: windows over the passage's edge, that come once,
   drop out; those that come a few times go to the shard of the document that first holds *them*;
   hot windows, all inside the passage, are cut where their own hash says so, so that equal stretches
   are equal segments whatever stands around them, and collapse.  A key is hot if it comes
   ``HOT`` times and makes up over one ``HOT_KEYS``-th of all, so tasks get at most ``HOT_KEYS`` of them
   (8 bytes each, 16 for windows), and no key that is joined has more rows than that.
5. Windows that repeat within their own document are found there, without a shuffle.

Words are 64-bit hashes in all this; texts themselves are only cut at the end.  Among n different
windows two get one hash with odds of n * n / 2**65.

Defined results: a null text has no words; a null id comes before all others; rows with one id
and equal texts are one document listed twice and get the same result; rows with one id and
different texts, null ids among them, are ordered by the texts' hashes; a document of fewer words than a window keeps
all; extra columns are ignored by ``remove_repeats`` and kept by ``dedup_texts``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import free_name, looked_up, written

LENGTH = 20
RUN = 6
#: Minimisers whose windows share a shard, on average; a minimiser stands for some eight words.
SHARD_MINIMISERS = 20_000
#: A key that comes more often, and makes up over one ``HOT_KEYS``-th of all, is hot.
HOT, HOT_KEYS = 256, 1_000_000
#: Hot windows in a segment, on average; keys of segments that a task remembers.
CUT, REMEMBERED = 32, 100_000
NO_ID = -(2**63)


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """best over each run of ``size`` values, by doubling."""
    reach, out = 1, values
    while reach * 2 <= size:
        out = best(out[:-reach], out[reach:])
        reach *= 2
    return best(out[: len(values) - size + 1], out[size - reach :]) if len(values) >= size else values[:0]


def minimisers(w: W.Words, h: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, hash of its minimiser, first word of each minimiser, its hash) of a chunk."""
    runs, reach = W.windows(h, RUN), length - RUN + 1
    least = _sliding(runs, reach, np.minimum)
    if not len(least):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64)) * 2
    inside = w.doc[: len(least)] == w.doc[length - 1 :]
    start = np.flatnonzero(inside)
    side = np.zeros(reach - 1, np.uint64)
    greatest = _sliding(np.concatenate([side, np.where(inside, least, np.uint64(0)), side]), reach, np.maximum)
    place = np.flatnonzero(greatest == runs)
    return start, least[start], place, runs[place]


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"))


@dataclass
class Hot:
    """Hot minimisers, and the hot windows among those that they stand for; sorted."""

    minimisers: np.ndarray
    windows: np.ndarray
    first: np.ndarray  # what chooses each hot window's shard


def _among(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in a sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _with_slot(docs: DataFrame) -> DataFrame:
    """Null ids share one number; their texts' hashes keep them apart."""
    return docs.withColumn("slot", F.when(F.col("doc") == NO_ID, F.col("th")).otherwise(0))


def _rows(docs: DataFrame, length: int, hot: Broadcast | None, which: str) -> DataFrame:
    """Rows (doc, slot, g, c, mark): each document's keys and how often it holds them.

    ``which``: "minimisers", all of them; "windows", hashes of the windows of hot minimisers; "cold", minimisers and
    windows that aren't hot, and one marked row for a document that holds a hot window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches):
            w = W.split(b.column(2))
            h = w.hashes()
            start, least, place, g = minimisers(w, h, length)
            owner = w.doc[place]
            ids, slots = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            marked = np.zeros(0, np.int64)
            if which != "minimisers":
                known = hot.value
                _, warm = _among(least, known.minimisers)
                start = start[warm]
                whole = W.windows(h, length)[start] if len(start) else least[:0]
                of = w.doc[start]
                if which == "windows":
                    g, owner = whole, of
                else:
                    _, inner = _among(whole, known.windows)
                    marked = np.unique(of[inner])
                    _, warm = _among(g, known.minimisers)
                    g, owner = np.concatenate([g[~warm], whole[~inner]]), np.concatenate([owner[~warm], of[~inner]])
            order = np.lexsort((g, owner))
            g, owner = g[order], owner[order]
            fresh = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])]) if len(g) else np.zeros(0, np.int64)
            total = np.diff(np.r_[fresh, len(g)])
            doc = np.concatenate([owner[fresh], marked])
            # A mark has a key of its own document, so that marks meet in no task.
            key = np.concatenate([g[fresh], W.mix64((ids[marked] ^ slots[marked]).view(np.uint64))]).view(np.int64)
            mark = np.r_[np.zeros(len(fresh), bool), np.ones(len(marked), bool)]
            columns = [pa.array(ids[doc], pa.int64()), pa.array(slots[doc], pa.int64()), pa.array(key), pa.array(np.r_[total, np.zeros(len(marked), np.int64)], pa.int64()), pa.array(mark, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "slot", "g", "c", "mark"])

    return docs.select("doc", "slot", "text").mapInArrow(run, "doc long, slot long, g long, c long, mark boolean")


def _repeated(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(written rows (g, c, first) of keys that come twice, those of them that are hot)."""
    # What chooses the shard: the first document; of null ids, the smallest slot among the key's rows.
    first = F.xxhash64(F.min("doc"), F.when(F.min("doc") == NO_ID, F.min("slot")))
    many = written(rows.groupBy("g").agg(F.sum("c").alias("c"), first.alias("first")).where("c > 1"), name)
    total = many.agg(F.sum("c").alias("n")).first()["n"] or 0
    return many, many.where(F.col("c") > max(HOT, total // HOT_KEYS))


def _hot(docs: DataFrame, hot_minimisers: DataFrame, length: int) -> tuple[DataFrame | None, Broadcast]:
    """(repeated windows of hot minimisers, what tasks know of hot keys): at most ``HOT_KEYS`` of each kind."""
    context = docs.sparkSession.sparkContext
    none = np.zeros(0, np.uint64)
    keys = np.sort(hot_minimisers.select("g").toArrow()["g"].to_numpy().view(np.uint64))
    if not len(keys):
        return None, context.broadcast(Hot(none, none, none.view(np.int64)))
    known = context.broadcast(Hot(keys, none, none.view(np.int64)))
    many, hot = _repeated(_rows(docs, length, known, "windows"), "windows")
    found = hot.select("g", "first").toArrow()
    inner, first = found["g"].to_numpy().view(np.uint64), found["first"].to_numpy()
    order = np.argsort(inner)
    return many, context.broadcast(Hot(keys, inner[order], first[order]))


def _segments(joined: DataFrame, length: int, shards: int, hot: Broadcast) -> DataFrame:
    """Rows (shard, doc, th, start, n, key, words): what goes to shards, with the key of its words.

    Without a key, repeats within a document; with a key and null words, a segment that an earlier place in the same task equals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warm, seen = hot.value, {}
        for b in W.chunks(batches):
            w = W.split(b.column(2))
            h = w.hashes()
            start, g, *_ = minimisers(w, h, length)
            owner = w.doc[start]
            whole = W.windows(h, length)[start] if len(start) else g
            # The key of a window: its minimiser, or its own hash if that is hot.
            _, is_warm = _among(g, warm.minimisers)
            g = np.where(is_warm, whole, g)
            at, inner = _among(whole, warm.windows)
            inner &= is_warm
            inner_first = warm.first[at] if len(warm.first) else np.zeros(len(at), np.int64)
            cut = inner & (whole % np.uint64(CUT) == 0)
            rows: list[tuple] = []
            keys = [b.column(0).to_pylist(), b.column(1).to_pylist()]
            hits, first = b.column(3), b.column(4)
            low = np.searchsorted(owner, np.arange(w.docs + 1))
            for i in range(w.docs):
                s, e = low[i], low[i + 1]
                if s == e:
                    continue
                base, doc, th = int(w.first[i]), keys[0][i], keys[1][i]
                own = whole[s:e]
                order = np.argsort(own, kind="stable")
                again = np.zeros(e - s, bool)
                again[order[1:]] = own[order[1:]] == own[order[:-1]]
                for a, z in _stretches(again):
                    rows.append((0, doc, th, a, z - a + length - 1, None, None))
                known = np.array(hits[i].as_py(), np.int64).view(np.uint64)
                to = np.array(first[i].as_py(), np.int64)
                sort = np.argsort(known)
                known, to = known[sort], to[sort]
                at, shared = _among(g[s:e], known)
                chosen = np.where(inner[s:e], inner_first[s:e], to[at])
                shard = (W.mix64(chosen.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                shard[~(shared | inner[s:e])] = -1
                edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (inner[s + 1 : e] != inner[s : e - 1]) | cut[s + 1 : e]])
                for a, z in zip(edge, np.r_[edge[1:], len(shard)], strict=True):
                    if shard[a] >= 0:
                        n = int(z - a) + length - 1
                        raw = h[base + a : base + a + n].tobytes()
                        key = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                        place = (doc, th, int(a))
                        if key in seen and seen[key] < place:
                            raw = None
                        else:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[key] = place
                        rows.append((int(shard[a]), *place, n, key, raw))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "doc", "th", "start", "n", "key", "words"])

    return joined.select("doc", "th", "text", "g", "first").mapInArrow(run, "shard long, doc long, th long, start long, n long, key long, words binary")


def _stretches(marks: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return [(int(a), int(z)) for a, z in zip(edge[::2], edge[1::2], strict=True)]


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the sequences that come through p."""
        nxt, link, length = self.next, self.link, self.length
        copy = self._state(length[p] + 1, link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def matches(self, sequence: list[int], least: int) -> np.ndarray:
        """For each word, whether the ``least`` words that end there occur in what was added."""
        nxt, link, length = self.next, self.link, self.length
        out = np.zeros(len(sequence), bool)
        state = run = 0
        for i, c in enumerate(sequence):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state = to
            run += 1
            if run >= least:
                out[i] = True
        return out


def _judged(segments: DataFrame, shards: int, length: int) -> DataFrame:
    """Rows (doc, th, start, n): stretches of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current, waiting, automaton = -1, None, [], SuffixAutomaton()
        out: list[tuple] = []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(5)]
            for k, (s, doc, th, start, n) in enumerate(zip(*columns, strict=True)):
                if s != shard:
                    shard, current, waiting, automaton = s, None, [], SuffixAutomaton()
                raw = b.column(5)[k]
                if not raw.is_valid:
                    out.append((doc, th, start, n))
                    continue
                if current != (doc, th):
                    # A document is compared with earlier ones only; its own repeats are known.
                    for part in waiting:
                        automaton.add(part)
                    current, waiting = (doc, th), []
                words = np.frombuffer(raw.as_buffer(), np.uint64).tolist()
                old = automaton.matches(words, length)[length - 1 :]
                out += [(doc, th, start + a, z - a + length - 1) for a, z in _stretches(old)]
                waiting += [words[a : z + length - 1] for a, z in _stretches(~old)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], ["doc", "th", "start", "n"])
            out = []

    dealt = segments.repartition(shards, "shard").sortWithinPartitions("shard", "doc", "th", "start")
    return dealt.mapInArrow(run, "doc long, th long, start long, n long")


def _collapsed(segments: DataFrame) -> DataFrame:
    """The segments, without the words of those that equal an earlier one: all their windows start earlier there.

    Segments without words are judged already, so they go to any task.
    """
    s = written(segments, "segments")
    place = F.struct("doc", "th", "start")
    firsts = s.where("key is not null").groupBy("key").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("key", "first")
    s = looked_up(s, "key", written(firsts, "firsts"), "first")
    s = s.withColumn("words", F.when(F.col("first").isNull() | (place == F.col("first")), F.col("words")))
    return s.withColumn("shard", F.when(F.col("words").isNull(), F.xxhash64("doc", "th", "start")).otherwise(F.col("shard"))).drop("key", "first")


def find_segments(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, int]:
    """(rows (shard, doc, th, start, n, words), number of shards): what is judged where."""
    docs = _with_slot(docs)
    many, hot_minimisers = _repeated(_rows(docs, length, None, "minimisers"), "minimisers")
    windows, hot = _hot(docs, hot_minimisers, length)
    table = many.select("g", "first")
    if windows is not None:
        table = table.unionAll(windows.select("g", "first"))
    rows = _rows(docs, length, hot, "cold").join(table, "g", "left").where("first is not null or mark")
    listed = [F.collect_list("g").alias("g"), F.collect_list(F.coalesce("first", F.lit(0))).alias("first")]
    hits = written(rows.groupBy("doc", "slot").agg(*listed), "hits")
    total = hits.agg(F.sum(F.size("g")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_MINIMISERS))
    return _collapsed(_segments(docs.join(hits, ["doc", "slot"]), length, shards, hot)), shards


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc, th, cuts): for each document that loses words, the stretches (start, n) to remove.

    ``docs`` has doc, th, text, as ``_keyed`` makes them.
    """
    cuts = _judged(*find_segments(docs, length), length)
    return written(cuts.distinct().groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n")).alias("cuts")), "cuts")


def _lost(n: int, cuts) -> np.ndarray:
    """Which words the stretches cover."""
    depth = np.zeros(n + 1, np.int64)
    for c in cuts:
        depth[c["start"]] += 1
        depth[c["start"] + c["n"]] -= 1
    return np.cumsum(depth)[:n] > 0


def remove_repeats(df: DataFrame, length: int = LENGTH, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows by document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces)."""
    docs = _keyed(df, id_column, text)
    joined = docs.join(find_repeats(docs, length), ["doc", "th"], "left").select("doc", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, digest = [], [], []
            for t, c in zip(b.column(1), b.column(2), strict=True):
                # On bytes, split() takes space and tab..carriage return, and nothing else.
                words = (t.as_py() or "").encode().split()
                total.append(len(words))
                gone = 0
                if c.is_valid:
                    lost = _lost(len(words), c.as_py())
                    gone = int(lost.sum())
                    words = compress(words, ~lost)
                removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def dedup_texts(df: DataFrame, length: int = LENGTH, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The same rows and columns, with repeated stretches cut from the text.

    A removed word goes with the white space before it; all other white space stays.
    """
    doc, th, cuts = (free_name(df, n) for n in ("_doc", "_th", "_cuts"))
    found = find_repeats(_keyed(df, id_column, text), length)
    keyed = df.withColumns({doc: F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.coalesce(text, F.lit("")))})
    renamed = found.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("cuts").alias(cuts))
    joined = keyed.join(renamed, [doc, th], "left").drop(doc, th)
    at = joined.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, c in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                t = t.as_py()
                if c.is_valid:
                    raw = t.encode()
                    places = [m.span() for m in _WORD.finditer(raw)]
                    lost = _lost(len(places), c.as_py())
                    parts, last = [], 0
                    for (low, high), gone in zip(places, lost, strict=True):
                        if not gone:
                            parts.append(raw[last:high])
                        last = high
                    parts.append(raw[last:])
                    t = b"".join(parts).decode()
                out.append(t)
            columns = [pa.array(out, b.column(i).type) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return joined.mapInArrow(run, df.schema)
