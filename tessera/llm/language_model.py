"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped shards (operator 10).

Counting: every word, bigram and trigram of the training texts is kept, whatever its count.  A
trigram (a, b, c) belongs to the shard of its middle word b, whose shard also has the bigrams (b, c)
and the contexts (a, b); the number of shards follows the number of tokens.  Tasks count what they
read, in blocks, and send the counts; each shard is merged in one task, which writes the trie of the
shard as a file of the shared folder.  A word that alone would fill a shard has its trigrams dealt
by the word before to shards of their own, and its bigrams stay in the first one.  A bounded sample
of the texts tells how many shards there are and which words are that frequent: the layout only, all
rows are counted.  Not split are the trigrams after a start token, whose word before is the start itself, and
the bigrams of one frequent word: they lie in one shard each, however large the corpus is.

Model: interpolated absolute discounting.  A shard stores, each in one byte, the discounted shares
(c - d) / total of its bigrams and trigrams and the mass that each context leaves to the next lower
order; the lowest order is the add-one probability of exact word counts.

Scoring: one pass over whole texts, without a shuffle.  A task sorts the different n-grams of a block
by shard, maps one shard at a time (``elias_fano.Trie``) and looks up only what the block asks for.
Words are told apart by 64-bit hashes (two of ten million words collide with odds of 3e-6);
neighbours within one context by 32 bits, which touches a smoothed probability with odds of 2e-10 for
each successor that the context has, and no exact column.

Defined results: a null or empty text is one end token; a null id is training, not held out;
repeated rows are scored (and counted) one by one; without training documents all words are
unknown and N and V are 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import mounted, shared_folder, written
from .elias_fano import Trie

HELD_OUT = (7, 2)
DISCOUNT = 0.75
SHARD_TOKENS = 1_500_000
#: Words of a block have numbers of 21 bits, so three of them fit one key.
BITS = 21
BLOCK_TOKENS = 1 << BITS
#: Bytes of text that a task scores at a time.
BLOCK_BYTES = 5_000_000
#: Documents that choose the layout.
LAYOUT_SAMPLE = 20_000
START, END, ANY = W.mix64(np.array([0x57A7, 0xE0D, 0xA11], np.uint64))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a start token, the lower-cased words and an end token of each text; first token of each text and one more)."""
    w = W.split(texts, lower=True)
    first = w.first + 2 * np.arange(w.docs + 1)
    out = np.full(int(first[-1]), END, np.uint64)
    out[first[:-1]] = START
    inner = np.ones(len(out), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    out[inner] = w.hashes()
    return out, first


def held_out(parts: tuple[int, int] = HELD_OUT):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts[0] == parts[1], F.lit(False))


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, place of each value among them)."""
    coded = pa.array(values.view(np.int64)).dictionary_encode()
    found = coded.dictionary.to_numpy().view(np.uint64)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[coded.indices.to_numpy()]


def trigrams(t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words in order, keys) of a token stream, in stretches: a key for each token that isn't a start.

    A key holds the places of the word before, the one before that, and the token itself.
    """
    for low in range(0, len(t), BLOCK_TOKENS - 2):
        lead = min(low, 2)
        part = t[low - lead : low + BLOCK_TOKENS - 2]
        words, place = ranked(part)
        at = np.flatnonzero(part[lead:] != START) + lead
        b = place[at - 1]
        a = np.where(part[at - 1] == START, b, place[np.maximum(at - 2, 0)])
        yield words, (b << 2 * BITS | a << BITS | place[at]).astype(np.uint64)


class Layout:
    """Where n-grams live: ``home`` by the middle word's hash range, and the shards of very frequent middle words."""

    def __init__(self, shards: int, frequent: dict[int, int]):
        self.shards = shards
        self.frequent = np.array(sorted(frequent), np.uint64)
        parts = np.array([frequent[int(w)] for w in self.frequent], np.int64)
        self.parts, self.begin = parts, shards + np.cumsum(parts) - parts

    def home(self, b: np.ndarray) -> np.ndarray:
        return (((b >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)

    def split(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where the middle word is a frequent one, their shards)."""
        if not len(self.frequent):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, b), len(self.frequent) - 1)
        some = np.flatnonzero(self.frequent[at] == b)
        at = at[some]
        return some, self.begin[at] + (W.mix64(a[some]) % self.parts[at].astype(np.uint64)).astype(np.int64)


def _layout(train: DataFrame, shard_tokens: int, sample: int) -> Layout:
    share = min(1.0, sample / max(train.count(), 1))
    some = train.sample(share, seed=7) if share < 1 else train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches):
            t, _ = tokens(b.column(0))
            w, n = np.unique(t, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    counts = some.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    often = F.when(F.col("n") > share * shard_tokens, F.struct("w", "n"))
    total, frequent = counts.agg(F.sum("n"), F.collect_list(often)).first()
    parts = {r["w"] & 0xFFFFFFFFFFFFFFFF: -int(-r["n"] // (share * shard_tokens)) for r in frequent if r["w"] != int(np.array(END).view(np.int64))}
    return Layout(max(1, -int(-(total or 0) // (share * shard_tokens))), parts)


def _rows(shard: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each shard: its middle words with their numbers of trigrams, and the trigrams' outer words and counts."""
    order = np.argsort(shard, kind="stable")
    shard, a, b, c, n = shard[order], a[order].astype(np.uint32), b[order], c[order].astype(np.uint32), n[order].astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    rows = []
    for low, high in zip(cut, np.r_[cut[1:], len(shard)], strict=False):
        inner = b[low:high]
        first = np.flatnonzero(np.r_[True, inner[1:] != inner[:-1]])
        rows.append((int(shard[low]), inner[first].tobytes(), np.diff(np.r_[first, len(inner)]).astype(np.uint32).tobytes(), *(x[low:high].tobytes() for x in (a, c, n))))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(columns)], ["shard", "b", "runs", "a", "c", "n"])


def _packed_counts(train: DataFrame, layout: Layout) -> DataFrame:
    """Rows (shard, b, runs, a, c, n): trigram counts of blocks, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for words, keys in trigrams(np.concatenate(kept)):
                keys, n = np.unique(keys, return_counts=True)
                a, b, c = (words[(keys >> np.uint64(s)).astype(np.int64) & (1 << BITS) - 1] for s in (BITS, 2 * BITS, 0))
                shard = layout.home(b)
                some, apart = layout.split(a, b)
                if len(some):
                    # The bigrams of a frequent middle word, summed over the words before.
                    pair, back = np.unique(keys[some] & ~np.uint64((1 << BITS) - 1 << BITS), return_inverse=True)
                    b2, c2 = (words[(pair >> np.uint64(s)).astype(np.int64) & (1 << BITS) - 1] for s in (2 * BITS, 0))
                    shard[some] = apart
                    yield _rows(np.r_[shard, layout.home(b2)], np.r_[a, np.full(len(b2), ANY)], np.r_[b, b2], np.r_[c, c2], np.r_[n, np.bincount(back, n[some]).astype(np.int64)])
                else:
                    yield _rows(shard, a, b, c, n)

        kept, total = [], 0
        for batch in W.chunks(batches):
            t, _ = tokens(batch.column(0))
            kept.append(t)
            total += len(t)
            if total >= BLOCK_TOKENS:
                yield from counted(kept)
                kept, total = [], 0
        if total:
            yield from counted(kept)

    return train.select("text").mapInArrow(run, "shard long, b binary, runs binary, a binary, c binary, n binary")


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/{shard // 1000}/{shard}.trie"


def _unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])


def build_shards(train: DataFrame, layout: Layout, folder: str) -> DataFrame:
    """Writes each shard's trie as a file; rows (shard, tokens, words): what it counts at home."""

    def build(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        b = np.repeat(_unpacked(table, "b", np.uint64), _unpacked(table, "runs", np.uint32))
        image, n_tokens, n_words = Trie.image(_unpacked(table, "a", np.uint32), b, _unpacked(table, "c", np.uint32), _unpacked(table, "n", np.uint32), DISCOUNT)
        path = shard_path(folder, shard)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        # A task that runs again puts the same bytes in place of the file, which is never there in part.
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.writelines(image)
        os.replace(own, path)
        at_home = shard < layout.shards
        return pa.table({"shard": [shard], "tokens": [n_tokens if at_home else 0], "words": [n_words if at_home else 0]})

    n = layout.shards + int(layout.parts.sum())
    return _packed_counts(train, layout).repartition(n, "shard").groupBy("shard").applyInArrow(build, "shard long, tokens long, words long")


def stream_scores(t: np.ndarray, layout: Layout, folder: str, n_tokens: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, log10 of the add-one probability, log10 P in context) of each token that isn't a start."""
    known, base, score = [], [], []
    for words, keys in trigrams(t):
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(keys)])
        keys = keys[first].astype(np.int64)
        part = (1 << BITS) - 1
        at_a, at_b, at_c = keys >> BITS & part, keys >> 2 * BITS, keys & part
        a, b, c = words[at_a], words[at_b], words[at_c]
        count = np.zeros(len(words), np.int64)
        own2, own3, rest1, rest2 = np.zeros(len(keys)), np.zeros(len(keys)), np.ones(len(keys)), np.ones(len(keys))
        home, word_home = layout.home(b), layout.home(words)
        some, apart = layout.split(a, b)
        # Words and middle words stand in order of their hash, which is the order of home shards.
        for s in np.unique(word_home):
            trie = Trie.mapped(shard_path(folder, s))
            if trie is None:
                continue
            low, high = np.searchsorted(word_home, [s, s + 1])
            count[low:high] = trie.word_counts(words[low:high])
            low, high = np.searchsorted(home, [s, s + 1])
            own2[low:high], rest1[low:high], own3[low:high], rest2[low:high] = trie.shares(a[low:high], b[low:high], c[low:high])
        for s in np.unique(apart):
            trie = Trie.mapped(shard_path(folder, s))
            at = some[apart == s]
            if trie is not None:
                _, _, own3[at], rest2[at] = trie.shares(a[at], b[at], c[at])
        # A start stands before each text as an end stands behind it: their counts are one.
        for i in np.flatnonzero(words == END):
            start = np.searchsorted(words, START)
            has = start < len(words) and words[start] == START
            trie = None if has else Trie.mapped(shard_path(folder, layout.home(np.array([START]))[0]))
            count[i] = count[start] if has else trie.word_counts(np.array([START]))[0] if trie else 0
        p1 = (count[at_c] + 1) / (n_tokens + n_words + 1)
        for out, value in ((known, count[at_c] > 0), (base, np.log10(p1)), (score, np.log10(own3 + rest2 * (own2 + rest1 * p1)))):
            each = np.empty(len(order), value.dtype)
            each[order] = np.repeat(value, times)
            out.append(each)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (known, base, score))


def score_documents(df: DataFrame, shard_tokens: int = SHARD_TOKENS, sample: int = LAYOUT_SAMPLE) -> DataFrame:
    """Rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    train = docs.where(~F.col("held_out"))
    layout = _layout(train, shard_tokens, sample)
    folder = f"{mounted(shared_folder(spark))}/trie-{uuid.uuid4().hex}"
    built = written(build_shards(train, layout, folder), "shards")
    n, v = built.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(kept)
            t, first = tokens(table["text"])
            known, base, score = stream_scores(t, layout, folder, n, v)
            size = np.diff(first) - 1
            begin = np.cumsum(size) - size
            sums = [np.add.reduceat(x, begin) for x in (known.astype(np.int64), base, score)]
            ids, out = (table[c].combine_chunks() for c in ("doc_id", "held_out"))
            return pa.RecordBatch.from_arrays([ids, out, pa.array(size), pa.array(sums[0]), pa.array(np.full(len(size), n)), pa.array(sums[1]), pa.array(sums[2])], names)

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kept, total = [], 0
        for b in W.chunks(batches):
            kept.append(b)
            total += b.column(2).nbytes
            if total >= BLOCK_BYTES:
                yield scored(kept)
                kept, total = [], 0
        if kept:
            yield scored(kept)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
