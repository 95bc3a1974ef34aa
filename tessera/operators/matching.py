"""Substrings in texts by equi joins: no needle is compared with a text that lacks a piece of it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written

#: Bytes of a lookup table that go to all tasks; beyond it, Spark shuffles both sides.
SMALL = 64_000_000
#: Characters of a slice, at least; longer runs are sliced before they are cut into pieces.
SLICE = 256
#: What parts runs of letters and digits.
APART = "[^\\p{L}\\p{N}]+"


def is_small(df: DataFrame) -> bool:
    """Whether a written table may go to all tasks, by its counted bytes (16 more a value)."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(16 * len(df.columns)))
    return (df.agg(F.sum(width)).first()[0] or 0) <= SMALL


def small(df: DataFrame) -> DataFrame:
    """A written table as the broadcast side of a join, if it is small."""
    return F.broadcast(df) if is_small(df) else df


def runs_of(c: Column, apart: str) -> Column:
    """Different pieces of a text between what ``apart`` matches."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), apart), lambda r: r != ""))


def runs_holding(runs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows (run, token), written: the different runs that hold a token.

    Runs are cut into pieces of the lengths that tokens have, and pieces meet tokens.  A long run is first cut, in one
    pass, into slices that overlap by the longest token, so that no piece is looked for from the start of the run.
    """
    distinct = tokens.select("token").distinct()
    sizes = distinct.agg(F.collect_set(F.length("token")).alias("sizes"))
    fit = F.filter("sizes", lambda n: n <= F.length("slice"))
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.length("slice") - n + 1), lambda i: F.substr(F.col("slice"), i, n))
    # The longest token that the run may hold sets the width, so slices hold twice the run's characters at most.
    longest = F.greatest(F.array_max(F.filter("sizes", lambda n: n <= F.length("run"))), F.lit(SLICE))
    pattern = F.concat(F.lit("(?s)(.{1,"), longest.cast("string"), F.lit("})(?=(.{0,"), (longest - 1).cast("string"), F.lit("}))"))
    parts = F.zip_with(F.regexp_extract_all("run", pattern, F.lit(1)), F.regexp_extract_all("run", pattern, F.lit(2)), lambda x, y: F.concat(x, y))
    sliced = F.when(F.length("run") > 2 * longest, parts).otherwise(F.array("run"))
    cut = runs.select("run").distinct().crossJoin(F.broadcast(sizes)).where(F.exists("sizes", lambda n: n <= F.length("run")))
    cut = cut.select("run", "sizes", F.explode(sliced).alias("slice"))
    pieces = cut.select("run", F.explode(F.array_distinct(F.flatten(F.transform(fit, piece)))).alias("token"))
    return written(pieces.join(distinct, "token").select("run", "token").distinct(), "runs")


def _ending(runs: DataFrame, tokens: DataFrame, at_end: bool) -> DataFrame:
    """Rows (run, token): the tokens that a run ends (or begins) with; only lengths that tokens have are cut off."""
    sizes = tokens.agg(F.collect_set(F.length("token")).alias("sizes"))
    piece = lambda n: F.substr(F.col("run"), F.length("run") - n + 1 if at_end else F.lit(1), n)
    cut = runs.crossJoin(F.broadcast(sizes)).select("run", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("run")), piece)).alias("token"))
    return cut.join(small(tokens), "token")


def _neighbours(c: Column) -> Column:
    """Pairs (x, y) of neighbouring runs of letters and digits, as often as they are there (equal structs are costly to find in an array)."""
    runs = F.filter(F.split(F.coalesce(c, F.lit("")), APART), lambda r: r != "")
    pairs = F.zip_with(runs, F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))
    return F.array_compact(pairs)


def _by_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (text_id, needle) of needles (needle, pairs) with two runs or more.

    Where such a needle stands, two runs of the text are side by side, one ending with the needle's left run and one beginning with
    the right one.  Different pairs of runs of all texts are looked up once; of a needle's pairs the one that fewest texts have
    finds the candidates.
    """
    keyed = written(needles.select("needle", F.explode("pairs").alias("p")).select("needle", F.col("p.x").alias("l"), F.col("p.y").alias("r")).distinct(), "pairs")
    wanted = written(keyed.select("l", "r").distinct(), "wanted")
    side = lambda c: written(wanted.select(F.col(c).alias("token")).distinct(), "tokens")
    met = written(texts.select(F.explode(_neighbours(F.col("text"))).alias("p")).select("p.x", "p.y").distinct(), "neighbours")
    ends = _ending(met.select(F.col("x").alias("run")).distinct(), side("l"), True).toDF("l", "x")
    begins = _ending(met.select(F.col("y").alias("run")).distinct(), side("r"), False).toDF("r", "y")
    ends, begins = written(ends, "ends"), written(begins, "begins")
    held = met.join(small(ends), "x").join(small(begins), "y").join(small(wanted), ["l", "r"])
    held = written(held.select(F.xxhash64("x", "y").alias("h"), F.xxhash64("l", "r").alias("key")).distinct(), "held")
    have = texts.select("text_id", F.explode(F.array_distinct(F.transform(_neighbours(F.col("text")), lambda p: F.xxhash64(p["x"], p["y"])))).alias("h"))
    have = written(have.join(small(held), "h").select("text_id", "key").distinct(), "having")
    df = have.groupBy("key").agg(F.count("*").alias("df"))
    of = keyed.select("needle", F.xxhash64("l", "r").alias("key")).join(df, "key", "left").groupBy("needle")
    # All of a needle's pairs must be known.
    rare = of.agg(F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min_by("key", F.struct("df", "key")).alias("key")).where("least > 0")
    return have.join(rare.select("needle", "key"), "key").select("text_id", "needle")


#: Bytes of runs in a scan: ASCII letters and digits, and all that is not ASCII.  A needle with such a run has this pattern.
_IN_RUN = np.array([chr(c).isalnum() or c > 127 for c in range(256)])
HAS_RUN = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
#: Bytes of text that are scanned at once, and pieces of neighbours that are looked up at once.
SCANNED_AT_ONCE, LOOKED_UP_AT_ONCE = 1_000_000, 2_000_000
_P = 0x9E3779B97F4A7C15
_PARTS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Pieces:
    """Texts (bytes) as runs, with a hash of any slice: the sum of byte times power, shifted to its start."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        with np.errstate(over="ignore"):
            factors = np.full(len(raw) + 1, _P, np.uint64)
            back = np.full(len(raw) + 1, pow(_P, -1, 1 << 64), np.uint64)
            factors[0] = back[0] = 1
            self.back = np.cumprod(back)
            self.sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(factors)[:-1], dtype=np.uint64)]
        inside = _IN_RUN[raw]
        head = np.zeros(len(raw) + 1, bool)
        head[at] = True
        starts, stops = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | head[1:-1]
        stops[:-1] &= ~inside[1:] | head[1:-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.back[start]

    def neighbours(self) -> np.ndarray:
        """Runs whose next run lies in the same text."""
        return np.flatnonzero(self.text[:-1] == self.text[1:])

    def key(self, left: np.ndarray, right: np.ndarray, run: np.ndarray) -> np.ndarray:
        """One key for the left piece, what parts the run from the next, and the right piece."""
        with np.errstate(over="ignore"):
            return left * _PARTS[0] + self.hashes(self.end[run], self.start[run + 1]) * _PARTS[1] + right * _PARTS[2]


def _scanner(needles: list[bytes]) -> tuple:
    """What a scan looks up: (hashes and lengths of left pieces, of right pieces, sorted keys, needle of each key), and for needles
    of one run (sorted hashes, lengths, needle of each hash).

    Of a needle's neighbours those that fewest needles have find it.
    """
    p = _Pieces(needles)
    alone = np.flatnonzero(np.bincount(p.text, minlength=len(needles))[p.text] == 1)
    hashes = p.hashes(p.start[alone], p.end[alone])
    alone = alone[order := np.argsort(hashes, kind="stable")]
    one = hashes[order], np.unique((p.end - p.start)[alone]), p.text[alone]
    run = p.neighbours()
    left, right = p.hashes(p.start[run], p.end[run]), p.hashes(p.start[run + 1], p.end[run + 1])
    key = p.key(left, right, run)
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((run, count[which], p.text[run]))
    first = order[np.unique(p.text[run][order], return_index=True)[1]]
    first = first[np.argsort(key[first], kind="stable")]
    size = lambda i: np.unique((p.end - p.start)[i])
    return (np.unique(left[first]), size(run[first]), np.unique(right[first]), size(run[first] + 1), key[first], p.text[run[first]]), one


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, ``count`` of them, for each."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _met(p: _Pieces, words: np.ndarray, known: np.ndarray, sizes: np.ndarray, at_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The known pieces that runs end (or begin) with, by run: (first, count, hashes)."""
    owner, found = [], []
    for n in sizes:
        w = np.flatnonzero(p.end[words] - p.start[words] >= n)
        s = p.end[words[w]] - n if at_end else p.start[words[w]]
        h = p.hashes(s, s + n)
        there = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        owner.append(w[there])
        found.append(h[there])
    owner, found = np.concatenate(owner), np.concatenate(found)
    count = np.bincount(owner, minlength=len(words))
    return np.cumsum(count) - count, count, found[np.argsort(owner, kind="stable")]


def _of_pairs(p: _Pieces, words: np.ndarray, of: np.ndarray, scanner: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, needle) of needles whose neighbours stand in the text; ``words``: a run of each kind, ``of``: the kind of each run."""
    lefts, left_sizes, rights, right_sizes, keys, needle = scanner
    run = p.neighbours()
    l_first, l_count, l = _met(p, words, lefts, left_sizes, True)
    r_first, r_count, r = _met(p, words, rights, right_sizes, False)
    x, y = of[run], of[run + 1]
    many = l_count[x] * r_count[y]
    run, x, y, many = (v[many > 0] for v in (run, x, y, many))
    low = 0
    for high in np.searchsorted(np.cumsum(many), np.arange(LOOKED_UP_AT_ONCE, many.sum() + LOOKED_UP_AT_ONCE, LOOKED_UP_AT_ONCE), "left") + 1:
        m = many[low:high]
        at, i = np.repeat(np.arange(low, low + len(m)), m), _spread(np.zeros(len(m), np.int64), m)
        width = r_count[y[at]]
        key = p.key(l[l_first[x[at]] + i // width], r[r_first[y[at]] + i % width], run[at])
        a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        hit = np.flatnonzero(b > a)
        n = (b - a)[hit]
        yield np.repeat(p.text[run[at[hit]]], n), needle[_spread(a[hit], n)]
        low = high


def _of_runs(p: _Pieces, words: np.ndarray, of: np.ndarray, scanner: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, needle) of needles whose only run stands in a run of the text."""
    keys, sizes, needle = scanner
    size = p.end[words] - p.start[words]
    owner, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in sizes:
        w = np.flatnonzero(size >= n)
        places = size[w] - n + 1
        start = _spread(p.start[words[w]], places)
        h = p.hashes(start, start + n)
        a, b = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        hit = np.flatnonzero(b > a)
        n_hit = (b - a)[hit]
        owner.append(np.repeat(np.repeat(w, places)[hit], n_hit))
        found.append(needle[_spread(a[hit], n_hit)])
    owner, found = np.concatenate(owner), np.concatenate(found)
    found = found[np.argsort(owner, kind="stable")]
    count = np.bincount(owner, minlength=len(words))
    here = np.unique(p.text * len(words) + of)
    text, word = here // len(words), here % len(words)
    yield np.repeat(text, count[word]), found[_spread((np.cumsum(count) - count)[word], count[word])]


def _scanned(texts: list[bytes], needles: list[bytes], scanner: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(text, needle): positions of the needles that stand in each text."""
    p = _Pieces(texts)
    pairs = [np.zeros(0, np.int64)]
    if len(p.start):
        # Equal runs are looked up once.
        _, words, of = np.unique(p.hashes(p.start, p.end), return_index=True, return_inverse=True)
        for how, known in ((_of_pairs, scanner[0]), (_of_runs, scanner[1])):
            if len(known[-1]):
                pairs += [np.unique(text * len(needles) + needle) for text, needle in how(p, words, of, known)]
    pairs = np.unique(np.concatenate(pairs))
    text, which = pairs // len(needles), pairs % len(needles)
    there = np.fromiter((needles[w] in texts[t] for t, w in zip(text.tolist(), which.tolist(), strict=True)), bool, len(text))
    return text[there], which[there]


def _by_scan(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (text_id, needle) of needles (needle) that have a run, which go to all tasks: texts are read once, and none is shuffled."""
    told = needles.select("needle").toArrow()["needle"].combine_chunks()
    raw = [s.encode() for s in told.to_pylist()]
    known = needles.sparkSession.sparkContext.broadcast((told, raw, _scanner(raw)))
    kind = dict(texts.dtypes)["text_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, raw, scanner = known.value
        for batch in batches:
            ids, held = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
            size = np.cumsum([len(t) for t in held])
            low = 0
            while low < len(held):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SCANNED_AT_ONCE, "right")))
                text, which = _scanned(held[low:high], raw, scanner)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + low)), told.take(pa.array(which))], ["text_id", "needle"])
                low = high

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, needle string")


def strings_in_texts(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (text_id, needle): the different needles (needle) that stand, as they are, in a text (text_id, text).

    Needles of two runs of letters and digits or more are found by neighbouring runs, those of one run by the runs that hold it: in one scan
    of the texts if such needles may go to all tasks, else by joins.  Needles without any are compared with every text: only those.
    """
    n = needles.where("needle <> ''").select("needle").distinct()
    n = n.select("needle", _neighbours(F.col("needle")).alias("pairs"), F.array_max(runs_of(F.col("needle"), APART)).alias("token"))
    n = written(n.withColumn("held", F.col("needle").rlike(HAS_RUN)), "needles")
    done = []
    if is_small(held := n.where("held").select("needle")) and not held.isEmpty():
        done, n = [_by_scan(held, texts)], n.where("not held")
    return reduce(DataFrame.unionAll, done + _by_joins(n, texts, bool(done)))


def _by_joins(n: DataFrame, texts: DataFrame, some: bool) -> list[DataFrame]:
    """The rows of needles (needle, pairs, token), nothing shuffled for kinds of needles that there are none of; ``some``: there are other rows."""
    paired = n.where(F.size("pairs") > 0)
    parts = [] if some and paired.isEmpty() else [_by_pairs(paired, texts)]
    single = n.where((F.size("pairs") == 0) & F.col("token").isNotNull())
    if not single.isEmpty():
        have = texts.select("text_id", F.explode(runs_of(F.col("text"), APART)).alias("run"))
        held = written(runs_holding(have, single).join(single.select("token", "needle"), "token").select("run", "needle").distinct(), "holding")
        parts.append(have.join(small(held), "run").select("text_id", "needle").distinct())
    out = []
    if parts:
        met = reduce(DataFrame.unionAll, parts).groupBy("text_id").agg(F.collect_list("needle").alias("met"))
        out.append(texts.join(met, "text_id").select("text_id", F.explode(F.filter("met", lambda m: F.contains(F.col("text"), m))).alias("needle")))
    bare = n.where("token is null").select("needle")
    if not bare.isEmpty():
        out.append(texts.join(bare, F.contains(F.col("text"), F.col("needle"))).select("text_id", "needle"))
    return out


def substrings_in_texts(needles: DataFrame, texts: DataFrame, needle_id: str, needle: str, text_id: str, text: str) -> DataFrame:
    """All pairs (needle_id, text_id) where the needle, as it is, stands in the text; equal needles are looked for once."""
    n = written(needles.select(needle_id, needle).where(F.col(needle) != ""), "needles")
    found = strings_in_texts(n.select(F.col(needle).alias("needle")), texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("text")))
    return found.join(n.select(needle_id, F.col(needle).alias("needle")), "needle").select(needle_id, F.col("text_id").alias(text_id))
