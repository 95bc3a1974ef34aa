"""Tokens of a small query table in artifacts by one scan of the texts; nothing that a text holds is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

FIELDS = (("title", 4.0), ("search_text", 1.5), ("body_text", 1.0))
RUN = re.compile("[a-z0-9]+")
#: Runs whose tokens a task remembers, and rows whose runs are looked up at a time.
KNOWN, TEXTS = 200_000, 512
#: Characters of a piece that are one number to base 37, and characters of runs that are cut at a time.
PIECE, STEP = 12, 1 << 19
CODES = np.zeros(256, dtype=np.int64)
CODES[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 37)
#: Rows and hits that are scored at a time.
ROWS, HITS = 65_536, 3_000_000
#: Artifacts that hold a rare token, at most.
RARE = 200


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def cutter(words: list[str]) -> Callable[[list[str]], list[np.ndarray]]:
    """Places in ``words`` of those that stand in each of a list of runs of [a-z0-9].

    The pieces of all runs are numbers to base 37, each one digit longer than the one before, and are looked up among the words'
    numbers; a longer word is looked up by its first PIECE characters and then compared.
    """
    index = np.array([i for i, w in enumerate(words) if RUN.fullmatch(w)], dtype=np.int64)
    size = np.array([len(words[i]) for i in index], dtype=np.int64)
    said = CODES[np.frombuffer("".join(words[i] for i in index).encode() + b"\n", dtype=np.uint8)]
    begin = np.cumsum(size) - size
    number = said[begin] if len(index) else size
    for k in range(1, PIECE):
        more = size > k
        number[more] = number[more] * 37 + said[begin[more] + k]
    short = size <= PIECE
    order = np.argsort(number[short])
    keys, place, sizes = number[short][order], index[short][order], set(size[short].tolist())
    large: dict[int, list[int]] = {}
    for n, i in zip(number[~short].tolist(), index[~short].tolist(), strict=True):
        large.setdefault(n, []).append(i)
    starts = np.array(sorted(large), dtype=np.int64)
    bits = min(24, max(10, (16 * len(words)).bit_length()))
    slot = lambda n: (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    taken = np.zeros((2, 1 << bits), dtype=bool)
    taken[0, slot(keys)] = taken[1, slot(starts)] = True

    def among(n: np.ndarray, kind: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(taken[kind, slot(n)])
        j = np.minimum(np.searchsorted(known, n[at]), len(known) - 1)
        same = known[j] == n[at]
        return at[same], j[same]

    def cut(runs: list[str]) -> list[np.ndarray]:
        c = CODES[np.frombuffer("\n".join(runs).encode() + b"\n" * (PIECE + 1), dtype=np.uint8)].astype(np.uint8)
        first = np.cumsum([0, *(len(r) + 1 for r in runs)])
        where, what = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(c), STEP):
            at = a + np.flatnonzero(c[a : a + STEP])
            n = c[at].astype(np.int64)
            for k in range(1, PIECE + 1):
                if k > 1:
                    more = c[at + k - 1]
                    on = np.flatnonzero(more)
                    at, n = at[on], n[on] * 37 + more[on]
                if k in sizes and len(at):
                    i, j = among(n, 0, keys)
                    where.append(at[i])
                    what.append(place[j])
            if large and len(at):
                i, _ = among(n, 1, starts)
                for x, y in zip(at[i].tolist(), n[i].tolist(), strict=True):
                    r = int(np.searchsorted(first, x, "right")) - 1
                    got = [w for w in large[y] if runs[r].startswith(words[w], x - int(first[r]))]
                    where.append(np.full(len(got), x))
                    what.append(np.array(got, dtype=np.int64))
        run = np.searchsorted(first, np.concatenate(where), "right") - 1
        by = np.argsort(run, kind="stable")
        found, ends = np.concatenate(what)[by].astype(np.int32), np.searchsorted(run[by], np.arange(len(runs) + 1)).tolist()
        return [found[i:j].copy() for i, j in zip(ends, ends[1:])]

    return cut


def finder(words: list[str]) -> Callable[[list[str]], list[np.ndarray]]:
    """Places in ``words`` of those that stand in each text's runs of [a-z0-9], some more than once; a frequent run is cut into pieces once."""
    cut = cutter(words)
    known: dict[str, np.ndarray] = {}
    none = np.zeros(0, dtype=np.int32)

    def find(texts: list[str]) -> list[np.ndarray]:
        said = [set(RUN.findall(t)) for t in texts]
        new = set().union(*said).difference(known)
        if known and len(known) + len(new) > KNOWN:
            known.clear()
            new = set().union(*said)
        new = list(new)
        known.update(zip(new, cut(new), strict=True))
        return [np.concatenate([none, *map(known.__getitem__, runs)]) for runs in said]

    return find


def scanned_hits(words: list[str], artifacts: DataFrame) -> DataFrame:
    """Rows (artifact_id, places, weights): which of ``words`` each artifact holds, with the weights of the fields that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, mark = finder(words), np.zeros(len(words), dtype=bool)
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS):
                b = whole.slice(first, TEXTS)
                places, weights = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.float32)]
                for held in zip(*(find(b.column(k + 1).to_pylist()) for k in range(len(FIELDS))), strict=True):
                    at = distinct(np.concatenate(held))
                    total = np.zeros(len(at), dtype=np.float32)
                    for field, (_, weight) in zip(held, FIELDS, strict=True):
                        if len(field):
                            mark[field] = True
                            total += np.float32(weight) * mark[at]
                            mark[field] = False
                    places.append(at)
                    weights.append(total)
                ends = np.cumsum([len(x) for x in places]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (places, weights)]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["artifact_id", "places", "weights"])

    said = artifacts.select("artifact_id", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c, _ in FIELDS))
    return said.mapInArrow(run, f"artifact_id {artifacts.schema['artifact_id'].dataType.simpleString()}, places array<int>, weights array<float>").where(F.size("places") > 0)


def frequencies(hits: DataFrame) -> dict[int, int]:
    """By place of a token: the artifacts that hold it."""
    df = hits.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df")).toArrow()
    return dict(zip(df["place"].to_pylist(), df["df"].to_pylist(), strict=True))


def best(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``top`` highest scores, of equal ones the first, and these scores, rounded."""
    at = np.arange(len(scores))
    if len(scores) > top:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top] - 2e-6)
    r = np.round(scores[at], 6)
    if len(r) > top:
        last = np.partition(r, len(r) - top)[len(r) - top]
        above = np.flatnonzero(r > last)
        keep = np.concatenate([above, np.flatnonzero(r == last)[: top - len(above)]])
        at, r = at[keep], r[keep]
    return at, r


def prefixes(lists: Iterator[list[int]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The different prefixes of the lists, each before those that it begins: their last elements, their lengths less one,
    and the place of the prefix that is one shorter (-1: none); and the place of each list as a whole (-1: empty)."""
    known: dict[tuple[int, int], int] = {}
    below: dict[int, list[int]] = {-1: []}
    last, whole = [], []
    for each in lists:
        at = -1
        for x in each:
            if (to := known.get((at, x))) is None:
                to = known[at, x] = len(last)
                last.append(x)
                below[at].append(to)
                below[to] = []
            at = to
        whole.append(at)
    place, depth, parent, todo = {-1: -1}, [], [], [(x, 0, -1) for x in reversed(below[-1])]
    order = []
    while todo:
        x, d, up = todo.pop()
        place[x] = len(order)
        order.append(x)
        depth.append(d)
        parent.append(place[up])
        todo += [(y, d + 1, x) for y in reversed(below[x])]
    return [last[x] for x in order], depth, parent, [place[x] for x in whole]


def blocks(batches: Iterator[pa.RecordBatch], rows: int, hits: int) -> Iterator[pa.Table]:
    """Rows in blocks of so many rows and hits (a row of more hits alone), by ascending first column."""
    held: list[pa.RecordBatch] = []
    n = k = 0

    def block() -> pa.Table:
        whole = pa.Table.from_batches(held)
        held.clear()
        return whole.take(pc.sort_indices(whole.column(0))).combine_chunks()

    for whole in batches:
        ends = np.cumsum(pc.list_value_length(whole.column(1)).to_numpy())
        at = 0
        while at < whole.num_rows:
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + hits - k, "right")), at + rows - n, whole.num_rows)
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(whole.slice(at, to - at))
                n, k, at = n + to - at, k + int(ends[to - 1] - before), to
            if at < whole.num_rows:
                yield block()
                n = k = 0
    if held:
        yield block()


def best_scores(hits: DataFrame, asked: DataFrame, gain: dict[str, float], words: list[str], top: int, df: dict[int, int] | None = None) -> DataFrame:
    """Rows (query_id, artifact_id, score): each query's ``top`` artifacts, and some more; scores are rounded, ties go to the smaller id.

    ``asked``: query_id, token, small; ``gain`` by token; a query's score of an artifact is the sum of gain times weight over its tokens.
    No query meets all artifacts.  Its tokens are ordered: those that most pairs of a query and an artifact share, then the rare ones.
    Queries share prefixes of frequent tokens, and a prefix keeps the best of the artifacts that hold its last token.  An artifact has its
    score at the last prefix whose last token it holds; where it isn't among the best there, those before it are no worse at the end,
    as gains are above 0.  Artifacts with a rare token of a query are scored pair by pair.
    """
    df = frequencies(hits) if df is None else df
    place = {w: i for i, w in enumerate(words)}
    rows = asked.select("query_id", "token").toArrow().combine_chunks()
    coded = pc.dictionary_encode(rows["query_id"], null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    query, token = coded.indices.to_numpy().astype(np.int64), np.array([place[t] for t in rows["token"].to_pylist()], dtype=np.int64)
    n, v = len(coded.dictionary), len(words)
    often = np.array([df.get(i, 0) for i in range(v)], dtype=np.int64)
    cost = often * np.bincount(token, minlength=v)
    frequent = np.flatnonzero(often > RARE)
    number = np.full(v, -1, dtype=np.int32)
    number[frequent] = np.arange(len(frequent))
    by = np.lexsort((token, -cost[token], query))
    query, token = query[by], token[by]
    is_rare = number[token] < 0
    at = np.searchsorted(query[~is_rare], np.arange(n + 1))
    dense = number[token[~is_rare]].tolist()
    last, depth, parent, leaf = prefixes(dense[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    # Queries of one prefix follow each other.
    leaf_of = np.array(leaf, dtype=np.int64)
    order = np.argsort(leaf_of, kind="stable")
    leaf_of, rank = leaf_of[order], np.argsort(order, kind="stable")
    by = np.argsort(token[is_rare], kind="stable")
    begin, asking = np.searchsorted(token[is_rare][by], np.arange(v + 1)), rank[query[is_rare]][by]
    gains, m_frequent = np.array([gain[w] for w in words], dtype=float), len(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, ROWS, HITS):
            m = b.num_rows
            held, weight = (pc.list_flatten(b.column(i).chunk(0)).to_numpy(zero_copy_only=False) for i in (1, 2))
            row = np.repeat(np.arange(m, dtype=np.int32), pc.list_value_length(b.column(1)).to_numpy())
            some = number[held] >= 0
            # Rare tokens: pairs of a query and a row.
            t, t_row, value = held[~some], row[~some], weight[~some] * gains[held[~some]]
            times = begin[t + 1] - begin[t]
            each = np.repeat(begin[t] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pair, of = np.unique(asking[each] * m + np.repeat(t_row, times), return_inverse=True)
            rare = np.bincount(of, weights=np.repeat(value, times), minlength=len(pair))
            asks, pair_row = pair // m, pair % m
            edges = np.searchsorted(leaf_of[asks], np.arange(len(last) + 1)).tolist()
            # Frequent tokens: rows by token.
            held, row, weight = held[some], row[some], weight[some]
            which = number[held].astype(np.uint16 if m_frequent < 65_536 else np.int64)
            start = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=m_frequent))]).tolist()
            by = np.argsort(which, kind="stable")
            docs_of, value_of = row[by], weight[by] * gains[held[by]]
            score, base, stack, found = np.zeros(m), np.zeros(len(pair)), [], []
            for x, (k, d) in enumerate(zip(last, depth, strict=True)):
                while len(stack) > d:
                    docs, old = stack.pop()
                    score[docs] = old
                docs = docs_of[start[k] : start[k + 1]]
                old = score[docs]
                new = old + value_of[start[k] : start[k + 1]]
                score[docs] = new
                stack.append((docs, old))
                if len(docs):
                    at, rounded = best(new, top)
                    found.append((np.full(len(at), x), docs[at], rounded))
                base[edges[x] : edges[x + 1]] = score[pair_row[edges[x] : edges[x + 1]]]
            found.append((-1 - asks, pair_row, np.round(base + rare, 6)))
            owner, at, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            ids = b.column(0).chunk(0)
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), ids.take(pa.array(at.astype(np.int64))), pa.array(scores)], ["owner", "artifact_id", "score"])

    def top_of(d: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("score"), "artifact_id")
        return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("rank")

    table = lambda **c: F.broadcast(hits.sparkSession.createDataFrame(pa.table(c)))
    # By prefix, and by query for its rare tokens (below 0).
    kept = written(top_of(hits.mapInArrow(run, f"owner long, artifact_id {hits.schema['artifact_id'].dataType.simpleString()}, score double"), "owner"), "best")
    paths = []
    for x in sorted(set(leaf_of.tolist()) - {-1}):
        at = x
        while at >= 0:
            paths.append((x, at))
            at = parent[at]
    path = np.array(paths, dtype=np.int64).reshape(-1, 2)
    of = table(query_id=coded.dictionary.take(pa.array(order)), owner=-1 - np.arange(n), leaf=leaf_of)
    own = kept.join(of.drop("leaf"), "owner").select("query_id", "artifact_id", "score")
    shared = kept.join(table(leaf=path[:, 0], owner=path[:, 1]), "owner").groupBy("leaf", "artifact_id").agg(F.max("score").alias("score"))
    shared = top_of(shared, "leaf").join(of.drop("owner"), "leaf").select("query_id", "artifact_id", "score")
    return own.unionAll(shared).groupBy("query_id", "artifact_id").agg(F.max("score").alias("score"))
