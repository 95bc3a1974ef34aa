"""Resolving phrases, paths and vectors to artifacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.written import written


#: Vectors of a tile; a task holds one tile of 64-bit numbers and a batch of queries.
TILE = 8192


def _best(product: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity) of each row's ``k`` best, ties to the smaller id, without its own id."""
    value = np.round(product, 6)
    value[own[:, None] == ids[None, :]] = -np.inf
    if value.shape[1] > k:
        bound = np.partition(value, -k, axis=1)[:, -k][:, None]
        row, col = np.nonzero(value >= np.maximum(bound, least))
    else:
        row, col = np.nonzero(value >= least)
    order = np.lexsort((ids[col], -value[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[place < k], col[place < k]
    return row, ids[col], value[row, col]


def similar_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """Top k by cosine: (query_id, vec_id, similarity, rank); zero and null vectors and self are left out, ties go to the smaller id.

    Block cosine: vectors are dealt into tiles of about ``TILE``, unit length, and each batch of queries is multiplied with a
    tile as matrices.  A tile gives each query its ``k`` best, which merge by partial top-k; so what a query costs after
    its products is ``k`` rows for each tile.  Any stated set may be the queries, all vectors too: query vectors go once to
    each tile.  ``vectors`` and ``queries``: vec_id, embedding, of one length.
    """
    n = max(1, -(-vectors.count() // TILE))
    corpus = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("tile"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"), F.lit(True).alias("asks"), "vec_id", "embedding")
    dealt = corpus.unionAll(asked).where("embedding IS NOT NULL").repartition(n, "tile").sortWithinPartitions("tile", "asks")

    def unit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        flat = b.column(3)
        rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
        norm = np.sqrt((rows * rows).sum(1))
        good = norm > 0
        return rows[good] / norm[good, None], b.column(2).to_numpy(zero_copy_only=False)[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, ids = None, [], []
        for whole in (b for b in batches if b.num_rows):
            # A batch may hold several tiles, and a tile's vectors come before its queries.
            code = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                b = whole.slice(low, high - low)
                if code[low] // 2 != tile:
                    tile, held, ids = code[low] // 2, [], []
                rows, own = unit(b)
                if not code[low] & 1:
                    held.append(rows)
                    ids.append(own)
                    continue
                if len(held) > 1:
                    held, ids = [np.concatenate(held)], [np.concatenate(ids)]
                for at in range(0, len(own) if held and len(held[0]) else 0, 512):
                    row, found, value = _best(rows[at : at + 512] @ held[0].T, ids[0], own[at : at + 512], k, least)
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 512][row]), pa.array(found), pa.array(value)], ["query_id", "vec_id", "similarity"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    best = dealt.mapInArrow(run, f"query_id {kind}, vec_id {kind}, similarity double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)


#: Tokens of a set, at most, whose subsets are keys; larger sets meet by the rarest of their tokens.
SUBSETS = 8


def _subsets(least: float) -> Column:
    """Structs (c, key) of the subsets of ``set``, which is sorted, that an alike set may share: ``least`` of its tokens or more."""
    none = F.expr("array(struct(0 AS c, '' AS key))")
    every = F.aggregate("set", none, lambda s, t: F.concat(s, F.transform(s, lambda x: F.struct((x["c"] + 1).alias("c"), F.concat(x["key"], F.lit(" "), t).alias("key")))))
    return F.filter(every, lambda x: (x["c"] > 0) & (x["c"] >= F.size("set") * (least - 1e-6)))


def _long_pairs(q: DataFrame, a: DataFrame, least: float) -> DataFrame:
    """Rows (set, neg, best) of pairs with a side of over ``SUBSETS`` tokens, compared whole.

    Alike sets share one of the rarest tokens of each: all but those that the rest of the overlap takes.
    """
    df = q.select(F.explode("set").alias("token")).unionAll(a.select(F.explode("set").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))
    met = lambda d, *own: (
        d.select("set", F.size("set").alias("n"), *own, F.explode("set").alias("token")).join(df, "token")
        .withColumn("r", F.row_number().over(Window.partitionBy("set").orderBy("df", "token"))).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * (least - 1e-6)) + 1)
    )
    x, y = met(q).select("token", "set", "n"), met(a, "best").select("token", F.col("set").alias("other"), F.col("n").alias("m"), "best")
    j = x.join(y, "token").where((F.greatest("n", "m") > SUBSETS) & (F.least("n", "m") >= F.greatest("n", "m") * (least - 1e-6)))
    c = F.size(F.array_intersect("set", "other"))
    return j.select("set", (-F.round(c / (F.col("n") + F.col("m") - c), 6)).alias("neg"), "best")


def fuzzy_resolve(queries: DataFrame, aliases: DataFrame, least: float = 0.3) -> DataFrame:
    """Best alias for each query: an equal phrase scores 1, else the Jaccard of token sets from ``least`` on.

    An equal phrase wins over any other alias, a permutation of its words included; ties go to more confirmations, then
    the alias.  Queries and aliases with one token set count once.  Sets meet on what they share: each alias set offers
    its best alias under each of its subsets and its size, and a query takes the best offer under its subsets.  An offer
    tells at most its alias's score, and under the tokens that both share just that, so the best offer is the best
    alias.  A subset has one offer for each size, however many sets hold it, so no token makes pairs.  Sets of over ``SUBSETS``
    tokens are compared pair by pair where they share rare tokens.
    """
    phrase = lambda c: text.normalize_phrase(F.col(c)).alias("phrase")
    with_set = lambda d: d.where("phrase <> ''").withColumn("set", F.array_sort(F.array_distinct(F.split("phrase", " "))))
    one = F.struct(F.col("confirmations").isNull().alias("none"), (-F.col("confirmations")).alias("neg"), "alias")
    q = written(with_set(queries.select("query_id", phrase("query_text"))), "queries")
    a = written(with_set(aliases.select("alias", "confirmations", phrase("alias"))).groupBy("phrase", "set").agg(F.min(one).alias("best")), "aliases")
    qs, as_ = q.select("set").distinct(), a.groupBy("set").agg(F.min("best").alias("best"))
    short = F.size("set") <= SUBSETS
    offers = as_.where(short).select(F.size("set").alias("m"), "best", F.explode(_subsets(least)).alias("s")).groupBy("s.key", "m").agg(F.min("best").alias("best"))
    offers = offers.groupBy("key").agg(F.collect_list(F.struct("m", "best")).alias("offers"))
    met = qs.where(short).select("set", F.explode(_subsets(least)).alias("s")).select("set", "s.key", "s.c").join(offers, "key").select("set", "c", F.explode("offers").alias("o"))
    scored = met.select("set", (-F.round(F.col("c") / (F.size("set") + F.col("o.m") - F.col("c")), 6)).alias("neg"), "o.best")
    if not q.select("set").unionAll(a.select("set")).where(~short).isEmpty():
        scored = scored.unionAll(_long_pairs(qs, as_, least))
    near = scored.where(F.col("neg") <= -least).groupBy("set").agg(F.min(F.struct(F.lit(1).alias("rank"), "neg", "best")).alias("found"))
    same = a.select("phrase", F.struct(F.lit(0).alias("rank"), F.lit(-1.0).alias("neg"), "best").alias("found"))
    every = q.join(near, "set").select("query_id", "found").unionAll(q.join(same, "phrase").select("query_id", "found"))
    return every.groupBy("query_id").agg(F.min("found").alias("f")).select("query_id", F.col("f.best.alias").alias("alias"), (-F.col("f.neg")).alias("score"))


def resolve_targets(paths: DataFrame, artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """The preferred live artifact of each (repo, path): a code file, then a summary, then any; ties to the smaller id."""
    live = artifacts.where("invalidated_at_seq is null")
    a = live.join(sources.where(~F.col("is_deleted")).select("source_id", "repo", "path"), "source_id").select("repo", "path", "artifact_id", F.when(F.col("artifact_type") == "code_file", 0).when(F.col("artifact_type") == "summary", 1).otherwise(2).alias("p"))
    j = paths.join(a, ["repo", "path"])
    return j.groupBy("repo", "path").agg(F.min_by("artifact_id", F.struct("p", "artifact_id")).alias("artifact_id"))


def path_table(sources: DataFrame) -> DataFrame:
    """Distinct paths with their places in order over all sources.

    Paths are sorted into ranges; a place is the one inside its range plus the sizes of the ranges
    before it, so no task sees all paths.
    """
    p = written(sources.select("path").where("path is not null").distinct().repartitionByRange("path").withColumn("range", F.spark_partition_id()), "paths")
    inside = p.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("path")) - 1)
    size = p.groupBy("range").agg(F.count("*").alias("n"))
    before = size.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before), "range").select("path", (F.col("r") + F.col("before")).alias("place"))


def grounded_quotes(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """All pairs (item_id, doc_id) where the whole quote stands in the span, white space collapsed in both.

    A quote's inner words stand whole in any span that holds it, so one run of up to five of them
    finds the candidates by an equi join on hashes.  Quotes without inner words are compared with
    every span.
    """
    q = quotes.select("item_id", text.collapsed(F.col("text")).alias("q")).where("q <> ''")
    q = q.withColumn("inner", F.expr("slice(split(q, ' '), 2, greatest(least(size(split(q, ' ')) - 2, 5), 0))")).withColumn("k", F.size("inner"))
    d = spans.select("doc_id", text.collapsed(F.col("text")).alias("d")).where("d <> ''")
    sizes = [r["k"] for r in q.where("k > 0").select("k").distinct().orderBy("k").collect()]
    hit = F.contains(F.col("d"), F.col("q"))
    out = d.join(q.where("k = 0"), hit).select("item_id", "doc_id")
    words = d.withColumn("w", F.split("d", " "))
    for k in sizes:
        runs = F.expr(f"array_distinct(transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k}))))")
        found = words.where(F.size("w") >= k).select("doc_id", "d", F.explode(runs).alias("h")).join(q.where(F.col("k") == k).select("item_id", "q", F.xxhash64("inner").alias("h")), "h")
        out = out.unionAll(found.where(hit).select("item_id", "doc_id"))
    return out
