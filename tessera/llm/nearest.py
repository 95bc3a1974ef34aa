"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard (operator 7).

Vectors are dealt to shards of about ``SHARD`` by a hash, whatever their number.  In a shard,
points join the graph in batches: a greedy search from the middle point proposes neighbours, and
robust pruning keeps the diverse ones (a candidate goes when a kept neighbour is ``ALPHA`` times
nearer to it than the point is).  Edges are made both ways and pruned to ``DEGREE``.  Queries run a
beam search in every shard; the best of all shards are kept, scored in double precision on the
original vectors.

The measure is the inner product.  For building and searching, one more component makes it a
distance: sqrt(M * M - x * x) for points of at most length M, and 0 for queries.

Equal vectors are one point, which carries its 1 + k smallest ids, so a vector that a third of all
rows share is bounded before the shuffle.  A graph is written once, as a file of the shared
folder; queries are shuffled by (shard, block) and each task maps its shard's file.  Graphs and blocks
have bounded sizes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id; vectors of different lengths aren't compared; of repeated rows
(same id and vector) one counts; a query's own id is never its answer; with fewer than k
candidates all that are found are returned; an empty table gives no rows; extra columns are
ignored.  Components are searched as 32-bit numbers and scored as 64-bit ones: vectors with components
beyond 1e18 are found by chance only.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mounted, shared_folder, written
from .elias_fano import pack_arrays, view_arrays

NEIGHBOURS = 20
SHARD = 4096
DEGREE = 32
BEAM = 96
ALPHA = 1.2
BATCH = 512
QUERY_BLOCK = 2048


def lifted(x: np.ndarray) -> np.ndarray:
    """Points with the component that turns inner products into distances."""
    square = np.einsum("ij,ij->i", x, x)
    return np.c_[x, np.sqrt(np.maximum(square.max() - square, 0))] if len(x) else np.c_[x, x[:, :0].sum(1)]


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the ``beam`` best points that each query's search has seen; -1 where fewer."""
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    ids[:, 0] = start
    far[:, 0] = ((queries - points[start]) ** 2).sum(1)
    open_[:, 0] = True
    square = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    live = np.arange(n)
    while len(live):
        best = np.where(open_[live], far[live], np.inf).argmin(1)
        open_[live, best] = False
        near = edges[ids[live, best]]
        safe = np.maximum(near, 0)
        d = own[live, None] + square[safe] - 2 * np.einsum("nrd,nd->nr", points[safe], queries[live])
        held = (near[:, :, None] == ids[live][:, None, :]).any(2)
        d[(near < 0) | held] = np.inf
        all_ids, all_far = np.concatenate([ids[live], near], 1), np.concatenate([far[live], d.astype(np.float32)], 1)
        all_open = np.concatenate([open_[live], np.isfinite(d)], 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :beam]
        take = np.take_along_axis
        ids[live], far[live], open_[live] = take(all_ids, order, 1), take(all_far, order, 1), take(all_open, order, 1)
        live = live[(open_[live] & np.isfinite(far[live])).any(1)]
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each owner, out of its row of candidates (-1: none)."""
    safe = np.maximum(candidates, 0)
    x = points[safe]
    d = ((x - points[owners][:, None, :]) ** 2).sum(2)
    d[(candidates < 0) | (candidates == owners[:, None])] = np.inf
    order = np.argsort(d, 1, kind="stable")
    d, safe, x = np.take_along_axis(d, order, 1), np.take_along_axis(safe, order, 1), np.take_along_axis(x, order[:, :, None], 1)
    same = (safe[:, 1:] == safe[:, :-1]) & np.isfinite(d[:, 1:])
    d[:, 1:][same] = np.inf
    square = (x * x).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(owners), degree), -1, np.int64)
    rows = np.arange(len(owners))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        out[some, k] = safe[rows, first][some]
        alive[rows, first] = False
        alive &= ~((alpha * alpha * between[rows, first] <= d) & some[:, None])
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges by point, -1 where fewer; the start point)."""
    n = len(points)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(11).permutation(n)
    order = np.r_[start, order[order != start]] if n else order
    low = 1
    while low < n:
        new = order[low : low + min(BATCH, max(8, low))]
        found, _ = beam_search(points, edges, start, points[new], beam)
        # A batch's own points are candidates too: they don't see each other in the graph yet.
        near = ((points[new][:, None, :] - points[new][None, :, :]) ** 2).sum(2) if len(new) <= 64 else None
        if near is None:
            sq = (points[new] ** 2).sum(1)
            near = sq[:, None] + sq[None, :] - 2 * points[new] @ points[new].T
        np.fill_diagonal(near, np.inf)
        mates = new[np.argsort(near, 1)[:, : min(16, len(new) - 1)]] if len(new) > 1 else np.zeros((len(new), 0), np.int64)
        edges[new] = robust_prune(points, new, np.concatenate([found, mates], 1), degree, alpha)
        to, back = edges[new].ravel(), np.repeat(new, degree)
        keep = to >= 0
        _link_back(points, edges, to[keep], back[keep], degree, alpha)
        low += len(new)
    return edges, start


def _link_back(points: np.ndarray, edges: np.ndarray, to: np.ndarray, back: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges to -> back; points with too many are pruned."""
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    owners, first, count = np.unique(to, return_index=True, return_counts=True)
    wide = np.full((len(owners), degree + int(count.max(initial=0))), -1, np.int64)
    wide[:, :degree] = edges[owners]
    column = np.arange(len(to)) - np.repeat(first, count)
    wide[np.repeat(np.arange(len(owners)), count), degree + column] = back
    wide.sort(axis=1)
    wide = wide[:, ::-1]
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    many = (wide >= 0).sum(1) > degree
    few = -np.sort(-wide[~many], axis=1)[:, :degree]
    edges[owners[~many]] = few
    at = np.flatnonzero(many)
    for low in range(0, len(at), BATCH):
        part = at[low : low + BATCH]
        edges[owners[part]] = robust_prune(points, owners[part], wide[part], degree, alpha)


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Rows (vector, ids): each different vector with its smallest ids."""
    r = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return r.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def graph_path(folder: str, dim: int, shard: int) -> str:
    return f"{folder}/{dim}-{shard // 1000}/{shard}.graph"


def _write_graph(table: pa.Table, folder: str) -> pa.Table:
    """Builds a shard's graph and writes it, with its vectors and ids, as one file that tasks map."""
    x = _matrix(table["vector"].combine_chunks())
    edges, start = build(lifted(x.astype(np.float32)))
    ids = table["ids"].combine_chunks()
    dim, shard = (table[c][0].as_py() for c in ("dim", "shard"))
    parts = {
        "vectors": x.astype(np.float64).ravel(), "edges": edges.astype(np.int32).ravel(), "start": np.array([start]),
        "ids": ids.flatten().to_numpy(), "first": np.cumsum(np.r_[0, pc.list_value_length(ids).to_numpy()]),
    }
    path = graph_path(folder, dim, shard)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    # A task that runs again puts the same bytes in place of the file, which is never there in part.
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.writelines(pack_arrays(parts))
    os.replace(own, path)
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "folder": [folder]})


def index(vectors: DataFrame, k: int = NEIGHBOURS, shard: int = SHARD) -> DataFrame:
    """Rows (dim, shard, folder): the graphs, each one file of the shared folder."""
    p = written(_points(vectors, k).withColumn("dim", F.size("vector")), "points")
    shards = max(1, -(-p.count() // shard))
    p = p.withColumn("shard", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).cast("long"))
    folder = f"{mounted(shared_folder(vectors.sparkSession))}/graphs-{uuid.uuid4().hex}"
    return written(p.groupBy("dim", "shard").applyInArrow(lambda t: _write_graph(t, folder), "dim int, shard long, folder string"), "graphs")


def search(graphs: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, vec_id, score): the k nearest that each shard finds; ``queries`` has query_id, vector.

    A task maps its shard's graph; only queries are shuffled.
    """
    q = written(queries.withColumn("dim", F.size("vector")), "queries")
    blocks = max(1, -(-q.count() // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long"))
    keys = graphs.select(F.col("dim").alias("to_dim"), F.col("shard").alias("to_shard"))
    q = q.join(F.broadcast(keys) if keys.count() <= 10_000 else keys, F.col("dim") == F.col("to_dim"))
    q = q.select("query_id", "vector", "to_shard", "to_dim", "block")
    some = graphs.select("folder").first()
    folder = some["folder"] if some else ""

    def run(asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        dim, shard = (asked[c][0].as_py() for c in ("to_dim", "to_shard"))
        graph = view_arrays(np.memmap(graph_path(folder, dim, shard), np.uint8, "r"))
        x = graph["vectors"].reshape(-1, dim)
        edges = graph["edges"].reshape(len(x), -1).astype(np.int64)
        ids, first, start = graph["ids"], graph["first"], int(graph["start"][0])
        points = lifted(x.astype(np.float32))
        who = asked["query_id"].to_pylist()
        y = _matrix(asked["vector"].combine_chunks()).astype(np.float64)
        for low in range(0, len(y), BATCH):
            part = y[low : low + BATCH]
            found, _ = beam_search(points, edges, start, np.c_[part, np.zeros(len(part))].astype(np.float32), max(BEAM, k + 1))
            exact = np.einsum("nbd,nd->nb", x[np.maximum(found, 0)], part)
            exact[found < 0] = -np.inf
            for i, best in enumerate(np.argsort(-exact, 1, kind="stable")):
                rows: list[tuple] = []
                least = None
                for j in best:
                    at = found[i, j]
                    if at < 0 or (len(rows) >= k and exact[i, j] < least):
                        break
                    least = exact[i, j]
                    rows += [(who[low + i], v, float(least)) for v in ids[first[at] : first[at + 1]].tolist() if v != who[low + i]]
                out += sorted(rows, key=lambda r: (-r[2], r[1]))[:k]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return q.groupBy("to_shard", "to_dim", "block").applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows: query_id, rank, vec_id, score; ties go to the smaller id."""
    v = rows.where(usable(F.col(vector)) & F.col(id_column).isNotNull())
    v = v.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    graphs = index(v.select("vec_id", "vector"), k)
    found = search(graphs, v.where("asks").select(F.col("vec_id").alias("query_id"), "vector").distinct(), k).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
