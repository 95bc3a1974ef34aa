"""Bulk-synchronous best-fit packing into as few sequences as can be (operator 13).

A document's ids and its end token are cut into pieces of ``capacity`` ids, the first piece being the
shorter one.  Full pieces are sequences by themselves, and each piece of more than half a sequence opens
one: no two of them fit together.  All others are packed in supersteps, each over documents (the pieces still
to be placed) and gaps (what is free in open sequences):

* documents and gaps are range-sorted together by size, largest first, a gap before documents of its size;
* a sweep of each range gives each document the smallest gap of the range that holds it (its successor), and puts what is
  left of the gap back;
* documents that found none meet gaps of ranges further up.  Where several want the same gap their ranks decide: ranges
  are swept from the largest to the smallest, the nearest range with gaps gives its smallest gaps first, each to as many
  documents, by rank, as surely fit into it;
* gaps are updated; if the documents left are larger together than all gaps, the largest of them open the sequences that
  they must need, at least; the next superstep takes the rest.

A superstep that places nothing opens sequences, so each one makes progress.  The driver sees one row of counts for each
range.  Each superstep is written to the shared folder, so a lost executor costs a part of one superstep.
Equal sizes are dealt by a hash, so a length that a third of all documents have is spread over ranges.

Defined results: a null or empty text is one end token; repeated rows are packed one by one; null ids are packed like
others; ties between equal sizes are broken by a hash of the piece's place in the table; an empty table gives no rows;
texts of any length are taken whole; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .token_ids import byte_ids
from .words import chunks

CAPACITY = 1024
END_ID = 2
#: A range holds at least so many documents and gaps, while more than one is needed.
RANGE_ROWS = 1000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"
SWEPT = "size long, is_doc boolean, key long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, length long, part int, rank long"
RESULT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_CARRIED = ["doc_id", "piece", "start", "length", "ids_crc32", "key"]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows by piece, with a key of its own: no piece is longer than ``capacity``, only the first of a document is shorter than the others."""
    names = [f.split()[0] for f in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end = byte_ids(path), np.array([end_id], dtype="<u4")
        task = TaskContext.get()
        key = (task.partitionId() if task else 0) << 36
        for batch in chunks(batches, text):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), library.ids(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                low, high = 0, len(ids) % capacity or capacity
                for number in range(-(-len(ids) // capacity)):
                    out.append((doc_id, number, low, high - low, zlib.crc32(ids[low:high].tobytes()), key))
                    low, high, key = high, high + capacity, key + 1
            columns = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*out, strict=True) if out else [()] * 6, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(id_column, text).mapInArrow(run, PIECE)


class Gaps:
    """Open gaps of one range by size, with the smallest gap that holds a size."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.at: dict[int, list[int]] = {}

    def add(self, size: int, row: int) -> None:
        if size not in self.at:
            insort(self.sizes, size)
            self.at[size] = []
        self.at[size].append(row)

    def take(self, size: int) -> tuple[int, int] | None:
        i = bisect_left(self.sizes, size)
        if i == len(self.sizes):
            return None
        found = self.sizes[i]
        row = self.at[found].pop()
        if not self.at[found]:
            del self.at[found], self.sizes[i]
        return found, row


def sweep(size: np.ndarray, is_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit within one range, sorted from the largest size: (row of each document's gap or -1, what is left of each gap, rank).

    Ranks count documents without a gap, from the largest, and gaps that are still at least as large as the range's smallest size, from
    the smallest; other rows have none (-1).
    """
    n = len(size)
    found, left, rank = np.full(n, -1), np.where(is_doc, 0, size), np.full(n, -1)
    gaps, alone = Gaps(), 0
    for i in range(n):
        s = int(size[i])
        if not is_doc[i]:
            gaps.add(s, i)
            continue
        hit = gaps.take(s)
        if hit is None:
            rank[i] = alone
            alone += 1
        else:
            found[i] = hit[1]
            left[hit[1]] = hit[0] - s
            if hit[0] > s:
                gaps.add(hit[0] - s, hit[1])
    offered = [row for g in gaps.sizes if g >= size[-1] for row in gaps.at[g]]
    rank[offered] = np.arange(len(offered))
    return found, left, rank


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, which is one partition."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    size, is_doc = t.column("size").to_numpy(), t.column("is_doc").to_numpy(zero_copy_only=False)
    found, left, rank = sweep(size, is_doc)
    sequence = t.column("sequence_id").combine_chunks()
    owner = np.where(is_doc, found, np.arange(len(size)))
    sequence = sequence.take(pa.array(owner, mask=owner < 0))
    task = TaskContext.get()
    part = pa.array(np.full(len(size), task.partitionId() if task else 0, np.int32))
    columns = {n: t.column(n).combine_chunks() for n in t.column_names} | {"size": pa.array(np.where(is_doc, size, left)), "sequence_id": sequence, "part": part, "rank": pa.array(rank, mask=rank < 0)}
    names = [f.split()[0] for f in SWEPT.split(", ")]
    yield from pa.table([columns[n] for n in names], names).to_batches(max_chunksize=20_000)


def across(ranges: list) -> tuple[list[tuple], dict[int, int]]:
    """Documents without a gap against gaps of ranges further up, by counts.

    ``ranges``: rows (part, docs, largest, gaps, smallest) from the largest sizes to the smallest.  Returns runs (part, first rank, end,
    part of the gaps, first gap, documents for each gap) and how many documents of each part they cover.
    """
    runs, covered, stack = [], {}, []
    for r in ranges:
        at = 0
        while at < r["docs"] and stack:
            part, first, count, smallest = stack[-1]
            each = smallest // r["largest"]
            if not each:  # only where a sampled border lies within one size
                break
            used = min(count, -(-(r["docs"] - at) // each))
            end = min(r["docs"], at + used * each)
            runs.append((r["part"], at, end, part, first, each))
            at = end
            stack[-1] = (part, first + used, count - used, smallest)
            if used == count:
                stack.pop()
        covered[r["part"]] = at
        if r["gaps"]:
            stack.append((r["part"], 0, r["gaps"], r["smallest"]))
    return runs, covered


def best_fit(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (written ``pieces``) with ``sequence_id``: the key of the piece that opened the sequence."""
    spark = rows.sparkSession
    large = rows.where(F.col("length") > capacity // 2)
    done = [large.select(*_CARRIED, F.col("key").alias("sequence_id"))]
    gaps = large.where(F.col("length") < capacity).select(F.col("key").alias("sequence_id"), (capacity - F.col("length")).alias("size"))
    docs = rows.where(F.col("length") <= capacity // 2)
    small = F.col("length") <= capacity // 2
    told = rows.agg(F.count_if(small).alias("docs"), F.count_if(~small & (F.col("length") < capacity)).alias("gaps"), F.min("length").alias("least")).first()
    n_docs, n_gaps, least = told["docs"], told["gaps"], told["least"]
    while n_docs:
        both = docs.select(F.col("length").alias("size"), F.lit(True).alias("is_doc"), *_CARRIED, F.lit(None).cast("long").alias("sequence_id")).unionByName(
            gaps.where(F.col("size") >= least).select("size", F.lit(False).alias("is_doc"), "sequence_id"), allowMissingColumns=True
        )
        ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_docs + n_gaps) // RANGE_ROWS))
        by = [F.desc("size"), F.col("is_doc"), F.xxhash64("key", "sequence_id"), F.col("key")]
        swept = written(both.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(_swept, SWEPT), "superstep")
        alone = F.col("is_doc") & F.col("sequence_id").isNull()
        offered = ~F.col("is_doc") & F.col("rank").isNotNull()
        # At most a row for each range.
        counts = (
            swept.groupBy("part")
            .agg(
                F.count_if(alone).alias("docs"), F.max(F.when(alone, F.col("size"))).alias("largest"), F.min(F.when(alone, F.col("size"))).alias("least"), F.sum(F.when(alone, F.col("size"))).alias("doc_ids"),
                F.count_if(offered).alias("gaps"), F.min(F.when(offered, F.col("size"))).alias("smallest"), F.count_if(~F.col("is_doc")).alias("all_gaps"), F.sum(F.when(~F.col("is_doc"), F.col("size"))).alias("free"),
                F.count_if(F.col("is_doc") & F.col("sequence_id").isNotNull()).alias("placed"),
            )
            .orderBy("part")
            .collect()
        )
        runs, covered = across(counts)
        total = lambda c: sum(r[c] or 0 for r in counts)
        # Placing a document takes as much from the documents as from the gaps, so the difference holds before and after it.
        lacking = -(-(total("doc_ids") - total("free")) // capacity)
        if lacking <= 0 and not total("placed") and not runs:
            lacking = -(-total("doc_ids") // capacity)
        opening = []
        for r in counts:
            n = min(max(lacking, 0), r["docs"] - covered[r["part"]])
            if n:
                opening.append((r["part"], covered[r["part"]], covered[r["part"]] + n, None, None, None))
                lacking -= n
        plan = spark.createDataFrame([*runs, *opening], "part int, low long, high long, gap_part int, gap_low long, each long")
        here = swept.where(alone).alias("d").join(F.broadcast(plan).alias("p"), (F.col("d.part") == F.col("p.part")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
        here = here.select(*[F.col(f"d.{c}") for c in _CARRIED], F.col("low").isNotNull().alias("met"), "gap_part", F.expr("gap_low + (rank - low) DIV each").alias("gap_rank"))
        target = swept.where(offered).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), "sequence_id")
        matched = here.where("gap_part IS NOT NULL").join(target, ["gap_part", "gap_rank"]).select(*_CARRIED, "sequence_id")
        opened = here.where("met AND gap_part IS NULL").select(*_CARRIED, F.col("key").alias("sequence_id"))
        placed = swept.where(F.col("is_doc") & F.col("sequence_id").isNotNull()).select(*_CARRIED, "sequence_id")
        done += [placed, matched, opened]
        free = swept.where("NOT is_doc AND size > 0").select("sequence_id", "size").unionByName(matched.select("sequence_id", (-F.col("length")).alias("size")))
        free = free.unionByName(opened.select("sequence_id", (capacity - F.col("length")).alias("size")))
        gaps = free.groupBy("sequence_id").agg(F.sum("size").alias("size"))
        docs = here.where("NOT met").select(*_CARRIED)
        n_opened = sum(o[2] - o[1] for o in opening)
        n_docs = total("docs") - sum(covered.values()) - n_opened
        n_gaps = total("all_gaps") + n_opened
        least = min((r["least"] for r in counts if r["least"]), default=1)
    return reduce(DataFrame.unionByName, done)


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows by piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    placed = best_fit(written(pieces(df, path, capacity, end_id, text, id_column), "pieces"), capacity)
    # A sequence has at most ``capacity`` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*RESULT)
