"""Filter interaction audit by wide packed counters (operator 11).

Which filter removes what depends on the order of the filters.  A document's outcome in every step of
every order depends on its mask of failing filters alone, so each mask is mapped to one big integer
whose fields hold all 600 step outcomes: one section of 600 fields for each of ``COUNTS``.  A part's
counts are the sum of its documents' integers; ``unpack`` cuts the sum into fields again.

A field has 64 bits and no field of a sum exceeds the number of rows, so no field runs over into the
next one below 2**63 rows.  Tasks sum by part and give up what they hold after ``HELD`` parts (29 KB
each); the sums of tasks are added in two rounds, first by part and salt, so that no task gets the sums
of all tasks.  A text and its copies meet by digest, pre-aggregated, so a text of a third of all rows
costs a row for each task.

Defined results: a null text is an empty one; a null part is the empty string; rows with equal ids and
equal texts don't make each other fail ``E``; null ids count as larger than all ids and as equal to each
other; repeated rows count one by one; of repeated ``labels`` rows of an id one with a 1 is enough, and
labels of null ids belong to no document; an empty table gives no rows; extra columns are not read.
Texts are told apart by 256-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bytes of a field, and of an integer.
FIELD = 8
WIDE = STEPS * len(COUNTS) * FIELD
#: Parts that a task holds sums of at a time; sums of a part are added by so many tasks at first.
HELD, SALTS = 1000, 16
SUMS = "part string, salt int, packed binary"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def outcomes(mask: int, good: bool, toxic: bool) -> int:
    """The integer of one document: bit i of ``mask`` is set if it fails filter i."""
    kept, removed, redundant = (np.zeros((len(ORDERS), len(FILTERS)), np.int64) for _ in range(3))
    alone = np.zeros_like(kept)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            fails = mask >> FILTERS.index(letter) & 1
            removed[o, s] = fails and not gone
            redundant[o, s] = fails and gone
            gone = gone or bool(fails)
            kept[o, s] = not gone
            alone[o, s] = mask == 1 << FILTERS.index(letter)
    sections = (kept, removed, redundant, alone, removed * good, removed * toxic)
    return int.from_bytes(np.stack(sections).astype("<i8").tobytes(), "little")


def unpack(packed: int) -> np.ndarray:
    """Counts by section, order and step."""
    return np.frombuffer(packed.to_bytes(WIDE, "little"), "<i8").reshape(len(COUNTS), len(ORDERS), len(FILTERS))


def conditions(text: Column) -> list[Column]:
    """Filters A to D fail where these hold; one pass of built-in functions over the whole text."""
    words = words_of(text)
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Rows (part, mask, good, toxic, n): documents by failing filters and labels, not yet summed over all tasks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(text))]
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), sum(bits[1:], bits[0]).cast("int").alias("mask"), digest)
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # A row without an id has no labels; a salt deals such rows out.
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)).alias("salt")
    rows = rows.withColumn("salt", salt).join(told.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    # Equal rows of an id first, then the rows of a text by part, mask and labels: the smallest id and its rows.
    each = rows.groupBy("id", "salt", "digest", "part", "mask", *flags).agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    same = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    least = F.min(F.struct("first.none", "first.id"))
    group = same.withColumn("least", least.over(Window.partitionBy("digest")))
    # Rows with the text's smallest id pass E; where no row has an id, all pass.
    is_first = (F.col("first.none") == F.col("least.none")) & F.col("first.id").eqNullSafe(F.col("least.id"))
    passing = F.when(~is_first, 0).when(F.col("least.none"), F.col("no_id")).otherwise(F.col("first.n"))
    group = group.withColumn("passing", passing.cast("long"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return group.select("part", "good", "toxic", F.explode(both).alias("e")).select("part", "e.mask", "good", "toxic", "e.n").where("n > 0")


def _packed(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Sums of a task's integers by part."""
    table: dict[tuple, int] = {}
    sums: dict[str, int] = {}
    task = TaskContext.get()
    turn = task.partitionId() if task else 0

    def given() -> pa.RecordBatch:
        parts = list(sums)
        packed = [sums[p].to_bytes(WIDE, "little") for p in parts]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array([turn % SALTS] * len(parts), pa.int32()), pa.array(packed, pa.binary())], ["part", "salt", "packed"])

    for batch in batches:
        for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (mask, good, toxic)
            if key not in table:
                table[key] = outcomes(*key)
            sums[part] = sums.get(part, 0) + (table[key] if n == 1 else n * table[key])
            if len(sums) >= held:
                yield given()
                turn += 1
    yield given()


def _added(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(int.from_bytes(x, "little") for t in tables for x in t.column("packed").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([0], pa.int32()), pa.array([total.to_bytes(WIDE, "little")], pa.binary())], ["part", "salt", "packed"])


def _unpacked(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(int.from_bytes(x, "little") for t in tables for x in t.column("packed").to_pylist())
    counts = unpack(total)
    which = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    value = np.array([counts[COUNTS.index("removed")][which == f].sum() for f in range(len(FILTERS))])
    columns = [pa.array([key[0].as_py()] * STEPS), pa.array(np.repeat(ORDERS, len(FILTERS))), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))]
    columns += [pa.array(counts[i].ravel()) for i in range(len(COUNTS))] + [pa.array(value[which].ravel())]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", held: int = HELD) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    rows = masks(docs, labels, part).select("part", "mask", "good", "toxic", "n")
    sums = written(rows.mapInArrow(partial(_packed, held=held), SUMS), "packed")
    added = sums.groupBy("part", "salt").applyInArrow(_added, SUMS)
    return added.groupBy("part").applyInArrow(_unpacked, RESULT)
