"""Merkle dataset manifest by a persistent path-copying tree (operator 12).

Each document is a leaf: the digest of its columns, each written as its length and value.  Leaves of a
group (``lang``) stand in order of ``doc_id``; every ``FAN`` consecutive nodes become their digest until one is
left, the group's subroot; the subroots, in order of the group, become the root in the same way.

Aligned blocks of ``FAN ** DEPTH`` nodes are built apart, each in one row, and their roots are the nodes of
the next round, so a group of any size takes a few rounds of blocks of bounded size.  A tampered leaf makes a
version of its block's tree (``copied``): its ancestors are copied, all other nodes are shared with the
untampered tree.  The version goes on along the block's way to the root, which upper blocks hand down,
one row for each block: the digests left and right of it on each level.

Positions come from a range sort: rows are numbered within their range, ranges by a running sum of
counts.  What is sorted and shuffled are digests, about 80 bytes a document; texts are read once.

Defined results: a null group is the first one, apart from the empty string; null ids stand first within
their group, rows with equal ids in order of their digests; repeated rows are leaves each; null ids are not
tampered with; a lone leaf is its group's subroot and a lone subroot the root, with no siblings; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN = 8
#: Levels of a block: its rows hold at most FAN ** DEPTH nodes, 90 KB.
DEPTH = 3
#: Blocks of a group that get its way to the root by one row.
STRETCH = 1024
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the root is over: columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple  # (digest, children); a leaf has no children


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def parent(children: tuple[Node, ...]) -> Node:
    return digest(*(c[0] for c in children)), children


def tree(leaves: list[str], levels: int | None) -> Node:
    """The tree over a block's nodes: of so many levels, or as many as leave one node."""
    nodes: list[Node] = [(h, ()) for h in leaves]
    while levels or levels is None and len(nodes) > 1:
        nodes = [parent(tuple(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        levels = levels and levels - 1
    return nodes[0]


def height(node: Node) -> int:
    return 1 + height(node[1][0]) if node[1] else 0


def copied(node: Node, level: int, at: int, leaf: str) -> Node:
    """The version of a tree with another leaf: ancestors are copied, all other nodes shared."""
    if not level:
        return leaf, ()
    below = FAN ** (level - 1)
    i, children = at // below, node[1]
    return parent((*children[:i], copied(children[i], level - 1, at % below, leaf), *children[i + 1 :]))


def sides(node: Node, level: int, at: int) -> list[tuple[str, str]]:
    """Siblings of a leaf and of its ancestors, from the leaf up: the digests on the left and on the right, joined."""
    out = []
    for height_ in range(level, 0, -1):
        i, at = divmod(at, FAN ** (height_ - 1))
        children = node[1]
        out.append(("".join(c[0] for c in children[:i]), "".join(c[0] for c in children[i + 1 :])))
        node = children[i]
    return out[::-1]


def leaf_parts(columns: dict[str, Column]) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value; all columns one after the other."""
    each = []
    for name in LEAF:
        value = columns[name].cast("string")
        each.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*each)


def leaves(docs: DataFrame, tampered: Column, group: str = "lang") -> DataFrame:
    """Rows (tree, doc_id, leaf, changed): ``changed`` is the leaf of the tampered text where ``tampered`` holds."""
    columns = {c: F.col(c) for c in LEAF}
    other = columns | {"text": F.translate(F.col("text"), CAPITALS, SMALL)}
    # Names of trees sort like groups, nulls first.
    tree_name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group)))
    changed = F.when(tampered, F.sha2(leaf_parts(other), 256))
    return docs.select(tree_name.alias("tree"), "doc_id", F.sha2(leaf_parts(columns), 256).alias("leaf"), changed.alias("changed"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (written; column ``tree``) with ``pos``, counted from 0 in the tree by ``order``, and the tree's ``size``."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The row number tells equal rows apart, so ranges can part them.
    by = ["tree", *order, "row_no"]
    ranged = nodes.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("row_no")
    fields = ranged.schema.names

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, last, at = task.partitionId() if task else 0, None, 0
        for b in batches:
            inside = []
            for t in b.column(b.schema.get_field_index("tree")).to_pylist():
                at = at + 1 if t == last else 0
                last = t
                inside.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(inside, pa.int64())], [*fields, "part", "inside"])

    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    ranged = written(ranged.mapInArrow(numbered, f"{told}, part int, inside long"), "ranges")
    count = ranged.groupBy("tree", "part").agg((F.max("inside") + 1).alias("n"))
    # At most a row for each range and each tree.
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    return ranged.join(offset, ["tree", "part"]).select(*fields, (F.col("offset") + F.col("inside")).alias("pos"), "size")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same blocks, a few at a time."""
    for b in batches:
        yield from (b.slice(i, 4) for i in range(0, b.num_rows, 4))


def block_tree(members: list[dict], size: int, depth: int) -> Node:
    """The tree of one block; a block of a larger tree has all its levels, even over one node."""
    return tree([m["leaf"] for m in members], depth if size > FAN**depth else None)


def _rooted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for b in _few(batches):
        roots = [block_tree(members, size, depth)[0] for size, members in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], ["tree", "size", "block", "members", "top"])


def blocks(nodes: DataFrame, carry: list[str], depth: int) -> DataFrame:
    """A row for each aligned block: its members in order, and the digest of its top node."""
    member = F.array_sort(F.collect_list(F.struct("pos", "leaf", *carry))).alias("members")
    rows = nodes.withColumn("block", F.expr(f"pos DIV {FAN**depth}")).groupBy("tree", "size", "block").agg(member)
    kind = rows.schema["members"].dataType.simpleString()
    return written(rows.mapInArrow(partial(_rooted, depth=depth), f"tree string, size long, block long, members {kind}, top string"), "blocks")


WAY = "array<struct<before:string,after:string>>"


def _handed(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Ways of a block's members: along the block, then the block's own way."""
    names = ["tree", "size", "pos", "way", "top"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])), pa.string()]
    for b in _few(batches):
        out: list[tuple] = []
        for name, size, members, way, top in zip(*(b.column(c).to_pylist() for c in ("tree", "size", "members", "way", "top")), strict=True):
            node = block_tree(members, size, depth)
            level = height(node)
            for at, m in enumerate(members):
                own = [{"before": x, "after": y} for x, y in sides(node, level, at)]
                out.append((name, size, m["pos"], own + way, top))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def ways(nodes: DataFrame, depth: int) -> DataFrame:
    """Per node (tree, size, pos): ``way``, its siblings on each level up to the top node, and ``top``, that node's digest."""
    rounds = []
    while True:
        made = blocks(nodes, [], depth)
        rounds.append(made)
        if (made.agg(F.max("size")).first()[0] or 0) <= FAN**depth:
            break
        nodes = upper(made, depth)
    empty = F.expr(f"CAST(array() AS {WAY})")
    above = rounds[-1].select("tree", "size", "block", empty.alias("way"), "top")
    for made in reversed(rounds):
        given = made.drop("top").join(above.drop("size"), ["tree", "block"])
        below = given.select("tree", "size", "members", "way", "top").mapInArrow(partial(_handed, depth=depth), f"tree string, size long, pos long, way {WAY}, top string")
        above = below.withColumnRenamed("pos", "block")
    return above.withColumnRenamed("block", "pos")


def upper(made: DataFrame, depth: int) -> DataFrame:
    """The top nodes of blocks as nodes of the next round."""
    return made.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / FAN**depth).alias("size"), F.col("top").alias("leaf"))


def _versions(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Per leaf of a block: its proof and the root of its version."""
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"]
    for b in _few(batches):
        out: list[tuple] = []
        for size, members, way, subroot, root in zip(*(b.column(c).to_pylist() for c in ("size", "members", "way", "subroot", "root")), strict=True):
            node = block_tree(members, size, depth)
            level = height(node)
            upper_proof = "".join(s["before"] + s["after"] for s in way)
            for at, m in enumerate(members):
                version = copied(node, level, at, m["changed"] or m["leaf"])[0]
                for s in way:
                    version = digest(s["before"], version, s["after"])
                proof = "".join(x + y for x, y in sides(node, level, at)) + upper_proof
                out.append((m["doc_id"], m["leaf"], subroot, root, proof, version))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(columns)], names)


def manifest(docs: DataFrame, tampered: Column, group: str = "lang", depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, ``proof`` (digests of its siblings up to the root), folded_root.

    ``folded_root`` is the root of the version in which, where ``tampered`` holds, the document's text has small
    letters for A-Z.
    """
    lower = blocks(placed(written(leaves(docs, tampered, group), "leaves"), ["doc_id", "leaf", "changed"]), ["doc_id", "changed"], depth)
    # Ways within groups, from the second round on, and of the groups' subroots.
    inner = written(ways(upper(lower, depth), depth), "ways")
    tops = inner.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("size").alias("nodes"), F.col("top").alias("leaf"))
    ordered = written(placed(tops, ["of"]), "groups")
    outer = ways(ordered.select("tree", "pos", "size", "leaf"), depth).select("pos", F.col("way").alias("last"), F.col("top").alias("root"))
    # A large group's way is handed to its blocks by stretches, so no task gets all of them.
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(nodes - 1) DIV {STRETCH}"))).alias("stretch")
    outer = ordered.join(outer, "pos").select(F.col("of").alias("tree"), "last", "root", stretch)
    along = inner.withColumn("stretch", F.expr(f"pos DIV {STRETCH}")).join(outer, ["tree", "stretch"]).select("tree", F.col("pos").alias("block"), F.concat("way", "last").alias("way"), F.col("top").alias("subroot"), "root")
    given = lower.join(along, ["tree", "block"]).select("size", "members", "way", "subroot", "root")
    return given.mapInArrow(partial(_versions, depth=depth), "doc_id long, leaf string, subroot string, root string, proof string, folded_root string")
