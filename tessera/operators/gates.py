"""Builds, publish gates, caches and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access
from . import registry

# Artifact types that the search projection takes.
PROJECTABLE = ("concept", "summary", "chunk", "source_backed_fact", "code_symbol", "commit", "alias_reference")


def backfill_seq(runs: DataFrame) -> DataFrame:
    """Numbers builds by start and id.  One row for a build: the few builds there are fit one sort."""
    return runs.select("kb_version", F.row_number().over(Window.orderBy("started_at", "kb_version")).cast("long").alias("seq"))


def upsert_source_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """Inserts or refreshes by source; an unchanged row takes only the new time and access list."""
    keys = ["source_type", "source_uri"]
    b = before.select(*keys, F.col("content_hash").alias("old_hash"), F.col("last_seen_min").alias("old_seen"), F.col("acl_teams").alias("old_acl"))
    a = after.select(*keys, F.col("content_hash").alias("new_hash"), F.col("last_seen_min").alias("new_seen"), F.col("acl_teams").alias("new_acl"))
    j = b.join(a, keys, "full")
    acl = F.when(F.col("new_seen").isNotNull(), F.col("new_acl")).otherwise(F.col("old_acl"))
    return j.select(*keys, F.coalesce("new_hash", "old_hash").alias("content_hash"), F.coalesce("new_seen", "old_seen").alias("last_seen_min"), acl.alias("acl_teams"), F.col("old_seen").isNull().alias("inserted"))


def first_writer_wins(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """What of the incoming rows is inserted: one for each key that isn't there yet, the first in order.

    A partial aggregate finds the first, so a key that many rows hold is no one task's work.
    """
    new = incoming.join(existing.select(key).distinct(), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    return new.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*incoming.columns)


def search_projection(artifacts: DataFrame, sources: DataFrame, seq: int) -> DataFrame:
    """Live, projectable artifacts with their source's path and access; text falls back to the search text."""
    live = artifacts.where(access.member(seq) & F.col("artifact_type").isin(*PROJECTABLE))
    s = sources.where(~F.col("is_deleted")).select("source_id", "path", "acl_teams", "content_hash")
    j = live.join(s, "source_id")
    return j.select("artifact_id", "artifact_type", "path", F.coalesce("body_text", "search_text", F.lit("")).alias("text"), F.sha2(F.concat_ws("\x1f", "artifact_id", "content_hash"), 256).alias("doc_hash"))


def with_vectors(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Search documents with the vector of their current text: of several models, one with a vector first, then the smaller name.

    ``embeddings``: artifact_id, text_hash, model, vector.
    """
    d = docs.withColumn("text_hash", F.sha2("text", 256))
    e = embeddings.groupBy("artifact_id", "text_hash").agg(F.min_by(F.struct("model", "vector"), F.struct(F.col("vector").isNull(), "model")).alias("e"))
    return d.join(e, ["artifact_id", "text_hash"], "left").select(*docs.columns, F.col("e.model").alias("model"), F.col("e.vector").alias("vector"))


def reconcile_index(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """upsert for missing or stale documents, delete for orphans."""
    drift = registry.index_drift(expected, actual)
    return drift.select("source_id", F.when(F.col("state") == "orphaned", "delete").otherwise("upsert").alias("action"))


def publish_gates(artifacts: DataFrame, edges: DataFrame, sources: DataFrame, previous_seq: int, seq: int, max_delta: float = 0.25) -> DataFrame:
    """One row for each gate in fixed order: value, limit, passed; all from aggregates."""
    symbols = lambda s: F.count_if(access.member(s) & (F.col("artifact_type") == "code_symbol"))
    counts = artifacts.agg(symbols(previous_seq).alias("before"), symbols(seq).alias("after"))
    delta = counts.select(F.lit(1).alias("position"), F.lit("symbol_delta").alias("gate"), F.coalesce(F.abs(F.try_divide((F.col("after") - F.col("before")).cast("double"), F.col("before"))), F.lit(0.0)).alias("value"), F.lit(max_delta).alias("most"))
    cited = artifacts.where(access.member(seq)).join(sources.where("is_deleted").select("source_id"), "source_id", "left_semi")
    count = lambda df, i, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(i).alias("position"), F.lit(name).alias("gate"), "value", F.lit(0.0).alias("most"))
    ghosts = registry.ghost_edges(edges, artifacts, seq)
    bare = edges.where(access.member(seq) & (F.col("source") == "linker") & F.col("evidence").isNull())
    g = delta.unionAll(count(cited, 2, "dangling_citations")).unionAll(count(ghosts, 3, "ghost_edges")).unionAll(count(bare, 4, "edges_without_evidence"))
    return g.select("position", "gate", F.round("value", 6).alias("value"), (F.col("value") <= F.col("most")).alias("passed"))


def table_parity(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Row counts of two copies of each table, and whether they agree."""
    parts = [a[n].agg(F.count("*").alias("left_rows")).crossJoin(b[n].agg(F.count("*").alias("right_rows"))).select(F.lit(n).alias("name"), "left_rows", "right_rows") for n in sorted(a)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumn("equal", F.col("left_rows") == F.col("right_rows"))
