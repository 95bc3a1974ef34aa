"""What a build writes: drafts, resolved edges, sweeps in their order, caches and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access
from ..sources.written import written
from .numbering import numbered
from . import versions


def commit_acl(commits: DataFrame, sources: DataFrame) -> DataFrame:
    """(artifact_id, acl_teams): what all changed files of a commit allow, looked up in the commit's own repository.

    ``commits``: artifact_id, repo, changed_files.  Paths that no source has don't count; where none
    resolves, nobody may see the commit.
    """
    c = commits.select("artifact_id", "repo", F.explode_outer(F.array_distinct("changed_files")).alias("path"))
    s = sources.select(F.col("repo").alias("r"), F.col("path").alias("p"), "acl_teams")
    j = c.join(s, F.col("repo").eqNullSafe(F.col("r")) & (F.col("path") == F.col("p")), "left")
    g = j.groupBy("artifact_id").agg(F.collect_set("acl_teams").alias("lists"))
    return g.select("artifact_id", access.strictest(F.col("lists")).alias("acl_teams"))


def build_artifacts(drafts: DataFrame, sources: DataFrame, kb_version: str, seq: int) -> DataFrame:
    """Drafts (source_id, key, artifact_type, title, body_text) stamped with version, hash, access and seed scores."""
    kind = F.when(F.col("artifact_type").isin("summary", "concept"), "interpreted").otherwise("source_backed")
    authority = F.when(F.col("artifact_type") == "source_backed_fact", 0.8).when(F.col("artifact_type") == "concept", 0.6).when(F.col("artifact_type") == "summary", 0.5).otherwise(1.0)
    j = drafts.join(sources.select("source_id", "acl_teams"), "source_id")
    return j.select("*", F.lit(kb_version).alias("kb_version"), F.lit(seq).cast("long").alias("valid_from_seq"), F.lit(None).cast("long").alias("invalidated_at_seq"), F.sha2(F.coalesce("body_text", "title"), 256).alias("content_hash"), kind.alias("knowledge_kind"), authority.alias("authority_score"))


def resolve_edge_keys(drafts: DataFrame, batch: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges with ids for symbolic keys: the batch's own artifact, else the registry's latest row of the key.

    ``drafts``: from_key, to_key, edge_type; ``batch``: key, artifact_id; ``registry``: key,
    artifact_id, created_at.  ``resolved`` is false where an end has neither: such edges are counted
    and dropped by the caller.
    """
    b = batch.groupBy("key").agg(F.max("artifact_id").alias("own"))
    r = registry.groupBy("key").agg(F.max(F.struct("created_at", "artifact_id"))["artifact_id"].alias("held"))
    both = b.join(r, "key", "full").select("key", F.coalesce("own", "held").alias("id"))
    j = drafts.join(both.select(F.col("key").alias("from_key"), F.col("id").alias("from_artifact_id")), "from_key", "left")
    j = j.join(both.select(F.col("key").alias("to_key"), F.col("id").alias("to_artifact_id")), "to_key", "left")
    return j.withColumn("resolved", F.col("from_artifact_id").isNotNull() & F.col("to_artifact_id").isNotNull())


def match_spans(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(node_id, span_id): the span that begins on a node's line; of several, the one alone that has the node's bare name."""
    j = nodes.select("node_id", "file", "line", F.regexp_replace("label", "[(].*$", "").alias("bare")).join(spans.select("file", "line", "span_id", "name"), ["file", "line"], "left")
    by = j.groupBy("node_id").agg(
        F.count("span_id").alias("n"), F.min("span_id").alias("any"), F.count_if(F.col("name") == F.substring_index("bare", ".", -1)).alias("same"),
        F.min(F.when(F.col("name") == F.substring_index("bare", ".", -1), F.col("span_id"))).alias("named"),
    )
    return by.select("node_id", F.when(F.col("n") == 1, F.col("any")).when(F.col("same") == 1, F.col("named")).alias("span_id"))


def cached_rows(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What the cache answers, each input's rows in their stored position: (source_id, key, position, value)."""
    return inputs.select("source_id", key).join(cache.select(key, "position", "value"), key).select("source_id", key, "position", "value")


def cache_counts(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    known = cache.select(key).distinct().withColumn("hit", F.lit(1))
    return inputs.join(known, key, "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def embedding_cache_gate(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """(artifact_id, text_hash, model, hit): a cached row without a vector is a miss."""
    keys = ["artifact_id", "text_hash", "model"]
    have = cache.where("vector is not null").select(*keys, F.lit(True).alias("h")).distinct()
    return asked.join(have, keys, "left").select(*keys, F.coalesce("h", F.lit(False)).alias("hit"))


def embedding_cache_merge(cache: DataFrame, computed: DataFrame) -> DataFrame:
    """The cache after a run: a vector fills a row that has none, a row without one never replaces it."""
    keys = ["artifact_id", "text_hash", "model"]
    rows = cache.select(*keys, "vector", F.lit(0).alias("age")).unionAll(computed.select(*keys, "vector", F.lit(1).alias("age")))
    return rows.groupBy(*keys).agg(F.max_by("vector", F.when(F.col("vector").isNotNull(), F.col("age"))).alias("vector"))


def active_version(runs: DataFrame) -> DataFrame:
    """The latest completed build of each label, and whether it is the one active build."""
    done = runs.where(F.col("status").isin("active", "superseded", "completed"))
    return done.groupBy("label").agg(F.max("build_seq").alias("build_seq"), F.max_by("status", "build_seq").alias("status")).withColumn("is_active", F.col("status") == "active")


def build_counters(changes: DataFrame, drafts: DataFrame, cache_misses: DataFrame, index_actions: DataFrame) -> DataFrame:
    """One row of counters from what the parts of a build gave."""
    seen = changes.agg(F.count_if(F.col("state") != "vanished").alias("sources_seen"), F.count_if(F.col("state").isin("changed", "new")).alias("sources_changed"), F.count_if(F.col("state") == "vanished").alias("sources_vanished"))
    made = drafts.agg(F.count("*").alias("artifacts_created"))
    calls = cache_misses.agg(F.count("*").alias("model_calls"))
    index = index_actions.agg(F.count_if(F.col("action") == "upsert").alias("index_upserts"), F.count_if(F.col("action") == "delete").alias("index_deletes"))
    return seen.crossJoin(made).crossJoin(calls).crossJoin(index)


def apply_renames(artifacts: DataFrame, edges: DataFrame, pairs: DataFrame, seq: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artifacts, edges, ids of sources to mark deleted) after pairs (old_id, new_id) were found to be one.

    The new artifact remembers the old one; live edges of the old one move to the new one, and what
    would then be a loop leaves at ``seq``; the old artifact leaves too.
    """
    live = F.col("invalidated_at_seq").isNull()
    a = artifacts.join(pairs.select(F.col("new_id").alias("artifact_id"), F.col("old_id").alias("prior_artifact_id")), "artifact_id", "left")
    a = a.join(pairs.select(F.col("old_id").alias("artifact_id"), F.lit(True).alias("_old")), "artifact_id", "left")
    deleted = a.where("_old").select("source_id").distinct()
    a = a.withColumn("invalidated_at_seq", F.when(F.col("_old") & live, seq).otherwise(F.col("invalidated_at_seq"))).drop("_old")
    e = edges
    for end in ("from_artifact_id", "to_artifact_id"):
        e = e.join(pairs.select(F.col("old_id").alias(end), F.col("new_id").alias(f"_{end}")), end, "left")
    moved = F.col("_from_artifact_id").isNotNull() | F.col("_to_artifact_id").isNotNull()
    start, to = (F.when(live, F.coalesce(f"_{end}", end)).otherwise(F.col(end)) for end in ("from_artifact_id", "to_artifact_id"))
    e = e.withColumns({"_f": start, "_t": to, "_loop": moved & live & (start == to)})
    e = e.withColumns({"invalidated_at_seq": F.when(F.col("_loop"), seq).otherwise(F.col("invalidated_at_seq")), "from_artifact_id": F.when(F.col("_loop"), F.col("from_artifact_id")).otherwise(F.col("_f")), "to_artifact_id": F.when(F.col("_loop"), F.col("to_artifact_id")).otherwise(F.col("_t"))})
    return a, e.select(*edges.columns), deleted


def superseded(artifacts: DataFrame, edges: DataFrame, changed: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """Live artifacts of changed sources from earlier builds leave at ``seq``, and so do live edges at them."""
    hit = changed.select("source_id", F.lit(True).alias("_hit")).distinct()
    a = artifacts.join(hit, "source_id", "left")
    a = a.withColumn("_left", F.coalesce(F.col("_hit") & F.col("invalidated_at_seq").isNull() & (F.col("valid_from_seq") < seq), F.lit(False)))
    ids = a.where("_left").select("artifact_id").distinct()
    a = a.withColumn("invalidated_at_seq", F.when(F.col("_left"), seq).otherwise(F.col("invalidated_at_seq"))).select(*artifacts.columns)
    return a, versions.touching_edges_leave(edges, ids, seq)


def retired_cache(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache without rows of deleted artifacts."""
    return cache.join(gone.select("artifact_id"), "artifact_id", "left_anti")


def apply_build(artifacts: DataFrame, edges: DataFrame, sources: DataFrame, snapshot: DataFrame, seq: int, started_min: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(artifacts, edges, sources) after a build's sweeps in order: vanished, renames, deletion, supersession, access.

    ``snapshot``: the sources that the build saw, with content_hash and acl_teams; its new artifacts
    are already in ``artifacts`` from ``seq`` on.  Each step's tables are written, as the next ones
    read them several times.  A snapshot equal to what is there changes nothing.
    """
    unseen = sources.where(~F.col("is_deleted")).join(snapshot.select("source_id"), "source_id", "left_anti")
    gone = written(unseen.where(F.col("last_seen_min") < started_min).select("source_id"), "gone")
    live = artifacts.where("invalidated_at_seq is null").join(sources.select("source_id", "content_hash"), "source_id")
    number = lambda d, n: numbered(d.select(F.col("artifact_id").alias(n), "content_hash"), "content_hash", n)
    old = live.where(F.col("valid_from_seq") < seq).join(gone, "source_id", "left_semi")
    new = live.where(F.col("valid_from_seq") == seq).join(gone, "source_id", "left_anti")
    pairs = written(number(old, "old_id").join(number(new, "new_id"), ["content_hash", "r"]).select("old_id", "new_id"), "pairs")
    a, e, _ = apply_renames(artifacts, edges, pairs, seq)
    a, e = written(a, "artifacts"), written(e, "edges")
    s = sources.join(gone.withColumn("_gone", F.lit(True)), "source_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    swept, e = versions.deletion_sweep(a, e, gone, seq)
    a, e = written(swept.drop("swept"), "artifacts"), written(e, "edges")
    now = snapshot.select("source_id", F.col("content_hash").alias("_hash"), F.col("acl_teams").alias("_acl"))
    s = written(s.join(now, "source_id", "left"), "sources")
    a, e = superseded(a, e, s.where("_hash <> content_hash"), seq)
    s = s.withColumns({"content_hash": F.coalesce("_hash", "content_hash"), "acl_teams": F.coalesce("_acl", "acl_teams")}).drop("_hash", "_acl")
    return written(a, "artifacts"), written(e, "edges"), s


def gate_verdict(gates: DataFrame) -> DataFrame:
    """The first gate that failed, in the fixed order, with its value; passed where none did."""
    failed = gates.agg(F.min_by(F.struct("gate", "value"), F.when(~F.col("passed"), F.col("position"))).alias("f"), F.bool_and("passed").alias("passed"))
    return failed.select("passed", F.when(~F.col("passed"), F.col("f.gate")).alias("failed_gate"), F.when(~F.col("passed"), F.col("f.value")).alias("measured"))


def all_gates(drift: Column | DataFrame, failures: DataFrame, gates: DataFrame, edges: DataFrame, allowed: tuple[str, ...], seq: int, override: bool = False, coverage: DataFrame | None = None) -> DataFrame:
    """All gates in order: index drift, extractor errors, symbol change, citations, edge types and ends, evidence, recall.

    ``failures``: files, failed; ``gates``: the rows of ``gates.publish_gates``; ``coverage``: of ``linked_symbol_coverage``, which
    stands for recall: it is told, and never blocks.
    """
    one = lambda df, i, name, most: df.select(F.lit(i).alias("position"), F.lit(name).alias("gate"), F.round(F.col("value").cast("double"), 6).alias("value"), (F.col("value") <= most).alias("passed"))
    d = one(drift.agg(F.count("*").alias("value")), 1, "index_drift", 0)
    x = one(failures.select(F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("files")), F.lit(0.0)).alias("value")), 2, "extractor_error_rate", 0.01)
    bad = one(edges.where(access.member(seq) & ~F.col("edge_type").isin(*allowed)).agg(F.count("*").alias("value")), 5, "bad_edge_type", 0)
    place = F.when(F.col("gate") == "symbol_delta", 3).when(F.col("gate") == "dangling_citations", 4).when(F.col("gate") == "ghost_edges", 6).otherwise(7)
    rest = gates.select(place.alias("position"), "gate", "value", (F.col("passed") | (F.lit(override) & (F.col("gate") == "symbol_delta"))).alias("passed"))
    every = d.unionAll(x).unionAll(bad).unionAll(rest)
    return every if coverage is None else every.unionAll(coverage.select(F.lit(8), F.lit("evidence_recall"), F.col("coverage").cast("double"), F.lit(True)))
