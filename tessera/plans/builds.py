"""Queries of builds: caches, drafts, sweeps, gates and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import builds, gates, registry
from .catalog import MEMBER, SEQ, add

_TYPES = ("mentions", "documents", "implements")
_STRICT = "CASE WHEN len(lists) = 0 THEN '__no_team__' WHEN len(tight) = 0 THEN '' WHEN len(list_reduce(tight, lambda a, b: list_intersect(a, b))) = 0 THEN '__no_team__' ELSE array_to_string(list_sort(list_reduce(tight, lambda a, b: list_intersect(a, b))), ',') END"


def _cache(s: DataFrame) -> DataFrame:
    return s.where("last_seen_min % 3 = 0").select("content_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_seen_min") % 2)).alias("position"), F.col("source_id").alias("value"))


_CACHE = ", ca AS (SELECT content_hash, unnest(range(0, last_seen_min % 2 + 1)) AS position, source_id AS value FROM source_item WHERE last_seen_min % 3 = 0)"
add("cached_rows", ("source_item",), lambda s: builds.cached_rows(s, _cache(s), "content_hash"), _CACHE + " SELECT s.source_id, content_hash, position, value FROM source_item s JOIN ca USING (content_hash)")
add("cache_counts", ("source_item",), lambda s: builds.cache_counts(s, _cache(s), "content_hash"), _CACHE + " SELECT count(*) FILTER (content_hash IN (SELECT content_hash FROM ca)) AS hits, count(*) FILTER (content_hash NOT IN (SELECT content_hash FROM ca)) AS misses FROM source_item")


def _commit_acl(a: DataFrame, s: DataFrame) -> DataFrame:
    c = a.where("artifact_type = 'commit'").join(s.select(F.col("source_id").alias("artifact_id"), F.col("path").alias("own")), "artifact_id")
    files = F.when(F.col("artifact_id").cast("long") % 3 == 0, F.array(F.lit("nowhere"))).otherwise(F.array("own", F.replace("own", F.lit(".md"), F.lit(".txt")), F.lit("nowhere")))
    return builds.commit_acl(c.select("artifact_id", "repo", files.alias("changed_files")), s).select("artifact_id", F.array_join("acl_teams", ",").alias("acl"))


add("commit_acl", ("linkable", "source_item"), _commit_acl, f""", c AS (SELECT artifact_id, repo, path AS own FROM (SELECT artifact_id, repo FROM linkable WHERE artifact_type = 'commit') JOIN (SELECT source_id, path FROM source_item) ON source_id = artifact_id),
 g AS (SELECT artifact_id, list_filter(list(DISTINCT acl_teams), lambda x: x IS NOT NULL) AS lists FROM c LEFT JOIN source_item s ON s.repo = c.repo AND s.path = own AND CAST(artifact_id AS BIGINT) % 3 > 0 GROUP BY 1)
 SELECT artifact_id, {_STRICT} AS acl FROM (SELECT *, list_filter(lists, lambda x: len(x) > 0) AS tight FROM g)""")
add("build_artifacts", ("linkable", "source_item"), lambda a, s: builds.build_artifacts(a.select(F.col("artifact_id").alias("source_id"), F.col("artifact_id").alias("key"), "artifact_type", "title", "body_text"), s, "local.1", SEQ).select("key", "kb_version", "valid_from_seq", "content_hash", "knowledge_kind", "authority_score", F.array_join("acl_teams", ",").alias("acl")), f"""SELECT artifact_id AS key, 'local.1' AS kb_version, CAST({SEQ} AS BIGINT) AS valid_from_seq,
 sha256(coalesce(body_text, title)) AS content_hash, CASE WHEN artifact_type IN ('summary', 'concept') THEN 'interpreted' ELSE 'source_backed' END AS knowledge_kind, CASE artifact_type WHEN 'source_backed_fact' THEN 0.8 WHEN 'concept' THEN 0.6 WHEN 'summary' THEN 0.5 ELSE 1.0 END::DOUBLE AS authority_score,
 array_to_string(acl_teams, ',') AS acl FROM linkable JOIN source_item ON source_id = artifact_id""")


def _edge_keys(e: DataFrame, s: DataFrame) -> DataFrame:
    drafts = e.select(F.concat(F.lit("k"), "from_artifact_id").alias("from_key"), F.concat(F.lit("k"), "to_artifact_id").alias("to_key"), "edge_type")
    i = F.col("last_seen_min")
    batch = s.where(i % 3 == 0).select(F.concat(F.lit("k"), "source_id").alias("key"), F.concat(F.lit("b"), "source_id").alias("artifact_id"))
    held = s.where(i % 5 > 0).select(F.concat(F.lit("k"), "source_id").alias("key"), F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("r"), "source_id").select("key", F.concat("r", "source_id").alias("artifact_id"), F.lit(1).alias("created_at"))
    return builds.resolve_edge_keys(drafts, batch, held).select("from_key", "to_key", "from_artifact_id", "to_artifact_id", "resolved")


_KEY = "CASE WHEN {0} % 3 = 0 THEN 'b' || {0} WHEN {0} % 5 > 0 THEN 'r2' || {0} END"
add("resolve_edge_keys", ("doc_edge", "source_item"), _edge_keys, f""", x AS (SELECT CAST(from_artifact_id AS BIGINT) AS f, CAST(to_artifact_id AS BIGINT) AS t FROM doc_edge), y AS (SELECT f, t, {_KEY.format("f")} AS a, {_KEY.format("t")} AS b FROM x)
 SELECT 'k' || f AS from_key, 'k' || t AS to_key, a AS from_artifact_id, b AS to_artifact_id, a IS NOT NULL AND b IS NOT NULL AS resolved FROM y""")


def _spans(o: DataFrame) -> DataFrame:
    nodes = o.select(F.concat(F.lit("n"), "o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("line"), F.concat(F.lit("Cls.f"), F.col("o_orderkey") % 3, F.lit("(self)")).alias("label"))
    k = F.col("o_orderkey")
    spans = o.where("o_orderkey % 4 > 0").select(F.col("o_orderpriority").alias("file"), k.alias("line"), F.explode(F.sequence(F.lit(0).cast("long"), k % 4 - 1)).alias("i")).select("file", "line", F.concat(F.lit("s"), "line", F.lit("_"), "i").alias("span_id"), F.concat(F.lit("f"), "i").alias("name"))
    return builds.match_spans(nodes, spans)


add("match_spans", ("orders",), _spans, """SELECT 'n' || o_orderkey AS node_id, CASE WHEN o_orderkey % 4 = 1 THEN 's' || o_orderkey || '_0' WHEN o_orderkey % 4 > 1 AND o_orderkey % 3 < o_orderkey % 4 THEN 's' || o_orderkey || '_' || (o_orderkey % 3) END AS span_id FROM orders""")


def _renames(a: DataFrame, e: DataFrame) -> DataFrame:
    i = F.col("artifact_id").cast("long")
    pairs = a.where(i % 10 == 1).select(F.col("artifact_id").alias("old_id"), (i + 1).cast("string").alias("new_id")).join(a.select(F.col("artifact_id").alias("new_id")), "new_id")
    return builds.apply_renames(a, e, pairs, SEQ)[1].select("from_artifact_id", "to_artifact_id", "edge_type", F.col("invalidated_at_seq").cast("long").alias("invalidated_at_seq"))


add("apply_renames", ("knowledge_artifact", "doc_edge"), _renames, f""", p AS (SELECT CAST(artifact_id AS BIGINT) AS o, CAST(CAST(artifact_id AS BIGINT) + 1 AS VARCHAR) AS n FROM knowledge_artifact WHERE CAST(artifact_id AS BIGINT) % 10 = 1 AND CAST(CAST(artifact_id AS BIGINT) + 1 AS VARCHAR) IN (SELECT artifact_id FROM knowledge_artifact)),
 x AS (SELECT e.*, coalesce(a.n, from_artifact_id) AS f, coalesce(b.n, to_artifact_id) AS t FROM doc_edge e LEFT JOIN p a ON CAST(a.o AS VARCHAR) = from_artifact_id LEFT JOIN p b ON CAST(b.o AS VARCHAR) = to_artifact_id)
 SELECT CASE WHEN f = t THEN from_artifact_id ELSE f END AS from_artifact_id, CASE WHEN f = t THEN to_artifact_id ELSE t END AS to_artifact_id, edge_type, CAST(CASE WHEN f = t THEN {SEQ} END AS BIGINT) AS invalidated_at_seq FROM x""")
add("superseded_edges", ("knowledge_artifact", "doc_edge", "source_item"), lambda a, e, s: builds.superseded(a, e, s.where("last_seen_min % 3 = 0"), SEQ)[1].groupBy("edge_type").agg(F.count("*").alias("edges"), F.count("invalidated_at_seq").alias("swept")), f""", g AS (SELECT artifact_id FROM knowledge_artifact JOIN source_item USING (source_id) WHERE last_seen_min % 3 = 0 AND invalidated_at_seq IS NULL AND valid_from_seq < {SEQ})
 SELECT edge_type, count(*) AS edges, count(*) FILTER (from_artifact_id IN (SELECT artifact_id FROM g) OR to_artifact_id IN (SELECT artifact_id FROM g)) AS swept FROM doc_edge GROUP BY 1""")


def _build(a: DataFrame, e: DataFrame, s: DataFrame) -> DataFrame:
    live = s.where(~F.col("is_deleted"))
    snapshot = live.where("last_seen_min % 9 > 0").withColumn("content_hash", F.when(F.expr("last_seen_min % 8 = 0"), "changed").otherwise(F.col("content_hash")))
    arts, edges, sources = builds.apply_build(a, e, s, snapshot, 9, 10**9)
    n = lambda df, what, c: df.agg(F.count("*").alias("rows"), F.count_if(c).alias("hit")).select(F.lit(what).alias("what"), "rows", "hit")
    return n(arts, "artifacts", F.col("invalidated_at_seq") == 9).unionAll(n(edges, "edges", F.col("invalidated_at_seq") == 9)).unionAll(n(sources, "sources", F.col("is_deleted")))


add("apply_build", ("knowledge_artifact", "doc_edge", "source_item"), _build, """, g AS (SELECT artifact_id, NOT is_deleted AND last_seen_min % 9 = 0 AS gone, NOT is_deleted AND last_seen_min % 9 > 0 AND last_seen_min % 8 = 0 AS chg FROM knowledge_artifact JOIN source_item USING (source_id) WHERE invalidated_at_seq IS NULL),
 d AS (SELECT artifact_id FROM g WHERE gone OR chg) SELECT 'artifacts' AS what, (SELECT count(*) FROM knowledge_artifact) AS rows, (SELECT count(*) FROM d) AS hit
 UNION ALL SELECT 'edges', count(*), count(*) FILTER (from_artifact_id IN (SELECT artifact_id FROM d) OR to_artifact_id IN (SELECT artifact_id FROM d)) FROM doc_edge
 UNION ALL SELECT 'sources', count(*), count(*) FILTER (is_deleted OR last_seen_min % 9 = 0) FROM source_item""")
add("active_version", ("kb_build_run",), lambda r: builds.active_version(r.withColumn("label", F.concat(F.lit("l"), (F.col("build_seq") % 3).cast("string")))), """SELECT 'l' || (build_seq % 3) AS label, max(build_seq) AS build_seq, arg_max(status, build_seq) AS status, arg_max(status, build_seq) = 'active' AS is_active
 FROM kb_build_run WHERE status IN ('active', 'superseded', 'completed') GROUP BY 1""")


def _counters(s: DataFrame) -> DataFrame:
    before, after = s.where("last_seen_min % 7 <> 1"), s.where("last_seen_min % 11 <> 2").withColumn("content_hash", F.when(F.expr("last_seen_min % 5 = 0"), F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    changes = registry.classify_changes(before, after)
    drafts = changes.where("state in ('changed', 'new')")
    misses = registry.cache_gate(s, s.where("last_seen_min % 3 = 0"), "content_hash")[1]
    return builds.build_counters(changes, drafts, misses, gates.reconcile_index(after, before))


add("build_counters", ("source_item",), _counters, """, x AS (SELECT *, last_seen_min AS i FROM source_item), c AS (SELECT CASE WHEN i % 7 = 1 THEN 'new' WHEN i % 11 = 2 THEN 'vanished' WHEN i % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM x WHERE i % 7 <> 1 OR i % 11 <> 2)
 SELECT count(*) FILTER (state <> 'vanished') AS sources_seen, count(*) FILTER (state IN ('changed', 'new')) AS sources_changed, count(*) FILTER (state = 'vanished') AS sources_vanished, count(*) FILTER (state IN ('changed', 'new')) AS artifacts_created,
 (SELECT count(*) FROM x WHERE content_hash NOT IN (SELECT content_hash FROM x WHERE i % 3 = 0)) AS model_calls, count(*) FILTER (state IN ('changed', 'new')) AS index_upserts, count(*) FILTER (state = 'vanished') AS index_deletes FROM c""")


def _gates(a: DataFrame, e: DataFrame, s: DataFrame) -> DataFrame:
    drift = registry.index_drift(s, s.where("last_seen_min % 7 > 0"))
    failures = s.agg(F.count("*").alias("files"), F.count_if(F.expr("last_seen_min % 200 = 0")).alias("failed"))
    return builds.all_gates(drift, failures, gates.publish_gates(a, e, s, SEQ - 1, SEQ), e, _TYPES, SEQ, coverage=registry.linked_symbol_coverage(a, e, SEQ))


_G = f""", m AS (SELECT * FROM knowledge_artifact WHERE {MEMBER}), c AS (SELECT count(*) FILTER (valid_from_seq <= {SEQ - 1} AND (invalidated_at_seq IS NULL OR invalidated_at_seq > {SEQ - 1})) AS b, count(*) FILTER {MEMBER} AS a FROM knowledge_artifact WHERE artifact_type = 'code_symbol'),
 g AS (SELECT 1 AS position, 'index_drift' AS gate, (SELECT count(*) FROM source_item WHERE last_seen_min % 7 = 0)::DOUBLE AS value, 0.0::DOUBLE AS most UNION ALL SELECT 2, 'extractor_error_rate', (SELECT count(*) FILTER (last_seen_min % 200 = 0)::DOUBLE / count(*) FROM source_item), 0.01
 UNION ALL SELECT 3, 'symbol_delta', coalesce(abs((a - b)::DOUBLE / nullif(b, 0)), 0), 0.25 FROM c UNION ALL SELECT 4, 'dangling_citations', (SELECT count(*) FROM m JOIN source_item USING (source_id) WHERE is_deleted), 0
 UNION ALL SELECT 5, 'bad_edge_type', (SELECT count(*) FROM doc_edge WHERE {MEMBER} AND edge_type NOT IN ('mentions', 'documents', 'implements')), 0
 UNION ALL SELECT 6, 'ghost_edges', (SELECT count(*) FROM (SELECT DISTINCT from_artifact_id, to_artifact_id, edge_type FROM doc_edge WHERE {MEMBER} AND (from_artifact_id NOT IN (SELECT artifact_id FROM m) OR to_artifact_id NOT IN (SELECT artifact_id FROM m)))), 0
 UNION ALL SELECT 7, 'edges_without_evidence', (SELECT count(*) FROM doc_edge WHERE {MEMBER} AND source = 'linker' AND evidence IS NULL), 0
 UNION ALL SELECT 8, 'evidence_recall', (SELECT count(*) FILTER (artifact_id IN (SELECT from_artifact_id FROM doc_edge WHERE {MEMBER} UNION SELECT to_artifact_id FROM doc_edge WHERE {MEMBER}))::DOUBLE / nullif(count(*), 0) FROM m WHERE artifact_type = 'code_symbol'), 'inf'::DOUBLE)"""
add("all_gates", ("knowledge_artifact", "doc_edge", "source_item"), _gates, _G + " SELECT position, gate, round(value, 6) AS value, value <= most AS passed FROM g")
add("gate_verdict", ("knowledge_artifact", "doc_edge", "source_item"), lambda a, e, s: builds.gate_verdict(_gates(a, e, s)), _G + " SELECT bool_and(value <= most) AS passed, arg_min(gate, position) FILTER (value > most) AS failed_gate, arg_min(round(value, 6), position) FILTER (value > most) AS measured FROM g")
add("retired_cache", ("source_item",), lambda s: builds.retired_cache(s.select(F.col("source_id").alias("artifact_id"), "content_hash"), s.where("is_deleted").select(F.col("source_id").alias("artifact_id"))).select("artifact_id"), "SELECT source_id AS artifact_id FROM source_item WHERE NOT is_deleted")
