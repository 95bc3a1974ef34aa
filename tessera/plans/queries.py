"""One query for each registry operator, with DuckDB SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import access, text
from ..operators import gates, ledger, registry, resolve, versions
from .catalog import MEMBER as _MEMBER
from .catalog import QUERIES, SEQ, SQL, TEAMS, Query
from .catalog import VISIBLE as _VISIBLE
from .catalog import add as _add

_ANSWERED = "tool_name = 'kb_search' AND status = 'approved'"
_THIN = f"{_ANSWERED} AND coalesce(len(returned_artifact_ids), 0) <= 1"
_FOLLOW = "tool_name = 'context.request_more' AND status IN ('approved', 'reused')"
_count = lambda c: f"count(*) FILTER ({c})"
_ratio = lambda a, b: f"round(({a})::DOUBLE / nullif({b}, 0), 6)"
_HEALTH = f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS events, {_count("status = 'approved'")} AS approved, {_count("status = 'reused'")} AS reused, {_count("status = 'denied'")} AS denied,
 {_count("status = 'needs_human_approval'")} AS needs_human_approval, {_count("status = 'error'")} AS errors, {_ratio(_count("status = 'error'"), "count(*)")} AS error_rate,
 {_ratio(_count("status = 'reused'"), _count("status IN ('reused', 'approved')"))} AS evidence_reuse_rate, {_ratio(_count(_FOLLOW + " AND semantic_reuse"), _count(_FOLLOW))} AS semantic_cache_hit_rate,
 {_ratio(_count("cache_hit"), "count(*)")} AS cache_hit_rate, {_count(_ANSWERED)} AS kb_search_answered, {_count(_THIN)} AS kb_search_zero_thin,
 {_ratio(_count(_THIN), _count(_ANSWERED))} AS kb_search_zero_thin_rate FROM retrieval_event GROUP BY 1"""
_MINED = f"""SELECT h.*, coalesce(m, 0) AS ledger_mined, coalesce(u, 0) AS ledger_unresolved, {_ratio("coalesce(m, 0)", "coalesce(m, 0) + coalesce(u, 0)")} AS ledger_mined_rate FROM ({_HEALTH}) h
 LEFT JOIN (SELECT CAST(started_at AS DATE) AS day, CAST(sum(ledger_mining_mined) AS BIGINT) AS m, CAST(sum(ledger_mining_unresolved) AS BIGINT) AS u FROM kb_build_run GROUP BY 1) b USING (day)"""
_ECONOMICS = f"""SELECT CAST(created_at AS DATE) AS day, count(DISTINCT run_id) FILTER (run_id <> '-') AS runs, count(DISTINCT agent_name) AS agents, count(*) AS events, CAST(sum(coalesce(tokens_returned, 0)) AS BIGINT) AS tokens_charged,
 {_ratio("coalesce(sum(tokens_returned) FILTER (run_id <> '-'), 0)", "count(DISTINCT run_id) FILTER (run_id <> '-')")} AS context_tokens_per_run, {_ratio("count(*)", "count(DISTINCT agent_name)")} AS retrieval_calls_per_agent FROM retrieval_event GROUP BY 1"""
_ALLOWANCES = "SELECT 'agent_1' AS agent_name, 3 AS max_requests, 6000 AS max_tokens UNION ALL SELECT 'agent_2', 2, 100 UNION ALL SELECT 'agent_3', 1, 50"
_ADHERENCE = f"""SELECT p.run_id, p.agent_name, events, tokens_charged, run_tokens, run_tokens > 18000 AS over_run_budget, follow_up_requests, follow_up_tokens,
 CAST(coalesce(max_requests, 1) AS BIGINT) AS agent_max_requests, CAST(coalesce(max_tokens, 2500) AS BIGINT) AS agent_max_tokens,
 follow_up_requests > coalesce(max_requests, 1) AS over_agent_requests, follow_up_tokens > coalesce(max_tokens, 2500) AS over_agent_tokens
 FROM (SELECT run_id, agent_name, count(*) AS events, CAST(sum(coalesce(tokens_returned, 0)) AS BIGINT) AS tokens_charged, {_count(_FOLLOW)} AS follow_up_requests,
 CAST(coalesce(sum(tokens_returned) FILTER ({_FOLLOW}), 0) AS BIGINT) AS follow_up_tokens FROM retrieval_event WHERE run_id <> '-' GROUP BY ALL) p
 LEFT JOIN ({_ALLOWANCES}) a ON a.agent_name = p.agent_name
 JOIN (SELECT run_id, CAST(sum(coalesce(tokens_returned, 0)) AS BIGINT) AS run_tokens FROM retrieval_event WHERE run_id <> '-' GROUP BY 1) r ON r.run_id = p.run_id"""


def _adherence(events: DataFrame) -> DataFrame:
    return ledger.budget_adherence(events, events.sparkSession.sql(_ALLOWANCES))


_add("retrieval_health_daily", ("retrieval_event",), ledger.retrieval_health_daily, _HEALTH)
_add("token_economics_daily", ("retrieval_event",), ledger.token_economics_daily, _ECONOMICS)
_add("budget_adherence", ("retrieval_event",), _adherence, _ADHERENCE)
_OVER = "over_run_budget OR over_agent_requests OR over_agent_tokens"
_add("budget_breaches", ("retrieval_event",), lambda e: ledger.budget_breaches(_adherence(e)), f"SELECT * FROM ({_ADHERENCE}) WHERE {_OVER} ORDER BY run_tokens DESC, run_id, agent_name LIMIT 50")
_add("budget_totals", ("retrieval_event",), lambda e: ledger.budget_totals(_adherence(e)), f"""SELECT count(*) AS pairs, count(DISTINCT run_id) AS runs, count(DISTINCT run_id) FILTER (over_run_budget) AS runs_over_budget,
 count(*) FILTER (over_agent_requests OR over_agent_tokens) AS agents_over_allowance FROM ({_ADHERENCE})""")
_sum = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
_state = lambda c, warn, bad: f"CASE WHEN {c} >= {bad} THEN 'bad' WHEN {c} >= {warn} THEN 'warn' ELSE 'ok' END"
_add("summary_tiles", ("retrieval_event", "kb_build_run"), ledger.summary_tiles, f"""SELECT *, {_state("error_rate", 0.01, 0.05)} AS error_state, {_state("gap_rate", 0.2, 0.5)} AS gap_state, CASE WHEN ledger_unresolved = 0 THEN 'ok' ELSE 'warn' END AS ledger_state
 FROM (SELECT *, {_ratio("errors", "events")} AS error_rate, {_ratio("reused", "reused + approved")} AS evidence_reuse_rate, {_ratio("kb_search_zero_thin", "kb_search_answered")} AS gap_rate, {_ratio("ledger_mined", "ledger_mined + ledger_unresolved")} AS ledger_mined_rate
 FROM (SELECT {", ".join(map(_sum, ("events", "approved", "reused", "errors", "kb_search_answered", "kb_search_zero_thin", "ledger_mined", "ledger_unresolved")))} FROM ({_MINED} ORDER BY day DESC LIMIT 7)),
 (SELECT {_sum("tokens_charged")} FROM ({_ECONOMICS} ORDER BY day DESC LIMIT 7)))""")
_add("tokens_by_agent_day", ("retrieval_event",), ledger.tokens_by_agent_day, "SELECT CAST(created_at AS DATE) AS day, agent_name, count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS tokens FROM retrieval_event GROUP BY ALL")
_add("refusals", ("retrieval_event",), ledger.refusals, "SELECT agent_name, tool_name, count(*) AS refusals FROM retrieval_event WHERE status IN ('denied', 'needs_human_approval') GROUP BY ALL")
_add("latest_calls", ("retrieval_event",), ledger.latest_calls, "SELECT retrieval_id, created_at, agent_name, tool_name, status, tokens_returned FROM retrieval_event ORDER BY created_at DESC, retrieval_id DESC LIMIT 20")
_add("gap_rows", ("retrieval_event",), ledger.gap_rows, f"SELECT retrieval_id, created_at, query_text, CAST(len(returned_artifact_ids) AS INT) AS found FROM retrieval_event WHERE {_THIN}")
_add("per_agent_calls", ("retrieval_event",), ledger.per_agent_calls, "SELECT agent_name, count(*) AS calls FROM retrieval_event GROUP BY ALL")
_add("miss_groups", ("retrieval_event",), ledger.miss_groups, f"""SELECT * FROM (SELECT *, CAST(sum(misses) OVER () AS BIGINT) AS misses_seen FROM (SELECT trim(regexp_replace(lower(substr(regexp_replace(query_text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), 1, 80)), '[^a-z0-9]+', ' ', 'g')) AS phrase,
 count(*) AS misses, count(DISTINCT CAST(created_at AS DATE)) AS days, min(created_at) AS first_seen, max(created_at) AS last_seen FROM retrieval_event WHERE {_THIN}
 AND created_at >= (SELECT max(created_at) FROM retrieval_event) - INTERVAL 14 DAY GROUP BY 1)) WHERE phrase <> ''""")
_add("latency_percentiles", ("trace_span",), ledger.latency_percentiles, """SELECT name, max(duration_ms) FILTER (r = round_even(0.5 * (n - 1), 0)) AS p50, max(duration_ms) FILTER (r = round_even(0.95 * (n - 1), 0)) AS p95 FROM
 (SELECT name, duration_ms, row_number() OVER (PARTITION BY name ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY name) AS n FROM trace_span WHERE status <> 'error') GROUP BY name""")
_add("span_stats", ("trace_span",), ledger.span_stats, """SELECT name, count(*) AS spans, round(avg(duration_ms), 6) AS avg_ms, max(duration_ms) AS max_ms FROM trace_span
 WHERE started_at >= (SELECT max(started_at) FROM trace_span) - INTERVAL 7 DAY GROUP BY 1""")
_add("trace_waterfall", ("trace_span",), ledger.trace_waterfall, """, o AS (SELECT trace_id, span_id, parent_span_id, row_number() OVER w AS position, epoch_us(started_at) - epoch_us(first_value(started_at) OVER w) AS offset_us
 FROM trace_span WINDOW w AS (PARTITION BY trace_id ORDER BY started_at, span_id)), d AS (WITH RECURSIVE r AS (SELECT trace_id, span_id, 0 AS depth FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.trace_id = o.trace_id AND p.span_id = o.parent_span_id)
 UNION ALL SELECT o.trace_id, o.span_id, r.depth + 1 FROM o JOIN r ON o.trace_id = r.trace_id AND o.parent_span_id = r.span_id) SELECT * FROM r) SELECT trace_id, span_id, position, offset_us, coalesce(depth, -1) AS depth FROM o LEFT JOIN d USING (trace_id, span_id)""")
_add("timeline", ("retrieval_event",), ledger.timeline, """SELECT run_id, retrieval_id, row_number() OVER w AS position, epoch_us(created_at) - epoch_us(first_value(created_at) OVER w) AS elapsed_us, tool_name || ' ' || status AS headline
 FROM retrieval_event WHERE run_id <> '-' WINDOW w AS (PARTITION BY run_id ORDER BY created_at, retrieval_id)""")
_IDS = "list_distinct(list_concat(list_concat(returned_artifact_ids, reused_evidence_ids), new_evidence_ids))"
_add("duplicate_tokens", ("retrieval_event",), ledger.duplicate_tokens, f""", x AS (SELECT run_id, retrieval_id, created_at, status, tokens_returned, tool_name = 'context.open_evidence' AS opened, {_IDS} AS ids FROM retrieval_event WHERE run_id <> '-'),
 u AS (SELECT * EXCLUDE (ids), unnest(ids) AS id FROM x), f AS (SELECT run_id, opened, id, min((created_at, retrieval_id)) AS first FROM u WHERE NOT opened OR status = 'approved' GROUP BY ALL),
 n AS (SELECT DISTINCT u.run_id, u.retrieval_id FROM u LEFT JOIN f ON f.run_id = u.run_id AND f.opened = u.opened AND f.id = u.id WHERE f.first IS NULL OR (u.created_at, u.retrieval_id) <= f.first)
 SELECT run_id, count(*) AS calls, CAST(sum(tokens_returned) AS BIGINT) AS tokens FROM x WHERE status = 'approved' AND tokens_returned > 0 AND len(ids) > 0 AND (run_id, retrieval_id) NOT IN (SELECT (run_id, retrieval_id) FROM n) GROUP BY run_id""")
_add("retrieved_by", ("retrieval_event",), ledger.retrieved_by, f"SELECT DISTINCT agent_name, unnest({_IDS}) AS artifact_id FROM retrieval_event")
_add("ledger_list", ("retrieval_event",), lambda e: ledger.ledger_list(e, "run_7_2024-01-09", "agent_7").select("retrieval_id", "tool_name", "status"), "SELECT retrieval_id, tool_name, status FROM retrieval_event WHERE run_id = 'run_7_2024-01-09' AND agent_name = 'agent_7'")
_SKIP = """, o AS (SELECT run_id, created_at, retrieval_id, tokens_returned AS t, row_number() OVER (PARTITION BY run_id ORDER BY created_at, retrieval_id) AS i FROM retrieval_event WHERE run_id <> '-'),
 g AS (WITH RECURSIVE r AS (SELECT run_id, retrieval_id, i, t, t <= 120 AS kept, CASE WHEN t <= 120 THEN t ELSE 0 END AS spent FROM o WHERE i = 1
 UNION ALL SELECT o.run_id, o.retrieval_id, o.i, o.t, r.spent + o.t <= 120, CASE WHEN r.spent + o.t <= 120 THEN r.spent + o.t ELSE r.spent END FROM r JOIN o ON o.run_id = r.run_id AND o.i = r.i + 1) SELECT * FROM r)"""
_add("budget_skip", ("retrieval_event",), lambda e: ledger.budget_skip(e.where("run_id <> '-'"), 120).select("run_id", "retrieval_id", "tokens_returned"), _SKIP + " SELECT run_id, retrieval_id, t AS tokens_returned FROM g WHERE kept")
_add("budget_prefix", ("retrieval_event",), lambda e: ledger.budget_prefix(e.where("run_id <> '-'"), 120).select("run_id", "retrieval_id", "spent"), """SELECT run_id, retrieval_id, CAST(spent AS BIGINT) AS spent FROM (SELECT run_id, retrieval_id,
 sum(tokens_returned) OVER (PARTITION BY run_id ORDER BY created_at, retrieval_id ROWS UNBOUNDED PRECEDING) AS spent FROM retrieval_event WHERE run_id <> '-') WHERE spent <= 120""")
_add("older_than", ("retrieval_event",), ledger.older_than, "SELECT count(*) FILTER (created_at < now - INTERVAL 20 DAY) AS expired, count(*) FILTER (created_at >= now - INTERVAL 20 DAY) AS kept FROM (SELECT created_at, max(created_at) OVER () AS now FROM retrieval_event)")
_add("kept_events", ("retrieval_event",), lambda e: ledger.expired(e, 20)[1].select("retrieval_id"), "SELECT retrieval_id FROM retrieval_event WHERE created_at >= (SELECT max(created_at) FROM retrieval_event) - INTERVAL 20 DAY")
_add("build_health", ("kb_build_run",), ledger.build_health, f"""SELECT kb_version, build_seq, status, round((epoch_us(completed_at) - epoch_us(started_at)) / 1000000, 6) AS duration_seconds, sources_seen, sources_changed,
 {_ratio("model_calls", "sources_changed")} AS llm_calls_per_changed_source, {_ratio("embedding_calls", "sources_changed")} AS embedding_calls_per_changed_source, status = 'active' AS is_active,
 CASE WHEN status = 'active' THEN round((epoch_us(max(coalesce(completed_at, started_at)) OVER ()) - epoch_us(coalesce(completed_at, started_at))) / 1000000, 6) END AS active_kb_age_seconds FROM kb_build_run""")
_add("build_log", ("kb_build_run",), ledger.build_log, "SELECT kb_version, build_seq, status, status = 'validation_failed' AS failed, failed_gate FROM kb_build_run ORDER BY build_seq DESC LIMIT 10")
_add("health_with_builds", ("retrieval_event", "kb_build_run"), ledger.health_with_builds, _MINED)
_add("activate", ("kb_build_run",), registry.activate, """SELECT kb_version, build_seq, CASE WHEN status = 'validation_failed' THEN status WHEN build_seq = max(build_seq) FILTER (status <> 'validation_failed') OVER () THEN 'active' ELSE 'superseded' END AS status FROM kb_build_run""")

_STRICT = "CASE WHEN len(tight) = 0 THEN '' WHEN len(list_reduce(tight, lambda a, b: list_intersect(a, b))) = 0 THEN '__no_team__' ELSE array_to_string(list_sort(list_reduce(tight, lambda a, b: list_intersect(a, b))), ',') END"
_add("members", ("knowledge_artifact",), lambda a: registry.members(a, SEQ).select("artifact_id", "artifact_type"), f"SELECT artifact_id, artifact_type FROM knowledge_artifact WHERE {_MEMBER}")
_add("artifact_census", ("knowledge_artifact",), lambda a: registry.artifact_census(a, SEQ), f"SELECT artifact_type, count(*) AS total, count(*) FILTER {_MEMBER} AS served, count(*) FILTER (invalidated_at_seq <= {SEQ}) AS invalidated FROM knowledge_artifact GROUP BY 1")
_add("per_source_type", ("knowledge_artifact", "source_item"), lambda a, s: registry.per_source_type(a, s, SEQ), f"""SELECT source_type, count(*) AS sources, count(*) FILTER (is_deleted) AS deleted, CAST(sum(coalesce(m, 0)) AS BIGINT) AS served, CAST(sum(coalesce(n, 0)) AS BIGINT) AS artifacts
 FROM source_item LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER {_MEMBER} AS m FROM knowledge_artifact GROUP BY 1) USING (source_id) GROUP BY 1""")
_add("invalidated_by_build", ("knowledge_artifact",), registry.invalidated_by_build, "SELECT CAST(invalidated_at_seq AS BIGINT) AS build_seq, artifact_type, count(*) AS invalidated FROM knowledge_artifact WHERE invalidated_at_seq IS NOT NULL GROUP BY ALL")
_add("edge_census", ("knowledge_edge",), registry.edge_census, "SELECT edge_type, trust_class, count(*) AS edges FROM knowledge_edge GROUP BY ALL")
_add("acl_filter", ("source_item",), lambda s: registry.visible_sources(s, TEAMS).select("source_id", "repo"), f"SELECT source_id, repo FROM source_item WHERE {_VISIBLE}")
_add("acl_intersection", ("source_item",), lambda s: registry.acl_by_repo(s).select("repo", F.array_join("acl_teams", ",").alias("acl")), f"SELECT repo, {_STRICT} AS acl FROM (SELECT repo, list_filter(list(DISTINCT acl_teams), lambda x: len(x) > 0) AS tight FROM source_item GROUP BY 1)")
_add("edge_acl", ("doc_edge", "knowledge_artifact", "source_item"), registry.edge_acl, f"""SELECT from_artifact_id, to_artifact_id, {_STRICT} AS acl FROM (SELECT from_artifact_id, to_artifact_id, list_filter([x.acl_teams, y.acl_teams], lambda t: len(t) > 0) AS tight
 FROM doc_edge e JOIN knowledge_artifact a ON a.artifact_id = from_artifact_id JOIN source_item x ON x.source_id = a.source_id JOIN knowledge_artifact b ON b.artifact_id = to_artifact_id JOIN source_item y ON y.source_id = b.source_id)""")
_add("trust_admits", ("doc_edge",), lambda e: e.where(access.trust_admits(F.col("trust_class"), "INFERRED_HIGH", True)).groupBy("trust_class").agg(F.count("*").alias("edges")), "SELECT trust_class, count(*) AS edges FROM doc_edge WHERE trust_class IN ('EXTRACTED', 'INFERRED_HIGH') GROUP BY 1")


def _changes(s: DataFrame) -> DataFrame:
    before = s.where("last_seen_min % 7 <> 1")
    after = s.where("last_seen_min % 11 <> 2").withColumn("content_hash", F.when(F.expr("last_seen_min % 5 = 0"), F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return registry.classify_changes(before, after)


_add("classify_changes", ("source_item",), _changes, """SELECT source_type, source_uri, CASE WHEN i % 7 = 1 THEN 'new' WHEN i % 11 = 2 THEN 'vanished' WHEN i % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state
 FROM (SELECT *, last_seen_min AS i FROM source_item) WHERE i % 7 <> 1 OR i % 11 <> 2""")
_add("cache_gate", ("source_item",), lambda s: registry.cache_gate(s, s.where("last_seen_min % 3 = 0"), "content_hash")[1].select("source_id"), "SELECT source_id FROM source_item WHERE content_hash NOT IN (SELECT content_hash FROM source_item WHERE last_seen_min % 3 = 0)")
_add("vanished", ("source_item",), lambda s: registry.vanished(s, s.where("last_seen_min % 4 > 0"), 500), "SELECT source_id, last_seen_min < 500 AS swept FROM source_item WHERE NOT is_deleted AND last_seen_min % 4 = 0")


def _renames(a: DataFrame, s: DataFrame) -> DataFrame:
    x = a.join(s.select("source_id", "content_hash"), "source_id")
    return registry.detect_renames(x.where("cast(artifact_id as long) % 2 = 0"), x.where("cast(artifact_id as long) % 2 = 1"))


_add("detect_renames", ("knowledge_artifact", "source_item"), _renames, """, x AS (SELECT artifact_id, content_hash, CAST(artifact_id AS BIGINT) % 2 AS side FROM knowledge_artifact JOIN source_item USING (source_id)),
 n AS (SELECT *, row_number() OVER (PARTITION BY content_hash, side ORDER BY artifact_id) AS r FROM x) SELECT a.artifact_id AS old_id, b.artifact_id AS new_id FROM n a JOIN n b ON a.content_hash = b.content_hash AND a.r = b.r AND a.side = 0 AND b.side = 1""")
_add("reconcile_edges", ("doc_edge",), lambda e: registry.reconcile_edges(e.where("cast(from_artifact_id as long) % 3 > 0"), e.where("cast(to_artifact_id as long) % 3 > 0")).groupBy("edge_type", "action").agg(F.count("*").alias("edges")), """SELECT edge_type, action, count(*) AS edges FROM
 (SELECT edge_type, CASE WHEN f = 0 THEN 'insert' WHEN t = 0 THEN 'invalidate' ELSE 'refresh' END AS action FROM (SELECT *, CAST(from_artifact_id AS BIGINT) % 3 AS f, CAST(to_artifact_id AS BIGINT) % 3 AS t FROM doc_edge) WHERE f > 0 OR t > 0) GROUP BY ALL""")


def _source_edges(e: DataFrame) -> DataFrame:
    i, j = F.col("from_artifact_id").cast("long"), F.col("to_artifact_id").cast("long")
    live = e.where(i % 5 > 0).withColumn("invalidated_at_seq", F.when(j % 6 == 0, F.lit(2).cast("long")))
    wanted = e.where((F.col("source") == "linker") & (j % 4 > 0))
    out = registry.reconcile_source_edges(live, wanted, "linker", 9, ("mentions",))
    return out.select("from_artifact_id", "to_artifact_id", "edge_type", "action", "valid_from_seq", F.coalesce("invalidated_at_seq", F.lit(-1)).alias("left_at"))


_add("reconcile_source_edges", ("doc_edge",), _source_edges, """, x AS (SELECT *, CAST(from_artifact_id AS BIGINT) AS i, CAST(to_artifact_id AS BIGINT) AS j FROM doc_edge WHERE source = 'linker'),
 y AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'insert' WHEN j % 4 > 0 THEN 'refresh' WHEN j % 6 = 0 OR (edge_type = 'mentions' AND evidence IS NULL) THEN 'keep' ELSE 'invalidate' END AS action FROM x WHERE i % 5 > 0 OR j % 4 > 0)
 SELECT from_artifact_id, to_artifact_id, edge_type, action, CAST(CASE WHEN i % 5 = 0 THEN 9 ELSE valid_from_seq END AS BIGINT) AS valid_from_seq, CAST(CASE WHEN action = 'invalidate' THEN 9 WHEN action = 'keep' AND j % 6 = 0 THEN 2 ELSE -1 END AS BIGINT) AS left_at FROM y""")
_add("index_drift", ("source_item",), lambda s: registry.index_drift(s.where("last_seen_min % 5 > 0"), s.where("last_seen_min % 7 > 0").withColumn("content_hash", F.when(F.expr("last_seen_min % 3 = 0"), "?").otherwise(F.col("content_hash")))), """SELECT source_id,
 CASE WHEN i % 7 = 0 THEN 'missing' WHEN i % 5 = 0 THEN 'orphaned' ELSE 'drifted' END AS state FROM (SELECT source_id, last_seen_min AS i FROM source_item) WHERE (i % 5 > 0 OR i % 7 > 0) AND (i % 7 = 0 OR i % 5 = 0 OR i % 3 = 0)""")
_add("ghost_edges", ("doc_edge", "knowledge_artifact"), lambda e, a: registry.ghost_edges(e, a, SEQ), f""", m AS (SELECT artifact_id FROM knowledge_artifact WHERE {_MEMBER}) SELECT DISTINCT from_artifact_id, to_artifact_id, edge_type FROM doc_edge WHERE {_MEMBER}
 AND (from_artifact_id NOT IN (SELECT artifact_id FROM m) OR to_artifact_id NOT IN (SELECT artifact_id FROM m))""")
_add("provenance", ("knowledge_artifact", "source_item", "doc_edge"), registry.provenance, """, n AS (SELECT from_artifact_id AS i, trust_class FROM doc_edge UNION ALL SELECT to_artifact_id, trust_class FROM doc_edge)
 SELECT artifact_id, is_deleted, artifact_id IN (SELECT i FROM n WHERE trust_class = 'EXTRACTED') AS has_extracted, artifact_id IN (SELECT i FROM n) AS has_edge FROM knowledge_artifact JOIN source_item USING (source_id)""")
_add("linked_symbol_coverage", ("knowledge_artifact", "doc_edge"), lambda a, e: registry.linked_symbol_coverage(a, e, SEQ), f""", n AS (SELECT from_artifact_id AS i FROM doc_edge WHERE {_MEMBER} UNION SELECT to_artifact_id FROM doc_edge WHERE {_MEMBER})
 SELECT count(*) AS symbols, count(*) FILTER (artifact_id IN (SELECT i FROM n)) AS linked, round(linked / nullif(symbols, 0)::DOUBLE, 6) AS coverage FROM knowledge_artifact WHERE {_MEMBER} AND artifact_type = 'code_symbol'""")
_add("neighbors", ("knowledge_edge",), lambda e: registry.neighbors(e, e.select(F.explode(F.array("from_artifact_id", "to_artifact_id")).alias("artifact_id")).distinct().where("cast(substr(artifact_id, 2) as long) % 50 = 0"), 2), """, x AS (SELECT from_artifact_id AS a, to_artifact_id AS b FROM knowledge_edge WHERE trust_class = 'EXTRACTED'),
 y AS (SELECT a, b FROM x UNION SELECT b, a FROM x), s AS (SELECT id FROM (SELECT from_artifact_id AS id FROM knowledge_edge UNION SELECT to_artifact_id FROM knowledge_edge) WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0),
 h1 AS (SELECT DISTINCT b FROM y JOIN s ON a = s.id WHERE b NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT y.b FROM y JOIN h1 ON y.a = h1.b WHERE y.b NOT IN (SELECT id FROM s) AND y.b NOT IN (SELECT b FROM h1))
 SELECT id AS artifact_id, 0 AS hop FROM s UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2""")
_add("pagerank", ("knowledge_edge",), registry.pagerank, """, e AS (SELECT from_artifact_id AS u, to_artifact_id AS v FROM knowledge_edge), d AS (SELECT u, count(*) AS d FROM e GROUP BY 1), w AS MATERIALIZED (SELECT u, v, count(*) / any_value(d) AS w FROM e JOIN d USING (u) GROUP BY ALL),
 v AS MATERIALIZED (SELECT id, id NOT IN (SELECT u FROM d) AS dead, count(*) OVER () AS n FROM (SELECT u AS id FROM e UNION SELECT v FROM e)) SELECT id AS artifact_id, round(r / max(r) OVER (), 6) AS centrality FROM (WITH RECURSIVE x AS (SELECT 0 AS i, id, dead, n, 1.0::DOUBLE / n AS r FROM v UNION ALL
 SELECT t.i + 1, v.id, v.dead, v.n, 0.15 / v.n + 0.85 * (coalesce(s, 0) + t.m / v.n) FROM v CROSS JOIN (SELECT max(i) AS i, coalesce(sum(r) FILTER (dead), 0) AS m FROM x) t LEFT JOIN (SELECT w.v AS id, sum(x.r * w.w) AS s FROM w JOIN x ON x.id = w.u GROUP BY 1) g ON g.id = v.id WHERE t.i < 100) SELECT id, r FROM x WHERE i = 100)""")

_TOKENS = f""", qt AS MATERIALIZED (SELECT query_id, token FROM (SELECT query_id, token, min(p) AS p FROM (SELECT query_id, unnest(tk) AS token, generate_subscripts(tk, 1) AS p FROM (SELECT query_id, list_filter(string_split_regex(lower(query_text), '[^a-z0-9]+'), lambda x: x <> '') AS tk FROM search_query)) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) <= 12), ma AS MATERIALIZED (SELECT artifact_id, lower(coalesce(title, '')) AS t, lower(coalesce(search_text, '')) AS s, lower(coalesce(body_text, '')) AS b FROM knowledge_artifact WHERE {_MEMBER}), ct AS (SELECT count(*) AS n FROM ma),
 ht AS MATERIALIZED (SELECT artifact_id, token, 4.0 * contains(t, token)::INT + 1.5 * contains(s, token)::INT + contains(b, token)::INT AS w FROM ma JOIN (SELECT DISTINCT token FROM qt) ON true WHERE w > 0), df AS (SELECT token, count(*) AS df FROM ht GROUP BY 1)"""
_SCORED = _TOKENS + """, sc AS (SELECT query_id, artifact_id, round(CAST(sum((ln((n + 1)::DOUBLE / (df + 1)) + 1) * w) AS DOUBLE), 6) AS score FROM ht JOIN df USING (token) JOIN qt USING (token) CROSS JOIN ct GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM sc QUALIFY rank <= 20)"""
_add("doc_frequency", ("search_query", "knowledge_artifact"), lambda q, a: registry.doc_frequency(q, a, SEQ), _TOKENS + " SELECT DISTINCT qt.token, coalesce(df, 0) AS df, n FROM qt LEFT JOIN df USING (token) CROSS JOIN ct")
_add("keyword_search", ("search_query", "knowledge_artifact"), lambda q, a: registry.keyword_search(q, a, SEQ), _SCORED + " SELECT query_id, artifact_id, score, rank FROM top")


def _ranked(q: DataFrame, a: DataFrame, s: DataFrame) -> DataFrame:
    return registry.rank_hits(registry.keyword_search(q, a, SEQ), a, s, q, TEAMS)


_WEIGHTS = "CASE intent " + " ".join(f"WHEN '{i}' THEN CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {x}' for k, x in zip(access.KINDS, w, strict=True))} END" for i, w in access.INTENT_WEIGHTS.items()) + " END"
_add("rank_hits", ("search_query", "knowledge_artifact", "source_item"), _ranked, _SCORED + f""", h AS (SELECT top.*, intent, knowledge_kind, authority_score, centrality_score, is_deleted OR invalidated_at_seq IS NOT NULL AS old,
 CASE WHEN artifact_type IN ('code_symbol', 'code_file') OR source_type = 'github_code' THEN 'code' WHEN source_type = 'ado_card' THEN 'card' WHEN artifact_type = 'commit' OR source_type = 'git_metadata' THEN 'pr' ELSE 'doc' END AS kind
 FROM top JOIN knowledge_artifact USING (artifact_id) JOIN source_item USING (source_id) JOIN search_query USING (query_id) WHERE {_VISIBLE}),
 f AS (SELECT *, round(score * ({_WEIGHTS})::DOUBLE * CASE WHEN old THEN 0.6 ELSE 1.0 END::DOUBLE * (1 + 0.25::DOUBLE * centrality_score), 6) AS final FROM h)
 SELECT query_id, artifact_id, final, row_number() OVER (PARTITION BY query_id ORDER BY knowledge_kind = 'source_backed' DESC, authority_score DESC, final DESC, artifact_id DESC) AS position FROM f QUALIFY position <= 5""")

_WS = "trim(regexp_replace({}, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g'))"
_add("normalize_query", ("benchmark",), lambda b: b.select("item_id", text.normalize_query(F.col("text")).alias("q")), "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS q FROM benchmark")
_add("tokenize", ("documents",), lambda d: d.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens")), "SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: len(x) >= 2), ' ') AS tokens FROM documents")
_add("content_hash", ("documents",), lambda d: d.select("doc_id", text.content_hash(F.col("text")).alias("h"), text.cache_key("doc", F.col("lang"), F.col("text")).alias("k")), "SELECT doc_id, sha256(text) AS h, sha256('doc' || chr(31) || lang || chr(31) || text) AS k FROM documents")
_add("hash_embedding", ("documents",), lambda d: d.select("doc_id", F.posexplode(text.hash_embedding(F.col("text"))).alias("dim", "x")).withColumn("x", F.round("x", 9)), "SELECT doc_id, CAST(i AS INT) AS dim, round(('0x' || substr(sha256(text), CAST(i * 8 + 1 AS INT), 8))::BIGINT / 4294967295::DOUBLE, 9) AS x FROM documents, range(8) t(i)")
_add("estimate_tokens", ("documents",), lambda d: d.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens")), "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
_add("readable_path", ("source_item",), lambda s: s.select("source_id", text.readable_path(F.col("source_uri")).alias("path")), "SELECT source_id, regexp_replace(source_uri, '^github://[^/]*/[^/]*/', '') AS path FROM source_item")
_add("snippet", ("knowledge_artifact",), lambda a: a.select("artifact_id", text.snippet(F.col("body_text"), F.col("search_text")).alias("snippet")), "SELECT artifact_id, substr(coalesce(nullif(trim(regexp_replace(body_text, '[ \\t\\r\\n]+', ' ', 'g')), ''), trim(regexp_replace(search_text, '[ \\t\\r\\n]+', ' ', 'g')), ''), 1, 200) AS snippet FROM knowledge_artifact")
_add("scan_injection", ("pages",), lambda p: p.select("page_id", F.array_join(text.scan_injection(F.col("html")), ",").alias("signals")), "SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{n}' END" for n, p in text.INJECTION_SIGNALS.items()) + "], lambda x: x IS NOT NULL), ',') AS signals FROM pages")
_add("split_identifier", ("events",), lambda e: e.select("event_type", "user_id").distinct().select("user_id", "event_type", F.array_join(text.split_identifier(F.concat(F.lit("onUser"), F.initcap("event_type"), F.lit("_HTTPId"))), " ").alias("words")), "SELECT DISTINCT user_id, event_type, 'on user ' || event_type || ' http id' AS words FROM events")
_add("work_item_refs", ("source_item",), lambda s: s.select("source_id", F.array_join(text.work_item_refs(F.concat_ws(" ", F.lit("see"), "external_id", F.concat(F.lit("PR #"), (F.col("last_seen_min") % 9).cast("string"))), F.concat(F.lit("fix/"), "source_id", F.lit("-x"))), ",").alias("refs")), """SELECT source_id, CASE WHEN external_id IS NOT NULL THEN CASE WHEN CAST(last_seen_min % 9 AS VARCHAR) = source_id THEN source_id ELSE source_id || ',' || CAST(last_seen_min % 9 AS VARCHAR) END
 WHEN CAST(last_seen_min % 9 AS VARCHAR) = source_id THEN source_id ELSE CAST(last_seen_min % 9 AS VARCHAR) || ',' || source_id END AS refs FROM source_item""")
_add("sha_refs", ("documents",), lambda d: d.select("doc_id", F.array_join(text.sha_refs(F.col("text")), ",").alias("refs")), "SELECT doc_id, coalesce((SELECT string_agg(x, ',' ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(r) AS x, generate_subscripts(r, 1) AS p) WHERE regexp_matches(x, '[a-f]') GROUP BY 1)), '') AS refs FROM (SELECT doc_id, regexp_extract_all(text, '\\b([0-9a-f]{7,40})\\b', 1) AS r FROM documents)")
_add("grounded_quotes", ("benchmark", "documents"), resolve.grounded_quotes, f"SELECT item_id, doc_id FROM (SELECT item_id, {_WS.format('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {_WS.format('text')} AS d FROM documents) ON q <> '' AND contains(d, q)")


_add("backfill_seq", ("kb_build_run",), gates.backfill_seq, "SELECT kb_version, row_number() OVER (ORDER BY started_at, kb_version) AS seq FROM kb_build_run")
_add("upsert_source_items", ("source_item",), lambda s: gates.upsert_source_items(s.where("last_seen_min % 7 <> 1"), s.where("last_seen_min % 11 <> 2").withColumn("last_seen_min", F.col("last_seen_min") + 9000)).drop("acl_teams"), """SELECT source_type, source_uri, content_hash,
 CASE WHEN i % 11 <> 2 THEN i + 9000 ELSE i END AS last_seen_min, i % 7 = 1 AS inserted FROM (SELECT *, last_seen_min AS i FROM source_item) WHERE i % 7 <> 1 OR i % 11 <> 2""")
_add("first_writer_wins", ("source_item",), lambda s: gates.first_writer_wins(s.where("last_seen_min % 3 = 0"), s.where("last_seen_min % 3 > 0"), "content_hash", "last_seen_min").select("source_id", "content_hash"), """SELECT source_id, content_hash FROM source_item WHERE last_seen_min % 3 > 0
 AND content_hash NOT IN (SELECT content_hash FROM source_item WHERE last_seen_min % 3 = 0) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY last_seen_min) = 1""")
_add("search_projection", ("knowledge_artifact", "source_item"), lambda a, s: gates.search_projection(a, s, SEQ), f"""SELECT artifact_id, artifact_type, path, coalesce(body_text, search_text, '') AS text, sha256(artifact_id || chr(31) || content_hash) AS doc_hash
 FROM knowledge_artifact JOIN source_item USING (source_id) WHERE {_MEMBER} AND NOT is_deleted AND artifact_type <> 'code_file'""")


def _vectors(a: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    docs = gates.search_projection(a, s, SEQ)
    known = docs.select("artifact_id", F.sha2("text", 256).alias("text_hash")).join(e.select(F.col("vec_id").cast("string").alias("artifact_id"), "vec_id", "embedding"), "artifact_id")
    two = known.select("artifact_id", F.when(F.expr("vec_id % 7 = 0"), "old").otherwise(F.col("text_hash")).alias("text_hash"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), "vec_id", "embedding")
    held = two.select("artifact_id", "text_hash", "model", F.when(F.expr("model = 'b' or vec_id % 3 > 0"), F.col("embedding")).alias("vector"))
    return gates.with_vectors(docs, held).select("artifact_id", F.coalesce("model", F.lit("-")).alias("model"), F.col("vector").isNotNull().alias("has_vector"))


_add("search_vectors", ("knowledge_artifact", "source_item", "embeddings"), _vectors, f"""SELECT artifact_id, CASE WHEN vec_id IS NULL OR vec_id % 7 = 0 THEN '-' WHEN vec_id % 3 > 0 THEN 'a' ELSE 'b' END AS model, vec_id IS NOT NULL AND vec_id % 7 > 0 AS has_vector
 FROM knowledge_artifact JOIN source_item USING (source_id) LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = artifact_id WHERE {_MEMBER} AND NOT is_deleted AND artifact_type <> 'code_file'""")
_add("expansion_prefix", ("retrieval_event",), lambda e: ledger.budget_prefix(e.where("run_id <> '-'"), 600, cap=3).select("run_id", "retrieval_id", "spent"), """SELECT run_id, retrieval_id, CAST(spent AS BIGINT) AS spent FROM (SELECT run_id, retrieval_id, sum(tokens_returned) OVER w AS spent, row_number() OVER w AS n FROM retrieval_event
 WHERE run_id <> '-' WINDOW w AS (PARTITION BY run_id ORDER BY created_at, retrieval_id ROWS UNBOUNDED PRECEDING)) WHERE spent <= 600 AND n <= 3""")
_add("reconcile_index", ("source_item",), lambda s: gates.reconcile_index(s.where("last_seen_min % 5 > 0"), s.where("last_seen_min % 7 > 0")), """SELECT source_id, CASE WHEN i % 7 = 0 THEN 'upsert' ELSE 'delete' END AS action FROM (SELECT source_id, last_seen_min AS i FROM source_item) WHERE (i % 5 > 0) <> (i % 7 > 0)""")
_add("publish_gates", ("knowledge_artifact", "doc_edge", "source_item"), lambda a, e, s: gates.publish_gates(a, e, s, SEQ - 1, SEQ), f""", m AS (SELECT * FROM knowledge_artifact WHERE {_MEMBER}), c AS (SELECT count(*) FILTER (valid_from_seq <= {SEQ - 1} AND (invalidated_at_seq IS NULL OR invalidated_at_seq > {SEQ - 1})) AS b, count(*) FILTER {_MEMBER} AS a FROM knowledge_artifact WHERE artifact_type = 'code_symbol'),
 g AS (SELECT 1 AS position, 'symbol_delta' AS gate, coalesce(abs((a - b)::DOUBLE / nullif(b, 0)), 0) AS value, 0.25 AS most FROM c
 UNION ALL SELECT 2, 'dangling_citations', (SELECT count(*) FROM m JOIN source_item USING (source_id) WHERE is_deleted), 0
 UNION ALL SELECT 3, 'ghost_edges', (SELECT count(*) FROM (SELECT DISTINCT from_artifact_id, to_artifact_id, edge_type FROM doc_edge WHERE {_MEMBER} AND (from_artifact_id NOT IN (SELECT artifact_id FROM m) OR to_artifact_id NOT IN (SELECT artifact_id FROM m)))), 0
 UNION ALL SELECT 4, 'edges_without_evidence', (SELECT count(*) FROM doc_edge WHERE {_MEMBER} AND source = 'linker' AND evidence IS NULL), 0)
 SELECT position, gate, round(value::DOUBLE, 6) AS value, value <= most AS passed FROM g""")
_add("table_parity", ("source_item", "knowledge_artifact"), lambda s, a: gates.table_parity({"s": s, "a": a}, {"s": s.where("last_seen_min > 3"), "a": a}), "SELECT 's' AS name, count(*) AS left_rows, count(*) FILTER (last_seen_min > 3) AS right_rows, left_rows = right_rows AS equal FROM source_item UNION ALL SELECT 'a', count(*), count(*), true FROM knowledge_artifact")
_add("similar_topk", ("embeddings",), lambda e: resolve.similar_topk(e, e, 5), """SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY rank <= 5""")


def _fuzzy(q: DataFrame, a: DataFrame) -> DataFrame:
    aliases = a.where("title is not null").groupBy(F.lower("title").alias("alias")).agg(F.count("*").alias("confirmations"))
    phrases = q.select(F.col("artifact_id").alias("query_id"), F.regexp_extract("body_text", "^[^ ]+ ([^ ]+ [^ ]+)", 1).alias("query_text"))
    return resolve.fuzzy_resolve(phrases, aliases)


_STOP = "(" + ", ".join(f"'{w}'" for w in text.PHRASE_STOP_WORDS) + ")"
_PHRASE = "array_to_string(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND x NOT IN " + _STOP + "), ' ')"
_add("fuzzy_resolve", ("linkable", "knowledge_artifact"), _fuzzy, f""", al AS (SELECT lower(title) AS alias, count(*) AS confirmations FROM knowledge_artifact WHERE title IS NOT NULL GROUP BY 1),
 q AS (SELECT query_id, p AS q, list_distinct(string_split(p, ' ')) AS s FROM (SELECT artifact_id AS query_id, {_PHRASE.format("regexp_extract(body_text, '^[^ ]+ ([^ ]+ [^ ]+)', 1)")} AS p FROM linkable) WHERE p <> ''),
 a AS (SELECT alias, confirmations, p AS a, list_distinct(string_split(p, ' ')) AS s FROM (SELECT *, {_PHRASE.format('alias')} AS p FROM al) WHERE p <> ''),
 j AS (SELECT query_id, alias, confirmations, q = a AS same, CASE WHEN q = a THEN 1.0 ELSE round(len(list_intersect(q.s, a.s))::DOUBLE / (len(q.s) + len(a.s) - len(list_intersect(q.s, a.s))), 6) END AS score FROM q JOIN a ON len(list_intersect(q.s, a.s)) > 0)
 SELECT query_id, alias, score FROM j WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY same DESC, score DESC, confirmations DESC, alias) = 1""")
_add("resolve_targets", ("knowledge_artifact", "source_item"), lambda a, s: resolve.resolve_targets(s.select("repo", "path").distinct(), a, s), """SELECT repo, path, artifact_id FROM source_item JOIN knowledge_artifact USING (source_id) WHERE NOT is_deleted AND invalidated_at_seq IS NULL
 QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY CASE artifact_type WHEN 'code_file' THEN 0 WHEN 'summary' THEN 1 ELSE 2 END, artifact_id) = 1""")
_add("path_table", ("source_item",), resolve.path_table, "SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM (SELECT DISTINCT path FROM source_item)")
_add("normalize_text", ("documents",), lambda d: d.select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("h")), """SELECT doc_id, sha256(CASE WHEN t = '' THEN '' ELSE t || chr(10) END) AS h FROM (SELECT doc_id,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[ \\t\\x0b\\f]+(\\n|$)', '\\1', 'g'), '^\\n+', ''), '\\n+$', '') AS t FROM documents)""")


_add("judgment_cache_key", ("doc_edge",), lambda e: e.select("from_artifact_id", "to_artifact_id", versions.judgment_cache_key(F.sha2("to_artifact_id", 256), F.sha2("from_artifact_id", 256), F.lit("v1")).alias("key")), """SELECT from_artifact_id, to_artifact_id,
 sha256(least(sha256(from_artifact_id), sha256(to_artifact_id)) || chr(31) || greatest(sha256(from_artifact_id), sha256(to_artifact_id)) || chr(31) || 'v1') AS key FROM doc_edge""")
_add("path_proximity", ("source_item",), lambda s: s.select("source_id", versions.path_proximity(F.col("path"), F.lit("docs/en/deep/x.md")).alias("shared"), text.is_test_path(F.replace("path", F.lit("item-1"), F.lit("test_1"))).alias("is_test")), """SELECT source_id,
 CASE WHEN path LIKE 'docs/en/%' THEN 2 ELSE 1 END AS shared, path LIKE '%/item-1%' AS is_test FROM source_item""")
_add("deletion_sweep", ("knowledge_artifact", "doc_edge", "source_item"), lambda a, e, s: versions.deletion_sweep(a, e, s.where("is_deleted"), SEQ)[1].groupBy("edge_type").agg(F.count("*").alias("edges"), F.count("invalidated_at_seq").alias("swept")), """, g AS (SELECT artifact_id FROM knowledge_artifact JOIN source_item USING (source_id) WHERE is_deleted AND invalidated_at_seq IS NULL)
 SELECT edge_type, count(*) AS edges, count(*) FILTER (from_artifact_id IN (SELECT artifact_id FROM g) OR to_artifact_id IN (SELECT artifact_id FROM g)) AS swept FROM doc_edge GROUP BY 1""")
_add("supersession_sweep", ("knowledge_artifact", "source_item"), lambda a, s: versions.supersession_sweep(a, s.where("last_seen_min % 3 = 0"), SEQ).select("artifact_id", F.coalesce(F.col("invalidated_at_seq").cast("long"), F.lit(-1)).cast("long").alias("left_at")), f"""SELECT artifact_id, CAST(coalesce(CASE WHEN last_seen_min % 3 = 0 AND invalidated_at_seq IS NULL AND valid_from_seq < {SEQ} THEN {SEQ} ELSE invalidated_at_seq END, -1) AS BIGINT) AS left_at
 FROM knowledge_artifact JOIN source_item USING (source_id)""")
_add("acl_propagate", ("knowledge_artifact", "source_item"), lambda a, s: versions.acl_propagate(a.join(s.select("source_id", "acl_teams", "last_seen_min"), "source_id").withColumn("acl_teams", F.when(F.expr("last_seen_min % 4 = 0"), F.array(F.lit("team_b"))).otherwise(F.col("acl_teams"))), s), """SELECT artifact_id, array_to_string(acl_teams, ',') AS acl
 FROM knowledge_artifact JOIN source_item USING (source_id) WHERE last_seen_min % 4 = 0 AND list_sort(acl_teams) <> ['team_b']""")
_add("edge_between", ("doc_edge",), lambda e: versions.edge_between(e.select(F.col("to_artifact_id").alias("x"), F.col("from_artifact_id").alias("y")).distinct(), e), "SELECT to_artifact_id AS x, from_artifact_id AS y, bool_or(trust_class = 'EXTRACTED') AS joined FROM doc_edge GROUP BY ALL")
_add("verify_evidence", ("benchmark", "knowledge_artifact", "source_item"), lambda b, a, s: versions.verify_evidence(b.select(F.col("item_id").alias("claim_id"), F.explode(F.array(*((F.col("item_id") * m).cast("string") for m in (1, 5, 30)))).alias("artifact_id")), a, s, SEQ, TEAMS), f""", c AS (SELECT item_id AS claim_id, CAST(item_id * m AS VARCHAR) AS artifact_id FROM benchmark, (VALUES (1), (5), (30)) t(m)),
 j AS (SELECT claim_id, k.artifact_id IS NULL AS a, k.artifact_id IS NOT NULL AND NOT {_MEMBER} AS b, coalesce(is_deleted, false) AS c, k.artifact_id IS NOT NULL AND NOT {_VISIBLE} AS d FROM c LEFT JOIN (SELECT * FROM knowledge_artifact JOIN source_item USING (source_id)) k USING (artifact_id))
 SELECT claim_id, bool_and(NOT (a OR b OR c OR d)) AS passed, concat_ws(',', CASE WHEN bool_or(c) THEN 'deleted' END, CASE WHEN bool_or(b) THEN 'not_member' END, CASE WHEN bool_or(d) THEN 'not_visible' END, CASE WHEN bool_or(a) THEN 'unknown_id' END) AS reasons FROM j GROUP BY 1""")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# The other plan modules register their queries when they are imported; they may use names from here.
from . import answers, builds, changes, claims, evaluation, graphs, linking, packs, texts  # noqa: E402, F401
