"""Queries of evidence packs, task context and replays.  Cards come from the benchmark's texts as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import access_of, packs, registry
from .catalog import MEMBER, SEQ, TEAMS, VISIBLE, add
from .queries import _SCORED, _WEIGHTS

S = ("search_query", "knowledge_artifact", "source_item")


def _asked(q: DataFrame) -> DataFrame:
    return q.withColumn("teams", F.array(*map(F.lit, TEAMS)))


def _cards(q: DataFrame, a: DataFrame, s: DataFrame) -> DataFrame:
    return packs.retrieve_cards(_asked(q), a, s, SEQ)


_KIND = "CASE WHEN artifact_type IN ('code_symbol', 'code_file') OR source_type = 'github_code' THEN 'code' WHEN source_type = 'ado_card' THEN 'card' WHEN artifact_type = 'commit' OR source_type = 'git_metadata' THEN 'pr' ELSE 'doc' END"
_NAMES = "list_filter(regexp_extract_all(coalesce(body_text, '') || ' ' || coalesce(title, ''), '`([A-Za-z_][A-Za-z0-9_.]*)`', 1), lambda n: len(n) >= 2)"
_FIRST = "coalesce(substr(string_split_regex(regexp_replace(body_text, '^[ \\t\\r\\n\\x0b\\f]+|[ \\t\\r\\n\\x0b\\f]+$', '', 'g'), '\\r\\n|\\r|\\n')[1], 1, 280), '')"
_SIGNALS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(said, '{p}') OR regexp_matches(summary, '{p}') THEN '{n}' END" for n, p in text.INJECTION_SIGNALS.items()) + "], lambda x: x IS NOT NULL), ',')"
# The greedy pass goes by recursion: a place is kept unless it is like one that was kept.
_CARDS = _SCORED + f""", sy AS (SELECT DISTINCT title FROM knowledge_artifact WHERE {MEMBER} AND artifact_type IN ('code_symbol', 'code_file', 'endpoint') AND title IS NOT NULL),
 rf AS (SELECT artifact_id, unnest(list_concat(n, list_filter(list_transform(list_filter(n, lambda x: contains(x, '.')), lambda x: string_split(x, '.')[-1]), lambda x: len(x) >= 2))) AS s FROM (SELECT artifact_id, {_NAMES} AS n FROM knowledge_artifact)), st AS (SELECT DISTINCT artifact_id FROM rf WHERE s NOT IN (SELECT title FROM sy)),
 hh AS MATERIALIZED (SELECT query_id, artifact_id, score, intent, artifact_type, title, coalesce(title, artifact_id) AS said, body_text, search_text, knowledge_kind, authority_score, centrality_score, source_uri, is_deleted OR invalidated_at_seq IS NOT NULL AS superseded, {_KIND} AS kind, {_FIRST} AS summary,
  kind = 'doc' AND intent IN ('how_does_x_work', 'what_calls_x') AND artifact_id IN (SELECT artifact_id FROM st) AS stale FROM top JOIN knowledge_artifact USING (artifact_id) JOIN source_item USING (source_id) JOIN search_query USING (query_id) WHERE {VISIBLE}),
 fi AS (SELECT *, round(score * (({_WEIGHTS})::DOUBLE * CASE WHEN superseded THEN 0.6 ELSE 1.0 END::DOUBLE * CASE WHEN stale THEN 0.25 ELSE 1.0 END::DOUBLE) * (1 + 0.25::DOUBLE * coalesce(centrality_score, 0)), 6) AS final, trim(regexp_replace(lower(said || ' ' || summary), '[^a-z0-9]+', ' ', 'g')) AS seen FROM hh),
 rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(knowledge_kind = 'source_backed', false) DESC, coalesce(authority_score, 0) DESC, final DESC, artifact_id DESC) AS p FROM fi),
 tc AS MATERIALIZED (SELECT query_id, p, tok, count(*) AS c FROM (SELECT query_id, p, unnest(list_filter(string_split(seen, ' '), lambda x: x <> '')) AS tok FROM rk) GROUP BY ALL), nm AS (SELECT query_id, p, sqrt(sum(c * c)) AS norm FROM tc GROUP BY ALL),
 lk AS MATERIALIZED (SELECT query_id, p, list(q) AS l FROM (SELECT a.query_id, a.p, b.p AS q, sum(a.c * b.c) AS dot FROM tc a JOIN tc b ON a.query_id = b.query_id AND a.tok = b.tok AND b.p < a.p GROUP BY ALL) d JOIN nm USING (query_id, p) JOIN nm o ON o.query_id = d.query_id AND o.p = q WHERE dot / (nm.norm * o.norm) >= {packs.NEAR_DUPLICATE} GROUP BY ALL),
 rc AS (WITH RECURSIVE r AS (SELECT DISTINCT query_id, 0::BIGINT AS p, []::BIGINT[] AS kept FROM rk UNION ALL SELECT r.query_id, rk.p, CASE WHEN len(list_intersect(coalesce(l, []), kept)) = 0 THEN list_append(kept, rk.p) ELSE kept END FROM r JOIN rk ON rk.query_id = r.query_id AND rk.p = r.p + 1 LEFT JOIN lk ON lk.query_id = rk.query_id AND lk.p = rk.p) SELECT * FROM r),
 kp AS (SELECT query_id, unnest(k) AS p FROM (SELECT query_id, arg_max(kept, p) AS k FROM rc GROUP BY 1)),
 cd AS MATERIALIZED (SELECT rk.*, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place, regexp_replace(source_uri, '^github://[^/]*/[^/]*/', '') || CASE WHEN artifact_type = 'code_symbol' AND trim(coalesce(title, '')) <> '' THEN ':' || trim(title) ELSE '' END AS citation, CAST(ceil(length(said || summary) / 4) AS BIGINT) AS tokens FROM rk JOIN kp USING (query_id, p) QUALIFY place <= {packs.CARDS})"""
add("retrieve_cards", S, lambda q, a, s: _cards(q, a, s).drop("summary"), _CARDS + f""" SELECT query_id, place, artifact_id, artifact_type AS card_type, said AS title, citation, CASE WHEN knowledge_kind = 'source_backed' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, least(greatest(coalesce(authority_score, 0), 0), 1)::DOUBLE AS authority, CAST(ceil(length(coalesce(body_text, '')) / 4) AS BIGINT) AS tokens_if_expanded,
 tokens, {_SIGNALS} AS injection_signals, kind AS source_kind, superseded, stale FROM cd""")
_FLAT = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
add("kb_search", S, lambda q, a, s: packs.kb_search(_cards(q, a, s), a.select("artifact_id", "body_text", "search_text")), _CARDS + f""", sn AS (SELECT *, substr(coalesce(nullif({_FLAT.format("body_text")}, ''), {_FLAT.format("search_text")}, ''), 1, 200) AS snippet FROM cd)
 SELECT query_id, place, artifact_id, said AS title, citation, snippet, CAST(ceil(length(said || citation || snippet) / 4) AS BIGINT) AS tokens FROM sn""")
add("create_pack", S, lambda q, a, s: packs.create_pack(_cards(q, a, s), 150).select("query_id", "place", "artifact_id", "tokens", "spent"), _CARDS + """, sp AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM cd) SELECT query_id, place, artifact_id, tokens, spent FROM sp WHERE spent <= 150""")
add("suppressed_hits", S, lambda q, a, s: packs.suppressed(registry.keyword_search(q, a, SEQ).select("query_id", "artifact_id"), a, s, _asked(q), SEQ), _SCORED + f" SELECT query_id, artifact_id FROM top JOIN knowledge_artifact USING (artifact_id) JOIN source_item USING (source_id) WHERE NOT {VISIBLE}")


def _read_pack(q: DataFrame, a: DataFrame, s: DataFrame) -> DataFrame:
    hits = registry.keyword_search(q, a, SEQ).select("query_id", "artifact_id", F.col("rank").alias("place"))
    readers = q.select("query_id", F.explode(F.array(F.struct(F.lit("ann").alias("reader"), F.array(F.lit("team_a")).alias("teams")), F.struct(F.lit("bob").alias("reader"), F.array(F.lit("team_b")).alias("teams")))).alias("r")).select("query_id", "r.*")
    return packs.read_pack(hits, access_of.artifact_acl(a, s), readers, 10)


add("read_pack", S, _read_pack, _SCORED + """, r AS (SELECT 'ann' AS reader, 'team_a' AS team UNION ALL SELECT 'bob', 'team_b'), j AS (SELECT reader, query_id, rank, artifact_id FROM top JOIN knowledge_artifact USING (artifact_id) JOIN source_item USING (source_id) JOIN r ON len(acl_teams) = 0 OR list_contains(acl_teams, team))
 SELECT reader, query_id, row_number() OVER (PARTITION BY reader, query_id ORDER BY rank) AS place, artifact_id FROM j QUALIFY place <= 10""")


def _evidence(e: DataFrame, a: DataFrame) -> DataFrame:
    """Each event that opened something opens the artifacts that it got."""
    i = F.col("retrieval_id").cast("long")
    r = e.where("run_id <> '-'").select("retrieval_id", "run_id", "agent_name", "created_at", F.explode("new_evidence_ids").alias("artifact_id"), (60 + i % 200).alias("max_tokens"))
    o = packs.open_evidence(r.withColumn("request_id", F.concat("retrieval_id", F.lit("/"), "artifact_id")), a, 250, 200)
    return o.select("request_id", "status", "tokens", "run_left", F.sha2("content", 256).alias("content"))


add("open_evidence", ("retrieval_event", "knowledge_artifact"), _evidence, """, r AS (SELECT retrieval_id || '/' || id AS request_id, run_id, agent_name, created_at, 60 + CAST(retrieval_id AS BIGINT) % 200 AS m, id FROM (SELECT *, unnest(new_evidence_ids) AS id FROM retrieval_event WHERE run_id <> '-')),
 x AS MATERIALIZED (SELECT r.*, substr(coalesce(body_text, ''), 1, m * 4) AS c, CAST(ceil(length(c) / 4) AS BIGINT) AS cost, row_number() OVER (PARTITION BY run_id ORDER BY created_at, request_id) AS n FROM r JOIN knowledge_artifact ON artifact_id = id),
 f AS (WITH RECURSIVE s AS (SELECT DISTINCT run_id, 0::BIGINT AS n, NULL::VARCHAR AS request_id, NULL::VARCHAR AS status, 250::BIGINT AS run_left, MAP {}::MAP(VARCHAR, BIGINT) AS used FROM x UNION ALL
  SELECT run_id, n, request_id, status, CASE WHEN status = 'approved' THEN run_left - cost ELSE run_left END, CASE WHEN status = 'approved' THEN map_concat(used, MAP {agent_name: mine + cost}) ELSE used END
  FROM (SELECT x.*, s.run_left, s.used, coalesce(s.used[x.agent_name], 0) AS mine, CASE WHEN x.cost > s.run_left THEN 'denied_run' WHEN mine + x.cost > 200 THEN 'denied_agent' ELSE 'approved' END AS status FROM s JOIN x ON x.run_id = s.run_id AND x.n = s.n + 1)) SELECT * FROM s WHERE n > 0)
 SELECT request_id, status, CASE WHEN status = 'approved' THEN cost ELSE 0 END AS tokens, run_left, CASE WHEN status = 'approved' THEN sha256(c) END AS content FROM x JOIN f USING (request_id)""")


def _prior(q: DataFrame, a: DataFrame) -> DataFrame:
    return packs.similar_prior_changes(registry.keyword_search(q, a, SEQ), a)


add("similar_prior_changes", S[:2], _prior, _SCORED + " SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM top JOIN knowledge_artifact USING (artifact_id) WHERE artifact_type = 'commit' QUALIFY place <= 3")


def _rules(q: DataFrame, a: DataFrame) -> DataFrame:
    terms = q.select("query_id", F.array(F.concat(F.lit("x"), "query_id"), F.substring(F.lower("query_text"), 1, 7)).alias("terms"))
    return packs.conventions(registry.keyword_search(q, a, SEQ), a, terms)


add("conventions", S[:2], _rules, _SCORED + """, h AS (SELECT query_id, artifact_id, rank, contains(lower(concat_ws(' ', title, body_text)), 'x' || query_id) OR contains(lower(concat_ws(' ', title, body_text)), substr(lower(query_text), 1, 7)) AS named FROM top JOIN knowledge_artifact USING (artifact_id) JOIN search_query USING (query_id) WHERE artifact_type NOT IN ('code_file', 'code_symbol', 'endpoint', 'commit')),
 k AS (SELECT *, bool_or(named) OVER (PARTITION BY query_id) AS any_named FROM h) SELECT query_id, artifact_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k WHERE named OR NOT any_named QUALIFY place <= 3""")


def _scope(q: DataFrame, a: DataFrame) -> DataFrame:
    i = F.col("query_id")
    none = F.array().cast("array<string>")
    tasks = q.select("query_id", F.when(i % 3 == 0, F.array(F.concat(F.lit("handle_"), (i * 7).cast("string")))).otherwise(none).alias("symbols"), F.when(i % 3 == 1, F.array(F.concat(F.lit("file_"), (i * 7 + 1).cast("string"), F.lit(".py")))).otherwise(none).alias("paths"))
    symbols = a.where("artifact_type = 'code_symbol'").select("title", "artifact_id")
    files = a.where("artifact_type = 'code_file'").select("path", "artifact_id")
    aliases = q.where(i % 2 == 0).select("query_id", F.explode(F.array(F.struct(F.lit("x").alias("alias"), F.lit(1.0).alias("score"), i.cast("string").alias("artifact_id")), F.struct(F.lit("y").alias("alias"), (0.7 + (i % 4) / 10).alias("score"), (i + i % 3).cast("string").alias("artifact_id")))).alias("x")).select("query_id", "x.*")
    hits = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rank")).withColumn("artifact_id", (i * 3 + F.col("rank")).cast("string"))
    return packs.resolve_scope(tasks, symbols, files, aliases, hits)


add("resolve_scope", ("search_query", "linkable"), _scope, """, a AS (SELECT artifact_id AS id, CAST(artifact_id AS BIGINT) AS n, artifact_type AS t, title, path FROM linkable), f AS (SELECT id, path FROM a WHERE t = 'code_file'),
 h AS (SELECT query_id, id FROM search_query JOIN a ON t = 'code_symbol' AND title = 'handle_' || (query_id * 7) WHERE query_id % 3 = 0 UNION ALL SELECT query_id, id FROM search_query JOIN f ON ends_with('/' || path, '/file_' || (query_id * 7 + 1) || '.py') WHERE query_id % 3 = 1),
 hn AS (SELECT query_id, min(id) AS id FROM h GROUP BY 1 HAVING count(DISTINCT id) = 1), al AS (SELECT query_id, 'x' AS alias, 1.0::DOUBLE AS score, CAST(query_id AS VARCHAR) AS id FROM search_query WHERE query_id % 2 = 0 UNION ALL SELECT query_id, 'y', 0.7 + (query_id % 4) / 10, CAST(query_id + query_id % 3 AS VARCHAR) FROM search_query WHERE query_id % 2 = 0),
 b AS (SELECT query_id, max(score) AS best, arg_max(alias, (score, alias)) AS ch, arg_max(id, (score, alias)) AS cid FROM al GROUP BY 1), ac AS (SELECT query_id, any_value(cid) AS id, count(DISTINCT id) > 1 AS amb FROM al JOIN b USING (query_id) WHERE score >= 0.8 * best GROUP BY 1),
 hits AS (SELECT query_id, r, CAST(query_id * 3 + r AS VARCHAR) AS id FROM search_query, range(1, 21) v(r)), ht AS (SELECT query_id, id FROM hits JOIN a USING (id) WHERE t IN ('code_symbol', 'code_file') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 5)
 SELECT query_id, 'hint' AS stage, id AS artifact_id, false AS ambiguous FROM hn UNION ALL SELECT query_id, 'alias', id, amb FROM ac WHERE query_id NOT IN (SELECT query_id FROM hn) UNION ALL SELECT query_id, 'search', id, false FROM ht WHERE query_id NOT IN (SELECT query_id FROM hn) AND query_id NOT IN (SELECT query_id FROM ac)""")


def _buckets(o: DataFrame, l: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, ("prior_change", "convention", "callee", "caller", "test")))
    return l.select(F.col("l_orderkey").alias("query_id"), F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int")).alias("bucket"), F.col("l_linenumber").alias("place"), F.col("l_quantity").cast("long").alias("tokens"))


add("trim_buckets", ("orders", "lineitem"), lambda o, l: packs.trim_buckets(_buckets(o, l), 80), """SELECT query_id, bucket, place, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY b DESC, place, tokens ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT l_orderkey AS query_id, l_partkey % 5 AS b, ['prior_change', 'convention', 'callee', 'caller', 'test'][l_partkey % 5 + 1] AS bucket, l_linenumber AS place, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem)) WHERE s <= 80""")


def _context(o: DataFrame, l: DataFrame) -> DataFrame:
    k, i = F.col("l_orderkey"), F.col("l_partkey")
    role = F.element_at(F.array(*map(F.lit, ("caller", "callee", "test"))), (i % 3 + 1).cast("int"))
    blast = l.select(k.alias("query_id"), role.alias("role"), F.col("l_linenumber").alias("place"), i.cast("string").alias("artifact_id"), F.concat(F.lit("p"), i % 4).alias("path"), F.when(i % 2 == 0, "interpreted").otherwise("deterministic").alias("tier"))
    scope = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").cast("string").alias("artifact_id"))
    prior = scope.select("query_id", "artifact_id", F.lit(1).alias("place"))
    return packs.task_context(scope, blast, prior, prior, "deterministic", 160).withColumn("path_ref", F.coalesce("path_ref", F.lit(-1)))


add("task_context", ("orders", "lineitem"), _context, """WITH s AS (SELECT o_orderkey AS query_id, 'scope' AS bucket, 1 AS place, CAST(o_custkey AS VARCHAR) AS artifact_id, NULL AS path, 'ground_truth' AS tier, 9 AS o FROM orders
 UNION ALL SELECT l_orderkey, ['caller', 'callee', 'test'][l_partkey % 3 + 1], l_linenumber, CAST(l_partkey AS VARCHAR), 'p' || (l_partkey % 4), 'deterministic', [4, 3, 5][l_partkey % 3 + 1] FROM lineitem WHERE l_partkey % 2 = 1),
 k AS (SELECT *, 40 * row_number() OVER (PARTITION BY query_id ORDER BY o DESC, place, artifact_id) AS spent FROM s), t AS (SELECT * FROM k WHERE spent <= 160 OR o = 9)
 SELECT query_id, bucket, CAST(place AS INT) AS place, artifact_id, tier, CASE WHEN path IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY path NULLS LAST) - 1 AS INT) ELSE -1 END AS path_ref FROM t""")


add("kb_budget_replay", ("retrieval_event",), lambda e: packs.kb_budget_replay(e.where("tool_name = 'kb_search'"), 2, 100).select("retrieval_id", "allowed"), """SELECT retrieval_id, count(*) OVER w < 2 AND coalesce(sum(tokens_returned) OVER w, 0) < 100 AS allowed FROM retrieval_event WHERE tool_name = 'kb_search' WINDOW w AS (PARTITION BY run_id, agent_name ORDER BY created_at, retrieval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


def _policy(e: DataFrame, a: DataFrame, s: DataFrame) -> DataFrame:
    """Follow-ups with the cards of what their events returned; agents of even numbers are in team_a, the others in team_b."""
    acl = access_of.artifact_acl(a, s).join(a.select("artifact_id", text.estimate_tokens(F.substring(F.coalesce("body_text", F.lit("")), 1, 120)).alias("tokens")), "artifact_id")
    r = e.where("run_id <> '-' and tool_name <> 'kb_search'").withColumn("teams", F.when(F.col("agent_name").rlike("[02468]$"), F.array(F.lit("team_a"))).otherwise(F.array(F.lit("team_b"))))
    each = r.select("retrieval_id", "teams", F.posexplode("returned_artifact_ids").alias("at", "artifact_id")).join(acl, "artifact_id").where((F.size("acl_teams") == 0) | F.arrays_overlap("acl_teams", "teams"))
    cards = each.groupBy("retrieval_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "artifact_id", "tokens", "acl_teams"))), lambda c: c.dropFields("at")).alias("cards"))
    none = F.expr("CAST(array() AS array<struct<artifact_id: string, tokens: bigint, acl_teams: array<string>>>)")
    r = r.join(cards, "retrieval_id", "left").withColumns({"asked_tokens": F.lit(60).cast("long"), "cards": F.coalesce("cards", none)})
    return packs.request_policy_replay(r, 2, 150, 200).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


# State decides what the next request meets: tests hold it against a brute-force version.
add("request_policy_replay", ("retrieval_event", "knowledge_artifact", "source_item"), _policy, None)
