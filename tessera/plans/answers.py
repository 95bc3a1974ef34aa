"""The query of whole task contexts: every stage on real searches, down to the serialised answer.

A task's hints are the pairs of words at the beginning of its text; the alias index are the concepts with what
their edges lead to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers
from .catalog import MEMBER, SEQ, TEAMS, VISIBLE, add
from .queries import _SCORED

TABLES = ("search_query", "knowledge_artifact", "source_item", "code_edge", "doc_edge")


def _tasks(q: DataFrame) -> DataFrame:
    words, i = F.split("query_text", " "), F.col("query_id")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.concat(F.get(words, k), F.lit(" "), F.get(words, k + 1)))
    floor = F.when(i % 4 == 3, "deterministic").otherwise("interpreted")
    most = F.when(i % 3 == 0, 400).when(i % 3 == 1, 900)
    return q.select("query_id", "query_text", "intent", F.array(*map(F.lit, TEAMS)).alias("teams"), pairs.alias("symbols"), F.expr("CAST(array() AS array<string>)").alias("paths"), floor.alias("floor"), most.alias("max_tokens"))


def _aliases(a: DataFrame, e: DataFrame) -> DataFrame:
    of = e.join(a.where("artifact_type = 'concept'").select(F.col("artifact_id").alias("from_artifact_id")), "from_artifact_id")
    return of.groupBy(F.col("from_artifact_id").alias("artifact_id")).agg(F.slice(F.array_sort(F.collect_set("to_artifact_id")), 1, 3).alias("targets")).withColumn("tier", F.lit("deterministic"))


def _answers(q: DataFrame, a: DataFrame, s: DataFrame, c: DataFrame, e: DataFrame) -> DataFrame:
    out = answers.task_answers(_tasks(q), a, s, c, _aliases(a, e), SEQ)
    return out.withColumn("answer", F.sha2("answer", 256))


_CODE = "('code_symbol', 'endpoint', 'code_file', 'test')"
_SQL = _SCORED + f""", al AS MATERIALIZED (SELECT from_artifact_id AS artifact_id, list_sort(list(DISTINCT to_artifact_id))[1:3] AS targets FROM doc_edge JOIN knowledge_artifact a ON a.artifact_id = from_artifact_id WHERE a.artifact_type = 'concept' GROUP BY 1),
 tk AS (SELECT query_id, string_split(query_text, ' ') AS w, CASE WHEN query_id % 4 = 3 THEN 'deterministic' ELSE 'interpreted' END AS floor, CASE query_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 900 ELSE {answers.SERVER_CAP} END AS cap FROM search_query),
 sh AS MATERIALIZED (SELECT artifact_id, artifact_type, title, path FROM knowledge_artifact JOIN source_item USING (source_id) WHERE {MEMBER} AND {VISIBLE}),
 h AS MATERIALIZED (SELECT query_id, rank, score, artifact_id, sh.artifact_type, sh.title, sh.path, k.body_text FROM top JOIN sh USING (artifact_id) JOIN knowledge_artifact k USING (artifact_id) WHERE rank <= {answers.WIDER_TOP}),
 hn AS MATERIALIZED (SELECT query_id, said, list_sort(list(artifact_id)) AS ids FROM (SELECT DISTINCT query_id, unnest(list_transform(range(1, 12), lambda i: w[i] || ' ' || w[i + 1])) AS said FROM tk) JOIN sh ON title = said AND artifact_type IN ('code_symbol', 'endpoint') GROUP BY ALL),
 ps AS (SELECT * FROM (VALUES (0, {answers.SEARCH_TOP}), (1, {answers.WIDER_TOP})) v(p, n)),
 ab AS MATERIALIZED (SELECT p, query_id, l[1] AS t, list_filter(l[2:], lambda x: x.score >= 0.8 * l[1].score AND list_sort(x.targets) <> list_sort(l[1].targets)) AS o FROM (SELECT p, query_id, list({{'rank': rank, 'score': score, 'title': title, 'targets': targets}} ORDER BY rank) AS l FROM ps JOIN h ON rank <= n JOIN al USING (artifact_id) GROUP BY ALL)),
 e0 AS MATERIALIZED (SELECT p, query_id, 1 AS stage, ids[1] AS artifact_id, 'deterministic' AS tier, 0 AS ord FROM ps, hn WHERE len(ids) = 1
  UNION ALL SELECT p, query_id, 2, x.id, 'deterministic', x.ord FROM (SELECT p, query_id, unnest(list_transform(t.targets, lambda v, i: {{'id': v, 'ord': i}})) AS x FROM ab WHERE len(o) = 0) WHERE x.id IN (SELECT artifact_id FROM sh)
  UNION ALL SELECT p, query_id, 3, artifact_id, 'interpreted', rank FROM ps JOIN h ON rank <= n WHERE artifact_id NOT IN (SELECT artifact_id FROM al) AND CASE WHEN p = 0 THEN artifact_type IN {_CODE} ELSE artifact_type <> 'commit' END),
 a0 AS MATERIALIZED (SELECT p, query_id, 1 AS stage, said, ids AS c FROM ps, hn WHERE len(ids) > 1 UNION ALL SELECT p, query_id, 2, said, list_filter(v, lambda x, i: list_position(v, x) = i) FROM (SELECT p, query_id, coalesce(t.title, '') AS said, list_concat(t.targets, flatten(list_transform(o, lambda x: x.targets))) AS v FROM ab WHERE len(o) > 0)),
 bs AS MATERIALIZED (SELECT query_id, p, stage FROM (SELECT query_id, p, stage FROM e0 UNION SELECT query_id, p, stage FROM a0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, stage) = 1),
 en AS MATERIALIZED (SELECT query_id, stage, artifact_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY ord, artifact_id) AS place FROM (SELECT DISTINCT query_id, stage, artifact_id, tier, ord FROM e0 JOIN bs USING (query_id, p, stage)) QUALIFY place <= {answers.ENTITIES}),
 am AS (SELECT query_id, list({{'alias_text': said, 'candidates': c}} ORDER BY said, c) AS amb FROM a0 JOIN bs USING (query_id, p, stage) GROUP BY 1),
 e AS MATERIALIZED (SELECT DISTINCT from_artifact_id AS f, to_artifact_id AS t, edge_type FROM code_edge WHERE trust_class = 'EXTRACTED'), hm AS (SELECT f, min(t) AS file FROM e WHERE edge_type = 'defined_in' GROUP BY 1),
 r AS (SELECT f AS seed, 'callee' AS role, t AS id, edge_type FROM e WHERE edge_type IN ('calls', 'imports') UNION ALL SELECT t, CASE WHEN edge_type = 'tests' THEN 'test' ELSE 'caller' END, f, edge_type FROM e WHERE edge_type IN ('calls', 'imports', 'tests')),
 b0 AS (SELECT query_id, role, id, edge_type, CASE WHEN role = 'callee' THEN a.file ELSE b.file END AS cf, CASE WHEN role = 'callee' THEN b.file ELSE a.file END AS tf FROM en JOIN r ON seed = artifact_id LEFT JOIN hm a ON a.f = seed LEFT JOIN hm b ON b.f = id WHERE seed <> id),
 b1 AS (SELECT query_id, role, id, edge_type, min(CASE WHEN edge_type <> 'calls' OR coalesce(cf = tf, false) OR (cf, tf) IN (SELECT (f, t) FROM e WHERE edge_type = 'imports') THEN 'deterministic' ELSE 'interpreted' END) AS tier FROM b0 GROUP BY ALL),
 b2 AS (SELECT query_id, role, id, sh.path, CASE WHEN artifact_type IN ('code_symbol', 'endpoint') THEN title END AS symbol, edge_type, tier FROM b1 JOIN sh ON sh.artifact_id = id),
 b3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY path, coalesce(symbol, ''), id, edge_type) AS place FROM b2 QUALIFY place <= {answers.BLAST}),
 bl AS MATERIALIZED (SELECT query_id, role, list({{'entity_id': id, 'path': path, 'symbol': symbol, 'edge_type': edge_type, 'confidence_tier': tier, 'caveat': CASE WHEN tier = 'interpreted' THEN '{answers.CAVEAT}' END}} ORDER BY place) AS items FROM b3 JOIN tk USING (query_id) WHERE floor = 'interpreted' OR tier = 'deterministic' GROUP BY ALL),
 tm AS (SELECT query_id, list(DISTINCT t) AS terms FROM (SELECT query_id, unnest(list_concat(s[1:len(s) - 1], [regexp_replace(s[len(s)], '\\.[^.]*$', '')])) AS t FROM (SELECT query_id, string_split(lower(path), '/') AS s FROM en JOIN sh USING (artifact_id))) WHERE t <> '' AND t NOT IN {answers.GENERIC} GROUP BY 1),
 dc AS (SELECT query_id, rank, h.artifact_id, title, path, coalesce(len(list_filter(terms, lambda t: contains(lower(coalesce(title, '') || ' ' || coalesce(body_text, '')), t))) > 0, false) AS named FROM h LEFT JOIN tm USING (query_id) WHERE rank <= {answers.SEARCH_TOP} AND artifact_type NOT IN {_CODE} AND artifact_type <> 'commit' AND artifact_id NOT IN (SELECT artifact_id FROM al)),
 d1 AS (SELECT *, bool_or(named) OVER (PARTITION BY query_id) AS has FROM dc), d2 AS (SELECT * FROM d1 WHERE named OR NOT has QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {answers.CONVENTIONS}),
 cv AS (SELECT query_id, list({{'pattern': coalesce(title, path), 'evidence_ids': [artifact_id], 'confidence_tier': 'interpreted'}} ORDER BY rank) AS conv FROM d2 GROUP BY 1),
 pr AS (SELECT query_id, list({{'commit_or_pr_id': coalesce(path, artifact_id), 'summary': substr(coalesce(title, substr(string_split(trim(body_text), chr(10))[1], 1, 280)), 1, 200), 'evidence_ids': [artifact_id]}} ORDER BY rank) AS prior FROM (SELECT * FROM h WHERE artifact_type = 'commit' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= {answers.PRIOR}) GROUP BY 1),
 es AS (SELECT query_id, list({{'entity_id': artifact_id, 'path': path, 'symbol': CASE WHEN artifact_type IN ('code_symbol', 'endpoint') THEN title END, 'via': ['hint', 'alias_index', 'search'][stage], 'confidence_tier': tier}} ORDER BY place) AS ents FROM en JOIN sh USING (artifact_id) JOIN tk USING (query_id) WHERE floor = 'interpreted' OR tier = 'deterministic' GROUP BY 1),
 x AS MATERIALIZED (SELECT query_id, cap, stage, p IS NULL OR p = 1 AS widened, coalesce(ents, []) AS ents, coalesce(amb, []) AS amb, coalesce(t.items, []) AS te, coalesce(c.items, []) AS cr, coalesce(d.items, []) AS ce, CASE WHEN floor = 'interpreted' THEN coalesce(conv, []) ELSE [] END AS cv, CASE WHEN floor = 'interpreted' THEN coalesce(prior, []) ELSE [] END AS pr,
  list_concat(list_transform(coalesce(amb, []), lambda a: 'Which ''' || a.alias_text || ''' is in scope? ' || len(a.candidates) || ' candidates match.'), CASE WHEN stage IS NULL THEN ['{answers.UNRESOLVED.replace(chr(39), chr(39) * 2)}'] ELSE [] END) AS qs
  FROM tk LEFT JOIN bs USING (query_id) LEFT JOIN es USING (query_id) LEFT JOIN am USING (query_id) LEFT JOIN cv USING (query_id) LEFT JOIN pr USING (query_id)
  LEFT JOIN (SELECT * FROM bl WHERE role = 'test') t USING (query_id) LEFT JOIN (SELECT * FROM bl WHERE role = 'caller') c USING (query_id) LEFT JOIN (SELECT * FROM bl WHERE role = 'callee') d USING (query_id)),
 n AS (SELECT *, len(te) + len(cr) + len(ce) + len(cv) + len(pr) AS items FROM x),
 g AS (SELECT *, te[1:least(k, len(te))] AS te_, cr[1:least(k - len(te), len(cr))] AS cr_, ce[1:least(k - len(te) - len(cr), len(ce))] AS ce_, cv[1:least(k - len(te) - len(cr) - len(ce), len(cv))] AS cv_, pr[1:least(k - len(te) - len(cr) - len(ce) - len(cv), len(pr))] AS pr_ FROM (SELECT *, unnest(range(0, items + 1)) AS k FROM n)),
 g1 AS (SELECT query_id, cap, stage, widened, ents, amb, te, cr, ce, cv, pr, qs, items, k, te_, CASE WHEN k > len(te) THEN cr_ ELSE [] END AS cr_, CASE WHEN k > len(te) + len(cr) THEN ce_ ELSE [] END AS ce_, CASE WHEN k > len(te) + len(cr) + len(ce) THEN cv_ ELSE [] END AS cv_, CASE WHEN k > len(te) + len(cr) + len(ce) + len(cv) THEN pr_ ELSE [] END AS pr_ FROM g),
 g2 AS (SELECT *, list_sort(list_distinct(list_transform(list_concat(list_concat(cr_, ce_), te_), lambda v: v.path))) AS paths,
  list_sort(list_distinct(list_concat(list_concat(list_concat(list_transform(ents, lambda v: v.entity_id), flatten(list_transform(amb, lambda v: v.candidates))), list_transform(list_concat(list_concat(cr_, ce_), te_), lambda v: v.entity_id)), list_concat(flatten(list_transform(cv_, lambda v: v.evidence_ids)), flatten(list_transform(pr_, lambda v: v.evidence_ids)))))) AS ev FROM g1),
 z AS (SELECT *, CAST(to_json({{'resolved_scope': {{'entities': ents, 'ambiguous_candidates': amb}}, 'referenced_paths': paths, 'blast_radius': {{'callers': {{cr_}}, 'callees': {{ce_}}, 'tests': {{te_}}}}, 'conventions': cv_, 'similar_prior_changes': pr_, 'evidence_ids': ev, 'open_questions': qs, 'budget_used': {{'tokens': 0, 'calls': CASE WHEN widened THEN 3 ELSE 2 END}}}}) AS VARCHAR) AS answer FROM g2),
 y AS (SELECT *, CAST(ceil(length(answer) / 4) AS BIGINT) AS tokens FROM z)
 SELECT query_id, coalesce(['hint', 'alias_index', 'search'][stage], 'none') AS stage, widened, len(ents) AS n_entities, len(amb) AS n_ambiguous, len(te) AS n_tests, len(cr) AS n_callers, len(ce) AS n_callees, len(cv) AS n_conventions, len(pr) AS n_prior, items - k AS trimmed, tokens, sha256(answer) AS answer
 FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tokens > cap, CASE WHEN tokens > cap THEN k ELSE -k END) = 1"""
for _c in ("cr_", "ce_", "te_"):
    _SQL = _SQL.replace(f"{{{_c}}}", f"list_transform({_c}, lambda v: {{'entity_id': v.entity_id, 'path_ref': list_position(paths, v.path) - 1, 'symbol': v.symbol, 'edge_type': v.edge_type, 'confidence_tier': v.confidence_tier, 'caveat': v.caveat}})")
add("task_answers", TABLES, _answers, _SQL)
