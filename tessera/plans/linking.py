"""Queries of links, candidates and mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import linking, mining, resolve
from .catalog import add

L = ("linkable",)
_W = "[\\p{L}\\p{N}_]"
_E = "regexp_replace(t.title, '([^\\p{L}\\p{N}_ ])', '\\\\\\1', 'g')"
_SYMBOL = f"CASE WHEN contains(x.text, t.title) THEN regexp_matches(x.text, '(^|[^\\p{{L}}\\p{{N}}_.])' || {_E} || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END"
_PATH = f"CASE WHEN contains(x.text, t.title) THEN regexp_matches(x.text, '(^|[^\\p{{L}}\\p{{N}}_/])' || {_E} || '($|[^\\p{{L}}\\p{{N}}_/])') ELSE false END"
_PHRASE = f"""CASE WHEN contains(x.low, t.low) THEN regexp_matches(x.text, '(?i)' || CASE WHEN regexp_matches(t.title, '^{_W}') THEN '(^|[^\\p{{L}}\\p{{N}}_])' ELSE '{_W}' END || {_E} || CASE WHEN regexp_matches(t.title, '{_W}$') THEN '($|[^\\p{{L}}\\p{{N}}_])' ELSE '{_W}' END) ELSE false END"""
_DOCS = "artifact_type IN ('chunk', 'summary', 'source_backed_fact') AND source_type IN ('azure_wiki', 'github_doc', 'ado_card') AND body_text IS NOT NULL"
_PHRASES = f""", c AS MATERIALIZED (SELECT artifact_id AS i, title, lower(title) AS low FROM linkable WHERE artifact_type = 'concept' AND regexp_matches(title, '{_W}') AND (instr(trim(title), ' ') > 0 OR length(title) >= 6)),
 s AS (SELECT artifact_id AS i, title FROM linkable WHERE artifact_type = 'code_symbol' AND length(title) >= 4), f AS (SELECT artifact_id AS i, title FROM linkable WHERE artifact_type IN ('code_file', 'endpoint')),
 d AS MATERIALIZED (SELECT artifact_id AS i, body_text AS text, lower(body_text) AS low, source_type = 'ado_card' AS card FROM linkable WHERE {_DOCS}),
 k AS (SELECT artifact_id AS i, concat_ws(chr(10), nullif(title, ''), nullif(body_text, '')) AS text FROM linkable WHERE artifact_type = 'concept' AND title IS NOT NULL AND (instr(trim(title), ' ') > 0 OR length(title) >= 6))
 SELECT DISTINCT t.i AS from_artifact_id, x.i AS to_artifact_id, 'implements' AS edge_type, 0.95::DOUBLE AS confidence FROM s t JOIN k x ON {_SYMBOL} WHERE t.i <> x.i
 UNION ALL SELECT DISTINCT x.i, t.i, CASE WHEN card THEN 'requests' ELSE 'documents' END, 0.9 FROM c t JOIN d x ON {_PHRASE} WHERE t.i <> x.i
 UNION ALL SELECT DISTINCT x.i, t.i, 'mentions', 0.9 FROM (SELECT *, 1 AS kind FROM s UNION ALL SELECT *, 2 FROM f) t JOIN d x ON CASE WHEN kind = 1 THEN {_SYMBOL} ELSE {_PATH} END WHERE t.i <> x.i"""
add("phrase_links", L, linking.phrase_links, _PHRASES)

_INDEX = """, ky AS (SELECT artifact_id, unnest(list_concat([trim(external_id)], list_concat(regexp_extract_all(external_id, '[0-9]+'), coalesce(regexp_extract_all(title, '[0-9]+'), [])))) AS key FROM linkable WHERE source_type = 'ado_card'),
 ix AS (SELECT key, min(artifact_id) AS item FROM ky WHERE key <> '' GROUP BY 1)"""


def _refs(body: str, branch: str | None) -> str:
    """SQL: rows (artifact_id, key, matched, pos) of references, form by form; a bare # form stands alone."""
    forms = [("AB#([0-9]+)", body), ("GH-([0-9]+)", body), ("(?i)PR\\s*#([0-9]+)", body)]
    parts = [f"SELECT artifact_id, unnest(regexp_extract_all({c}, '{p}', 1)) AS key, unnest(regexp_extract_all({c}, '{p}')) AS matched, {i} AS form FROM linkable WHERE {{where}}" for i, (p, c) in enumerate(forms)]
    # RE2 has no look-behind: the character before is taken along, and the hash is put back.
    parts.append(f"SELECT artifact_id, unnest(regexp_extract_all({body}, '(^|[^\\w#-])#([0-9]+)', 2)), '#' || unnest(regexp_extract_all({body}, '(^|[^\\w#-])#([0-9]+)', 2)), 3 FROM linkable WHERE {{where}}")
    if branch:
        for i, p in enumerate(("AB-([0-9]+)", "GH-([0-9]+)", "/([0-9]+)[-_/]", "^([0-9]+)[-_/]"), 4):
            lead = "" if i < 6 else ""
            matched = f"unnest(regexp_extract_all({branch}, '{p}', 1))" if i >= 6 else f"unnest(regexp_extract_all({branch}, '{p}'))"
            parts.append(f"SELECT artifact_id, unnest(regexp_extract_all({branch}, '{p}', 1)), {lead}{matched}, {i} FROM linkable WHERE {{where}}")
    return " UNION ALL ".join(parts)


def _ref_links(where: str, branch: str | None, edge_type: str) -> str:
    return _INDEX + f""", rf AS ({_refs("coalesce(body_text, '')", branch).replace("{where}", where)}), fr AS (SELECT artifact_id, key, arg_min(matched, form) AS matched, min(form) AS form FROM rf GROUP BY ALL)
 SELECT artifact_id AS from_artifact_id, item AS to_artifact_id, '{edge_type}' AS edge_type, 0.95::DOUBLE AS confidence, arg_min(matched, form) AS matched FROM fr JOIN ix USING (key) WHERE artifact_id <> item GROUP BY ALL"""


add("commit_work_item_links", L, linking.commit_work_item_links, _ref_links("artifact_type = 'commit'", "coalesce(branch, '')", "implements"))
add("doc_work_item_links", L, linking.doc_work_item_links, _ref_links(_DOCS, None, "mentions"))
_SHA = """, id AS (SELECT external_id AS e, max(artifact_id) AS t FROM linkable WHERE artifact_type = 'commit' AND external_id <> '' GROUP BY 1),
 rf AS (SELECT DISTINCT artifact_id AS a, r FROM (SELECT artifact_id, unnest(regexp_extract_all(body_text, '\\b[0-9a-f]{7,40}\\b')) AS r FROM linkable WHERE artifact_type = 'commit') WHERE regexp_matches(r, '[a-f]')),
 j AS (SELECT a, r, max(t) FILTER (e = r) AS exact, count(*) AS n, min(t) AS sole FROM rf JOIN id ON starts_with(e, r) GROUP BY ALL), k AS (SELECT a, r, coalesce(exact, CASE WHEN n = 1 THEN sole END) AS t FROM j)
 SELECT a AS from_artifact_id, t AS to_artifact_id, 'implements' AS edge_type, 0.95::DOUBLE AS confidence, min(r) AS matched FROM k WHERE t <> a GROUP BY a, t"""
add("commit_commit_links", L, linking.commit_commit_links, _SHA)
_FILES = "list_filter(list_transform(string_split(string_split(body_text, '--- changed files ---')[-1], chr(10)), lambda x: trim(x)), lambda x: x <> '')"
add("commit_file_links", L, linking.commit_file_links, f""", f AS (SELECT path, max(artifact_id) AS i FROM linkable WHERE artifact_type = 'code_file' AND path IS NOT NULL GROUP BY 1), c AS (SELECT artifact_id AS a, unnest({_FILES}) AS path FROM linkable WHERE artifact_type = 'commit')
 SELECT a AS from_artifact_id, i AS to_artifact_id, 'mentions' AS edge_type, 0.95::DOUBLE AS confidence, min(path) AS matched FROM c JOIN f USING (path) WHERE a <> i GROUP BY a, i""")
add("changed_files", L, lambda a: a.where("artifact_type = 'commit'").select("artifact_id", F.array_join(text.parse_changed_files(F.col("body_text")), ",").alias("files")), f"SELECT artifact_id, array_to_string({_FILES}, ',') AS files FROM linkable WHERE artifact_type = 'commit'")


def _candidates(a: DataFrame) -> DataFrame:
    linked = linking.commit_file_links(a).select(F.col("from_artifact_id").alias("a"), F.col("to_artifact_id").alias("b"))
    return linking.candidate_pairs(a, linked).select("from_artifact_id", "to_artifact_id", F.round("score", 6).alias("score"), "bucket", F.array_join(F.map_keys("signals"), ",").alias("signals"))


_DOMAIN = "CASE WHEN source_type = 'git_metadata' THEN 'commit' WHEN source_type = 'ado_card' THEN 'card' WHEN source_type IN ('azure_wiki', 'github_doc') THEN 'doc' ELSE 'code' END"
add("candidate_pairs", L, _candidates, f""", f AS (SELECT path, max(artifact_id) AS i FROM linkable WHERE artifact_type = 'code_file' AND path IS NOT NULL GROUP BY 1), c AS (SELECT artifact_id AS a, unnest({_FILES}) AS path FROM linkable WHERE artifact_type = 'commit'), ex AS (SELECT DISTINCT least(a, i) AS p, greatest(a, i) AS q FROM c JOIN f USING (path)),
 n AS MATERIALIZED (SELECT artifact_id AS i, {_DOMAIN} AS d, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', title, path, external_id)), '[^a-z0-9]+'), lambda x: len(x) >= 3)) AS t, lower(coalesce(nullif(path, ''), nullif(title, ''), '')) AS needle, lower(coalesce(body_text, '')) AS body,
 CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir FROM linkable),
 o AS (SELECT x.i AS a, y.i AS b, len(list_intersect(x.t, y.t)) / nullif(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)), 0) AS ov, len(y.needle) >= 4 AND x.body <> '' AND contains(x.body, y.needle) AS se, coalesce(x.dir = y.dir, false) AS co FROM n x JOIN n y ON x.d <> y.d AND x.i <> y.i),
 s AS (SELECT a, b, greatest(CASE WHEN ov >= 0.1 THEN ov END, CASE WHEN se THEN 0.6 END, CASE WHEN co THEN 0.4 END)::DOUBLE AS score, concat_ws(',', CASE WHEN co THEN 'path_colocation' END, CASE WHEN se THEN 'section_proximity' END, CASE WHEN ov >= 0.1 THEN 'token_overlap' END) AS signals FROM o WHERE ov >= 0.1 OR se OR co)
 SELECT a AS from_artifact_id, b AS to_artifact_id, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS bucket, signals FROM s WHERE (least(a, b), greatest(a, b)) NOT IN (SELECT (p, q) FROM ex) QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10""")


def _semantic(e: DataFrame) -> DataFrame:
    """Vectors of even ids are concepts, the others symbols; every fifth concept has a deterministic link."""
    concepts, symbols = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    near = resolve.similar_topk(symbols, concepts, 3)
    near = near.select(F.col("query_id").cast("string").alias("concept_id"), F.col("vec_id").cast("string").alias("symbol_id"), "similarity")
    linked = concepts.where("vec_id % 10 = 0").select(F.lit("s").alias("from_artifact_id"), F.col("vec_id").cast("string").alias("to_artifact_id"))
    return linking.semantic_links(concepts.select(F.col("vec_id").cast("string").alias("artifact_id")), linked, near, ACCEPT).withColumn("confidence", F.round("confidence", 6))


#: Similarity that these vectors' neighbours reach.
ACCEPT = 0.3
add("semantic_links", ("embeddings",), _semantic, f"""WITH r AS (SELECT a.vec_id AS c, b.vec_id AS s, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS x FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND a.vec_id % 10 > 0 AND b.vec_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY x DESC, b.vec_id) <= 3)
 SELECT CAST(s AS VARCHAR) AS from_artifact_id, CAST(c AS VARCHAR) AS to_artifact_id, 'implements' AS edge_type, x AS confidence FROM r WHERE x >= {ACCEPT}""")


def _merge(e: DataFrame) -> DataFrame:
    rows = lambda n, x: e.where(f"cast(from_artifact_id as long) % {n} > 0").select("from_artifact_id", "to_artifact_id", F.lit(x).alias("score"))
    return linking.merge_candidates(rows(3, 0.5), rows(4, 0.7))


add("merge_candidates", ("doc_edge",), _merge, """, x AS (SELECT from_artifact_id, to_artifact_id, CAST(from_artifact_id AS BIGINT) AS i FROM doc_edge) SELECT from_artifact_id, to_artifact_id, CASE WHEN i % 4 > 0 THEN 0.7::DOUBLE END AS score,
 CASE WHEN i % 4 = 0 THEN 'drop' WHEN i % 3 = 0 THEN 'insert' ELSE 'update' END AS action FROM x WHERE i % 3 > 0 OR i % 4 > 0""")


def _judged(e: DataFrame, d: DataFrame) -> DataFrame:
    keys = ["from_artifact_id", "to_artifact_id"]
    i = F.col("from_artifact_id").cast("long") + F.col("to_artifact_id").cast("long")
    spans = e.join(d.select(F.col("doc_id").cast("string").alias("to_artifact_id"), "text"), "to_artifact_id").select(*keys, F.array("text").alias("spans"), "text")
    bucket = F.when(i % 5 == 0, "REJECTED").when(i % 5 < 3, "INFERRED_HIGH").otherwise("INFERRED_LOW")
    quote = F.when(i % 3 == 0, F.lit("no such words here")).otherwise(F.substring(text.collapsed(F.col("text")), 2, 30))
    verdicts = spans.select(*keys, F.lit("related_to").alias("relation_type"), bucket.alias("trust_bucket"), quote.alias("quote"))
    live = e.where("cast(from_artifact_id as long) % 2 = 0").select(*keys, F.lit("related_to").alias("relation_type"))
    return linking.judge_edges(spans.select(*keys, "spans"), verdicts, live).groupBy("trust_class", "action").agg(F.count("*").alias("edges"))


_WS = "trim(regexp_replace({}, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g'))"
add("judge_edges", ("doc_edge", "documents"), _judged, f""", j AS (SELECT CAST(from_artifact_id AS BIGINT) AS f, CAST(from_artifact_id AS BIGINT) + CAST(to_artifact_id AS BIGINT) AS i, {_WS.format("text")} AS w FROM doc_edge JOIN documents ON doc_id = CAST(to_artifact_id AS BIGINT)),
 q AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'no such words here' ELSE trim(substr(w, 2, 30)) END AS quote FROM j), v AS (SELECT f, CASE WHEN i % 5 = 0 THEN NULL WHEN quote <> '' AND contains(w, quote) THEN CASE WHEN i % 5 < 3 THEN 'INFERRED_HIGH' ELSE 'INFERRED_LOW' END ELSE 'AMBIGUOUS' END AS trust_class FROM q)
 SELECT trust_class, CASE WHEN trust_class IS NULL THEN 'invalidate' WHEN f % 2 = 0 THEN 'refresh' ELSE 'insert' END AS action, count(*) AS edges FROM v WHERE trust_class IS NOT NULL OR f % 2 = 0 GROUP BY ALL""")

# -- mining


def _contributions(a: DataFrame) -> DataFrame:
    c = a.where("artifact_type = 'commit'")
    commits = c.select(F.concat(F.lit("commit:"), "artifact_id").alias("source_key"), F.sha2("body_text", 256).alias("content_hash"), F.element_at(F.split("body_text", "\n"), 1).alias("subject"), text.parse_changed_files(F.col("body_text")).alias("changed_files"))
    docs = a.where("artifact_type = 'summary' and path is not null").select(F.concat(F.lit("doc:"), "artifact_id").alias("source_key"), F.sha2("body_text", 256).alias("content_hash"), F.concat(F.lit("docs/0001-order-queue-"), "artifact_id", F.lit(".md")).alias("path"))
    return mining.mine_commits(commits).unionByName(mining.mine_docs(docs))


_STOP = "(" + ", ".join(f"'{w}'" for w in text.PHRASE_STOP_WORDS) + ")"
_PH = "array_to_string(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND x NOT IN " + _STOP + "), ' ')"
_MINED = f""", c AS (SELECT artifact_id, string_split(body_text, chr(10))[1] AS s, {_FILES} AS fs, repo FROM linkable WHERE artifact_type = 'commit'), sub AS (SELECT artifact_id, fs, regexp_extract(s, '^\\s*([A-Za-z][\\w./-]*)(?:\\(([^)]*)\\))?!?:\\s*(.+)$', 2) AS scope, trim(regexp_extract(s, '^\\s*([A-Za-z][\\w./-]*)(?:\\(([^)]*)\\))?!?:\\s*(.+)$', 3)) AS descr FROM c),
 tk AS (SELECT artifact_id, fs, list_filter(string_split_regex(lower(descr), '[^a-z0-9]+'), lambda x: len(x) >= 2) AS t FROM sub),
 gr AS (SELECT DISTINCT artifact_id, fs, array_to_string(g, ' ') AS phrase FROM (SELECT artifact_id, fs, n, t[i : i + n - 1] AS g, len(t) AS l, i FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk), (VALUES (2), (3), (4)) v(n)) WHERE i + n - 1 <= l AND len(list_filter(g, lambda x: x IN {_STOP})) = 0),
 ph AS (SELECT artifact_id, fs, {_PH.format("scope")} AS phrase FROM sub UNION SELECT artifact_id, fs, phrase FROM gr),
 mi AS (SELECT 'commit:' || artifact_id AS source_key, phrase, unnest(fs) AS path FROM ph WHERE phrase <> '' UNION SELECT 'commit:' || artifact_id, 'payment retry guide', p FROM (SELECT artifact_id, unnest(fs) AS p FROM c) WHERE starts_with(p, 'docs/')
 UNION SELECT 'doc:' || artifact_id, CASE WHEN len(artifact_id) >= 2 THEN 'order queue ' || artifact_id ELSE 'order queue' END, 'docs/0001-order-queue-' || artifact_id || '.md' FROM linkable WHERE artifact_type = 'summary' AND path IS NOT NULL)"""
_AGG = _MINED + """, co AS (SELECT phrase, count(DISTINCT source_key) AS confirmations FROM mi GROUP BY 1), ct AS (SELECT phrase, path, count(*) AS count FROM mi GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY count DESC, contains('/' || path, '/tests/') OR starts_with(string_split(path, '/')[-1], 'test_'), len(list_intersect(list_filter(string_split_regex(lower(string_split(path, '/')[-1]), '[^a-z0-9]+'), lambda x: len(x) >= 2), string_split(phrase, ' '))) DESC, path) AS place FROM ct)"""
add("mine_phrases", L, lambda a: _contributions(a).select("source_key", "phrase", "path"), _MINED + " SELECT source_key, phrase, path FROM mi")
add("alias_aggregate", L, lambda a: mining.alias_aggregate(_contributions(a)), _AGG + " SELECT phrase, path, place, count, confirmations FROM rk JOIN co USING (phrase) WHERE place <= 50")


def _incremental(a: DataFrame) -> DataFrame:
    c = _contributions(a)
    key = F.xxhash64("source_key") % 2 == 0
    n = F.length("source_key")
    stored = c.withColumn("content_hash", F.when((n % 3 == 0) & F.col("phrase").contains("a"), "old").otherwise(F.col("content_hash")))
    inputs = c.select("source_key", "content_hash").distinct()
    replay, mine = mining.incremental_mining(stored, inputs)
    del key
    return replay.groupBy("source_key").agg(F.count("*").alias("rows")).withColumn("how", F.lit("replayed")).unionAll(mine.select("source_key", F.lit(0).cast("long"), F.lit("mined")))


add("incremental_mining", L, _incremental, _MINED + """, g AS (SELECT source_key, count(*) AS rows, count(*) FILTER (len(source_key) % 3 = 0 AND contains(phrase, 'a')) AS old FROM mi GROUP BY 1)
 SELECT source_key, CASE WHEN old = 0 THEN rows ELSE 0 END AS rows, CASE WHEN old = 0 THEN 'replayed' ELSE 'mined' END AS how FROM g""")


def _reconciled(a: DataFrame) -> DataFrame:
    desired = mining.alias_rows(mining.alias_aggregate(_contributions(a)))
    n = F.length("phrase")
    old = desired.where(n % 5 > 0).select("phrase", F.when(n % 3 == 0, F.lit("{}")).otherwise(F.col("body")).alias("body"), "search_text", F.lit("commit").alias("provenance"), F.lit(1).cast("long").alias("valid_from_seq"), F.when(n % 7 == 0, F.lit(3).cast("long")).alias("invalidated_at_seq"))
    lost = a.where("artifact_type = 'concept'").select(F.concat(F.lit("lost "), "artifact_id").alias("phrase"), F.lit("{}").alias("body"), F.lit("").alias("search_text"), F.when(F.length("artifact_id") % 2 == 0, "ledger_mined").otherwise("commit").alias("provenance"), F.lit(1).cast("long"), F.lit(None).cast("long"))
    return mining.reconcile_aliases(old.unionAll(lost), desired, 4).select("phrase", "action", "valid_from_seq", F.coalesce("invalidated_at_seq", F.lit(-1)).alias("left_at"))


add("reconcile_aliases", L, _reconciled, _AGG + """, d AS (SELECT DISTINCT phrase, len(phrase) AS n FROM mi), l AS (SELECT 'lost ' || artifact_id AS phrase, len(artifact_id) AS n FROM linkable WHERE artifact_type = 'concept')
 SELECT phrase, CASE WHEN n % 5 = 0 THEN 'insert' WHEN n % 3 = 0 OR n % 7 = 0 THEN 'refresh' ELSE 'unchanged' END AS action, CAST(CASE WHEN n % 5 = 0 THEN 4 ELSE 1 END AS BIGINT) AS valid_from_seq, CAST(-1 AS BIGINT) AS left_at FROM d
 UNION ALL SELECT phrase, CASE WHEN n % 2 = 0 THEN 'keep' ELSE 'invalidate' END, 1, CASE WHEN n % 2 = 1 THEN 4 ELSE -1 END FROM l""")


def _alias_edges(a: DataFrame) -> DataFrame:
    targets = a.where("artifact_type = 'code_file'").select("path", "artifact_id")
    return mining.alias_edges(mining.alias_aggregate(_contributions(a)), targets)


add("alias_edges", L, _alias_edges, _AGG + """ SELECT phrase, artifact_id, round(least(1.0, count / confirmations::DOUBLE), 6) AS confidence FROM rk JOIN co USING (phrase) JOIN (SELECT path, artifact_id FROM linkable WHERE artifact_type = 'code_file') f ON f.path = rk.path WHERE place <= 20""")


def _mined_groups(e: DataFrame) -> DataFrame:
    from ..operators import ledger

    groups = ledger.miss_groups(e).select("phrase")
    titles = e.sparkSession.sql(_TITLES)
    return mining.reconcile_mined(groups, titles, groups.where(F.length("phrase") % 4 == 0))


_TITLES = "SELECT 'click item ' || n AS alias, CAST(1 AS BIGINT) AS confirmations FROM (VALUES ('10'), ('11'), ('12')) t(n) UNION ALL SELECT 'view thing', 2"
add("reconcile_mined", ("retrieval_event",), _mined_groups, f""", g AS (SELECT DISTINCT trim(regexp_replace(lower(substr(query_text, 1, 80)), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM retrieval_event WHERE tool_name = 'kb_search' AND status = 'approved' AND len(returned_artifact_ids) <= 1 AND created_at >= (SELECT max(created_at) FROM retrieval_event) - INTERVAL 14 DAY),
 t AS (SELECT alias, confirmations, string_split(alias, ' ') AS s FROM ({_TITLES})), q AS (SELECT phrase, {_PH.format("phrase")} AS p, list_distinct(string_split({_PH.format("phrase")}, ' ')) AS s FROM g WHERE phrase <> ''),
 j AS (SELECT phrase, alias, CASE WHEN p = alias THEN 1.0 ELSE round(len(list_intersect(q.s, t.s))::DOUBLE / (len(q.s) + len(t.s) - len(list_intersect(q.s, t.s))), 6) END AS x, p = alias AS same, confirmations FROM q JOIN t ON len(list_intersect(q.s, t.s)) > 0),
 b AS (SELECT phrase, alias FROM j WHERE x >= 0.3 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY same DESC, x DESC, confirmations DESC, alias) = 1)
 SELECT phrase, CASE WHEN len(phrase) % 4 = 0 THEN 'already_aliased' WHEN alias IS NULL THEN 'unresolved' ELSE 'mined' END AS outcome, CASE WHEN len(phrase) % 4 > 0 THEN alias END AS alias FROM q LEFT JOIN b USING (phrase)""")


def _targets(a: DataFrame) -> DataFrame:
    body = F.when(F.col("artifact_type") == "concept", F.lit("{bad")).when(F.length("artifact_id") % 2 == 0, F.concat(F.lit('{"target_entity_ids": ["'), "artifact_id", F.lit('", "x"]}'))).otherwise(F.concat(F.lit('{"targets": [{"artifact_id": "'), "artifact_id", F.lit('", "path": "p"}]}')))
    return mining.explode_targets(a.select(F.col("artifact_id").alias("alias_id"), body.alias("body")))


add("explode_targets", L, _targets, """ SELECT artifact_id AS alias_id, CAST(0 AS BIGINT) AS place, CASE WHEN len(artifact_id) % 2 = 1 THEN 'p' END AS path, artifact_id FROM linkable WHERE artifact_type <> 'concept'
 UNION ALL SELECT artifact_id, 1, NULL, 'x' FROM linkable WHERE artifact_type <> 'concept' AND len(artifact_id) % 2 = 0""")
