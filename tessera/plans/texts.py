"""Queries of text functions, files and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import builds, packs
from ..sources import files, sinks
from .catalog import MEMBER, SEQ, add

add("normalize_code", ("documents",), lambda d: d.select("doc_id", F.sha2(text.normalize_code(F.col("text")), 256).alias("h")), "SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS h FROM documents")
add("entailment_key", ("benchmark",), lambda b: b.select("item_id", text.entailment_key(F.col("text"), F.array(F.col("item_id").cast("string"), F.lit("7"))).alias("key")), """SELECT item_id, sha256(trim(regexp_replace(text, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g'))) || ':' ||
 sha256(array_to_string(list_sort([CAST(item_id AS VARCHAR), '7']), ',')) AS key FROM benchmark""")
add("card_summary", ("documents",), lambda d: d.select("doc_id", text.card_summary(F.col("text")).alias("summary")), "SELECT doc_id, substr(string_split_regex(regexp_replace(text, '^[ \\t\\r\\n\\x0b\\f]+|[ \\t\\r\\n\\x0b\\f]+$', '', 'g'), '\\r\\n|\\r|\\n')[1], 1, 280) AS summary FROM documents")
add("phrase_variants", ("linkable",), lambda a: a.where("title is not null").select("artifact_id", F.array_join(text.phrase_variants(text.normalize_query(F.col("title"))), ",").alias("variants")), """SELECT artifact_id, CASE WHEN contains(q, ' ') THEN replace(q, ' ', '-') || ',' || replace(q, ' ', '_') ELSE '' END AS variants
 FROM (SELECT artifact_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS q FROM linkable WHERE title IS NOT NULL)""")
_STOP = "(" + ", ".join(f"'{w}'" for w in text.PHRASE_STOP_WORDS) + ")"
add("phrase_ngrams", ("benchmark",), lambda b: b.select("item_id", F.explode(text.phrase_ngrams(F.col("text"))).alias("gram")), f""", tk AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: len(x) >= 2) AS t FROM benchmark)
 SELECT DISTINCT item_id, array_to_string(g, ' ') AS gram FROM (SELECT item_id, n, t[i : i + n - 1] AS g, len(t) AS l, i FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk), (VALUES (2), (3), (4)) v(n)) WHERE i + n - 1 <= l AND len(list_filter(g, lambda x: x IN {_STOP})) = 0""")
add("subject_labels", ("linkable",), lambda a: a.where("artifact_type = 'commit'").select("artifact_id", text.subject_scope(F.element_at(F.split("body_text", "\n"), 1)).alias("scope"), text.subject_description(F.element_at(F.split("body_text", "\n"), 1)).alias("description")), """SELECT artifact_id, repo AS scope,
 trim(regexp_extract(string_split(body_text, chr(10))[1], ':\\s*(.+)$', 1)) AS description FROM linkable WHERE artifact_type = 'commit'""")
add("doc_slugs", ("documents",), lambda d: d.select("doc_id", text.doc_slug_phrase(F.concat(F.lit("docs/adr/00"), "doc_id", F.lit("-ADR-the-"), "source", F.lit("-"), "lang", F.lit("-queue.md"))).alias("slug")), "SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(source || '-' || lang || '-queue'), '[^a-z0-9]+'), lambda x: len(x) >= 2), ' ') AS slug FROM documents")
_MENTION = lambda: F.concat(F.lit("uses `pkg.util."), "source", F.lit("` and `x` with `"), "lang", F.lit("`"))
add("referenced_symbols", ("documents",), lambda d: d.select("doc_id", F.array_join(text.referenced_symbols(_MENTION()), ",").alias("symbols")), """SELECT doc_id, array_to_string(list_filter(['pkg.util.' || source, lang, source], lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_.]+$')), ',') AS symbols FROM documents""")


def _stale(a: DataFrame) -> DataFrame:
    body = F.concat(F.lit("see `handle_"), (F.col("artifact_id").cast("long") - F.col("artifact_id").cast("long") % 7).cast("string"), F.lit("` and `handle_"), (F.col("artifact_id").cast("long") % 500).cast("string"), F.lit("`"))
    docs = a.where("artifact_type = 'summary'").select("artifact_id", "title", body.alias("body_text"))
    symbols = a.where("artifact_type = 'code_symbol'").select(F.col("title").alias("symbol"))
    return packs.stale_docs(docs.withColumn("title", F.lit(None).cast("string")), symbols)


add("stale_docs", ("linkable",), _stale, """, s AS (SELECT title FROM linkable WHERE artifact_type = 'code_symbol'), d AS (SELECT artifact_id, CAST(artifact_id AS BIGINT) AS i FROM linkable WHERE artifact_type = 'summary')
 SELECT artifact_id FROM d WHERE 'handle_' || CAST(i - i % 7 AS VARCHAR) NOT IN (SELECT title FROM s) OR 'handle_' || CAST(i % 500 AS VARCHAR) NOT IN (SELECT title FROM s)""")
add("display_citation", ("linkable", "source_item"), lambda a, s: a.join(s.select(F.col("source_id").alias("artifact_id"), "source_uri"), "artifact_id").select("artifact_id", text.display_citation(F.col("source_uri"), F.col("title"), F.col("artifact_type"), F.col("artifact_id")).alias("citation")), """SELECT artifact_id,
 regexp_replace(source_uri, '^github://[^/]*/[^/]*/', '') || CASE WHEN artifact_type = 'code_symbol' THEN ':' || title ELSE '' END AS citation FROM linkable JOIN source_item ON source_id = artifact_id""")
add("symbol_search_text", ("linkable",), lambda a: a.where("artifact_type = 'code_symbol'").select("artifact_id", text.symbol_search_text(F.col("title"), F.col("path")).alias("words")), """SELECT artifact_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(title || ' ' || path, '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS words FROM linkable WHERE artifact_type = 'code_symbol'""")
add("service_scope", ("linkable",), lambda a: a.select("artifact_id", text.service_scope(F.concat(F.lit("repo/services/"), "repo", F.lit("/tests/test_x.py"))).alias("scope"), text.is_test_file(F.coalesce("path", F.lit("tests/x"))).alias("is_test")), "SELECT artifact_id, 'services/' || repo AS scope, path IS NULL AS is_test FROM linkable")
_TREE = (["src/**/*.py", "docs/*"], ["src/m3/**"])
add("path_kept", ("linkable",), lambda a: a.where("path is not null").select("artifact_id", files.path_kept(F.col("path"), *_TREE).alias("kept")), "SELECT artifact_id, ends_with(path, '.py') AND NOT starts_with(path, 'src/m3/') AS kept FROM linkable WHERE path IS NOT NULL")
add("render_commits", ("linkable",), lambda a: a.where("artifact_type = 'commit'").select("artifact_id", F.sha2(text.render_commit(F.col("repo"), F.col("branch"), F.array("artifact_id", F.lit("a/b"), F.lit("a/b"))), 256).alias("h")), """SELECT artifact_id, sha256(nfc_normalize(repo) || CASE WHEN branch IS NULL THEN '' ELSE chr(10) || chr(10) || branch END || chr(10) || chr(10) || '--- changed files ---' || chr(10) || artifact_id || chr(10) || 'a/b' || chr(10)) AS h
 FROM linkable WHERE artifact_type = 'commit'""")
_FIELDS = lambda: F.map_from_arrays(F.array(F.lit("o.clerk"), F.lit("System.Title"), F.lit("a.status"), F.lit("System.State")), F.array(F.lit(None).cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("true")))
add("render_work_items", ("orders",), lambda o: o.select("o_orderkey", F.sha2(text.render_work_item(F.col("o_orderkey"), _FIELDS()), 256).alias("h")), """SELECT o_orderkey, sha256('WorkItem: ' || o_orderkey || chr(10) || 'System.Title: ' || o_orderpriority || chr(10) || 'System.State: true' || chr(10) || 'a.status: ' || o_orderstatus || chr(10) || 'o.clerk: ' || chr(10)) AS h FROM orders""")
add("note_slugs", ("knowledge_artifact",), lambda a: sinks.note_slugs(a, SEQ).select("artifact_id", "folder", "slug"), f""", b AS (SELECT artifact_id, artifact_type AS folder, coalesce(title, artifact_id) AS title FROM knowledge_artifact WHERE {MEMBER}),
 s AS (SELECT *, regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS base FROM b),
 t AS (SELECT *, CASE WHEN base = '' THEN 'untitled' ELSE base END AS k FROM s)
 SELECT artifact_id, folder, CASE WHEN row_number() OVER (PARTITION BY folder, k ORDER BY title, artifact_id) = 1 THEN k ELSE k || '-' || artifact_id END AS slug FROM t""")
add("export_notes", ("knowledge_artifact", "doc_edge", "source_item"), lambda a, e, s: sinks.note_index(sinks.export_notes(a, e, s, SEQ)), f"SELECT artifact_type AS folder, count(*) AS notes FROM knowledge_artifact WHERE {MEMBER} GROUP BY 1")
add("admits_floor", ("linkable",), lambda a: a.select("artifact_id", packs.admits_floor(F.when(F.col("artifact_type") == "concept", "interpreted").when(F.col("artifact_type") == "commit", "ground_truth").otherwise("deterministic"), "deterministic").alias("admitted")), "SELECT artifact_id, artifact_type <> 'concept' AS admitted FROM linkable")
add("embedding_cache_gate", ("embeddings",), lambda e: _embedding_gate(e), """SELECT CAST(vec_id AS VARCHAR) AS artifact_id, vec_id % 2 = 0 AND vec_id % 3 > 0 AS hit FROM embeddings""")


def _embedding_gate(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("vec_id").cast("string").alias("artifact_id"), F.lit("h").alias("text_hash"), F.lit("m").alias("model"), "vec_id", "embedding")
    cache = rows.where("vec_id % 2 = 0").withColumn("vector", F.when(F.expr("vec_id % 3 > 0"), F.col("embedding")))
    return builds.embedding_cache_gate(rows, cache).select("artifact_id", "hit")


def _embedding_merge(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("vec_id").cast("string").alias("artifact_id"), F.lit("h").alias("text_hash"), F.lit("m").alias("model"), "vec_id", "embedding")
    cache = rows.where("vec_id % 2 = 0").withColumn("vector", F.when(F.expr("vec_id % 3 > 0"), F.col("embedding")))
    computed = rows.where("vec_id % 5 > 0").withColumn("vector", F.when(F.expr("vec_id % 7 > 0"), F.col("embedding")))
    return builds.embedding_cache_merge(cache, computed).select("artifact_id", F.col("vector").isNotNull().alias("has_vector"))


add("embedding_cache_merge", ("embeddings",), _embedding_merge, "SELECT CAST(vec_id AS VARCHAR) AS artifact_id, (vec_id % 2 = 0 AND vec_id % 3 > 0) OR (vec_id % 5 > 0 AND vec_id % 7 > 0) AS has_vector FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 5 > 0")
