"""Queries of evaluation reports and reviews, over cases made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, ledger, reviews, skeletons
from .catalog import add
from .queries import _FOLLOW, _IDS, _ratio


def _records(e: DataFrame) -> DataFrame:
    n = F.length("run_id")
    g = e.where("run_id <> '-'").groupBy("run_id").agg(F.count("*").alias("c"), F.count_if(F.col("status") == "error").alias("x"))
    return g.select("run_id", (F.col("x") == 0).alias("succeeded"), F.col("c").alias("expected_items"), (F.col("c") % 3).alias("missing_items"), n.alias("total_claims"), (n % 2).alias("unsupported_claims"))


add("eval_metrics", ("retrieval_event",), lambda e: ledger.eval_metrics(_records(e), e), f""", g AS (SELECT run_id, count(*) AS c, count(*) FILTER (status = 'error') = 0 AS ok, sum(tokens_returned) AS t, length(run_id) AS n FROM retrieval_event WHERE run_id <> '-' GROUP BY 1), r AS (SELECT * FROM retrieval_event WHERE run_id <> '-'),
 x AS (SELECT run_id, retrieval_id, created_at, status, tokens_returned, tool_name = 'context.open_evidence' AS opened, {_IDS} AS ids FROM r), u AS (SELECT * EXCLUDE (ids), unnest(ids) AS id FROM x), f AS (SELECT run_id, opened, id, min((created_at, retrieval_id)) AS first FROM u WHERE NOT opened OR status = 'approved' GROUP BY ALL),
 n AS (SELECT DISTINCT u.run_id, u.retrieval_id FROM u LEFT JOIN f ON f.run_id = u.run_id AND f.opened = u.opened AND f.id = u.id WHERE f.first IS NULL OR (u.created_at, u.retrieval_id) <= f.first)
 SELECT (SELECT {_ratio("sum(t) FILTER (ok)", "count(*) FILTER (ok)")} FROM g) AS context_tokens_per_successful_task, (SELECT {_ratio("sum(n % 2)", "sum(n)")} FROM g) AS unsupported_claim_rate, (SELECT {_ratio("sum(c % 3)", "sum(c)")} FROM g) AS missing_context_rate,
 {_ratio("count(*) FILTER (status = 'reused')", "count(*) FILTER (status IN ('reused', 'approved'))")} AS evidence_reuse_rate, {_ratio("count(*)", "count(DISTINCT agent_name)")} AS retrieval_calls_per_agent, {_ratio(f"count(*) FILTER ({_FOLLOW} AND semantic_reuse)", f"count(*) FILTER ({_FOLLOW})")} AS semantic_cache_hit_rate,
 (SELECT coalesce(sum(tokens_returned), 0)::DOUBLE FROM x WHERE status = 'approved' AND tokens_returned > 0 AND len(ids) > 0 AND (run_id, retrieval_id) NOT IN (SELECT (run_id, retrieval_id) FROM n)) AS duplicate_context_tokens FROM r""")


def _pairs(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    i, j = F.col("from_artifact_id").cast("long"), F.col("to_artifact_id").cast("long")
    candidates = e.where(i % 3 > 0).select(F.col("to_artifact_id").alias("from_key"), F.col("from_artifact_id").alias("to_key"), F.when(j % 2 == 0, i % 5 > 0).alias("is_relevant"), F.when(i % 4 == 0, "AMBIGUOUS").otherwise("INFERRED_HIGH").alias("trust_bucket"))
    expected = e.where(j % 4 == 0).select(F.col("from_artifact_id").alias("a"), F.col("to_artifact_id").alias("b"))
    linked = e.where(i % 7 == 0).select(F.col("from_artifact_id").alias("a"), F.col("to_artifact_id").alias("b"))
    return candidates, expected, linked


_EDGES = ", d AS (SELECT CAST(from_artifact_id AS BIGINT) AS i, CAST(to_artifact_id AS BIGINT) AS j FROM doc_edge)"
add("candidate_report", ("doc_edge",), lambda e: evaluation.candidate_report(*_pairs(e)[:2]), _EDGES + f""" SELECT count(*) FILTER (i % 3 > 0) AS candidates, count(DISTINCT j) FILTER (i % 3 > 0) AS from_artifacts, count(*) FILTER (j % 4 = 0) AS expected, {_ratio("count(*) FILTER (j % 4 = 0 AND i % 3 > 0)", "count(*) FILTER (j % 4 = 0)")} AS recall,
 {_ratio("count(*) FILTER (i % 3 > 0 AND j % 2 = 0 AND i % 5 > 0)", "count(*) FILTER (i % 3 > 0 AND j % 2 = 0)")} AS precision, {_ratio("count(*) FILTER (i % 3 > 0)", "count(DISTINCT j) FILTER (i % 3 > 0)")} AS volume_per_artifact, 1200 * count(*) FILTER (i % 3 > 0) AS cost_if_judged_tokens FROM d""")
add("judge_report", ("doc_edge",), lambda e: evaluation.judge_report(_pairs(e)[0], _pairs(e)[2], _pairs(e)[1]), _EDGES + f""", x AS (SELECT *, i % 3 > 0 AND i % 4 > 0 AS inf, i % 7 = 0 AS det, j % 4 = 0 AS ex FROM d), y AS (SELECT count(*) FILTER (inf) AS inferred_edges, {_ratio("count(*) FILTER (inf AND j % 2 = 0 AND i % 5 > 0)", "count(*) FILTER (inf AND j % 2 = 0)")} AS inferred_edge_precision,
 {_ratio("count(*) FILTER (ex AND det)", "count(*) FILTER (ex)")} AS deterministic_recall, {_ratio("count(*) FILTER (ex AND (det OR inf))", "count(*) FILTER (ex)")} AS combined_recall FROM x) SELECT *, round(combined_recall - deterministic_recall, 6) AS recall_lift FROM y""")


def _cases(e: DataFrame) -> DataFrame:
    i = F.col("retrieval_id").cast("long")
    ids = lambda lo, n: F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: (lo + k).cast("string"))
    intent = F.element_at(F.array(*map(F.lit, ("how_does_x_work", "why_was_x_changed", "who_owns_x", "what_calls_x"))), (i % 4 + 1).cast("int"))
    kinds = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(i % 3 == 0, "code").when(i % 3 == 1, "pr").otherwise("doc"), F.lit("card")))
    none = F.array().cast("array<string>")
    return e.where("tool_name = 'kb_search'").select(
        F.col("retrieval_id").alias("case_id"), intent.alias("intent"), ids(i, i % 4).alias("returned_ids"), F.when(i % 6 == 0, none).otherwise(ids(i + 1, i % 3)).alias("expected_ids"), ids(i + 3, F.lit(0).cast("long")).alias("must_not_leak_ids"), F.lit(0.6).alias("floor"), kinds.alias("ordered_kinds"), (i % 8 == 0).alias("stale_primary"),
    )


# i returns i .. i + i % 4 and expects i + 1 .. i + 1 + i % 3, nothing where 6 divides i.
_GOLD = """, g AS (SELECT retrieval_id AS case_id, CAST(retrieval_id AS BIGINT) AS i FROM retrieval_event WHERE tool_name = 'kb_search'), h AS (SELECT *, CASE WHEN i % 6 = 0 THEN 0 ELSE i % 3 + 1 END AS ne, CASE WHEN i % 6 = 0 THEN 0 ELSE greatest(0, least(i % 4, i % 3 + 1)) END AS nf, CASE WHEN i % 5 > 0 THEN CASE i % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'pr' ELSE 'doc' END END AS k FROM g),
 s AS (SELECT case_id, CASE WHEN ne = 0 THEN 1.0 ELSE round(nf::DOUBLE / ne, 6) END AS recall, CASE WHEN i % 4 = 3 THEN 1 ELSE 0 END AS leaks, CASE WHEN k IS NULL THEN NULL ELSE i % 8 > 0 AND CASE i % 4 WHEN 0 THEN k = 'code' WHEN 1 THEN k = 'pr' WHEN 2 THEN k IN ('pr', 'code') ELSE k = 'code' END END AS ordering_ok,
 coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR)) FROM range(i + 1 + nf, i + 1 + ne) t(x)), '') AS missing FROM h)"""
add("golden_cases", ("retrieval_event",), lambda e: evaluation.golden_cases(_cases(e)), _GOLD + " SELECT case_id, recall, leaks, recall < 0.6 AS below_floor, ordering_ok, missing FROM s")
add("golden_report", ("retrieval_event",), lambda e: evaluation.golden_report(evaluation.golden_cases(_cases(e))), _GOLD + " SELECT count(*) AS cases, round(avg(recall), 6) AS mean_recall, min(recall) AS min_recall, CAST(sum(leaks) AS BIGINT) AS acl_leaks, count(*) FILTER (recall < 0.6) AS cases_below_floor, count(*) FILTER (ordering_ok = false) AS ordering_failures FROM s")


def _scores(l: DataFrame) -> DataFrame:
    e = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_shipmode").alias("edge_type") if "l_shipmode" in l.columns else F.col("l_returnflag").alias("edge_type"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_linenumber").distinct()
    return evaluation.edge_scores(e.where("a % 3 > 0"), e.where("b % 4 > 0"))


add("edge_scores", ("lineitem",), _scores, """WITH e AS (SELECT DISTINCT l_orderkey AS c, l_returnflag AS edge_type, l_partkey AS a, l_suppkey AS b FROM lineitem), k AS (SELECT c, edge_type, count(*) FILTER (a % 3 > 0) AS s, count(*) FILTER (b % 4 > 0) AS x, count(*) FILTER (a % 3 > 0 AND b % 4 > 0) AS n FROM e WHERE a % 3 > 0 OR b % 4 > 0 GROUP BY ALL)
 SELECT edge_type, round(avg(n / nullif(s, 0)), 6) AS edge_precision, round(avg(n / nullif(x, 0)), 6) AS edge_recall FROM k GROUP BY 1""")


def _resolved(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return o.select(k.alias("case_id"), F.when(k % 6 > 0, (k % 4).cast("string")).alias("first_target"), F.array((k % 3).cast("string"), F.lit("9")).alias("expected_targets"))


add("alias_report", ("orders",), lambda o: evaluation.alias_report(_resolved(o)), "SELECT count(*) AS cases, count(*) FILTER (o_orderkey % 6 > 0 AND o_orderkey % 4 = o_orderkey % 3) AS hits, round(count(*) FILTER (o_orderkey % 6 > 0 AND o_orderkey % 4 = o_orderkey % 3) / count(*), 6) AS top1_accuracy FROM orders")
add("alias_misses", ("orders",), lambda o: evaluation.alias_misses(_resolved(o)), "SELECT o_orderkey AS case_id FROM orders WHERE NOT (o_orderkey % 6 > 0 AND o_orderkey % 4 = o_orderkey % 3)")


def _arms(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    row = lambda n: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda x: x.cast("string"))
    return o.select(F.col("o_orderstatus").alias("arm"), k.alias("case_id"), row(k % 4 + 1).alias("found"), row(k % 6 + 1).alias("expected"))


add("coverage_ab", ("orders",), lambda o: evaluation.coverage_ab(_arms(o)), "SELECT o_orderstatus AS arm, count(*) AS cases, round(avg(least(o_orderkey % 4 + 1, o_orderkey % 6 + 1) / (o_orderkey % 6 + 1)), 6) AS coverage FROM orders GROUP BY 1")


def _metrics(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = e.groupBy("agent_name").agg(F.sum(F.when(F.dayofmonth("created_at") <= 15, F.col("tokens_returned")).otherwise(0)).cast("double").alias("o"), F.sum(F.when(F.dayofmonth("created_at") > 15, F.col("tokens_returned")).otherwise(0)).cast("double").alias("n"))
    return g.select(F.col("agent_name").alias("name"), F.col("o").alias("value")), g.select(F.col("agent_name").alias("name"), F.col("n").alias("value"), (F.length("agent_name") % 2 * 2 - 1).alias("better"))


def _compared(e: DataFrame) -> DataFrame:
    return evaluation.baseline_compare(*_metrics(e)).withColumn("relative", F.round("relative", 6))


_COMPARE = """, g AS (SELECT agent_name AS name, coalesce(sum(tokens_returned) FILTER (day(created_at) <= 15), 0)::DOUBLE AS old, coalesce(sum(tokens_returned) FILTER (day(created_at) > 15), 0)::DOUBLE AS new, length(agent_name) % 2 * 2 - 1 AS better FROM retrieval_event GROUP BY 1),
 r AS (SELECT *, CASE WHEN old <> 0 THEN (new - old) / abs(old) WHEN new = 0 THEN 0 ELSE 'inf'::DOUBLE END AS rel FROM g), v AS (SELECT name, old, new, round(rel, 6) AS relative, CASE WHEN rel * better < -0.05 THEN 'regressed' WHEN rel * better > 0.05 THEN 'improved' ELSE 'flat' END AS verdict FROM r)"""
add("baseline_compare", ("retrieval_event",), _compared, _COMPARE + " SELECT * FROM v")
add("baseline_verdict", ("retrieval_event",), lambda e: evaluation.baseline_verdict(_compared(e)), _COMPARE + " SELECT CASE WHEN bool_or(verdict = 'regressed') THEN 'regressed' WHEN bool_or(verdict = 'improved') THEN 'improved' ELSE 'flat' END AS verdict, arg_min(name, (-abs(relative), name)) AS biggest_mover FROM v")
def _files(d: DataFrame) -> DataFrame:
    """A source file of each document, Python or not: a function with a line for each of its words."""
    words = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w != "")
    i, py = F.col("doc_id").cast("string"), F.col("doc_id") % 2 == 0
    lines = F.array_join(F.transform(words, lambda w: F.concat(F.when(py, F.lit('    v = "')).otherwise('  let v = "'), w, F.when(py, F.lit('"\n')).otherwise('";\n'))), "")
    head = F.concat(F.when(py, F.lit("def f_")).otherwise("function f_"), i, F.when(py, F.lit("(a):\n")).otherwise("(a) {\n"))
    return d.select(F.concat("source", F.lit("/"), i, F.when(py, F.lit(".py")).otherwise(".js")).alias("path"), F.concat(head, lines, F.when(py, F.lit("")).otherwise("}\n")).alias("text"))


_FILES = """WITH w AS (SELECT doc_id, source, doc_id % 2 = 0 AS py, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '') AS ws FROM documents),
 f AS (SELECT source || '/' || doc_id || CASE WHEN py THEN '.py' ELSE '.js' END AS path, CASE WHEN py THEN 'def f_' || doc_id || '(a):' || chr(10) ELSE 'function f_' || doc_id || '(a) {' || chr(10) END || array_to_string(list_transform(ws, lambda w: CASE WHEN py THEN '    v = "' || w || '"' ELSE '  let v = "' || w || '";' END || chr(10)), '') || CASE WHEN py THEN '' ELSE '}' || chr(10) END AS text FROM w),
 l AS (SELECT path, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, unnest(range(len(string_split(regexp_replace(text, '\n$', ''), chr(10))))) AS n FROM f),
 k AS (SELECT *, sum(keep::INT) OVER (PARTITION BY path ORDER BY n) AS g FROM (SELECT *, trim(line) = '' OR left(line, 1) NOT IN (' ', chr(9)) AS keep FROM l)),
 r AS (SELECT path, min(n) AS n, CASE WHEN keep THEN min(line) ELSE '    ... # ' || count(*) || CASE WHEN count(*) = 1 THEN ' line' ELSE ' lines' END || ' elided' END AS line FROM k GROUP BY path, g, keep),
 s AS (SELECT path, text, skeleton FROM f JOIN (SELECT path, string_agg(line, chr(10) ORDER BY n) AS skeleton FROM r GROUP BY 1) USING (path))"""
# Each of these files has one function, so its definitions and its lines tell the same skeleton.
add("skeletons", ("documents",), lambda d: skeletons.skeletons(_files(d)).select("path", F.sha2("skeleton", 256).alias("skeleton")), _FILES + " SELECT path, sha256(skeleton) AS skeleton FROM s")
add("symbol_spans", ("documents",), lambda d: skeletons.scan_python(_files(d).where("path like '%.py'")).select("path", "ok", F.explode_outer("spans").alias("s")).select("path", "ok", "s.name", "s.kind", "s.line", "s.first", "s.last"), _FILES + """ SELECT path, len(x) > 2 AS ok, CASE WHEN ok THEN regexp_extract(text, 'f_[0-9]+') END AS name, CASE WHEN ok THEN 'def' END AS kind, CASE WHEN ok THEN 1 END AS line, CASE WHEN ok THEN 1 END AS first, CASE WHEN ok THEN CAST(len(x) - 1 AS INT) END AS last FROM (SELECT *, string_split(text, chr(10)) AS x FROM f WHERE path LIKE '%.py')""")
add("skeleton_savings", ("documents",), lambda d: evaluation.skeleton_savings(skeletons.skeletons(_files(d))), _FILES + """ SELECT CASE WHEN grouping(path) = 0 THEN 'file' WHEN grouping(folder) = 0 THEN 'folder' ELSE 'all' END AS level, coalesce(path, folder) AS path, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS before, CAST(sum(ceil(length(skeleton) / 4)) AS BIGINT) AS after, round((before - after)::DOUBLE / nullif(before, 0), 6) AS saved FROM (SELECT *, split_part(path, '/', 1) AS folder FROM s) GROUP BY ROLLUP (folder, path)""")


def _missing(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    expected = d.select(i.alias("case_id"), F.explode(F.array(F.struct(F.lit("doc").alias("kind"), F.concat(F.lit("d"), i % 7).alias("item")), F.struct(F.lit("file").alias("kind"), F.upper("source").alias("item")), F.struct(F.lit("symbol").alias("kind"), F.col("lang").alias("item")))).alias("x")).select("case_id", "x.*")
    returned = d.where(i % 2 == 0).select(i.alias("case_id"), F.concat(F.lit("d"), i % 5).alias("item"))
    corpus = d.where(i % 3 > 0).select(i.alias("case_id"), F.concat(F.lit("about "), "source").alias("said"))
    return evaluation.missing_items(expected, returned, corpus)


_LOST = """, m AS (SELECT doc_id AS case_id, 'doc' AS kind, 'd' || (doc_id % 7) AS item FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 7 = doc_id % 5) UNION ALL SELECT doc_id, 'file', upper(source) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'symbol', lang FROM documents WHERE doc_id % 3 = 0 OR NOT contains(lower('about ' || source), lower(lang)))"""
add("missing_items", ("documents",), _missing, _LOST + " SELECT case_id, kind, item FROM m")
add("case_success", ("documents",), lambda d: evaluation.case_success(d.select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 11 % 2).alias("failed_steps")), _missing(d), d.where("doc_id % 13 = 0").select(F.col("doc_id").alias("case_id"), F.lit("error").alias("status"))), _LOST + " SELECT doc_id AS case_id, doc_id % 11 % 2 = 0 AND doc_id % 13 > 0 AND doc_id NOT IN (SELECT case_id FROM m WHERE kind = 'doc') AS succeeded FROM documents")
add("claim_support", ("retrieval_event",), lambda e: evaluation.claim_support(e.select(F.col("agent_name").alias("case_id"), F.col("returned_artifact_ids").alias("evidence_ids"), F.slice("returned_artifact_ids", 1, 2).alias("returned_ids"))), "SELECT agent_name AS case_id, count(*) AS claims, count(*) FILTER (len(returned_artifact_ids) > 2) AS unsupported FROM retrieval_event GROUP BY 1")


def _outputs(c: DataFrame) -> DataFrame:
    i = F.col("conv_id") * 10 + F.col("turn")
    finding = F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), F.when(i % 7 == 0, "maybe").otherwise("approve").alias("verdict"), F.array(F.struct(F.when(i % 5 == 0, "huge").otherwise("major").alias("severity"), F.coalesce(F.nullif("text", F.lit("")), F.lit("empty")).alias("finding"), F.array(F.lit("e1")).alias("evidence_ids"))).alias("findings")))
    out = F.when(i % 11 == 0, "APPROVED!").when(i % 2 == 0, F.concat(F.lit("```json\n"), finding, F.lit("\n```"))).otherwise(finding)
    return c.select(F.col("conv_id").cast("string").alias("review_id"), F.col("turn").cast("string").alias("lens"), out.alias("output"))


def _parsed(c: DataFrame) -> DataFrame:
    good, bad = reviews.parse_findings(_outputs(c))
    return bad.unionAll(good.select("review_id", "lens", F.lit("ok")))


add("parse_findings", ("conversations",), _parsed, """SELECT CAST(conv_id AS VARCHAR) AS review_id, CAST(turn AS VARCHAR) AS lens, CASE WHEN (conv_id * 10 + turn) % 11 = 0 THEN 'not_json' WHEN (conv_id * 10 + turn) % 7 = 0 THEN 'bad_verdict' WHEN (conv_id * 10 + turn) % 5 = 0 THEN 'bad_finding' ELSE 'ok' END AS reason FROM conversations""")


def _merged(c: DataFrame) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, reviews.SEVERITIES)), (F.length(F.coalesce("text", F.lit(""))) % 4 + 1).cast("int"))
    f = c.select(F.col("conv_id").cast("string").alias("review_id"), F.col("turn").alias("lens_order"), F.col("role").alias("lens"), F.lit(0).alias("n"), severity.alias("severity"), F.coalesce("text", F.lit("")).alias("finding"), F.array(F.col("turn").cast("string")).alias("evidence_ids"))
    return reviews.reconcile_findings(f)


# The fold goes by recursion over a review's findings; a group holds its words and its members.
_MERGED = f"""WITH f AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS review_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {{'grave': length(coalesce(text, '')) % 4 + 1, 'lens': role, 'severity': ['blocker', 'major', 'minor', 'note'][length(coalesce(text, '')) % 4 + 1], 'finding': coalesce(text, ''), 'ev': CAST(turn AS VARCHAR)}} AS m,
 list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: len(w) > 1)) AS words FROM conversations),
 r AS (WITH RECURSIVE r AS (SELECT review_id, k, [{{'words': words, 'm': [m]}}] AS gs FROM f WHERE k = 1 UNION ALL
  SELECT review_id, k, CASE WHEN hit = 0 THEN list_append(gs, {{'words': words, 'm': [m]}}) ELSE list_transform(gs, lambda g, i: CASE WHEN i = hit THEN {{'words': list_distinct(list_concat(g.words, words)), 'm': list_append(g.m, m)}} ELSE g END) END
  FROM (SELECT f.*, r.gs, coalesce(list_position(list_transform(r.gs, lambda g: len(list_intersect(g.words, f.words)) > 0 AND len(list_intersect(g.words, f.words)) / len(list_distinct(list_concat(g.words, f.words))) >= {reviews.DUPLICATE}), true), 0) AS hit FROM r JOIN f ON f.review_id = r.review_id AND f.k = r.k + 1)) SELECT * FROM r),
 g AS (SELECT review_id, unnest(gs).m AS ms, generate_subscripts(gs, 1) AS i FROM (SELECT review_id, arg_max(gs, k) AS gs FROM r GROUP BY 1)),
 v AS (SELECT review_id, i, ms, list_sort(list_distinct(list_transform(ms, lambda x: x.lens))) AS lenses FROM g),
 w AS (SELECT *, list_transform(lenses, lambda l: list_filter(ms, lambda x: x.lens = l)[-1]) AS votes FROM v),
 x AS (SELECT *, list_min(list_transform(votes, lambda y: y.grave)) AS top FROM w),
 o AS (SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY top, i) AS place, ['blocker', 'major', 'minor', 'note'][top] AS severity, list_filter(ms, lambda y: y.grave = list_min(list_transform(ms, lambda z: z.grave)))[1].finding AS finding, list_sort(list_distinct(list_transform(ms, lambda y: y.ev))) AS evidence, lenses,
  CASE WHEN len(list_distinct(list_transform(votes, lambda y: y.severity))) > 1 THEN 'severity disputed (' || array_to_string(list_transform(votes, lambda y: y.lens || '=' || y.severity), ', ') || '); highest kept' END AS disagreement FROM x)"""
add("reconcile_findings", ("conversations",), lambda c: _merged(c).select("review_id", "place", "severity", F.array_join("evidence_ids", ",").alias("evidence"), F.array_join("lenses", ",").alias("lenses"), "disagreement"), _MERGED + " SELECT review_id, place, severity, array_to_string(evidence, ',') AS evidence, array_to_string(lenses, ',') AS lenses, disagreement FROM o")
add("render_comments", ("conversations",), lambda c: reviews.render_comments(_merged(c)).select("review_id", "place", F.length("body").alias("chars")), _MERGED + """ SELECT review_id, place, CAST(length(concat_ws(chr(10), '**[' || severity || ']** ' || finding, 'Evidence: ' || array_to_string(list_transform(evidence, lambda e: '`' || e || '`'), ', ') || ' (lenses: ' || array_to_string(lenses, ', ') || ')', 'Panel disagreement: ' || disagreement)) AS INT) AS chars FROM o""")
