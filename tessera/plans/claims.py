"""Queries of claim checks.  Claims are the benchmark's quotes, citing some documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims
from .catalog import MEMBER, SEQ, TEAMS, VISIBLE, add

T = ("benchmark", "knowledge_artifact", "source_item", "doc_edge")


def _claims(b: DataFrame) -> DataFrame:
    ids = F.array(*((F.col("item_id") * m).cast("string") for m in (1, 5, 30)), F.when(F.col("item_id") % 9 == 0, F.lit("bad-id")))
    quote = F.when(F.col("item_id") % 4 > 0, F.substring("text", 1, 700))
    return b.select(F.col("item_id").alias("claim_id"), "text", F.array_compact(ids).alias("evidence_ids"), quote.alias("quote"))


def _retrieved(a: DataFrame) -> DataFrame:
    return a.where("cast(artifact_id as long) % 4 > 0").select("artifact_id")


def _checked(b: DataFrame, a: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    return claims.evidence_checks(_claims(b), a, s, e, _retrieved(a), SEQ, TEAMS)


_C = f""", c AS (SELECT item_id AS claim_id, text, CASE WHEN item_id % 4 > 0 THEN substr(text, 1, 700) END AS quote, list_distinct(list_filter([CAST(item_id AS VARCHAR), CAST(item_id * 5 AS VARCHAR), CAST(item_id * 30 AS VARCHAR), CASE WHEN item_id % 9 = 0 THEN 'bad-id' END], lambda x: x IS NOT NULL)) AS ids FROM benchmark),
 u AS (SELECT claim_id, unnest(ids) AS artifact_id FROM c), n AS (SELECT from_artifact_id AS i, trust_class FROM doc_edge WHERE {MEMBER} UNION ALL SELECT to_artifact_id, trust_class FROM doc_edge WHERE {MEMBER}), nx AS (SELECT DISTINCT i FROM n), ne AS (SELECT DISTINCT i FROM n WHERE trust_class = 'EXTRACTED'),
 k AS (SELECT artifact_id, body_text, {MEMBER} AS m, is_deleted, {VISIBLE} AS v FROM knowledge_artifact JOIN source_item USING (source_id)),
 e AS (SELECT claim_id, u.artifact_id, body_text, regexp_matches(u.artifact_id, '^[0-9]+$') AS good, k.artifact_id IS NOT NULL AS "exists", coalesce(m, false) AS in_active_version, coalesce(m AND v, false) AS acl_visible,
 k.artifact_id IS NOT NULL AND coalesce(try_cast(u.artifact_id AS BIGINT) % 4 > 0, false) AS in_requester_ledger, coalesce(m AND NOT is_deleted, false) AS not_stale, coalesce(m AND (u.artifact_id IN (SELECT i FROM ne) OR u.artifact_id NOT IN (SELECT i FROM nx)), false) AS supporting_trust_ok FROM u LEFT JOIN k USING (artifact_id)),
 ck AS (SELECT *, in_active_version AND acl_visible AND in_requester_ledger AS resolvable, CASE WHEN NOT good THEN ['evidence_id_not_a_valid_artifact_id'] ELSE list_filter([CASE WHEN NOT "exists" THEN 'evidence_not_found' WHEN NOT in_active_version THEN 'evidence_from_another_version' END, CASE WHEN NOT acl_visible THEN 'evidence_acl_invisible' END, CASE WHEN NOT in_requester_ledger THEN 'evidence_not_retrieved_by_requester' END,
 CASE WHEN in_active_version AND NOT not_stale THEN 'evidence_stale' END, CASE WHEN in_active_version AND NOT supporting_trust_ok THEN 'evidence_supported_only_by_inferred_edge' END], lambda x: x IS NOT NULL) END AS reasons FROM e)"""
_ORDER = "['" + "', '".join(claims.REASONS) + "']"
_L0 = f"""SELECT claim_id, bool_and("exists") AS "exists", bool_and(in_active_version) AS in_active_version, bool_and(acl_visible) AS acl_visible, bool_and(in_requester_ledger) AS in_requester_ledger, bool_and(not_stale) AS not_stale, bool_and(supporting_trust_ok) AS supporting_trust_ok,
 bool_and("exists" AND in_active_version AND acl_visible AND in_requester_ledger AND not_stale AND supporting_trust_ok) AS passed, list_filter({_ORDER}, lambda r: list_contains(flatten(list(reasons)), r)) AS reasons FROM ck GROUP BY 1"""
_text = lambda d: d.withColumn("reasons", F.array_join("reasons", ","))
add("evidence_checks", T, lambda b, a, s, e: _text(_checked(b, a, s, e)), _C + ' SELECT claim_id, artifact_id, "exists", in_active_version, acl_visible, in_requester_ledger, not_stale, supporting_trust_ok, resolvable, array_to_string(reasons, \',\') AS reasons FROM ck')
add("verify_l0", T, lambda b, a, s, e: _text(claims.verify_l0(_checked(b, a, s, e))), _C + f" SELECT * REPLACE (array_to_string(reasons, ',') AS reasons) FROM ({_L0})")
_WS = "trim(regexp_replace({}, '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g'))"
_L1 = f"""SELECT c.claim_id, cited AND short AND NOT lost AS passed, list_filter([CASE WHEN NOT cited THEN 'claim_uncited' END, CASE WHEN NOT short THEN 'quote_over_cap' END, CASE WHEN lost THEN 'quote_not_found' END], lambda x: x IS NOT NULL) AS reasons
 FROM (SELECT c.claim_id, coalesce(bool_or(resolvable), false) AS cited, any_value(coalesce(length(quote) <= 600, true)) AS short, any_value(quote IS NOT NULL) AND short AND cited AND NOT coalesce(bool_or(resolvable AND {_WS.format("quote")} <> '' AND contains({_WS.format("coalesce(body_text, '')")}, {_WS.format("quote")})), false) AS lost FROM c LEFT JOIN ck ON ck.claim_id = c.claim_id GROUP BY 1) c"""
add("verify_l1", T, lambda b, a, s, e: _text(claims.verify_l1(_claims(b), _checked(b, a, s, e), a)), _C + f" SELECT * REPLACE (array_to_string(reasons, ',') AS reasons) FROM ({_L1})")


def _facts(b: DataFrame) -> DataFrame:
    kind = F.when(F.col("item_id") % 3 == 0, "symbol_in_file").when(F.col("item_id") % 3 == 1, "file_imports_module").otherwise("edge_between")
    i = F.col("item_id")
    subject = F.when(i % 3 == 2, i.cast("string")).otherwise(F.concat(F.lit("docs/en/item-"), i, F.lit(".md")))
    return b.select(i.alias("fact_id"), kind.alias("kind"), subject.alias("subject"), (i * 5).cast("string").alias("object"), F.lit("mentions").alias("edge_type"))


def _titled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of symbols name the artifacts' own titles."""
    mine = a.select(F.col("artifact_id").cast("long").alias("fact_id"), "title")
    p = F.concat(F.lit("docs/"), F.lit("en"), F.lit("/item-"), F.col("fact_id"), F.lit(".md"))
    f = _facts(b).join(mine, "fact_id", "left")
    return f.select("fact_id", "kind", F.when(F.col("kind") == "symbol_in_file", F.col("title")).otherwise(F.col("subject")).alias("subject"), F.when(F.col("kind") == "symbol_in_file", p).otherwise(F.col("object")).alias("object"), "edge_type")


def _imports(e: DataFrame) -> DataFrame:
    return e.withColumn("edge_type", F.when(F.col("edge_type") == "implements", "imports").otherwise(F.col("edge_type")))


_U = f""", ka AS (SELECT artifact_id, artifact_type, title, path FROM knowledge_artifact JOIN source_item USING (source_id) WHERE {MEMBER} AND {VISIBLE}),
 ed AS (SELECT from_artifact_id AS f, to_artifact_id AS t, CASE WHEN edge_type = 'implements' THEN 'imports' ELSE edge_type END AS et FROM doc_edge WHERE {MEMBER} AND trust_class = 'EXTRACTED'),
 un AS (SELECT item_id AS fact_id, k.artifact_id FROM benchmark JOIN knowledge_artifact o ON o.artifact_id = CAST(item_id AS VARCHAR) JOIN ka k ON k.title = o.title AND k.path = 'docs/en/item-' || item_id || '.md' AND k.artifact_type = 'code_symbol' WHERE item_id % 3 = 0
 UNION SELECT item_id, a.artifact_id FROM benchmark JOIN ka a ON a.path = 'docs/en/item-' || item_id || '.md' JOIN ed ON f = a.artifact_id AND et = 'imports' JOIN ka b ON b.artifact_id = t AND b.title = CAST(item_id * 5 AS VARCHAR) WHERE item_id % 3 = 1
 UNION SELECT item_id, unnest([f, t]) FROM benchmark JOIN ed ON f = CAST(item_id AS VARCHAR) AND t = CAST(item_id * 5 AS VARCHAR) AND et = 'mentions' JOIN ka a ON a.artifact_id = f JOIN ka b ON b.artifact_id = t WHERE item_id % 3 = 2)"""
_L2 = """SELECT item_id AS claim_id, coalesce(n, 0) >= CASE WHEN item_id % 3 = 2 THEN 2 ELSE 1 END AS passed FROM benchmark LEFT JOIN (SELECT fact_id, count(*) AS n FROM un JOIN ck ON ck.claim_id = fact_id AND ck.artifact_id = un.artifact_id AND resolvable GROUP BY 1) x ON fact_id = item_id"""
add("fact_units", T, lambda b, a, s, e: claims.fact_units(_titled(a, b), a, s, _imports(e), SEQ, TEAMS), _U + " SELECT fact_id, artifact_id FROM un")


def _l2(b: DataFrame, a: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    f = _titled(a, b)
    return claims.verify_l2(f, claims.fact_units(f, a, s, _imports(e), SEQ, TEAMS), _checked(b, a, s, e))


add("verify_l2", T, _l2, _C + _U + " " + _L2)


def _receipt(b: DataFrame, a: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    c, checked = _claims(b), _checked(b, a, s, e)
    l2 = _l2(b, a, s, e).where("claim_id % 5 = 0")
    l3 = c.where("claim_id % 2 = 0").select("claim_id", (F.col("claim_id") % 6 > 0).alias("entailed"))
    return claims.receipt(c, claims.verify_l0(checked), claims.verify_l1(c, checked, a), l2, l3)


_R = f""", l0 AS ({_L0}), l1 AS ({_L1}), l2 AS (SELECT * FROM ({_L2}) WHERE claim_id % 5 = 0),
 rc AS (SELECT c.claim_id, l0.passed AND l1.passed AND coalesce(l2.passed, true) AS b, b AND l2.passed IS NULL AND c.claim_id % 2 = 0 AS j, b AND (NOT j OR c.claim_id % 6 > 0) AS passed, list_concat(list_concat(l0.reasons, l1.reasons), list_filter([CASE WHEN NOT l2.passed THEN 'typed_fact_unsupported' END, CASE WHEN j AND c.claim_id % 6 = 0 THEN 'not_entailed' END], lambda x: x IS NOT NULL)) AS reasons
 FROM c JOIN l0 USING (claim_id) JOIN l1 USING (claim_id) LEFT JOIN l2 ON l2.claim_id = c.claim_id)"""
add("receipt", T, lambda b, a, s, e: _text(_receipt(b, a, s, e)), _C + _U + _R + " SELECT claim_id, passed, array_to_string(reasons, ',') AS reasons FROM rc")
add("receipt_verdict", T, lambda b, a, s, e: claims.receipt_verdict(_receipt(b, a, s, e)), _C + _U + _R + " SELECT count(*) AS claims, count(*) FILTER (passed) AS passed_claims, CASE WHEN count(*) FILTER (passed) = count(*) THEN 'passed' WHEN count(*) FILTER (passed) = 0 THEN 'failed' ELSE 'partial' END AS verdict FROM rc")
add("answer_hash", ("benchmark",), lambda b: claims.answer_hash(_claims(b).select((F.col("claim_id") % 7).alias("answer_id"), F.col("claim_id").cast("string").alias("claim_id"), "evidence_ids", F.regexp_replace("text", '["\\\\\\\\\\x00-\\x08\\x0e-\\x1f/]', "").alias("text"))), """WITH c AS (SELECT item_id % 7 AS a, CAST(item_id AS VARCHAR) AS i, trim(regexp_replace(regexp_replace(text, '["\\\\\\x00-\\x08\\x0e-\\x1f/]', '', 'g'), '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g')) AS t, list_sort(list_distinct(list_filter([CAST(item_id AS VARCHAR), CAST(item_id * 5 AS VARCHAR), CAST(item_id * 30 AS VARCHAR), CASE WHEN item_id % 9 = 0 THEN 'bad-id' END], lambda x: x IS NOT NULL))) AS ids FROM benchmark)
 SELECT a AS answer_id, sha256('[' || string_agg('{"claim_id":"' || i || '","evidence_ids":["' || array_to_string(ids, '","') || '"],"text":"' || t || '"}', ',' ORDER BY i) || ']') AS answer_hash FROM c GROUP BY 1""")
