"""Checks of claims against the registry: evidence (L0), quotes (L1), typed facts (L2) and the receipt.

``claims``: claim_id, text, evidence_ids, quote and the assertion's columns.  A cited id that isn't of
the registry's form fails every check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import access, text
from . import registry

# Reasons in the order of the checks.
REASONS = (
    "evidence_id_not_a_valid_artifact_id", "evidence_not_found", "evidence_from_another_version", "evidence_acl_invisible", "evidence_not_retrieved_by_requester", "evidence_stale",
    "evidence_supported_only_by_inferred_edge",
)
CHECKS = ("exists", "in_active_version", "acl_visible", "in_requester_ledger", "not_stale", "supporting_trust_ok")


def evidence_checks(claims: DataFrame, artifacts: DataFrame, sources: DataFrame, edges: DataFrame, retrieved: DataFrame, seq: int, teams: list[str], form: str = "^[0-9]+$") -> DataFrame:
    """Rows (claim_id, artifact_id, six booleans, reasons): the L0 checks of each cited id.

    ``retrieved`` (artifact_id): what the requester was given before.
    """
    c = claims.select("claim_id", F.explode(F.array_distinct("evidence_ids")).alias("artifact_id"))
    p = registry.provenance(artifacts.where(access.member(seq)), sources, edges.where(access.member(seq))).select("artifact_id", "is_deleted", "has_extracted", "has_edge", F.lit(True).alias("member"))
    known = artifacts.select("artifact_id", "source_id").join(sources.select("source_id", access.visible(F.col("acl_teams"), teams).alias("seen")), "source_id", "left")
    known = known.select("artifact_id", F.coalesce("seen", F.lit(False)).alias("seen"), F.lit(True).alias("known"))
    got = retrieved.select("artifact_id", F.lit(True).alias("got")).distinct()
    j = c.join(known, "artifact_id", "left").join(p, "artifact_id", "left").join(got, "artifact_id", "left")
    yes = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(False))
    good = F.col("artifact_id").rlike(form)
    checks = {
        "exists": good & yes("known"), "in_active_version": good & yes("member"), "acl_visible": good & yes("member") & yes("seen"), "in_requester_ledger": good & yes("got"),
        "not_stale": good & yes("member") & ~yes("is_deleted"), "supporting_trust_ok": good & yes("member") & (yes("has_extracted") | ~yes("has_edge")),
    }
    j = j.select("claim_id", "artifact_id", good.alias("good"), *(v.alias(k) for k, v in checks.items()))
    why = F.when(~F.col("good"), F.array(F.lit(REASONS[0]))).otherwise(F.array_compact(F.array(
        F.when(~F.col("exists"), REASONS[1]).when(~F.col("in_active_version"), REASONS[2]), F.when(~F.col("acl_visible"), REASONS[3]), F.when(~F.col("in_requester_ledger"), REASONS[4]),
        F.when(F.col("in_active_version") & ~F.col("not_stale"), REASONS[5]), F.when(F.col("in_active_version") & ~F.col("supporting_trust_ok"), REASONS[6]),
    )))
    resolvable = F.col("in_active_version") & F.col("acl_visible") & F.col("in_requester_ledger")
    return j.select("claim_id", "artifact_id", *CHECKS, resolvable.alias("resolvable"), why.alias("reasons"))


def in_order(reasons: Column, order: tuple[str, ...]) -> Column:
    """The different reasons of an array, in the order of the checks."""
    return F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains(reasons, r))


def verify_l0(checked: DataFrame) -> DataFrame:
    """By claim: the AND of its ids' checks, and the reasons of those that fail."""
    g = checked.groupBy("claim_id").agg(*(F.bool_and(c).alias(c) for c in CHECKS), F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("r"))
    passed = F.lit(True)
    for c in CHECKS:
        passed = passed & F.col(c)
    return g.select("claim_id", *CHECKS, passed.alias("passed"), in_order(F.col("r"), REASONS).alias("reasons"))


def verify_l1(claims: DataFrame, checked: DataFrame, artifacts: DataFrame, most: int = 600) -> DataFrame:
    """By claim: a cited id resolves, the quote isn't longer than ``most`` and stands in a resolvable cited body."""
    units = checked.where("resolvable").select("claim_id", "artifact_id").join(artifacts.select("artifact_id", "body_text"), "artifact_id")
    c = claims.select("claim_id", "quote")
    g = units.join(c, "claim_id").groupBy("claim_id").agg(F.bool_or(text.quote_grounded(F.col("quote"), F.coalesce("body_text", F.lit("")))).alias("found"), F.lit(True).alias("cited"))
    j = c.join(g.select("claim_id", "found", "cited"), "claim_id", "left").withColumns({"cited": F.coalesce("cited", F.lit(False)), "short": F.col("quote").isNull() | (F.length("quote") <= most)})
    lost = F.col("quote").isNotNull() & F.col("short") & F.col("cited") & ~F.coalesce("found", F.lit(False))
    why = F.array_compact(F.array(F.when(~F.col("cited"), "claim_uncited"), F.when(~F.col("short"), "quote_over_cap"), F.when(lost, "quote_not_found")))
    return j.select("claim_id", (F.col("cited") & F.col("short") & ~lost).alias("passed"), why.alias("reasons"))


def fact_units(facts: DataFrame, artifacts: DataFrame, sources: DataFrame, edges: DataFrame, seq: int, teams: list[str]) -> DataFrame:
    """Rows (fact_id, artifact_id): the visible member units that support typed facts.

    ``facts``: fact_id, kind, subject, object, edge_type.  symbol_in_file: a symbol of that title
    whose source has the path; file_imports_module: an EXTRACTED imports edge from a file of the path
    to an artifact of the title; edge_between: an EXTRACTED edge of the type between two ids.
    """
    s = sources.select("source_id", "path", access.visible(F.col("acl_teams"), teams).alias("seen"))
    a = artifacts.where(access.member(seq)).join(s.where("seen"), "source_id").select("artifact_id", "artifact_type", "title", "path")
    e = edges.where(access.member(seq) & (F.col("trust_class") == "EXTRACTED")).select("from_artifact_id", "to_artifact_id", F.col("edge_type").alias("et"))
    e = e.join(a.select(F.col("artifact_id").alias("from_artifact_id"), F.col("path").alias("from_path")), "from_artifact_id").join(a.select(F.col("artifact_id").alias("to_artifact_id"), F.col("title").alias("to_title")), "to_artifact_id")
    f = lambda k: facts.where(F.col("kind") == k)
    symbol = f("symbol_in_file").join(a.where("artifact_type = 'code_symbol'"), (F.col("subject") == F.col("title")) & (F.col("object") == F.col("path"))).select("fact_id", "artifact_id")
    imports = f("file_imports_module").join(e.where("et = 'imports'"), (F.col("subject") == F.col("from_path")) & (F.col("object") == F.col("to_title"))).select("fact_id", F.col("from_artifact_id").alias("artifact_id"))
    between = f("edge_between").join(e, (F.col("subject") == F.col("from_artifact_id")) & (F.col("object") == F.col("to_artifact_id")) & (F.col("edge_type") == F.col("et")))
    return symbol.unionAll(imports).unionAll(between.select("fact_id", F.explode(F.array("from_artifact_id", "to_artifact_id")).alias("artifact_id"))).distinct()


def verify_l2(facts: DataFrame, units: DataFrame, checked: DataFrame) -> DataFrame:
    """By claim with a typed fact (fact_id is the claim's): a supporting unit is cited and resolvable; for edges both ends."""
    cited = checked.where("resolvable").select(F.col("claim_id").alias("fact_id"), "artifact_id")
    n = units.join(cited, ["fact_id", "artifact_id"]).groupBy("fact_id").agg(F.count("*").alias("n"))
    need = F.when(F.col("kind") == "edge_between", 2).otherwise(1)
    return facts.join(n, "fact_id", "left").select(F.col("fact_id").alias("claim_id"), (F.coalesce("n", F.lit(0)) >= need).alias("passed"))


def receipt(claims: DataFrame, l0: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """By claim: levels folded, with reasons in order.  A given verdict (L3) counts for claims passed so far and without a typed fact."""
    j = claims.select("claim_id").join(l0.select("claim_id", F.col("passed").alias("p0"), F.col("reasons").alias("r0")), "claim_id", "left").join(l1.select("claim_id", F.col("passed").alias("p1"), F.col("reasons").alias("r1")), "claim_id", "left")
    j = j.join(l2.select("claim_id", F.col("passed").alias("p2")), "claim_id", "left").join(l3.select("claim_id", F.col("entailed").alias("p3")), "claim_id", "left")
    none = F.array().cast("array<string>")
    before = F.coalesce("p0", F.lit(False)) & F.coalesce("p1", F.lit(False)) & F.coalesce("p2", F.lit(True))
    judged = before & F.col("p2").isNull() & F.col("p3").isNotNull()
    why = F.concat(F.coalesce("r0", none), F.coalesce("r1", none), F.when(~F.coalesce("p2", F.lit(True)), F.array(F.lit("typed_fact_unsupported"))).otherwise(none), F.when(judged & ~F.col("p3"), F.array(F.lit("not_entailed"))).otherwise(none))
    return j.select("claim_id", (before & (~judged | F.col("p3"))).alias("passed"), F.array_distinct(why).alias("reasons"))


def receipt_verdict(receipts: DataFrame) -> DataFrame:
    """passed, failed or partial over all claims."""
    g = receipts.agg(F.count("*").alias("claims"), F.count_if("passed").alias("passed_claims"))
    return g.withColumn("verdict", F.when(F.col("passed_claims") == F.col("claims"), "passed").when(F.col("passed_claims") == 0, "failed").otherwise("partial"))


def answer_hash(claims: DataFrame) -> DataFrame:
    """By answer: the hash of its claims in order of id, texts collapsed, ids sorted and each once, as compact JSON."""
    c = F.struct("claim_id", F.array_sort(F.array_distinct("evidence_ids")).alias("evidence_ids"), text.collapsed(F.col("text")).alias("text"))
    g = claims.groupBy("answer_id").agg(F.sort_array(F.collect_list(c)).alias("c"))
    shape = F.transform("c", lambda x: F.struct(x["claim_id"].alias("claim_id"), x["evidence_ids"].alias("evidence_ids"), x["text"].alias("text")))
    return g.select("answer_id", F.sha2(F.to_json(shape), 256).alias("answer_hash"))
