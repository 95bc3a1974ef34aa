"""Review findings: parsing, merging across lenses, and the markdown of a draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from grave to slight, and the verdicts.
SEVERITIES = ("blocker", "major", "minor", "note")
VERDICTS = ("approve", "request_changes")
DUPLICATE = 0.7
_SHAPE = "schema_version string, verdict string, findings array<struct<severity: string, finding: string, evidence_ids: array<string>>>, open_questions array<string>"


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


def parse_findings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) model outputs: ``raw`` has review_id, lens, output.

    A code fence around the JSON is taken off.  An output is rejected, with a reason, if it isn't JSON
    of the shape or a severity, finding or evidence list isn't allowed.
    """
    bare = F.trim(F.regexp_replace("output", "^\\s+|\\s+$", ""))
    fenced = F.regexp_extract(bare, "(?s)^```(?:json)?\\s*\\n(.*)\\n\\s*```$", 1)
    r = raw.withColumn("_p", F.from_json(F.when(fenced != "", fenced).otherwise(bare), _SHAPE))
    ok = lambda f: F.coalesce(f["severity"].isin(*SEVERITIES) & (F.length(f["finding"]) > 0) & (F.size(f["evidence_ids"]) > 0), F.lit(False))
    none = F.from_json(F.lit("[]"), "array<struct<severity: string, finding: string, evidence_ids: array<string>>>")
    findings = F.coalesce("_p.findings", none)
    reason = F.when(F.col("_p.verdict").isNull(), "not_json").when(~F.col("_p.verdict").isin(*VERDICTS), "bad_verdict").when(F.exists(findings, lambda f: ~ok(f)), "bad_finding")
    r = r.withColumns({"reason": reason, "verdict": F.col("_p.verdict"), "findings": findings, "open_questions": F.coalesce(F.col("_p.open_questions"), F.array().cast("array<string>"))}).drop("_p")
    return r.where("reason is null").select("review_id", "lens", "verdict", "findings", "open_questions"), r.where("reason is not null").select("review_id", "lens", "reason")


def _words(said: Column) -> Column:
    """The different words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(said), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) > 1))


_MEMBER = "struct<grave: int, lens: string, severity: string, finding: string, evidence_ids: array<string>>"


def reconcile_findings(findings: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """Merged findings of each review: (review_id, place, severity, finding, evidence_ids, lenses, disagreement).

    ``findings``: review_id, lens_order, lens, n, severity, finding, evidence_ids.  A fold over the sorted
    array of a review, in order of lens and n: a finding joins the first group whose words, which grow with
    it, it resembles (Jaccard), or opens one.  A lens's last word on a group is its vote.  One review's
    findings are one row: a panel of a few lenses.
    """
    one = F.struct("lens_order", "n", F.struct(severity_rank(F.col("severity")).cast("int").alias("grave"), "lens", "severity", "finding", "evidence_ids").alias("said"), _words(F.col("finding")).alias("words"))
    told = findings.groupBy("review_id").agg(F.array_sort(F.collect_list(one)).alias("told"))
    none = F.expr(f"CAST(array() AS array<struct<words: array<string>, members: array<{_MEMBER}>>>)")

    def like(group: Column, r: Column) -> Column:
        shared = F.size(F.array_intersect(group["words"], r["words"]))
        return (shared > 0) & (shared / F.size(F.array_union(group["words"], r["words"])) >= threshold)

    def fold(groups: Column, r: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: like(g, r)), True)
        grown = lambda g: F.struct(F.array_union(g["words"], r["words"]).alias("words"), F.concat(g["members"], F.array(r["said"])).alias("members"))
        opened = F.array(F.struct(r["words"].alias("words"), F.array(r["said"]).alias("members")))
        return F.when(at == 0, F.concat(groups, opened)).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == at, grown(g)).otherwise(g)))

    groups = told.select("review_id", F.posexplode(F.aggregate("told", none, fold)).alias("at", "g")).select("review_id", "at", "g.members")
    lenses = F.array_sort(F.array_distinct(F.transform("members", lambda m: m["lens"])))
    votes = F.transform(lenses, lambda x: F.element_at(F.filter("members", lambda m: m["lens"] == x), -1))
    best = F.array_min(F.transform("members", lambda m, i: F.struct(m["grave"].alias("grave"), i.alias("i"), m["finding"].alias("finding"))))
    # Fixed value: how a disagreement is told.
    disputed = F.concat(F.lit("severity disputed ("), F.array_join(F.transform("votes", lambda v: F.concat(v["lens"], F.lit("="), v["severity"])), ", "), F.lit("); highest kept"))
    g = groups.withColumn("votes", votes).withColumn("top", F.array_min(F.transform("votes", lambda v: v["grave"])))
    place = F.row_number().over(Window.partitionBy("review_id").orderBy("top", "at")).cast("long")
    return g.select(
        "review_id", place.alias("place"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("top")).alias("severity"), best["finding"].alias("finding"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("members", lambda m: m["evidence_ids"])))).alias("evidence_ids"), lenses.alias("lenses"),
        F.when(F.size(F.array_distinct(F.transform("votes", lambda v: v["severity"]))) > 1, disputed).alias("disagreement"),
    )


def render_comments(merged: DataFrame) -> DataFrame:
    """One comment body for each merged finding."""
    evidence = F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("`"), e, F.lit("`"))), ", ")
    lines = F.concat_ws("\n", F.concat(F.lit("**["), "severity", F.lit("]** "), "finding"), F.concat(F.lit("Evidence: "), evidence, F.lit(" (lenses: "), F.array_join("lenses", ", "), F.lit(")")), F.concat(F.lit("Panel disagreement: "), "disagreement"))
    return merged.select("review_id", "place", lines.alias("body"))


def render_summaries(reviews: DataFrame, merged: DataFrame, questions: DataFrame) -> DataFrame:
    """One markdown summary for each review: findings by severity, then open questions, each once.

    ``reviews``: review_id, title, verdict, lenses; ``questions``: review_id, n, question.
    """
    evidence = F.array_join(F.transform("evidence_ids", lambda e: F.concat(F.lit("`"), e, F.lit("`"))), ", ")
    line = F.concat("place", F.lit(". **["), "severity", F.lit("]** "), "finding", F.lit(" (lenses: "), F.array_join("lenses", ", "), F.lit("; evidence: "), evidence, F.lit(")"))
    line = F.concat_ws("\n", line, F.concat(F.lit("   - Disagreement: "), "disagreement"))
    m = merged.select("review_id", F.struct("place", line.alias("line")).alias("x")).groupBy("review_id").agg(F.sort_array(F.collect_list("x")).alias("found"))
    w = Window.partitionBy("review_id", "question").orderBy("n")
    q = questions.withColumn("r", F.row_number().over(w)).where("r = 1").groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("n", "question"))).alias("asked"))
    j = reviews.join(m, "review_id", "left").join(q, "review_id", "left")
    found = F.coalesce(F.array_join(F.transform("found", lambda x: x["line"]), "\n"), F.lit("No findings from any lens."))
    asked = F.concat(F.lit("\n\n### Open questions\n"), F.array_join(F.transform("asked", lambda x: F.concat(F.lit("- "), x["question"])), "\n"))
    head = F.concat(F.lit("## Review-panel draft: "), "title", F.lit("\n\n**Advisory verdict (draft): `"), "verdict", F.lit("`**\n\n### Panel findings ("), F.col("lenses").cast("string"), F.lit(" lenses, ranked by severity)\n"))
    return j.select("review_id", F.concat(head, found, F.coalesce(asked, F.lit(""))).alias("markdown"))
