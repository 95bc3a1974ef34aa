"""Evaluation of retrieval, links, aliases and runs against expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGE_TOKENS = 1200
THRESHOLD = 0.05


def _share(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b), 6)


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).distinct()


def candidate_report(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: recall of expected pairs in either order, precision of sampled ones, volume, cost of judging all.

    ``candidates``: from_key, to_key, is_relevant (null where not sampled); ``expected``: a, b.
    """
    found = _pairs(candidates, "from_key", "to_key").withColumn("hit", F.lit(1))
    e = _pairs(expected, "a", "b").join(found, ["p", "q"], "left").agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
    c = candidates.agg(F.count("*").alias("candidates"), F.count_distinct("from_key").alias("from_artifacts"), F.count("is_relevant").alias("sampled"), F.count_if("is_relevant").alias("relevant"))
    return c.crossJoin(e).select(
        "candidates", "from_artifacts", "expected", _share(F.col("found"), F.col("expected")).alias("recall"), _share(F.col("relevant"), F.col("sampled")).alias("precision"),
        _share(F.col("candidates"), F.col("from_artifacts")).alias("volume_per_artifact"), (F.col("candidates") * JUDGE_TOKENS).alias("cost_if_judged_tokens"),
    )


def judge_report(judged: DataFrame, linked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: precision of sampled inferred edges, recall of linked pairs alone and with them, and the lift."""
    inferred = judged.where(F.col("trust_bucket").isin("INFERRED_HIGH", "INFERRED_LOW"))
    j = inferred.agg(F.count("*").alias("inferred_edges"), _share(F.count_if("is_relevant"), F.count("is_relevant")).alias("inferred_edge_precision"))
    det = _pairs(linked, "a", "b").withColumn("d", F.lit(1))
    both = det.select("p", "q").union(_pairs(inferred, "from_key", "to_key")).distinct().withColumn("c", F.lit(1))
    e = _pairs(expected, "a", "b").join(det, ["p", "q"], "left").join(both, ["p", "q"], "left")
    r = e.agg(_share(F.count("d"), F.count("*")).alias("deterministic_recall"), _share(F.count("c"), F.count("*")).alias("combined_recall"))
    return j.crossJoin(r).withColumn("recall_lift", F.round(F.col("combined_recall") - F.col("deterministic_recall"), 6))


# Kinds that may lead an answer by intent; the second must have one of them anywhere.
LEADS = {"how_does_x_work": ("code",), "what_calls_x": ("code",), "why_was_x_changed": ("card", "pr", "adr"), "who_owns_x": ("pr", "card", "code")}


def intent_ordering_ok(intent: Column, kinds: Column, stale_primary: Column) -> Column:
    """Whether an answer's kinds stand in the order that its intent asks for; null without kinds."""
    lead = F.element_at(F.create_map(*(x for i, k in LEADS.items() for x in (F.lit(i), F.array(*map(F.lit, k))))), intent)
    first = F.array_contains(lead, F.element_at(kinds, 1)) & ~stale_primary
    include = (intent != "why_was_x_changed") | F.arrays_overlap(kinds, F.array(F.lit("card"), F.lit("pr"), F.lit("adr")))
    return F.when(F.size(kinds) > 0, F.coalesce(first & include, F.lit(False)))


def golden_cases(cases: DataFrame) -> DataFrame:
    """By case: recall of expected ids, ids that must not leak but did, whether the floor and the order hold.

    ``cases``: case_id, intent, returned_ids, expected_ids, must_not_leak_ids, floor, ordered_kinds, stale_primary.
    """
    found = F.size(F.array_intersect("returned_ids", "expected_ids"))
    recall = F.when(F.size("expected_ids") == 0, 1.0).otherwise(F.round(found / F.size(F.array_distinct("expected_ids")), 6))
    return cases.select(
        "case_id", recall.alias("recall"), F.size(F.array_intersect("must_not_leak_ids", "returned_ids")).alias("leaks"), (recall < F.col("floor")).alias("below_floor"),
        intent_ordering_ok(F.col("intent"), F.col("ordered_kinds"), F.col("stale_primary")).alias("ordering_ok"), F.array_join(F.array_sort(F.array_except("expected_ids", "returned_ids")), ",").alias("missing"),
    )


def golden_report(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("cases"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.min("recall").alias("min_recall"), F.sum("leaks").alias("acl_leaks"), F.count_if("below_floor").alias("cases_below_floor"),
        F.count_if(F.col("ordering_ok") == F.lit(False)).alias("ordering_failures"),
    )


def edge_scores(surfaced: DataFrame, expected: DataFrame) -> DataFrame:
    """By edge type: precision and recall, each the mean over the cases that have something to score.

    Both: case_id, edge_type, a, b.
    """
    keys = ["case_id", "edge_type", "a", "b"]
    j = surfaced.select(*keys, F.lit(1).alias("s")).distinct().join(expected.select(*keys, F.lit(1).alias("e")).distinct(), keys, "full")
    c = j.groupBy("case_id", "edge_type").agg(F.count("s").alias("s"), F.count("e").alias("e"), F.count_if(F.col("s").isNotNull() & F.col("e").isNotNull()).alias("both"))
    return c.groupBy("edge_type").agg(F.round(F.avg(F.try_divide(F.col("both").cast("double"), F.col("s"))), 6).alias("edge_precision"), F.round(F.avg(F.try_divide(F.col("both").cast("double"), F.col("e"))), 6).alias("edge_recall"))


def alias_report(resolved: DataFrame) -> DataFrame:
    """One row: how many first targets were among the expected ones, and the cases that missed.

    ``resolved``: case_id, first_target (null for a miss), expected_targets.
    """
    hit = F.coalesce(F.array_contains("expected_targets", F.col("first_target")), F.lit(False))
    g = resolved.agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"))
    return g.select("cases", "hits", F.coalesce(_share(F.col("hits"), F.col("cases")), F.lit(0.0)).alias("top1_accuracy"))


def alias_misses(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.coalesce(F.array_contains("expected_targets", F.col("first_target")), F.lit(False))).select("case_id")


def coverage_ab(arms: DataFrame) -> DataFrame:
    """By arm: the mean share of a case's expected files that it found.  ``arms``: arm, case_id, found, expected."""
    share = F.size(F.array_intersect("found", "expected")) / F.size(F.array_distinct("expected"))
    return arms.where(F.size("expected") > 0).groupBy("arm").agg(F.count("*").alias("cases"), F.round(F.avg(share), 6).alias("coverage"))


def baseline_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """By metric measured in both: the relative change and what it means; ``new`` says which way is better (better: -1, 0, 1)."""
    j = old.where("value is not null").select("name", F.col("value").alias("old")).join(new.where("value is not null").select("name", F.col("value").alias("new"), "better"), "name")
    inf = F.lit(float("inf"))
    relative = F.when(F.col("old") != 0, (F.col("new") - F.col("old")) / F.abs("old")).when(F.col("new") == 0, 0.0).when(F.col("new") > 0, inf).otherwise(-inf)
    j = j.withColumn("relative", relative)
    gain = F.col("relative") * F.col("better")
    return j.select("name", "old", "new", "relative", F.when(F.col("better") == 0, "flat").when(gain < -THRESHOLD, "regressed").when(gain > THRESHOLD, "improved").otherwise("flat").alias("verdict"))


def baseline_verdict(compared: DataFrame) -> DataFrame:
    """regressed before improved before flat, and the metric that moved most; ties to the smaller name."""
    return compared.agg(
        F.when(F.max((F.col("verdict") == "regressed").cast("int")) == 1, "regressed").when(F.max((F.col("verdict") == "improved").cast("int")) == 1, "improved").otherwise("flat").alias("verdict"),
        F.min_by("name", F.struct(-F.abs("relative"), "name")).alias("biggest_mover"),
    )


def skeleton_savings(files: DataFrame) -> DataFrame:
    """Rows (level, path, before, after, saved): tokens of text and skeleton, and the share saved, of each file, each top folder and all.

    ``files``: path, text, skeleton; a null text is an empty one.  ``level`` is file, folder or all; the row of all has a null path, as a
    file may have.  Texts are measured before they are grouped, so none is copied.
    """
    tokens = lambda c: F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("long")
    each = files.select(F.substring_index("path", "/", 1).alias("folder"), "path", tokens("text").alias("before"), tokens("skeleton").alias("after"))
    level = F.when(F.grouping("path") == 0, "file").when(F.grouping("folder") == 0, "folder").otherwise("all")
    g = each.rollup("folder", "path").agg(level.alias("level"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return g.select("level", F.coalesce("path", "folder").alias("path"), "before", "after", _share(F.col("before") - F.col("after"), F.col("before")).alias("saved"))


def missing_items(expected: DataFrame, returned: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows (case_id, kind, item) that a case lacks: documents by id, all else as a substring of what it returned.

    ``expected``: case_id, kind, item; ``returned``: case_id, item; ``corpus``: case_id, said (all
    returned text of a case).
    """
    docs = expected.where("kind = 'doc'").join(returned.select("case_id", "item"), ["case_id", "item"], "left_anti").select("case_id", "kind", "item")
    rest = expected.where("kind <> 'doc'").join(corpus, "case_id", "left").where(~F.contains(F.lower(F.coalesce("said", F.lit(""))), F.lower("item"))).select("case_id", "kind", "item")
    return docs.unionAll(rest)


def case_success(cases: DataFrame, missing: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, succeeded): no document missing, no failed step, no error event.  ``cases``: case_id, failed_steps."""
    lost = missing.where("kind = 'doc'").select("case_id", F.lit(True).alias("lost")).distinct()
    bad = events.where("status = 'error'").select("case_id", F.lit(True).alias("bad")).distinct()
    j = cases.join(lost, "case_id", "left").join(bad, "case_id", "left")
    return j.select("case_id", (F.col("lost").isNull() & F.col("bad").isNull() & (F.col("failed_steps") == 0)).alias("succeeded"))


def claim_support(claims: DataFrame) -> DataFrame:
    """By case: claims, and those with an evidence id that wasn't returned.  ``claims``: case_id, evidence_ids, returned_ids."""
    return claims.groupBy("case_id").agg(F.count("*").alias("claims"), F.count_if(F.size(F.array_except("evidence_ids", "returned_ids")) > 0).alias("unsupported"))
