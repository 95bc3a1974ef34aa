"""Ledger and trace analytics: aggregates, windows and budget folds over retrieval events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_query
from ..sources.written import written

NO_RUN = "-"
DEFAULT_ALLOWANCE = (1, 2500)


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b), 6)


def _is_answered() -> Column:
    return (F.col("tool_name") == "kb_search") & (F.col("status") == "approved")


def _is_thin() -> Column:
    return _is_answered() & (F.coalesce(F.size("returned_artifact_ids"), F.lit(0)) <= 1)


def _follow_up() -> Column:
    return (F.col("tool_name") == "context.request_more") & F.col("status").isin("approved", "reused")


def retrieval_health_daily(events: DataFrame) -> DataFrame:
    """Events, outcomes and their rates by day; a rate over nothing is null, thin answers count for searches only."""
    is_ = lambda s: F.col("status") == s
    g = events.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("events"),
        *(F.count_if(is_(s)).alias(n) for s, n in (("approved", "approved"), ("reused", "reused"), ("denied", "denied"), ("needs_human_approval", "needs_human_approval"), ("error", "errors"))),
        F.count_if(F.col("cache_hit")).alias("_cache_hits"),
        F.count_if(_follow_up()).alias("_follow_ups"),
        F.count_if(_follow_up() & F.col("semantic_reuse")).alias("_semantic"),
        F.count_if(_is_answered()).alias("kb_search_answered"),
        F.count_if(_is_thin()).alias("kb_search_zero_thin"),
    )
    return g.select(
        "day", "events", "approved", "reused", "denied", "needs_human_approval", "errors",
        _rate(F.col("errors"), F.col("events")).alias("error_rate"),
        _rate(F.col("reused"), F.col("reused") + F.col("approved")).alias("evidence_reuse_rate"),
        _rate(F.col("_semantic"), F.col("_follow_ups")).alias("semantic_cache_hit_rate"),
        _rate(F.col("_cache_hits"), F.col("events")).alias("cache_hit_rate"),
        "kb_search_answered", "kb_search_zero_thin",
        _rate(F.col("kb_search_zero_thin"), F.col("kb_search_answered")).alias("kb_search_zero_thin_rate"),
    )


def token_economics_daily(events: DataFrame) -> DataFrame:
    """Runs, agents and tokens by day; tokens per run leave out rows without a run."""
    in_run = F.col("run_id") != NO_RUN
    tokens = F.coalesce("tokens_returned", F.lit(0))
    g = events.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count_distinct(F.when(in_run, F.col("run_id"))).alias("runs"), F.count_distinct("agent_name").alias("agents"), F.count("*").alias("events"),
        F.sum(tokens).alias("tokens_charged"), F.coalesce(F.sum(F.when(in_run, tokens)), F.lit(0)).alias("_run_tokens"),
    )
    return g.withColumns({
        "context_tokens_per_run": _rate(F.col("_run_tokens"), F.col("runs")), "retrieval_calls_per_agent": _rate(F.col("events"), F.col("agents"))
    }).drop("_run_tokens")


def budget_adherence(events: DataFrame, allowances: DataFrame, run_budget: int = 18_000) -> DataFrame:
    """By run and agent: charged follow-ups against the agent's allowance, all tokens of the run against its budget.

    ``allowances`` is a table of roles, whose size is checked before it goes to all tasks.
    """
    e = events.where(F.col("run_id") != NO_RUN)
    by_agent = e.groupBy("run_id", "agent_name").agg(
        F.count("*").alias("events"), F.sum(F.coalesce("tokens_returned", F.lit(0))).alias("tokens_charged"), F.count_if(_follow_up()).alias("follow_up_requests"),
        F.coalesce(F.sum(F.when(_follow_up(), F.col("tokens_returned"))), F.lit(0)).alias("follow_up_tokens"),
    )
    by_run = by_agent.groupBy("run_id").agg(F.sum("tokens_charged").alias("run_tokens"))
    small = F.broadcast(allowances) if allowances.count() <= 10_000 else allowances
    a = by_agent.join(small, "agent_name", "left").join(by_run, "run_id")
    most, most_tokens = (F.coalesce(c, F.lit(d)) for c, d in zip(("max_requests", "max_tokens"), DEFAULT_ALLOWANCE, strict=True))
    return a.select(
        "run_id", "agent_name", "events", "tokens_charged", "run_tokens", (F.col("run_tokens") > run_budget).alias("over_run_budget"), "follow_up_requests", "follow_up_tokens",
        most.cast("long").alias("agent_max_requests"), most_tokens.cast("long").alias("agent_max_tokens"),
        (F.col("follow_up_requests") > most).alias("over_agent_requests"), (F.col("follow_up_tokens") > most_tokens).alias("over_agent_tokens"),
    )


def budget_breaches(adherence: DataFrame, top: int = 50) -> DataFrame:
    """The breaches of the runs with most tokens: a report of ``top`` rows."""
    return adherence.where("over_run_budget or over_agent_requests or over_agent_tokens").orderBy(F.desc("run_tokens"), "run_id", "agent_name").limit(top)


def budget_totals(adherence: DataFrame) -> DataFrame:
    over = F.col("over_agent_requests") | F.col("over_agent_tokens")
    return adherence.agg(
        F.count("*").alias("pairs"), F.count_distinct("run_id").alias("runs"), F.count_distinct(F.when(F.col("over_run_budget"), F.col("run_id"))).alias("runs_over_budget"), F.count_if(over).alias("agents_over_allowance")
    )


def summary_tiles(events: DataFrame, runs: DataFrame, days: int = 7) -> DataFrame:
    """Sums, rates and states over the last rows of the daily tables, as many as ``days``."""
    latest = lambda d: d.orderBy(F.desc("day")).limit(days)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    t = latest(health_with_builds(events, runs)).agg(*map(total, ("events", "approved", "reused", "errors", "kb_search_answered", "kb_search_zero_thin", "ledger_mined", "ledger_unresolved")))
    t = t.crossJoin(latest(token_economics_daily(events)).agg(total("tokens_charged")))
    t = t.withColumns({
        "error_rate": _rate(F.col("errors"), F.col("events")),
        "evidence_reuse_rate": _rate(F.col("reused"), F.col("reused") + F.col("approved")),
        "gap_rate": _rate(F.col("kb_search_zero_thin"), F.col("kb_search_answered")),
        "ledger_mined_rate": _rate(F.col("ledger_mined"), F.col("ledger_mined") + F.col("ledger_unresolved")),
    })
    state = lambda c, warn, bad: F.when(F.col(c) >= bad, "bad").when(F.col(c) >= warn, "warn").otherwise("ok")
    return t.withColumns({"error_state": state("error_rate", 0.01, 0.05), "gap_state": state("gap_rate", 0.2, 0.5), "ledger_state": F.when(F.col("ledger_unresolved") == 0, "ok").otherwise("warn")})


def tokens_by_agent_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("created_at").alias("day"), "agent_name").agg(F.count("*").alias("calls"), F.sum("tokens_returned").alias("tokens"))


def latest_calls(events: DataFrame, top: int = 20) -> DataFrame:
    """The last calls: a report of ``top`` rows."""
    return events.orderBy(F.desc("created_at"), F.desc("retrieval_id")).limit(top).select("retrieval_id", "created_at", "agent_name", "tool_name", "status", "tokens_returned")


def gap_rows(events: DataFrame) -> DataFrame:
    """Answered searches that found one item at most."""
    return events.where(_is_thin()).select("retrieval_id", "created_at", "query_text", F.size("returned_artifact_ids").alias("found"))


def refusals(events: DataFrame) -> DataFrame:
    return events.where(F.col("status").isin("denied", "needs_human_approval")).groupBy("agent_name", "tool_name").agg(F.count("*").alias("refusals"))


def miss_groups(events: DataFrame, days: int = 14) -> DataFrame:
    """Searches of the last days that found one item at most, by normalised phrase.

    Control characters become spaces and the text is cut before it is normalised.  Rows with an empty
    phrase are left out of the groups but counted in ``misses_seen``, which every row carries.
    """
    last = events.agg(F.max("created_at").alias("now"))
    phrase = normalize_query(F.substring(F.regexp_replace("query_text", "[\\x00-\\x1f\\x7f]", " "), 1, 80))
    e = events.crossJoin(F.broadcast(last)).where(_is_thin() & (F.col("created_at") >= F.col("now") - F.make_dt_interval(F.lit(days))))
    g = e.groupBy(F.coalesce(phrase, F.lit("")).alias("phrase")).agg(
        F.count("*").alias("misses"), F.count_distinct(F.to_date("created_at")).alias("days"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )
    seen = g.agg(F.sum("misses").alias("misses_seen"))
    return g.where("phrase <> ''").crossJoin(F.broadcast(seen))


def per_agent_calls(events: DataFrame) -> DataFrame:
    return events.groupBy("agent_name").agg(F.count("*").alias("calls"))


def latency_percentiles(spans: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles of good spans by name: the value at half-even round(p * (n - 1)) in order.

    Spans are counted by name and duration first, so the window sees each duration of a name once.
    """
    w = Window.partitionBy("name")
    s = spans.where("status <> 'error'").groupBy("name", "duration_ms").agg(F.count("*").alias("c"))
    r = s.withColumns({"upto": F.sum("c").over(w.orderBy("duration_ms")), "n": F.sum("c").over(w)})
    at = lambda p: F.bround(F.lit(p) * (F.col("n") - 1))
    pick = lambda p: F.max(F.when((F.col("upto") > at(p)) & (F.col("upto") - F.col("c") <= at(p)), F.col("duration_ms"))).alias(f"p{round(p * 100)}")
    return r.groupBy("name").agg(*map(pick, shares))


def span_stats(spans: DataFrame, days: int = 7) -> DataFrame:
    """Count, mean and longest by name over the last days before the last span, most frequent first."""
    last = spans.agg(F.max("started_at").alias("now"))
    recent = spans.crossJoin(F.broadcast(last)).where(F.col("started_at") >= F.col("now") - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("name").agg(F.count("*").alias("spans"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.max("duration_ms").alias("max_ms")).orderBy(F.desc("spans"), "name")


def trace_waterfall(spans: DataFrame) -> DataFrame:
    """Spans of each trace in order, with the offset from the first and the depth by parent.

    Each round doubles the way that a span has looked up, so a chain of n spans takes log2(n) rounds.  A
    span without a parent in its trace has depth 0.  Spans that come to no such span, since their parents
    go round in a circle, have depth -1.
    """
    w = Window.partitionBy("trace_id").orderBy("started_at", "span_id")
    first = F.first("started_at").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = spans.select("trace_id", "span_id", "parent_span_id", F.row_number().over(w).cast("long").alias("position"), (F.unix_micros("started_at") - F.unix_micros(first)).alias("offset_us"))
    s = written(s, "spans")
    known = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known")).distinct()
    way = s.join(known, ["trace_id", "parent_span_id"], "left").select("trace_id", "span_id", F.when(F.col("known"), F.col("parent_span_id")).alias("up"), F.col("known").isNotNull().cast("long").alias("depth"))
    way = written(way, "way")
    # A way longer than the largest trace is a circle.
    longest, length = (way.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0), 1
    while length <= longest and not way.where("up IS NOT NULL").isEmpty():
        next_ = way.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        way = written(way.join(next_, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "way")
        length *= 2
    depth = F.when(F.col("up").isNull(), F.col("depth")).otherwise(-1)
    return s.join(way.withColumn("depth", depth), ["trace_id", "span_id"]).select("trace_id", "span_id", "position", "offset_us", F.col("depth").cast("int").alias("depth"))


def timeline(events: DataFrame) -> DataFrame:
    """Rows of each run in order with the time since its first."""
    w = Window.partitionBy("run_id").orderBy("created_at", "retrieval_id")
    first = F.first("created_at").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.where(F.col("run_id") != NO_RUN).select(
        "run_id", "retrieval_id", F.row_number().over(w).cast("long").alias("position"), (F.unix_micros("created_at") - F.unix_micros(first)).alias("elapsed_us"),
        F.concat_ws(" ", "tool_name", "status").alias("headline"),
    )


def evidence_ids(events: DataFrame) -> Column:
    """The different ids that a row delivered, in its three lists."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(F.col(c), none) for c in ("returned_artifact_ids", "reused_evidence_ids", "new_evidence_ids"))))


def duplicate_tokens(events: DataFrame) -> DataFrame:
    """Tokens of approved calls whose ids had all been delivered before in their run.

    Opened evidence and cards are told apart: the first opening of a carded id isn't a repeat.  Cards
    count as delivered whatever the status, opened evidence when approved.  A join with first
    deliveries stands in for the lists of all ids before each row.
    """
    opened = F.col("tool_name") == "context.open_evidence"
    e = events.where(F.col("run_id") != NO_RUN).select("run_id", "retrieval_id", "created_at", "status", "tokens_returned", opened.alias("opened"), evidence_ids(events).alias("ids"))
    each = e.select("run_id", "retrieval_id", "created_at", "status", "opened", F.explode("ids").alias("id"))
    given = each.where(~F.col("opened") | (F.col("status") == "approved"))
    firsts = given.groupBy("run_id", "opened", "id").agg(F.min(F.struct("created_at", "retrieval_id")).alias("first"))
    fresh = each.join(firsts, ["run_id", "opened", "id"], "left").where(F.coalesce(F.struct("created_at", "retrieval_id") <= F.col("first"), F.lit(True))).select("run_id", "retrieval_id").distinct()
    old = e.where((F.col("status") == "approved") & (F.col("tokens_returned") > 0) & (F.size("ids") > 0)).join(fresh, ["run_id", "retrieval_id"], "left_anti")
    return old.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("tokens_returned").alias("tokens"))


def retrieved_by(events: DataFrame, agent: str | None = None) -> DataFrame:
    """Distinct ids that each agent was given, in any of the three lists; of one agent where it is named."""
    e = events if agent is None else events.where(F.col("agent_name") == agent)
    return e.select("agent_name", F.explode(evidence_ids(events)).alias("artifact_id")).distinct()


def ledger_list(events: DataFrame, run_id: str, agent: str) -> DataFrame:
    """One agent's own rows of a run, in order of time."""
    return events.where((F.col("run_id") == run_id) & (F.col("agent_name") == agent)).orderBy("created_at", "retrieval_id")


def budget_prefix(cards: DataFrame, budget: int, group: str = "run_id", order: tuple = ("created_at", "retrieval_id"), tokens: str = "tokens_returned", cap: int | None = None) -> DataFrame:
    """The leading rows of each group, ``cap`` at most where given, whose running sum of tokens fits."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = cards.withColumns({"spent": F.sum(tokens).over(w), "_n": F.count("*").over(w)}).where(F.col("spent") <= budget)
    return (fits if cap is None else fits.where(F.col("_n") <= cap)).drop("_n")


def budget_skip(items: DataFrame, budget: int, group: str = "run_id", order: tuple = ("created_at", "retrieval_id"), tokens: str = "tokens_returned", cap: int | None = None) -> DataFrame:
    """The items of each group that a greedy pass keeps: one that doesn't fit is skipped, later ones may fit.

    A fold over the group's sorted items; an item carries only its order and cost, and the stated
    groups (the dependencies of one task) are short.
    """
    key = F.struct(*order)
    g = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(key.alias("at"), F.col(tokens).alias("cost")))).alias("items"))
    first = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(g.schema["items"].dataType).alias("kept"))
    fits = lambda a, x: (a["spent"] + x["cost"] <= budget) & (F.lit(True) if cap is None else F.size(a["kept"]) < cap)
    take = lambda a, x: F.when(fits(a, x), F.struct((a["spent"] + x["cost"]).alias("spent"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    kept = g.select(group, F.explode(F.aggregate("items", first, take)["kept"]).alias("x"))
    return kept.select(group, "x.at.*", F.col("x.cost").alias(tokens))


def expired(events: DataFrame, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(counts of rows beyond retention and kept, the rows that stay), against the last row's time."""
    last = events.agg(F.max("created_at").alias("now"))
    old = F.col("created_at") < F.col("now") - F.make_dt_interval(F.lit(days))
    marked = events.crossJoin(F.broadcast(last)).withColumn("_old", old)
    return marked.agg(F.count_if("_old").alias("expired"), F.count_if(~F.col("_old")).alias("kept")), marked.where("not _old").drop("_old", "now")


def older_than(events: DataFrame, days: int = 20) -> DataFrame:
    """Counts of rows beyond retention and kept."""
    return expired(events, days)[0]


def build_health(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Duration and calls of each build; ``now`` gives the active build's age, the last completion where left out."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1_000_000
    end = F.coalesce("completed_at", "started_at")
    if now is None:
        runs = runs.crossJoin(F.broadcast(runs.agg(F.max(end).alias("_now"))))
        now = F.col("_now")
    return runs.select(
        "kb_version", "build_seq", "status", F.round(seconds(F.col("started_at"), F.col("completed_at")), 6).alias("duration_seconds"), "sources_seen", "sources_changed",
        _rate(F.col("model_calls"), F.nullif(F.col("sources_changed"), F.lit(0))).alias("llm_calls_per_changed_source"),
        _rate(F.col("embedding_calls"), F.nullif(F.col("sources_changed"), F.lit(0))).alias("embedding_calls_per_changed_source"),
        (F.col("status") == "active").alias("is_active"), F.when(F.col("status") == "active", F.round(seconds(end, now), 6)).alias("active_kb_age_seconds"),
    )


def health_with_builds(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Daily health beside what the day's builds mined from the ledger."""
    by_day = runs.groupBy(F.to_date("started_at").alias("day")).agg(F.sum("ledger_mining_mined").alias("m"), F.sum("ledger_mining_unresolved").alias("u"))
    d = retrieval_health_daily(events).join(by_day, "day", "left")
    d = d.withColumns({"ledger_mined": F.coalesce("m", F.lit(0)), "ledger_unresolved": F.coalesce("u", F.lit(0))}).drop("m", "u")
    return d.withColumn("ledger_mined_rate", _rate(F.col("ledger_mined"), F.col("ledger_mined") + F.col("ledger_unresolved")))


def build_log(runs: DataFrame, top: int = 10) -> DataFrame:
    """The latest builds with their outcome: a report of ``top`` rows."""
    failed = F.col("status") == "validation_failed"
    return runs.orderBy(F.desc("build_seq")).limit(top).select("kb_version", "build_seq", "status", failed.alias("failed"), "failed_gate")


def eval_metrics(records: DataFrame, events: DataFrame) -> DataFrame:
    """Seven measured ratios in one row; a ratio over nothing is null.

    ``records``: run_id, succeeded, expected_items, missing_items, total_claims, unsupported_claims.
    """
    tokens = events.groupBy("run_id").agg(F.sum("tokens_returned").alias("t"))
    r = records.join(tokens, "run_id", "left").agg(
        _rate(F.sum(F.when(F.col("succeeded"), F.coalesce("t", F.lit(0)))), F.count_if("succeeded")).alias("context_tokens_per_successful_task"),
        _rate(F.sum("unsupported_claims"), F.sum("total_claims")).alias("unsupported_claim_rate"),
        _rate(F.sum("missing_items"), F.sum("expected_items")).alias("missing_context_rate"),
    )
    ours = events.join(records.select("run_id").distinct(), "run_id", "left_semi")
    e = ours.agg(
        _rate(F.count_if(F.col("status") == "reused"), F.count_if(F.col("status").isin("reused", "approved"))).alias("evidence_reuse_rate"),
        _rate(F.count("*"), F.count_distinct("agent_name")).alias("retrieval_calls_per_agent"),
        _rate(F.count_if(_follow_up() & F.col("semantic_reuse")), F.count_if(_follow_up())).alias("semantic_cache_hit_rate"),
    )
    d = duplicate_tokens(ours).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("duplicate_context_tokens"))
    return r.crossJoin(e).crossJoin(d)
