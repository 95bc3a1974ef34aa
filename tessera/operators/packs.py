"""Evidence cards, packs and task context for tables of requests, and replays of their budgets."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access, text
from ..sources.written import written
from . import registry

CARDS, OVERSAMPLE = 5, 4
NEAR_DUPLICATE = 0.90
# Confidence tiers from low to high.
TIERS = ("interpreted", "deterministic", "ground_truth")


def admits_floor(tier: Column, floor: str) -> Column:
    rank = lambda t: F.array_position(F.array(*map(F.lit, TIERS)), t)
    return rank(tier) >= rank(F.lit(floor))


def current_symbols(artifacts: DataFrame, seq: int) -> DataFrame:
    """Titles of member code artifacts."""
    return artifacts.where(access.member(seq) & F.col("artifact_type").isin("code_symbol", "code_file", "endpoint") & F.col("title").isNotNull()).select(F.col("title").alias("symbol")).distinct()


def stale_docs(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(artifact_id) of documents that name a symbol in backticks that no member code has; ``docs``: artifact_id, title, body_text."""
    refs = F.array_distinct(F.concat(text.referenced_symbols(F.col("body_text")), text.referenced_symbols(F.col("title"))))
    return docs.select("artifact_id", F.explode(refs).alias("symbol")).join(symbols, "symbol", "left_anti").select("artifact_id").distinct()


def hydrated(hits: DataFrame, artifacts: DataFrame, sources: DataFrame, queries: DataFrame, seq: int) -> DataFrame:
    """Hits with their member artifact's and source's columns, for requesters who may see them.

    ``queries``: query_id, intent, teams (what the requester is in).
    """
    a = artifacts.where(access.member(seq)).select("artifact_id", "source_id", "artifact_type", "title", "body_text", "search_text", "knowledge_kind", "authority_score", "centrality_score", "invalidated_at_seq")
    s = sources.select("source_id", "source_type", "source_uri", "path", "acl_teams", "is_deleted")
    h = hits.join(a, "artifact_id").join(s, "source_id").join(queries.select("query_id", "intent", "teams"), "query_id")
    return h.where((F.size("acl_teams") == 0) | F.arrays_overlap("acl_teams", "teams"))


def suppressed(hits: DataFrame, artifacts: DataFrame, sources: DataFrame, queries: DataFrame, seq: int) -> DataFrame:
    """(query_id, artifact_id) of hits on members that their requester may not see: for the audit, never for the answer."""
    a = artifacts.where(access.member(seq)).select("artifact_id", "source_id")
    h = hits.join(a, "artifact_id").join(sources.select("source_id", "acl_teams"), "source_id").join(queries.select("query_id", "teams"), "query_id")
    return h.where((F.size("acl_teams") > 0) & ~F.arrays_overlap("acl_teams", "teams")).select("query_id", "artifact_id")


def ranked(hits: DataFrame, stale: DataFrame) -> DataFrame:
    """Hydrated hits with relevance and place, best first: source-backed, authority, weighted score, id, all descending."""
    kind = access.source_kind(F.col("source_type"), F.col("artifact_type"))
    h = hits.join(stale.select("artifact_id", F.lit(True).alias("_stale")), "artifact_id", "left").withColumn("source_kind", kind)
    h = h.withColumn("stale", F.coalesce("_stale", F.lit(False)) & (F.col("source_kind") == "doc") & F.col("intent").isin("how_does_x_work", "what_calls_x"))
    old = F.col("is_deleted") | F.col("invalidated_at_seq").isNotNull()
    weight = access.temporal_weight(F.col("intent"), F.col("source_kind"), old, F.col("stale"))
    h = h.withColumns({"superseded": old, "final": F.round(F.col("score") * weight * (1 + 0.25 * F.coalesce("centrality_score", F.lit(0.0))), 6)})
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(F.col("knowledge_kind") == "source_backed", F.lit(False))), F.desc(F.coalesce("authority_score", F.lit(0.0))), F.desc("final"), F.desc("artifact_id"))
    return h.withColumn("place", F.row_number().over(w)).drop("_stale")


def dedupe_text() -> Column:
    """What an agent sees of a card: title and first line, normalised."""
    return text.normalize_query(F.concat_ws(" ", F.coalesce("title", "artifact_id"), text.card_summary(F.col("body_text"))))


def term_counts(said: Column) -> Column:
    """How often each token stands in a text, as a map."""
    tokens = F.filter(F.split(said, " "), lambda t: t != "")
    return F.map_from_entries(F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.size(F.filter(tokens, lambda x: x == t)).cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Of two maps of counts; 0 where one is empty."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.transform(F.map_keys(a), lambda t: F.element_at(a, t) * F.coalesce(F.element_at(b, t), F.lit(0.0))))
    norm = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda x: x * x)))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def collapse_near_dupes(rows: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Rows (query_id, artifact_id, kept_id): each ranked hit and the better one that stands for it, itself if kept.

    ``rows``: query_id, artifact_id, place, dedupe.  A greedy fold over a query's hits in order of place, which
    the search bounds to its over-fetch: a hit is kept unless it is like one that was kept.
    """
    one = F.struct("place", "artifact_id", term_counts(F.col("dedupe")).alias("terms"))
    # Maps can't be compared, so the array is sorted by places and ids alone.
    before = lambda a, b: F.when(F.struct(a["place"], a["artifact_id"]) < F.struct(b["place"], b["artifact_id"]), -1).when(F.struct(a["place"], a["artifact_id"]) > F.struct(b["place"], b["artifact_id"]), 1).otherwise(0)
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one), before).alias("hits"))
    none = F.expr("CAST(array() AS array<struct<artifact_id: string, kept_id: string, terms: map<string, double>>>)")

    def fold(seen: Column, r: Column) -> Column:
        like = F.filter(seen, lambda k: (k["artifact_id"] == k["kept_id"]) & (cosine(k["terms"], r["terms"]) >= threshold))
        kept = F.coalesce(F.get(like, 0)["artifact_id"], r["artifact_id"])
        return F.concat(seen, F.array(F.struct(r["artifact_id"].alias("artifact_id"), kept.alias("kept_id"), r["terms"].alias("terms"))))

    return each.select("query_id", F.explode(F.aggregate("hits", none, fold)).alias("h")).select("query_id", "h.artifact_id", "h.kept_id")


def cards(rows: DataFrame) -> DataFrame:
    """Card columns of ranked hits."""
    confidence = F.when(F.col("knowledge_kind") == "source_backed", 1.0).otherwise(0.5)
    summary = text.card_summary(F.col("body_text"))
    title = F.coalesce("title", "artifact_id")
    return rows.select(
        "query_id", "place", "artifact_id", F.col("artifact_type").alias("card_type"), title.alias("title"), summary.alias("summary"),
        text.display_citation(F.col("source_uri"), F.col("title"), F.col("artifact_type"), F.col("artifact_id")).alias("citation"), confidence.alias("confidence"),
        F.least(F.greatest(F.coalesce("authority_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("authority"), text.estimate_tokens(F.coalesce("body_text", F.lit(""))).alias("tokens_if_expanded"),
        text.estimate_tokens(F.concat(title, summary)).alias("tokens"), F.array_join(text.scan_injection(title, summary), ",").alias("injection_signals"), "source_kind", "superseded", "stale",
    )


def retrieve_cards(queries: DataFrame, artifacts: DataFrame, sources: DataFrame, seq: int, top: int = CARDS) -> DataFrame:
    """Cards of each query: search wider than the cap, what the requester may see, ranked, near copies collapsed, the first ``top``."""
    hits = registry.keyword_search(queries, artifacts, seq, top * OVERSAMPLE).select("query_id", "artifact_id", "score")
    docs = artifacts.where(access.member(seq)).select("artifact_id", "title", "body_text")
    stale = stale_docs(docs.join(hits.select("artifact_id").distinct(), "artifact_id", "left_semi"), current_symbols(artifacts, seq))
    r = written(ranked(hydrated(hits, artifacts, sources, queries, seq), stale), "ranked")
    kept = collapse_near_dupes(r.withColumn("dedupe", dedupe_text())).where("artifact_id = kept_id").select("query_id", "artifact_id")
    c = cards(r.join(kept, ["query_id", "artifact_id"]))
    w = Window.partitionBy("query_id").orderBy("place")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def kb_search(cards_: DataFrame, bodies: DataFrame) -> DataFrame:
    """Search hits of cards with a snippet and its cost; ``bodies``: artifact_id, body_text, search_text."""
    h = cards_.join(bodies, "artifact_id").withColumn("snippet", text.snippet(F.col("body_text"), F.col("search_text")))
    return h.select("query_id", "place", "artifact_id", "title", "citation", "snippet", text.estimate_tokens(F.concat("title", "citation", "snippet")).alias("tokens"))


def create_pack(cards_: DataFrame, budget: int) -> DataFrame:
    """The leading cards of each query whose tokens fit the budget."""
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cards_.withColumn("spent", F.sum("tokens").over(w)).where(F.col("spent") <= budget)


def read_pack(pack: DataFrame, acl: DataFrame, readers: DataFrame, most: int = 50) -> DataFrame:
    """A pack's cards for its readers: (reader, query_id, place, artifact_id), filtered again by what each reader may see.

    ``acl``: artifact_id, acl_teams; ``readers``: reader, query_id, teams.
    """
    j = pack.join(acl.select("artifact_id", "acl_teams"), "artifact_id").join(readers, "query_id").where((F.size("acl_teams") == 0) | F.arrays_overlap("acl_teams", "teams"))
    w = Window.partitionBy("reader", "query_id").orderBy("place")
    return j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("reader", "query_id", F.col("r").alias("place"), "artifact_id")


def replayed(rows: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple], schema: str) -> DataFrame:
    """An ordered fold for each value of ``by`` over a stream of its sorted rows: one row out for each row in.

    ``step(state, row)`` changes the state that ``start`` made and returns the row's result.  Only the state of one value is
    held, and no group is gathered.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                key = getattr(r, by)
                if state is None or key != at:
                    at, state = key, start()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def open_evidence(requests: DataFrame, artifacts: DataFrame, run_budget: int, agent_budget: int) -> DataFrame:
    """Outcome and content of each opening: (request_id, status, tokens, run_left, content), in order of each run.

    ``requests``: request_id, run_id, agent_name, created_at, artifact_id, max_tokens.  The cost is the body's, cut to
    the tokens asked for.  Two budgets are coupled: a success is charged to the run and to the agent within it; an
    opening beyond what the run has left, or else beyond the agent's allowance, is denied and charges nothing.
    Openings of unknown artifacts are left out.
    """
    content = F.substr(F.col("body"), F.lit(1), (F.col("max_tokens") * 4).cast("int"))
    j = requests.join(artifacts.select("artifact_id", F.coalesce("body_text", F.lit("")).alias("body")), "artifact_id").withColumn("content", content)
    j = written(j.withColumn("cost", text.estimate_tokens(F.col("content"))).select("request_id", "run_id", "agent_name", "created_at", "cost", "content"), "openings")

    def start() -> dict:
        return {"left": run_budget, "used": {}}

    def step(state: dict, r) -> tuple:
        used = state["used"].get(r.agent_name, 0)
        status = "denied_run" if r.cost > state["left"] else "denied_agent" if used + r.cost > agent_budget else "approved"
        if status == "approved":
            state["left"] -= r.cost
            state["used"][r.agent_name] = used + r.cost
        return r.request_id, status, state["left"]

    # Bodies take no part in the fold.
    told = replayed(j.select("request_id", "run_id", "agent_name", "created_at", "cost"), "run_id", ["created_at", "request_id"], start, step, "request_id string, status string, run_left long")
    ok = F.col("status") == "approved"
    return j.join(told, "request_id").select("request_id", "status", F.when(ok, F.col("cost")).otherwise(F.lit(0)).cast("long").alias("tokens"), "run_left", F.when(ok, F.col("content")).alias("content"))


def similar_prior_changes(hits: DataFrame, artifacts: DataFrame, top: int = 3) -> DataFrame:
    """The first commits among each task's hits."""
    c = hits.join(artifacts.where("artifact_type = 'commit'").select("artifact_id"), "artifact_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query_id", "artifact_id", "place")


def conventions(hits: DataFrame, artifacts: DataFrame, terms: DataFrame, top: int = 3) -> DataFrame:
    """The first hits that aren't code and name a term of the task's scope; all that aren't code where none does.

    ``terms``: query_id, terms (lower-case words).
    """
    a = artifacts.where(~F.col("artifact_type").isin("code_file", "code_symbol", "endpoint", "commit")).select("artifact_id", F.lower(F.concat_ws(" ", "title", "body_text")).alias("said"))
    h = hits.join(a, "artifact_id").join(terms, "query_id", "left")
    h = h.withColumn("named", F.coalesce(F.exists("terms", lambda t: F.contains(F.col("said"), t)), F.lit(False)))
    h = h.withColumn("some", F.max(F.col("named").cast("int")).over(Window.partitionBy("query_id"))).where((F.col("some") == 0) | F.col("named"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return h.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query_id", "artifact_id", "place")


def resolve_scope(tasks: DataFrame, symbols: DataFrame, files: DataFrame, aliases: DataFrame, hits: DataFrame, most: int = 5, ambiguous: float = 0.8) -> DataFrame:
    """Rows (query_id, stage, artifact_id, ambiguous): what a task is about, by the first stage that says so.

    Stages: hints (a symbol's exact title or the end of a path, if one artifact alone has it), the
    alias index (``aliases``: query_id, alias, score, artifact_id; another alias of ``ambiguous`` times
    the best score with other targets makes it ambiguous), code among the hits.  ``tasks``: query_id,
    symbols, paths; ``symbols``: title, artifact_id; ``files``: path, artifact_id.
    """
    named = tasks.select("query_id", F.explode("symbols").alias("title")).join(symbols, "title").select("query_id", F.col("title").alias("hint"), "artifact_id")
    tail = F.concat(F.lit("/"), "path")
    # A hint's last segment meets the files of that name, then the whole hint must be the end.
    paths = tasks.select("query_id", F.explode("paths").alias("hint")).withColumn("name", F.substring_index("hint", "/", -1))
    ended = paths.join(files.withColumn("name", F.substring_index("path", "/", -1)), "name").where(F.endswith(tail, F.concat(F.lit("/"), "hint"))).select("query_id", "hint", "artifact_id")
    hinted = named.unionAll(ended).groupBy("query_id", "hint").agg(F.count_distinct("artifact_id").alias("n"), F.min("artifact_id").alias("artifact_id"))
    by_hint = hinted.select("query_id", F.lit(1).alias("stage"), F.when(F.col("n") == 1, F.col("artifact_id")).alias("artifact_id"), (F.col("n") > 1).alias("ambiguous"))
    best = aliases.groupBy("query_id").agg(F.max("score").alias("best"), F.max_by("alias", F.struct("score", "alias")).alias("chosen"))
    near = aliases.join(best, "query_id").where(F.col("score") >= ambiguous * F.col("best"))
    targets = near.groupBy("query_id", "alias", "chosen").agg(F.array_sort(F.collect_set("artifact_id")).alias("ids"))
    clash = targets.groupBy("query_id").agg(F.count_distinct("ids").alias("n"), F.max(F.when(F.col("alias") == F.col("chosen"), F.col("ids"))).alias("ids"))
    by_alias = clash.select("query_id", F.lit(2).alias("stage"), F.explode("ids").alias("artifact_id"), (F.col("n") > 1).alias("ambiguous"))
    w = Window.partitionBy("query_id").orderBy("rank")
    code = hits.join(symbols.select("artifact_id").union(files.select("artifact_id")).distinct(), "artifact_id", "left_semi")
    by_hit = code.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query_id", F.lit(3).alias("stage"), "artifact_id", F.lit(False).alias("ambiguous"))
    every = by_hint.unionAll(by_alias).unionAll(by_hit)
    first = every.where("artifact_id is not null").groupBy("query_id").agg(F.min("stage").alias("stage"))
    chosen = every.join(first, ["query_id", "stage"]).where("artifact_id is not null").distinct()
    r = chosen.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("artifact_id"))).where(F.col("r") <= most)
    return r.select("query_id", F.element_at(F.array(F.lit("hint"), F.lit("alias"), F.lit("search")), F.col("stage")).alias("stage"), "artifact_id", "ambiguous")


def trim_buckets(items: DataFrame, budget: int, drop_order: tuple[str, ...] = ("prior_change", "convention", "callee", "caller", "test"), tie: str = "tokens") -> DataFrame:
    """The items of each task that stay: buckets are emptied from their tails, in ``drop_order``, until the rest fits.

    ``items``: query_id, bucket, place, tokens.  An item stays if all that is dropped after it, with
    itself, fits; buckets outside ``drop_order`` always stay.  ``tie`` orders items of one place.
    """
    order = F.array_position(F.array(*map(F.lit, drop_order)), F.col("bucket"))
    i = items.withColumn("_o", F.when(order == 0, F.lit(len(drop_order) + 1)).otherwise(order))
    # From the items that are dropped last to those that are dropped first.
    w = Window.partitionBy("query_id").orderBy(F.desc("_o"), "place", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return i.withColumn("_spent", F.sum("tokens").over(w)).where((F.col("_spent") <= budget) | (F.col("_o") > len(drop_order))).drop("_o", "_spent")


def task_context(scope: DataFrame, blast: DataFrame, prior: DataFrame, rules: DataFrame, floor: str, budget: int, cost: int = 40) -> DataFrame:
    """Rows (query_id, bucket, place, artifact_id, tier, path_ref): a task's whole context within its budget.

    ``scope`` of ``resolve_scope``; ``blast`` with query_id, role, place, artifact_id, path, tier;
    ``prior`` and ``rules`` with query_id, artifact_id, place.  Items below the floor go first; prior
    changes and conventions count as interpreted.  Paths are numbered over the whole answer.
    """
    none = F.lit(None).cast("string")
    w = Window.partitionBy("query_id").orderBy("artifact_id")
    parts = [
        scope.select("query_id", F.lit("scope").alias("bucket"), F.row_number().over(w).alias("place"), "artifact_id", none.alias("path"), F.lit("ground_truth").alias("tier")),
        blast.select("query_id", F.col("role").alias("bucket"), "place", "artifact_id", "path", "tier"),
        prior.select("query_id", F.lit("prior_change").alias("bucket"), "place", "artifact_id", none.alias("path"), F.lit("interpreted").alias("tier")),
        rules.select("query_id", F.lit("convention").alias("bucket"), "place", "artifact_id", none.alias("path"), F.lit("interpreted").alias("tier")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    kept = trim_buckets(every.where(admits_floor(F.col("tier"), floor)).withColumn("tokens", F.lit(cost)), budget, tie="artifact_id")
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("path"))) - 1
    return kept.select("query_id", "bucket", "place", "artifact_id", "tier", F.when(F.col("path").isNotNull(), number).alias("path_ref"))


def kb_budget_replay(events: DataFrame, max_calls: int, max_tokens: int) -> DataFrame:
    """Rows (retrieval_id, allowed): searches of each run and agent in order, against both caps.

    A call is allowed while calls and tokens are below their caps; its tokens are charged afterwards,
    so the last may overdraw; denied calls charge nothing.  Once a cap is reached it stays reached:
    the allowed calls are a prefix, which running sums find without a fold.
    """
    w = Window.partitionBy("run_id", "agent_name").orderBy("created_at", "retrieval_id").rowsBetween(Window.unboundedPreceding, -1)
    calls, tokens = F.count("*").over(w), F.coalesce(F.sum("tokens_returned").over(w), F.lit(0))
    return events.select("retrieval_id", "run_id", "agent_name", ((calls < max_calls) & (tokens < max_tokens)).alias("allowed"))


def request_policy_replay(requests: DataFrame, max_requests: int, max_tokens: int, run_budget: int, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Rows (run_id, retrieval_id, outcome, evidence_ids, tokens): follow-up requests of each run in order.

    ``requests``: run_id, agent_name, teams, retrieval_id, created_at, query_text, asked_tokens, cards (artifact_id, tokens,
    acl_teams: what a retrieval would give this requester, best first).  In order: an equal question of the run, then
    the most similar one (cosine of token counts, ``threshold`` at least): its evidence is filtered for the new
    requester, and where nothing of it may be seen the request goes on; then the agent's number of requests, its tokens, the run's
    tokens; else it retrieves: cards that the run hasn't got yet, up to the first that no longer fits.  State is what a run
    has asked and got, which its budget bounds.
    """

    def like(a: Counter, b: Counter) -> float:
        size = math.hypot(*a.values()) * math.hypot(*b.values())
        return sum(n * b[t] for t, n in a.items()) / size if size else 0.0

    def start() -> dict:
        return {"asked": [], "had": set(), "used": {}, "left": run_budget}

    def step(s: dict, r) -> tuple:
        terms = Counter(r.normalized.split())
        teams = set(r.teams)

        def visible(evidence: list) -> list[str] | None:
            """What the requester may see; None where there is something, but nothing for them."""
            seen = [i for i, acl in evidence if not acl or teams & set(acl)]
            return seen if seen or not evidence else None

        equal = next((e for q, _, e in s["asked"] if q == r.normalized), None)
        scores = [(like(terms, c), -k, e) for k, (_, c, e) in enumerate(s["asked"])]
        close = max(((x, k, e) for x, k, e in scores if x >= threshold), key=lambda x: x[:2], default=None)
        for what, evidence in (("exact_reuse", equal), ("semantic_reuse", close and close[2])):
            if evidence is not None and (seen := visible(evidence)) is not None:
                return r.run_id, r.retrieval_id, what, seen, 0
        requests_, tokens = s["used"].get(r.agent_name, (0, 0))
        if requests_ + 1 > max_requests:
            return r.run_id, r.retrieval_id, "denied_requests", [], 0
        if tokens + r.asked_tokens > max_tokens:
            return r.run_id, r.retrieval_id, "denied_tokens", [], 0
        if r.asked_tokens > s["left"]:
            return r.run_id, r.retrieval_id, "needs_human_approval", [], 0
        got, cost = [], 0
        for card in r.cards:
            if card["artifact_id"] in s["had"]:
                continue
            if cost + card["tokens"] > r.asked_tokens:
                break
            got.append((card["artifact_id"], tuple(card["acl_teams"])))
            cost += card["tokens"]
        s["left"] -= cost
        s["used"][r.agent_name] = (requests_ + 1, tokens + cost)
        s["had"].update(i for i, _ in got)
        s["asked"].append((r.normalized, terms, got))
        return r.run_id, r.retrieval_id, "approved", [i for i, _ in got], cost

    normalized = text.normalize_query(F.coalesce("query_text", F.lit("")))
    r = requests.select("run_id", "agent_name", "teams", "retrieval_id", "created_at", "asked_tokens", "cards", normalized.alias("normalized"))
    return replayed(r, "run_id", ["created_at", "retrieval_id"], start, step, "run_id string, retrieval_id string, outcome string, evidence_ids array<string>, tokens long")
