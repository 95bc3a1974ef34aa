"""Task context as a batch: from searches to serialised answers within a budget, for a table of tasks.

A plan in two passes.  The first resolves each task's scope from its hints, the alias index and its best
hits; only tasks that it leaves without any answer go through the second, with twice the hits and any kind of
artifact.  Then come blast radius, conventions and prior changes, the confidence floor, and a trim by
the size of the answer as it is serialised: its path table holds a path once, so what an item costs
depends on what else is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.written import written
from . import graph, packs, registry

# Hits of the first and of the wider search, and the most of each kind in an answer.
SEARCH_TOP, WIDER_TOP, ENTITIES, CONVENTIONS, PRIOR, BLAST = 8, 16, 5, 3, 3, 100
AMBIGUOUS, SERVER_CAP = 0.8, 8000
CODE_TYPES = ("code_symbol", "endpoint", "code_file", "test")
GENERIC = ("src", "services", "tests", "test", "lib", "docs")
UNRESOLVED = "No entity in the knowledge base could be resolved for this task, even after a broadened search; proceed from the task and the repository's files."
CAVEAT = "call target matched by name only"
#: Buckets from the one that is emptied last to the one that is emptied first.
KEPT = ("tests", "callers", "callees", "conventions", "prior")


def task_hits(tasks: DataFrame, artifacts: DataFrame, sources: DataFrame, seq: int) -> DataFrame:
    """What each task's wider search finds and its requester may see, by rank; written."""
    hits = registry.keyword_search(tasks, artifacts, seq, WIDER_TOP).select("query_id", "artifact_id", "score", "rank")
    h = packs.hydrated(hits, artifacts, sources, tasks, seq)
    return written(h.select("query_id", "artifact_id", "score", "rank", "artifact_type", "title", "body_text", "path"), "hits")


def _first(rows: DataFrame, order: list, most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)


def resolved(tasks: DataFrame, hits: DataFrame, aliases: DataFrame, shown: DataFrame, wider: bool) -> tuple[DataFrame, DataFrame]:
    """(entities, ambiguous) of each task by the first stage that has an answer.

    entities: query_id, stage, place, artifact_id, tier; ambiguous: query_id, stage, said, candidates.  ``tasks``: query_id,
    teams, symbols, paths; ``aliases``: artifact_id, targets (ranked), tier; ``shown``: artifact_id, artifact_type, title, path,
    acl_teams of members.  A hint that several artifacts answer and comparable aliases with other targets are ambiguous.
    """
    seen = (F.size("acl_teams") == 0) | F.arrays_overlap("acl_teams", "teams")
    symbols = tasks.select("query_id", "teams", F.explode(F.array_distinct("symbols")).alias("said"))
    by_symbol = symbols.join(shown.where(F.col("artifact_type").isin("code_symbol", "endpoint")), F.col("said") == F.col("title")).where(seen)
    # A path is one thing, whichever artifacts stand for it; the file itself first.
    paths = tasks.select("query_id", "teams", F.explode(F.array_distinct("paths")).alias("said")).withColumn("name", F.substring_index("said", "/", -1))
    by_path = paths.join(shown.withColumn("name", F.substring_index("path", "/", -1)), "name").where(seen & F.endswith(F.concat(F.lit("/"), "path"), F.concat(F.lit("/"), "said")))
    by_path = by_path.groupBy("query_id", "said", "path").agg(F.min(F.struct(F.col("artifact_type") != "code_file", "artifact_id"))["artifact_id"].alias("artifact_id"))
    named = by_symbol.select("query_id", "said", "artifact_id").unionAll(by_path.select("query_id", "said", "artifact_id"))
    named = named.groupBy("query_id", "said").agg(F.array_sort(F.collect_set("artifact_id")).alias("ids"))
    one = named.where(F.size("ids") == 1).select("query_id", F.lit(1).alias("stage"), F.col("ids")[0].alias("artifact_id"), F.lit("deterministic").alias("tier"), F.lit(0).alias("at"))
    several = named.where(F.size("ids") > 1).select("query_id", F.lit(1).alias("stage"), "said", F.col("ids").alias("candidates"))
    # The alias index: the best alias hit, and others nearly as good with other targets.
    a = hits.join(aliases, "artifact_id")
    a = a.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "title", "targets", "tier"))).alias("al"))
    top = F.get("al", 0)
    other = F.filter(F.slice("al", 2, WIDER_TOP), lambda x: (x["score"] >= AMBIGUOUS * top["score"]) & (F.size(x["targets"]) > 0) & (F.array_sort(x["targets"]) != F.array_sort(top["targets"])))
    a = a.where(F.size(top["targets"]) > 0).select("query_id", top.alias("top"), other.alias("other"))
    clash = a.where(F.size("other") > 0).select("query_id", F.lit(2).alias("stage"), F.coalesce("top.title", F.lit("")).alias("said"), F.array_distinct(F.concat("top.targets", F.flatten(F.transform("other", lambda x: x["targets"])))).alias("candidates"))
    by_alias = a.where(F.size("other") == 0).select("query_id", "top.tier", F.posexplode("top.targets").alias("at", "artifact_id"))
    by_alias = by_alias.join(shown.select("artifact_id", "acl_teams"), "artifact_id").join(tasks.select("query_id", "teams"), "query_id").where(seen).select("query_id", F.lit(2).alias("stage"), "artifact_id", "tier", "at")
    kind = ~F.col("artifact_type").isin("commit") if wider else F.col("artifact_type").isin(*CODE_TYPES)
    by_hit = hits.where(kind).join(aliases.select("artifact_id"), "artifact_id", "left_anti").select("query_id", F.lit(3).alias("stage"), "artifact_id", F.lit("interpreted").alias("tier"), F.col("rank").alias("at"))
    entities = written(one.unionAll(by_alias).unionAll(by_hit), "entities")
    ambiguous = written(several.unionAll(clash), "ambiguous")
    best = entities.select("query_id", "stage").unionAll(ambiguous.select("query_id", "stage")).groupBy("query_id").agg(F.min("stage").alias("stage"))
    entities = entities.join(best, ["query_id", "stage"]).dropDuplicates(["query_id", "artifact_id"])
    entities = _first(entities, ["at", "artifact_id"], ENTITIES).select("query_id", "stage", "place", "artifact_id", "tier")
    return entities, ambiguous.join(best, ["query_id", "stage"])


def two_passes(tasks: DataFrame, hits: DataFrame, aliases: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, ambiguous, tasks that took the wider pass)."""
    entities, ambiguous = resolved(tasks, hits.where(F.col("rank") <= SEARCH_TOP), aliases, shown, wider=False)
    answered = entities.select("query_id").union(ambiguous.select("query_id")).distinct()
    rest = written(tasks.join(answered, "query_id", "left_anti"), "unresolved")
    more, unclear = resolved(rest, hits.join(rest.select("query_id"), "query_id", "left_semi"), aliases, shown, wider=True)
    return entities.unionAll(more), ambiguous.unionAll(unclear), rest.select("query_id")


def scope_terms(path: Column) -> Column:
    """Folders and stem of a path that tell where it is."""
    parts = F.split(F.lower(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")
    return F.filter(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(stem)), lambda t: (t != "") & ~t.isin(*GENERIC))


def _lists(rows: DataFrame, name: str, item: Column) -> DataFrame:
    """One array for each task, in order of place."""
    packed = rows.select("query_id", F.struct("place", item.alias("item")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: a["place"] - b["place"]).alias("x"))
    return packed.select("query_id", F.transform("x", lambda x: x["item"]).alias(name))


def _answer(kept: Column) -> Column:
    """The serialised answer with so many items of ``KEPT``'s buckets, from the first bucket on."""
    part, left = {}, kept
    for name in KEPT:
        n = F.least(left, F.size(name))
        part[name] = F.slice(name, F.lit(1), n)
        left = left - n
    blast = F.concat(part["callers"], part["callees"], part["tests"])
    paths = F.array_sort(F.array_distinct(F.transform(blast, lambda e: e["path"])))
    wire = lambda items: F.transform(items, lambda e: F.struct(e["entity_id"].alias("entity_id"), (F.array_position(paths, e["path"]) - 1).alias("path_ref"), e["symbol"].alias("symbol"), e["edge_type"].alias("edge_type"), e["confidence_tier"].alias("confidence_tier"), e["caveat"].alias("caveat")))
    evidence = F.concat(
        F.transform("entities", lambda e: e["entity_id"]), F.flatten(F.transform("ambiguous", lambda e: e["candidates"])), F.transform(blast, lambda e: e["entity_id"]),
        F.flatten(F.transform(part["conventions"], lambda e: e["evidence_ids"])), F.flatten(F.transform(part["prior"], lambda e: e["evidence_ids"])),
    )
    whole = F.struct(
        F.struct(F.col("entities").alias("entities"), F.col("ambiguous").alias("ambiguous_candidates")).alias("resolved_scope"), paths.alias("referenced_paths"),
        F.struct(wire(part["callers"]).alias("callers"), wire(part["callees"]).alias("callees"), wire(part["tests"]).alias("tests")).alias("blast_radius"),
        part["conventions"].alias("conventions"), part["prior"].alias("similar_prior_changes"), F.array_sort(F.array_distinct(evidence)).alias("evidence_ids"), F.col("questions").alias("open_questions"),
        F.struct(F.lit(0).alias("tokens"), F.col("calls").alias("calls")).alias("budget_used"),
    )
    return F.to_json(whole, {"ignoreNullFields": "false"})


def task_answers(tasks: DataFrame, artifacts: DataFrame, sources: DataFrame, edges: DataFrame, aliases: DataFrame, seq: int) -> DataFrame:
    """One answer for each task: (query_id, stage, widened, buckets' sizes, ``trimmed``, tokens, answer).

    ``tasks``: query_id, query_text, intent, teams, symbols, paths, floor, max_tokens (null: the server's cap, which no task
    exceeds).  Items are dropped from the tails, prior changes first, then conventions, callees, callers, tests, as few as make
    the serialised answer fit; scope, ambiguity and questions always stay.  Dropping an item never makes an answer
    longer, so the number to keep is found by halving.  Blast lists hold ``BLAST`` items each, so an answer is bounded.
    """
    tasks = written(tasks, "tasks")
    hits = task_hits(tasks, artifacts, sources, seq)
    member = artifacts.where(registry.access.member(seq)).select("artifact_id", "source_id", "artifact_type", "title")
    shown = written(member.join(sources.select("source_id", "path", "acl_teams"), "source_id").drop("source_id"), "shown")
    entities, ambiguous, wider = two_passes(tasks, hits, aliases, shown)
    entities, wider = written(entities, "scope"), written(wider.withColumn("widened", F.lit(True)), "widened")
    scope = entities.join(shown.select("artifact_id", "artifact_type", "title", "path"), "artifact_id")
    floor = tasks.select("query_id", "floor", "teams")
    rank = lambda t: F.array_position(F.array(*map(F.lit, packs.TIERS)), t)
    admitted = lambda rows: rows.join(floor.select("query_id", "floor"), "query_id").where(rank(F.col("tier")) >= rank(F.col("floor"))).drop("floor")
    # Blast radius of what the scope has: each task sees what it may, an edge once, the surest tier of it.
    near = graph.blast_radius(edges, entities, shown, None).select("seed", "role", "artifact_id", "path", "symbol", "edge_type", "tier")
    near = entities.select("query_id", F.col("artifact_id").alias("seed")).join(near, "seed").join(shown.select("artifact_id", "acl_teams"), "artifact_id").join(floor, "query_id")
    near = near.where((F.size("acl_teams") == 0) | F.arrays_overlap("acl_teams", "teams"))
    near = near.groupBy("query_id", "role", "artifact_id", "path", "symbol", "edge_type").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("query_id", "role").orderBy("path", F.coalesce("symbol", F.lit("")), "artifact_id", "edge_type")
    near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= BLAST)
    near = written(admitted(near), "blast")
    blast_item = F.struct(F.col("artifact_id").alias("entity_id"), "path", "symbol", "edge_type", F.col("tier").alias("confidence_tier"), F.when(F.col("tier") == "interpreted", CAVEAT).alias("caveat"))
    # Conventions: of the first hits that are neither code nor alias nor commit, those that name the scope's place, else all.
    terms = scope.select("query_id", F.explode(scope_terms(F.col("path"))).alias("t")).groupBy("query_id").agg(F.collect_set("t").alias("terms"))
    docs = hits.where((F.col("rank") <= SEARCH_TOP) & ~F.col("artifact_type").isin(*CODE_TYPES, "commit")).join(aliases.select("artifact_id"), "artifact_id", "left_anti").join(terms, "query_id", "left")
    said = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit(""))))
    docs = docs.withColumn("said", said).withColumn("named", F.coalesce(F.exists("terms", lambda t: F.contains(F.col("said"), t)), F.lit(False)))
    docs = docs.withColumn("some", F.max("named").over(Window.partitionBy("query_id"))).where(F.col("named") | ~F.col("some"))
    rules = _first(docs, ["rank"], CONVENTIONS).withColumn("tier", F.lit("interpreted"))
    rule_item = F.struct(F.coalesce("title", "path").alias("pattern"), F.array("artifact_id").alias("evidence_ids"), F.col("tier").alias("confidence_tier"))
    prior = _first(hits.where("artifact_type = 'commit'"), ["rank"], PRIOR).withColumn("tier", F.lit("interpreted"))
    prior_item = F.struct(F.coalesce("path", "artifact_id").alias("commit_or_pr_id"), F.substring(F.coalesce("title", text.card_summary(F.col("body_text"))), 1, 200).alias("summary"), F.array("artifact_id").alias("evidence_ids"))
    entity = F.struct(F.col("artifact_id").alias("entity_id"), "path", F.when(F.col("artifact_type").isin("code_symbol", "endpoint"), F.col("title")).alias("symbol"), F.element_at(F.array(*map(F.lit, ("hint", "alias_index", "search"))), F.col("stage")).alias("via"), F.col("tier").alias("confidence_tier"))
    unclear = ambiguous.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("said").alias("alias_text"), "candidates"))).alias("ambiguous"))
    lists = [_lists(admitted(scope), "entities", entity), unclear, *(_lists(near.where(F.col("role") == r), n, blast_item) for n, r in (("tests", "test"), ("callers", "caller"), ("callees", "callee")))]
    lists += [_lists(admitted(rules), "conventions", rule_item), _lists(admitted(prior), "prior", prior_item)]
    found = entities.groupBy("query_id").agg(F.min("stage").alias("stage")).unionAll(ambiguous.groupBy("query_id").agg(F.min("stage").alias("stage"))).groupBy("query_id").agg(F.min("stage").alias("stage"))
    t = tasks.select("query_id", "max_tokens").join(found, "query_id", "left").join(wider, "query_id", "left").withColumn("widened", F.coalesce("widened", F.lit(False)))
    for d in lists:
        t = t.join(d, "query_id", "left").withColumn(d.columns[1], F.coalesce(d.columns[1], F.expr(f"CAST(array() AS {d.schema[1].dataType.simpleString()})")))
    asks = F.transform("ambiguous", lambda a: F.concat(F.lit("Which '"), a["alias_text"], F.lit("' is in scope? "), F.size(a["candidates"]).cast("string"), F.lit(" candidates match.")))
    questions = F.concat(asks, F.when(F.col("stage").isNull(), F.array(F.lit(UNRESOLVED))).otherwise(F.expr("CAST(array() AS array<string>)")))
    t = t.withColumns({"questions": questions, "calls": F.when(F.col("widened"), 3).otherwise(2), "cap": F.least(F.coalesce("max_tokens", F.lit(SERVER_CAP)), F.lit(SERVER_CAP)), "items": sum((F.size(c) for c in KEPT), F.lit(0))})
    t = written(t, "tasks")
    tokens = lambda k: text.estimate_tokens(_answer(k))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        fits = tokens(middle) <= F.col("cap")
        return F.when(s["low"] >= s["high"], s).when(fits, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    rounds = F.sequence(F.lit(1), F.lit((3 * BLAST + CONVENTIONS + PRIOR).bit_length() + 1))
    kept = F.when(tokens(F.col("items")) <= F.col("cap"), F.col("items")).otherwise(F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.col("items").alias("high")), halved)["low"])
    t = written(t.withColumn("keep", kept), "kept")
    answer = _answer(F.col("keep"))
    stage = F.coalesce(F.element_at(F.array(*map(F.lit, ("hint", "alias_index", "search"))), F.col("stage")), F.lit("none"))
    return t.select("query_id", stage.alias("stage"), "widened", *(F.size(c).alias(f"n_{c}") for c in ("entities", "ambiguous", *KEPT)), (F.col("items") - F.col("keep")).alias("trimmed"), text.estimate_tokens(answer).alias("tokens"), answer.alias("answer"))
