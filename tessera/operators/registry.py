"""Registry operators: membership, access, versioning, reconciliation, graph and retrieval joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access, text
from ..sources.written import written
from .matching import is_small, runs_holding, runs_of
from .numbering import numbered
from .scan import best_scores, frequencies, scanned_hits

#: Rounds of pagerank between two written tables.
STEP = 2
#: Rows of query tokens that go to all tasks at a time.
PART = 2_000_000


def members(artifacts: DataFrame, seq: int) -> DataFrame:
    return artifacts.where(access.member(seq))


def artifact_census(artifacts: DataFrame, seq: int) -> DataFrame:
    live = F.coalesce(access.member(seq), F.lit(False))
    return artifacts.groupBy("artifact_type").agg(F.count("*").alias("total"), F.count_if(live).alias("served"), F.count_if(F.col("invalidated_at_seq") <= seq).alias("invalidated"))


def per_source_type(artifacts: DataFrame, sources: DataFrame, seq: int) -> DataFrame:
    """By type of source: sources, those deleted, and the artifacts that are served and that there are."""
    a = artifacts.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(access.member(seq)).alias("m"))
    j = sources.join(a, "source_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("source_type").agg(F.count("*").alias("sources"), F.count_if("is_deleted").alias("deleted"), total("m").alias("served"), total("n").alias("artifacts"))


def invalidated_by_build(artifacts: DataFrame) -> DataFrame:
    return artifacts.where("invalidated_at_seq is not null").groupBy(F.col("invalidated_at_seq").cast("long").alias("build_seq"), "artifact_type").agg(F.count("*").alias("invalidated"))


def edge_census(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type", "trust_class").agg(F.count("*").alias("edges"))


def visible_sources(sources: DataFrame, teams: list[str]) -> DataFrame:
    return sources.where(access.visible(F.col("acl_teams"), teams))


def acl_by_repo(sources: DataFrame) -> DataFrame:
    """The strictest access over all of a repository's sources: bounded by the number of different lists."""
    g = sources.groupBy("repo").agg(F.collect_set("acl_teams").alias("lists"))
    return g.select("repo", access.strictest(F.col("lists")).alias("acl_teams"))


def edge_acl(edges: DataFrame, artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Access to an edge: what both ends allow."""
    acl = artifacts.join(sources.select("source_id", "acl_teams"), "source_id").select("artifact_id", "acl_teams")
    a = edges.join(acl.select(F.col("artifact_id").alias("from_artifact_id"), F.col("acl_teams").alias("a")), "from_artifact_id")
    a = a.join(acl.select(F.col("artifact_id").alias("to_artifact_id"), F.col("acl_teams").alias("b")), "to_artifact_id")
    return a.select("from_artifact_id", "to_artifact_id", F.array_join(access.strictest(F.array("a", "b")), ",").alias("acl"))


def classify_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """unchanged, changed, new or vanished by (source_type, source_uri)."""
    keys = ["source_type", "source_uri"]
    j = before.select(*keys, F.col("content_hash").alias("old")).join(after.select(*keys, F.col("content_hash").alias("new")), keys, "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "vanished").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return j.select(*keys, state.alias("state"))


def cache_gate(inputs: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inputs that the cache answers, inputs to compute)."""
    return inputs.join(cache.select(key).distinct(), key, "left_semi"), inputs.join(cache.select(key), key, "left_anti")


def vanished(sources: DataFrame, seen: DataFrame, started_min: int) -> DataFrame:
    """Live sources that a build didn't see, though they were recorded before it began."""
    gone = sources.where(~F.col("is_deleted")).join(seen.select("source_id"), "source_id", "left_anti")
    return gone.select("source_id", (F.col("last_seen_min") < started_min).alias("swept"))


def detect_renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """One-to-one pairs of equal content, in order of id on both sides."""
    by_hash = lambda d, n: numbered(d.select(F.col("artifact_id").alias(n), "content_hash"), "content_hash", n)
    return by_hash(gone, "old_id").join(by_hash(new, "new_id"), ["content_hash", "r"]).select("old_id", "new_id")


def reconcile_edges(live: DataFrame, desired: DataFrame) -> DataFrame:
    """insert, refresh or invalidate by (from, to, type)."""
    keys = ["from_artifact_id", "to_artifact_id", "edge_type"]
    j = live.select(*keys, F.lit(True).alias("l")).join(desired.select(*keys, F.lit(True).alias("d")), keys, "full")
    return j.select(*keys, F.when(F.col("l").isNull(), "insert").when(F.col("d").isNull(), "invalidate").otherwise("refresh").alias("action"))


def reconcile_source_edges(live: DataFrame, desired: DataFrame, source: str, seq: int, protected: tuple[str, ...] = ()) -> DataFrame:
    """The edges of one source after a run that wants ``desired`` (from, to, type, evidence), with what became of each.

    New ones are inserted from ``seq`` on; wanted ones are refreshed: their first version stays and an
    end of validity is taken back; live ones that aren't wanted leave at ``seq``, but not those of a
    protected type without evidence.  Edges of other sources aren't touched.
    """
    keys = ["from_artifact_id", "to_artifact_id", "edge_type"]
    own = live.where(F.col("source") == source).select(*keys, F.col("evidence").alias("old"), "valid_from_seq", "invalidated_at_seq", F.lit(True).alias("had"))
    j = own.join(desired.select(*keys, F.col("evidence").alias("new"), F.lit(True).alias("wanted")), keys, "full")
    shielded = F.col("edge_type").isin(*protected) & F.col("old").isNull() if protected else F.lit(False)
    leave = F.col("invalidated_at_seq").isNull() & ~shielded
    action = F.when(F.col("had").isNull(), "insert").when(F.col("wanted"), "refresh").when(leave, "invalidate").otherwise("keep")
    j = j.withColumn("action", action)
    ends = F.when(F.col("action") == "invalidate", F.lit(seq)).when(F.col("action") == "keep", F.col("invalidated_at_seq"))
    return j.select(*keys, "action", F.coalesce("new", "old").alias("evidence"), F.coalesce(F.col("valid_from_seq").cast("long"), F.lit(seq).cast("long")).alias("valid_from_seq"), ends.cast("long").alias("invalidated_at_seq"))


def index_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """missing, orphaned or drifted documents; equal ones are left out."""
    j = expected.select("source_id", F.col("content_hash").alias("e")).join(actual.select("source_id", F.col("content_hash").alias("a")), "source_id", "full")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "orphaned").when(F.col("e") != F.col("a"), "drifted")
    return j.select("source_id", state.alias("state")).where("state is not null")


def ghost_edges(edges: DataFrame, artifacts: DataFrame, seq: int) -> DataFrame:
    """Member edges with an end that isn't a member."""
    ids = members(artifacts, seq).select("artifact_id")
    e = edges.where(access.member(seq))
    bad = [e.join(ids.withColumnRenamed("artifact_id", c), c, "left_anti") for c in ("from_artifact_id", "to_artifact_id")]
    return bad[0].unionByName(bad[1]).select("from_artifact_id", "to_artifact_id", "edge_type").distinct()


def provenance(artifacts: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """By artifact: deleted source, any extracted edge, any edge at either end."""
    ends = edges.select(F.explode(F.array("from_artifact_id", "to_artifact_id")).alias("artifact_id"), "trust_class")
    by = ends.groupBy("artifact_id").agg(F.count("*").alias("edges"), F.max((F.col("trust_class") == "EXTRACTED").cast("int")).alias("x"))
    a = artifacts.select("artifact_id", "source_id").join(sources.select("source_id", "is_deleted"), "source_id", "left").join(by, "artifact_id", "left")
    return a.select("artifact_id", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), (F.coalesce("x", F.lit(0)) == 1).alias("has_extracted"), F.col("edges").isNotNull().alias("has_edge"))


def linked_symbol_coverage(artifacts: DataFrame, edges: DataFrame, seq: int) -> DataFrame:
    """Share of member symbols with a member edge."""
    ends = edges.where(access.member(seq)).select(F.explode(F.array("from_artifact_id", "to_artifact_id")).alias("artifact_id")).distinct().withColumn("linked", F.lit(1))
    s = members(artifacts, seq).where("artifact_type = 'code_symbol'").join(ends, "artifact_id", "left")
    return s.agg(F.count("*").alias("symbols"), F.count("linked").alias("linked")).withColumn("coverage", F.round(F.try_divide(F.col("linked").cast("double"), F.col("symbols")), 6))


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int, include_inferred: bool = False, floor: str = "INFERRED_LOW") -> DataFrame:
    """Undirected breadth-first search: (artifact_id, hop); each hop is a join and an anti join."""
    e = edges.where(access.trust_admits(F.col("trust_class"), floor, include_inferred)).select(F.col("from_artifact_id").alias("a"), F.col("to_artifact_id").alias("b"))
    # Parallel edges stay, as each hop is made distinct by its nodes.
    both = e.unionAll(e.select("b", "a"))
    seen = written(seeds.select("artifact_id", F.lit(0).alias("hop")), "seeds")
    front = seen
    for hop in range(1, depth + 1):
        front = front.select(F.col("artifact_id").alias("a")).join(both, "a").select(F.col("b").alias("artifact_id")).distinct().join(seen.select("artifact_id"), "artifact_id", "left_anti").withColumn("hop", F.lit(hop))
        front = written(front, "front")
        seen = seen.unionAll(front)
    return seen


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, nodes: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Ranks over the largest; parallel edges count, the mass of dead ends is spread evenly.

    ``nodes`` (artifact_id) are all that is ranked: edges to others are ignored, and without any
    edge all ranks are 0.  Left out, the ends of the edges are the nodes.  Mass that is spread evenly gives each node the
    same share, so it scales all ranks alike and drops out over the largest: a round gives each node 1 and the damped
    ranks of its origins, and a graph without cycles is done after as many rounds as its longest path.  A round joins ranks with
    out-degrees on the edge's origin and sums by target with partial aggregation, so a hub is summed
    before the shuffle.  Every ``STEP`` rounds the ranks are written, and it ends there once the sum
    of the last round's changes, of ranks over their total, is below ``tolerance``.  Only totals go to the driver.
    """
    e = edges.select(F.col("from_artifact_id").alias("u"), F.col("to_artifact_id").alias("v"))
    if nodes is not None:
        known = nodes.select(F.col("artifact_id").alias("id")).where("id is not null").distinct()
        e = e.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")
    parallel = e.groupBy("u", "v").agg(F.count("*").alias("m"))
    degree = parallel.groupBy("u").agg(F.sum("m").alias("d"))
    weighted = written(parallel.join(degree, "u").select("u", "v", (F.col("m") / F.col("d")).alias("w")), "weights")
    if nodes is None:
        known = weighted.select(F.col("u").alias("id")).distinct().union(weighted.select("v").distinct()).distinct()
    known = written(known, "nodes")
    if weighted.isEmpty():
        return known.select(F.col("id").alias("artifact_id"), F.lit(0.0).alias("centrality"))
    rank = known.withColumns({"r": F.lit(1.0), "last": F.lit(0.0)})
    for i in range(1, rounds + 1):
        got = weighted.join(rank.select(F.col("id").alias("u"), "r"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("s"))
        rank = rank.select("id", F.col("r").alias("last")).join(got, "id", "left").select("id", (1 + damping * F.coalesce("s", F.lit(0.0))).alias("r"), "last")
        if i % STEP == 0 or i == rounds:
            rank = written(rank, "rank")
            now, before = rank.agg(F.sum("r"), F.sum("last")).first()
            if rank.agg(F.sum(F.abs(F.col("r") / now - F.col("last") / before))).first()[0] < tolerance:
                break
    top = rank.agg(F.max("r").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select(F.col("id").alias("artifact_id"), F.round(F.col("r") / F.col("top"), 6).alias("centrality"))


def query_tokens(queries: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, token): each query's first distinct tokens, one character or longer."""
    parts = F.filter(F.split(text.normalize_query(F.col("query_text")), " "), lambda t: t != "")
    return queries.select("query_id", F.explode(F.slice(F.array_distinct(parts), 1, most)).alias("token"))


def substring_hits(tokens: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(artifact_id, token, weight): in which fields each distinct token stands as a substring, in one scan.

    A token is a run of [a-z0-9], so it stands inside one such run of the text.  The different runs
    of all texts are cut into pieces of the lengths that tokens have and meet the tokens by an equi
    join; that table, from runs to tokens, then meets the runs of each text.  No token is compared
    with a text.  If the table of runs may go to all tasks, runs are dealt by artifact before they are exploded, so
    what they hit is added up where it is found and isn't shuffled; else runs are shuffled to the table.
    """
    runs = lambda c: runs_of(F.lower(F.col(c)), "[^a-z0-9]+")
    fields = F.array(*(F.struct(F.lit(i).alias("field"), runs(c).alias("runs")) for i, c in enumerate(("title", "search_text", "body_text"))))
    each = lambda d: d.select("artifact_id", F.explode("fields").alias("f")).select("artifact_id", "f.field", F.explode("f.runs").alias("run"))
    cut = artifacts.select("artifact_id", fields.alias("fields"))
    held = runs_holding(each(cut), tokens)
    hits = each(cut.repartition("artifact_id")).join(F.broadcast(held), "run") if is_small(held) else each(cut).join(held, "run")
    inside = lambda i, weight: F.when(F.max(F.col("field") == i), weight).otherwise(0.0)
    return hits.groupBy("artifact_id", "token").agg((inside(0, 4.0) + inside(1, 1.5) + inside(2, 1.0)).alias("weight"))


def doc_frequency(queries: DataFrame, artifacts: DataFrame, seq: int) -> DataFrame:
    """By token: the member artifacts that hold it, and how many members there are."""
    t = written(query_tokens(queries).select("token").distinct(), "tokens")
    served = members(artifacts, seq)
    if is_small(t):
        words = sorted(r["token"] for r in t.collect())
        held = scanned_hits(words, served).select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
        df = t.sparkSession.createDataFrame(list(enumerate(words)), "place int, token string").join(held, "place").select("token", "df")
    else:
        df = substring_hits(t, served).groupBy("token").agg(F.count("*").alias("df"))
    return t.join(df, "token", "left").crossJoin(F.broadcast(served.agg(F.count("*").alias("n")))).select("token", F.coalesce("df", F.lit(0)).alias("df"), "n")


def keyword_search(queries: DataFrame, artifacts: DataFrame, seq: int, top: int = 20) -> DataFrame:
    """Best member artifacts for each query by idf-weighted substring hits; ties go to the smaller id (as a string).

    One scan writes a row of hits for each artifact; frequencies are counted from these rows, and scores are added up by what
    queries share (``best_scores``).  If the table of query tokens may not go to all tasks, queries are dealt into parts
    that may, each with its own scan.  The result is written, as callers read it more than once.
    """
    t = written(query_tokens(queries), "asked")
    served = members(artifacts, seq)
    parts = 1 if is_small(t) else max(2, -(-t.count() // PART))
    n = served.count()
    scored = []
    for i in range(parts):
        own = t if parts == 1 else written(t.where(F.pmod(F.xxhash64("query_id"), parts) == i), "asked")
        words = sorted(own.select("token").distinct().toArrow()["token"].to_pylist())
        hits = written(scanned_hits(words, served), "hits")
        df = frequencies(hits)
        gain = {w: math.log((n + 1) / (df.get(i, 0) + 1)) + 1 for i, w in enumerate(words)}
        scored.append(best_scores(hits, own, gain, words, top, df))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "artifact_id")
    return written(reduce(DataFrame.unionAll, scored).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top), "top")


def rank_hits(hits: DataFrame, artifacts: DataFrame, sources: DataFrame, queries: DataFrame, teams: list[str], top: int = 5) -> DataFrame:
    """Visible hits by (source-backed, authority, weighted score, id), all descending."""
    a = artifacts.select("artifact_id", "source_id", "artifact_type", "knowledge_kind", "authority_score", "centrality_score", "invalidated_at_seq")
    h = hits.join(a, "artifact_id").join(sources.select("source_id", "source_type", "acl_teams", "is_deleted"), "source_id").join(queries.select("query_id", "intent"), "query_id")
    h = h.where(access.visible(F.col("acl_teams"), teams))
    kind = access.source_kind(F.col("source_type"), F.col("artifact_type"))
    weight = access.temporal_weight(F.col("intent"), kind, F.col("is_deleted") | F.col("invalidated_at_seq").isNotNull(), F.lit(False))
    h = h.withColumn("final", F.round(F.col("score") * weight * (1 + 0.25 * F.coalesce("centrality_score", F.lit(0.0))), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(F.col("knowledge_kind") == "source_backed", F.lit(False))), F.desc(F.coalesce("authority_score", F.lit(0.0))), F.desc("final"), F.desc("artifact_id"))
    return h.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top).select("query_id", "artifact_id", "final", "position")


def activate(runs: DataFrame) -> DataFrame:
    """The latest completed build becomes the active one, the one before it superseded."""
    ok = F.when(F.col("status") != "validation_failed", F.col("build_seq"))
    last = runs.agg(F.max(ok).alias("last"))
    state = F.when(F.col("status") == "validation_failed", F.col("status")).when(F.col("build_seq") == F.col("last"), "active").otherwise("superseded")
    return runs.crossJoin(F.broadcast(last)).select("kb_version", "build_seq", state.alias("status"))
