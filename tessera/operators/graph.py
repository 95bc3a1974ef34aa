"""Graph search over registry edges: neighbours with access by hop, expansion, blast radius, extracted graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import access, text
from ..sources.written import written
from .matching import small


def visible_neighbors(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, depth: int, types: list[str] | None = None, floor: str = "INFERRED_LOW", include_inferred: bool = False, cap: int | None = 100) -> DataFrame:
    """Rows (seed, artifact_id, hop, edge_type, trust_class, direction): undirected search from each seed.

    The first edge in order of (from, to, type, trust) claims a node.  Nodes that aren't in ``allowed``
    (artifact_id) are neither returned nor crossed.  ``cap`` bounds what one seed gets, nearest first
    in order of the claiming edge: the answer's size, not the search.
    """
    e = edges.where(access.trust_admits(F.col("trust_class"), floor, include_inferred))
    if types is not None:
        e = e.where(F.col("edge_type").isin(*types))
    side = lambda a, b, d: e.select(F.col(a).alias("near"), F.col(b).alias("far"), "from_artifact_id", "to_artifact_id", "edge_type", "trust_class", F.lit(d).alias("direction"))
    both = side("from_artifact_id", "to_artifact_id", "out").unionAll(side("to_artifact_id", "from_artifact_id", "in"))
    claim = F.struct("from_artifact_id", "to_artifact_id", "edge_type", "trust_class", "direction")
    both = both.join(allowed.select(F.col("artifact_id").alias("far")).distinct(), "far", "left_semi").groupBy("near", "far").agg(F.min(claim).alias("claim"))
    if cap is not None:
        # A seed that isn't full yet has seen fewer than ``cap`` nodes and itself, so of a node's neighbours it takes none behind these.
        both = both.withColumn("r", F.row_number().over(Window.partitionBy("near").orderBy("claim"))).where(F.col("r") <= cap + 1).drop("r")
    both = written(both, "edges")
    seen = seeds.select(F.col("artifact_id").alias("seed"), "artifact_id").distinct()
    front, found = seen, None
    for hop in range(1, depth + 1):
        step = front.withColumnRenamed("artifact_id", "near").join(both, "near").join(seen.withColumnRenamed("artifact_id", "far"), ["seed", "far"], "left_anti")
        got = step.groupBy("seed", F.col("far").alias("artifact_id")).agg(F.min("claim").alias("claim")).withColumn("hop", F.lit(hop))
        if cap is not None:
            # What a hop adds behind the cap is no answer, and a full seed needs no further hop.
            got = got.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("claim"))).where(F.col("r") <= cap).drop("r")
        got = written(got, "hop")
        found = got if found is None else found.unionAll(got)
        front = got.select("seed", "artifact_id")
        seen = seen.unionAll(front)
        if cap is not None:
            full = found.groupBy("seed").count().where(F.col("count") >= cap).select("seed")
            front = front.join(full, "seed", "left_anti")
    if cap is not None:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("hop", "claim"))).where(F.col("r") <= cap)
    return found.select("seed", "artifact_id", "hop", "claim.edge_type", "claim.trust_class", "claim.direction")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root): nodes of undirected ``links`` (u, v) with the least node that they are joined to.

    Stars grow and merge (large star, small star) until a round changes nothing: logarithmically many rounds, not one
    for each hop.  A round is a minimum by node, pre-aggregated, and a join with the links.
    """
    e = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2_147_483_647)).first()
    seen = mark(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionAll(low.toDF("u", "v"))
        e = written(near.distinct(), "stars")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def reach(edges: DataFrame, seeds: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an expansion to exhaustion finds: (seed, tier, root), members (tier, root, artifact_id) and seeds (seed, own: whether it may be seen).

    Search is undirected over allowed nodes, so what a seed reaches is its component, or, if it may not be seen itself,
    those of its neighbours.  Tier EXTRACTED has the components of extracted edges, INFERRED those of both kinds.  A node
    without a link is a component of its own.

    Nodes are numbered once, and edges are pairs of numbers, each pair once.  What extracted edges join is one node for the others.
    """
    known = allowed.select(F.col("artifact_id").alias("id")).where("id is not null").distinct()
    known = written(known.withColumn("k", F.monotonically_increasing_id()), "known")
    of = small(known)
    side = lambda t, c, n: t.select(F.col(c).alias(n), F.col("k").alias(f"{n}_k"))
    e = edges.where(F.col("trust_class").isin("EXTRACTED", "INFERRED_HIGH", "INFERRED_LOW")).select(F.col("from_artifact_id").alias("u"), F.col("to_artifact_id").alias("v"), (F.col("trust_class") == "EXTRACTED").alias("sure"))
    inside = e.join(side(of, "id", "u"), "u").join(side(of, "id", "v"), "v").where("u_k <> v_k")
    links = written(inside.groupBy(F.greatest("u_k", "v_k").alias("u"), F.least("u_k", "v_k").alias("v")).agg(F.max("sure").alias("sure")), "links")
    first = components(links.where("sure").select("u", "v")).toDF("k", "EXTRACTED")
    first = written(known.join(small(first), "k", "left").select("id", "k", F.coalesce("EXTRACTED", "k").alias("EXTRACTED")), "roots")
    root = small(first.select("k", "EXTRACTED"))
    near = lambda n: root.select(F.col("k").alias(n), F.col("EXTRACTED").alias(f"{n}_k"))
    more = links.where("not sure").join(near("u"), "u").join(near("v"), "v").select(F.col("u_k").alias("u"), F.col("v_k").alias("v"))
    second = small(components(more).toDF("EXTRACTED", "INFERRED"))
    roots = written(first.join(second, "EXTRACTED", "left").select("id", "EXTRACTED", F.coalesce("INFERRED", "EXTRACTED").alias("INFERRED")), "roots")
    start = seeds.select(F.col("artifact_id").alias("seed")).distinct().join(known.select(F.col("id").alias("seed"), F.lit(1).alias("own")), "seed", "left")
    start = written(start, "start")
    hidden = start.where("own is null").select("seed")
    none = hidden.isEmpty()
    found, members = [], []
    for tier in ("EXTRACTED", "INFERRED"):
        at = start.where("own = 1").select("seed", F.col("seed").alias("id"))
        if not none:
            some = e.where("sure") if tier == "EXTRACTED" else e
            at = at.unionAll(some.select("u", "v").unionAll(some.select("v", "u")).toDF("seed", "id").join(small(hidden), "seed"))
        found.append(at.join(roots.select("id", F.col(tier).alias("root")), "id").select("seed", F.lit(tier).alias("tier"), "root").distinct())
        members.append(roots.select(F.lit(tier).alias("tier"), F.col(tier).alias("root"), F.col("id").alias("artifact_id")))
    return found[0].unionAll(found[1]), members[0].unionAll(members[1]), start


def expand(edges: DataFrame, seeds: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows (seed, artifact_id, tier): all that EXTRACTED edges reach, then what INFERRED ones add from there, however far."""
    found, members, start = reach(edges, seeds, allowed)
    each = found.join(members, ["tier", "root"]).groupBy("seed", "artifact_id").agg(F.min("tier").alias("tier"))
    own = start.select("seed", F.col("seed").alias("artifact_id"), F.lit("seed").alias("tier"))
    return own.unionAll(each.where("seed <> artifact_id").select("seed", "artifact_id", "tier"))


def expand_sizes(edges: DataFrame, seeds: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows (seed, tier, nodes): how many nodes each tier of an expansion adds, from sizes of components alone."""
    found, members, start = reach(edges, seeds, allowed)
    size = members.groupBy("tier", "root").agg(F.count("*").alias("n"))
    upto = found.join(size, ["tier", "root"]).groupBy("seed").pivot("tier", ["EXTRACTED", "INFERRED"]).agg(F.sum("n"))
    seen = start.join(upto, "seed", "left")
    own, first, all_ = F.coalesce("own", F.lit(0)), F.coalesce("EXTRACTED", F.lit(0)), F.coalesce("INFERRED", F.lit(0))
    tiers = F.array(F.struct(F.lit("seed").alias("tier"), F.lit(1).cast("long").alias("nodes")), F.struct(F.lit("EXTRACTED").alias("tier"), (first - own).alias("nodes")), F.struct(F.lit("INFERRED").alias("tier"), (all_ - first).alias("nodes")))
    return seen.select("seed", F.explode(tiers).alias("t")).select("seed", "t.*").where("nodes > 0")


def expand_cards(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, most: int = 30) -> DataFrame:
    """Rows (seed, place, artifact_id, tier): the first ``most`` nodes of an expansion, in order of hop, then id.

    A seed's search ends once it has ``most`` nodes: what comes behind them can't be among them.  A hop adds a node
    or ends a tier, so there are ``most`` hops a tier at most.
    """
    known = allowed.select(F.col("artifact_id").alias("far")).distinct()
    seen = written(seeds.select(F.col("artifact_id").alias("seed"), "artifact_id").distinct().withColumns({"place": F.lit(0), "tier": F.lit("seed")}), "seen")
    for tier, classes in (("EXTRACTED", ("EXTRACTED",)), ("INFERRED", ("EXTRACTED", "INFERRED_HIGH", "INFERRED_LOW"))):
        e = edges.where(F.col("trust_class").isin(*classes)).select(F.col("from_artifact_id").alias("near"), F.col("to_artifact_id").alias("far"))
        # A seed takes no more than ``most`` less what it had, and has seen that and itself: of a node's neighbours these suffice.
        near = F.row_number().over(Window.partitionBy("near").orderBy("far"))
        both = written(e.unionAll(e.select("far", "near")).distinct().join(known, "far", "left_semi").withColumn("r", near).where(F.col("r") <= most + 1).drop("r"), "edges")
        front = seen
        while True:
            had = seen.groupBy("seed").agg(F.max("place").alias("had")).where(F.col("had") < most)
            step = front.join(had, "seed").select("seed", "had", F.col("artifact_id").alias("near")).join(both, "near").select("seed", "had", F.col("far").alias("artifact_id")).distinct()
            new = step.join(seen.select("seed", "artifact_id"), ["seed", "artifact_id"], "left_anti")
            place = F.col("had") + F.row_number().over(Window.partitionBy("seed").orderBy("artifact_id"))
            front = written(new.withColumn("place", place).where(F.col("place") <= most).select("seed", "artifact_id", "place", F.lit(tier).alias("tier")), "front")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        seen = written(seen, "seen")
    return seen.where("place > 0").select("seed", "place", "artifact_id", "tier")


def blast_radius(edges: DataFrame, seeds: DataFrame, visible: DataFrame, cap: int | None = 100) -> DataFrame:
    """Rows (seed, role, artifact_id, path, symbol, edge_type, tier): callers, callees and tests of each seed.

    ``visible``: artifact_id, artifact_type, title, path of what may be shown.  A calls edge is
    deterministic if both ends are defined in one file or the caller's file imports the target's;
    else it is interpreted.  imports and tests are facts.  ``cap`` bounds each role of a seed.
    """
    e = edges.where("trust_class = 'EXTRACTED'").select("from_artifact_id", "to_artifact_id", "edge_type")
    s = seeds.select(F.col("artifact_id").alias("seed")).distinct()
    out = e.join(s, F.col("from_artifact_id") == F.col("seed")).where("edge_type in ('calls', 'imports')").select("seed", F.lit("callee").alias("role"), F.col("to_artifact_id").alias("artifact_id"), "edge_type")
    into = e.join(s, F.col("to_artifact_id") == F.col("seed")).where("edge_type in ('calls', 'imports', 'tests')").select("seed", F.when(F.col("edge_type") == "tests", "test").otherwise("caller").alias("role"), F.col("from_artifact_id").alias("artifact_id"), "edge_type")
    r = out.unionAll(into).where("seed <> artifact_id").distinct()
    home = e.where("edge_type = 'defined_in'").groupBy("from_artifact_id").agg(F.min("to_artifact_id").alias("file"))
    r = r.join(home.toDF("seed", "seed_file"), "seed", "left").join(home.toDF("artifact_id", "near_file"), "artifact_id", "left")
    caller = F.when(F.col("role") == "callee", F.col("seed_file")).otherwise(F.col("near_file"))
    target = F.when(F.col("role") == "callee", F.col("near_file")).otherwise(F.col("seed_file"))
    imports = e.where("edge_type = 'imports'").select(F.col("from_artifact_id").alias("caller"), F.col("to_artifact_id").alias("target"), F.lit(True).alias("imported")).distinct()
    r = r.withColumns({"caller": caller, "target": target}).join(imports, ["caller", "target"], "left")
    sure = (F.col("edge_type") != "calls") | F.coalesce((F.col("caller") == F.col("target")) | F.col("imported"), F.lit(False))
    r = r.withColumn("tier", F.when(sure, "deterministic").otherwise("interpreted")).join(visible.select("artifact_id", "artifact_type", "title", "path"), "artifact_id")
    symbol = F.when(F.col("artifact_type").isin("code_symbol", "endpoint"), F.col("title"))
    r = r.withColumn("symbol", symbol)
    w = Window.partitionBy("seed", "role").orderBy("path", F.coalesce("symbol", F.lit("")), "artifact_id", "edge_type")
    r = r.withColumn("place", F.row_number().over(w))
    r = r if cap is None else r.where(F.col("place") <= cap)
    return r.select("seed", "role", "place", "artifact_id", "path", "symbol", "edge_type", "tier")


# Confidence of extracted code edges by relation.
RELATIONS = {"calls": 0.9, "imports": 1.0, "uses": 0.8, "references": 0.8, "inherits": 0.8}


def graph_from_extraction(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (from_key, to_key, edge_type, confidence) of an extraction.

    ``nodes``: id, label, source_file; ``edges``: source, target, relation, source_location.  A node
    without a file is external.  A file's node is labelled with the file's base name.  Imports join
    files; the other relations join symbols, and a call site with several targets says nothing.
    """
    n = nodes.where("source_file <> ''")
    n = n.select("id", "source_file", (F.col("label") == F.substring_index("source_file", "/", -1)).alias("is_file"))
    files = n.where("is_file").groupBy("source_file").agg(F.max("id").alias("file_id"))
    n = n.join(files, "source_file", "left")
    name = F.when(F.startswith("id", F.concat("file_id", F.lit("_"))), F.substr("id", F.length("file_id") + 2)).otherwise(F.col("id"))
    key = F.when(F.col("is_file"), F.concat(F.lit("file:"), "source_file")).otherwise(F.concat(F.lit("symbol:"), "source_file", F.lit("#"), F.coalesce(name, "id")))
    n = written(n.select("id", "source_file", "is_file", key.alias("key"), F.col("file_id").isNotNull().alias("has_file")).dropDuplicates(["id"]), "nodes")
    defined = n.where("not is_file and has_file").select(F.col("key").alias("from_key"), F.concat(F.lit("file:"), "source_file").alias("to_key"), F.lit("defined_in").alias("edge_type"), F.lit(1.0).alias("confidence"))
    ends = edges.where(F.col("relation").isin(*RELATIONS)).join(n.select(F.col("id").alias("source"), F.col("key").alias("from_key"), F.col("is_file").alias("ff")), "source").join(n.select(F.col("id").alias("target"), F.col("key").alias("to_key"), F.col("is_file").alias("tf")), "target")
    ends = ends.where(F.when(F.col("relation") == "imports", F.col("ff") & F.col("tf")).otherwise(~F.col("ff") & ~F.col("tf")))
    calls = ends.where("relation = 'calls'").groupBy("source", "source_location").agg(F.count_distinct("target").alias("n"), F.min("from_key").alias("from_key"), F.min("to_key").alias("to_key")).where("n = 1")
    rest = ends.where("relation <> 'calls'").select("from_key", "to_key", F.col("relation").alias("edge_type"))
    both = calls.select("from_key", "to_key", F.lit("calls").alias("edge_type")).unionAll(rest)
    confidence = F.element_at(F.create_map(*(F.lit(x) for p in RELATIONS.items() for x in p)), F.col("edge_type"))
    return defined.unionAll(both.select("from_key", "to_key", "edge_type", confidence.alias("confidence"))).where("from_key <> to_key").distinct()


def doc_artifacts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Artifacts (path, node_id, artifact_type, knowledge_kind, title, body_text, authority_score) of extracted documents.

    ``nodes``: path, id, file_type, label, source_file, source_location; ``docs``: path, text.  A
    concept whose location stands in the text, white space collapsed, is a fact.
    """
    j = nodes.where((F.col("source_file") == F.col("path")) & F.col("file_type").isin("document", "concept")).join(docs.select("path", "text"), "path")
    j = j.where((F.col("file_type") == "document") | (F.coalesce("id", F.lit("")) != ""))
    fact = (F.col("file_type") == "concept") & text.quote_grounded(F.col("source_location"), F.col("text"))
    kind = F.when(fact, "source_backed_fact").when(F.col("file_type") == "document", "summary").otherwise("concept")
    body = F.when(fact, F.col("source_location")).when(F.col("file_type") == "document", F.coalesce(F.nullif("label", F.lit("")), "path")).otherwise(F.coalesce("label", "id"))
    return j.select(
        "path", F.col("id").alias("node_id"), kind.alias("artifact_type"), F.when(fact, "source_backed").otherwise("interpreted").alias("knowledge_kind"), F.col("label").alias("title"), body.alias("body_text"),
        F.when(fact, 0.8).when(F.col("file_type") == "document", 0.5).otherwise(0.6).alias("authority_score"),
    )
