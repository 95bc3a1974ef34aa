"""Components, expansion, traces of any depth against brute force."""

import collections
import random

from pyspark.sql import functions as F

from tessera.operators import graph, ledger

EDGE = "from_artifact_id string, to_artifact_id string, trust_class string"


def closure(links, start, allowed):
    seen, front = {start}, [start]
    while front:
        front = [b for a in front for b in links[a] if b in allowed and b not in seen and not seen.add(b)]
    return seen


def both_ways(edges, classes):
    links = collections.defaultdict(set)
    for a, b, t in edges:
        if t in classes:
            links[a].add(b)
            links[b].add(a)
    return links


def test_expansion_to_exhaustion(spark):
    """A chain of 200 nodes is reached to its end, in both tiers; hidden nodes aren't crossed."""
    r = random.Random(8)
    edges = [(f"n{i:03}", f"n{i + 1:03}", "EXTRACTED" if i < 120 else "INFERRED_LOW") for i in range(200)]
    edges += [(f"m{r.randint(0, 60)}", f"m{r.randint(0, 60)}", r.choice(["EXTRACTED", "INFERRED_HIGH", "AMBIGUOUS"])) for _ in range(60)]
    nodes = {x for a, b, _ in edges for x in (a, b)}
    allowed = {n for n in nodes if n not in ("m3", "m7", "n150", "m9")}
    seeds = ["n000", "n160", "m3", "m1", "m9", "alone"]
    e = spark.createDataFrame(edges, EDGE)
    s = spark.createDataFrame([(x,) for x in seeds], "artifact_id string")
    a = spark.createDataFrame([(x,) for x in allowed], "artifact_id string")
    told = {}
    for seed in seeds:
        first = closure(both_ways(edges, {"EXTRACTED"}), seed, allowed)
        every = closure(both_ways(edges, {"EXTRACTED", "INFERRED_HIGH", "INFERRED_LOW"}), seed, allowed)
        told |= {(seed, n): "seed" if n == seed else "EXTRACTED" if n in first else "INFERRED" for n in first | every}
    assert {(x["seed"], x["artifact_id"]): x["tier"] for x in graph.expand(e, s, a).collect()} == told
    sizes = collections.Counter((seed, tier) for (seed, _), tier in told.items())
    assert {(x["seed"], x["tier"]): x["nodes"] for x in graph.expand_sizes(e, s, a).collect()} == dict(sizes)
    cards = graph.expand_cards(e, s, a, 5).collect()
    by = collections.defaultdict(list)
    for x in sorted(cards, key=lambda x: (x["seed"], x["place"])):
        by[x["seed"]].append((x["artifact_id"], x["tier"]))
    assert by["n000"] == [(f"n{i:03}", "EXTRACTED") for i in range(1, 6)]
    for seed in seeds:
        want = sum(v for (s_, t), v in sizes.items() if s_ == seed and t != "seed")
        assert len(by[seed]) == min(5, want) and all(told[seed, n] == t for n, t in by[seed])
    assert graph.expand(e.limit(0), s, a).count() == len(seeds)


def test_components_of_random_links(spark):
    r = random.Random(9)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(6000, 6100)]
    got = dict(graph.components(spark.createDataFrame(links, "u long, v long")).collect())
    near = collections.defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert got == {n: min(closure(near, n, near.keys())) for n in near}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_trace_of_many_levels(spark):
    """200 nested spans, two roots, and parents in a circle."""
    rows = [("t", f"s{i:03}", f"s{i - 1:03}" if i else None) for i in range(200)]
    rows += [("u", "a", "b"), ("u", "b", "a"), ("u", "c", "b"), ("u", "d", "gone"), ("u", "e", "d"), ("v", "x", "x")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string").withColumn("started_at", F.timestamp_seconds(F.lit(0)))
    got = {(r["trace_id"], r["span_id"]): r["depth"] for r in ledger.trace_waterfall(df).collect()}
    assert got == {("t", f"s{i:03}"): i for i in range(200)} | {("u", "a"): -1, ("u", "b"): -1, ("u", "c"): -1, ("u", "d"): 0, ("u", "e"): 1, ("v", "x"): -1}
    assert ledger.trace_waterfall(df.limit(0)).count() == 0


def test_edges_are_written_once_and_hubs_are_cut_exactly(spark, tmp_path):
    """before, each use of the table joined orders with lines and compared four strings again."""
    from tessera.sources.registry import table

    spark.createDataFrame([(1, 10), (2, 11), (3, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 5, 7, 1, "R"), (1, 5, 7, 5, "R"), (1, 5, 7, 4, "A"), (2, 5, 8, 3, "N"), (3, 6, None, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = table(spark, str(tmp_path), "knowledge_edge")
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, e.collect()))) == sorted(map(str, [
        ("c10", "s5", "imports", "EXTRACTED"), ("c10", "s5", "calls", "INFERRED_HIGH"), ("c11", "s5", "defined_in", "INFERRED_LOW"), (None, "s6", "defined_in", "INFERRED_LOW"),
        ("s5", "p7", "imports", "EXTRACTED"), ("s5", "p7", "calls", "INFERRED_HIGH"), ("s5", "p8", "defined_in", "AMBIGUOUS"), ("s6", None, "defined_in", "AMBIGUOUS"),
    ]))


def test_a_cap_gives_the_first_rows_of_the_whole_search(spark):
    import random

    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(4) if rnd.random() < 0.5 else rnd.randrange(30)}", f"n{rnd.randrange(30)}", rnd.choice(("calls", "imports")), rnd.choice(("EXTRACTED", "INFERRED_HIGH"))) for _ in range(70)]
    e = spark.createDataFrame(pairs, "from_artifact_id string, to_artifact_id string, edge_type string, trust_class string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(30)], "artifact_id string")
    args = {"floor": "INFERRED_HIGH", "include_inferred": True}
    every = [r.asDict() for r in graph.visible_neighbors(e, nodes, nodes.where("artifact_id <> 'n3'"), 3, cap=None, **args).collect()]
    few = graph.visible_neighbors(e, nodes, nodes.where("artifact_id <> 'n3'"), 3, cap=4, **args).collect()
    hops = lambda rows: {s: sorted(r["hop"] for r in rows if r["seed"] == s)[:4] for s in {r["seed"] for r in rows}}
    assert hops(few) == hops(every) and {tuple(r) for r in few} <= {tuple(r.values()) for r in every}


def test_nodes_are_numbered_once_and_joined_ends_count_as_one(spark, monkeypatch):
    """before, each tier compared strings of all edges again, those that were joined already too."""
    made = {}
    monkeypatch.setattr(graph, "written", lambda d, name, write=graph.written: made.setdefault(f"{name}{sum(k.startswith(name) for k in made)}", write(d, name)))
    # Two rings of extracted edges with chords of inferred ones, and one inferred edge between the rings.
    edges = [(f"{c}{i:02}", f"{c}{(i + 1) % 30:02}", "EXTRACTED") for c in "ab" for i in range(30)]
    edges += [(f"{c}{i:02}", f"{c}{(i + 7) % 30:02}", "INFERRED_LOW") for c in "ab" for i in range(30)] + [("a03", "b05", "INFERRED_HIGH"), ("a03", "b05", "EXTRACTED_NOT"), ("b05", "a03", "INFERRED_LOW")]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    ids = lambda x: spark.createDataFrame([(n,) for n in x], "artifact_id string")
    got = {tuple(r) for r in graph.expand_sizes(spark.createDataFrame(edges, EDGE), ids(["a00", "b29", None]), ids([*nodes, None])).collect()}
    assert {g for g in got if g[0]} == {("a00", "seed", 1), ("a00", "EXTRACTED", 29), ("a00", "INFERRED", 30), ("b29", "seed", 1), ("b29", "EXTRACTED", 29), ("b29", "INFERRED", 30)}
    assert made["links0"].count() == 121 and dict(made["links0"].dtypes) == {"u": "bigint", "v": "bigint", "sure": "boolean"}
    # Of 61 inferred links one is left for the second tier.
    assert [d.count() for n, d in made.items() if n.startswith("stars")][-1] == 1
