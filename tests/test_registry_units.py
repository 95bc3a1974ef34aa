"""Small literal cases of registry operators."""

import random

from pyspark.sql import functions as F

from tessera.functions import access, text
from tessera.operators import gates, matching, registry, resolve
from tessera.plans import queries
from tessera.sources.registry import table


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="\n\na  \r\nb\t\r\n\n") == "a\nb\n"
    assert one(spark, text.normalize_text(F.col("t")), t="") == ""


def test_split_identifier(spark):
    assert one(spark, text.split_identifier(F.col("t")), t="parseHTTPRequest_v2") == ["parse", "http", "request", "v2"]


def test_phrase_ngrams_stop_at_stop_words(spark):
    assert one(spark, text.phrase_ngrams(F.col("t")), t="payment retry of the order queue") == ["payment retry", "order queue"]


def test_strictest_access(spark):
    lists = F.array(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.array(F.lit("b")))
    assert spark.range(1).select(access.strictest(lists).alias("x")).first()["x"] == ["b"]
    apart = F.array(F.array(F.lit("a")), F.array(F.lit("b")))
    assert spark.range(1).select(access.strictest(apart).alias("x")).first()["x"] == [access.NO_TEAM]


def test_pagerank_without_edges_and_star(spark):
    none = spark.createDataFrame([], "from_artifact_id string, to_artifact_id string")
    assert registry.pagerank(none, rounds=2).count() == 0
    star = spark.createDataFrame([("a", "c"), ("b", "c")], "from_artifact_id string, to_artifact_id string")
    got = {r["artifact_id"]: r["centrality"] for r in registry.pagerank(star, rounds=20).collect()}
    assert got["c"] == 1.0 and got["a"] == got["b"] < 1


def test_neighbors_by_hop(spark):
    e = spark.createDataFrame([("a", "b", "EXTRACTED"), ("b", "c", "EXTRACTED"), ("c", "d", "AMBIGUOUS")], "from_artifact_id string, to_artifact_id string, trust_class string")
    seeds = spark.createDataFrame([("a",)], "artifact_id string")
    assert {(r["artifact_id"], r["hop"]) for r in registry.neighbors(e, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_grounded_quotes_takes_all_pairs_and_whole_quotes(spark):
    long = "lead " + " ".join(f"w{i}" for i in range(40))
    quotes = [(1, long), (50, "two words"), (51, "x"), (52, " \t"), (53, None), (54, "a  b\nc d"), (55, "a b c")]
    docs = [(0, f"some {long} more"), (7, long[:-3] + "end"), (8, "twotwo  wordswords"), (9, "pa b c dx"), (9, "pa b c dx"), (10, None), (11, "")]
    collapsed = lambda t: " ".join((t or "").split())
    told = sorted((i, d) for i, q in quotes for d, t in docs if collapsed(q) and collapsed(q) in collapsed(t))
    schema = "{} long, text string"
    got = resolve.grounded_quotes(spark.createDataFrame(quotes, schema.format("item_id")), spark.createDataFrame(docs, schema.format("doc_id")))
    assert sorted(map(tuple, got.collect())) == told and len(told) > 5


def brute_ranks(edges, nodes):
    out = {u: [v for x, v in edges if x == u and v in nodes] for u in nodes}
    if not any(out.values()):
        return dict.fromkeys(nodes, 0.0)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * sum(rank[u] for u in nodes if not out[u]) / len(nodes))
        for u in nodes:
            for v in out[u]:
                new[v] += 0.85 * rank[u] / len(out[u])
        moved, rank = sum(abs(new[u] - rank[u]) for u in nodes), new
        if moved < 1e-9:
            break
    return {u: r / max(rank.values()) for u, r in rank.items()}


def test_pagerank_converges_over_given_nodes(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("b", "gone"), ("gone", "a")]
    nodes = ["a", "b", "c", "d", "alone"]
    known = spark.createDataFrame([(x,) for x in [*nodes, "a"]], "artifact_id string")
    for some in (edges, [("gone", "a")]):
        got = registry.pagerank(spark.createDataFrame(some, "from_artifact_id string, to_artifact_id string"), nodes=known).collect()
        told = brute_ranks(some, nodes)
        assert len(got) == len(nodes)
        assert all(abs(r["centrality"] - told[r["artifact_id"]]) < 2e-6 for r in got)


def test_pagerank_of_a_graph_without_cycles_takes_few_rounds(spark, monkeypatch):
    """Two layers with dead ends: ranks are written four times at most, whatever the dead ends hold."""
    edges = [(f"c{i}", f"s{i * k % 7}") for i in range(20) for k in (1, 3)] + [(f"s{i}", f"p{i * k % 11}") for i in range(7) for k in (1, 2, 5)]
    made = []
    monkeypatch.setattr(registry, "written", lambda d, name, write=registry.written: made.append(name) or write(d, name))
    got = registry.pagerank(spark.createDataFrame(edges, "from_artifact_id string, to_artifact_id string")).collect()
    told = brute_ranks(edges, sorted({x for e in edges for x in e}))
    assert len(got) == len(told) and all(abs(r["centrality"] - told[r["artifact_id"]]) < 2e-6 for r in got)
    assert made.count("rank") <= 4


def test_upsert_takes_the_new_access_list(spark):
    schema = "source_type string, source_uri string, content_hash string, last_seen_min long, acl_teams array<string>"
    before = spark.createDataFrame([("t", "same", "h", 1, ["a"]), ("t", "gone", "h", 1, ["b"]), ("t", "open", "h", 1, ["c"])], schema)
    after = spark.createDataFrame([("t", "same", "h", 2, ["c"]), ("t", "new", "h", 2, ["d"]), ("t", "open", "h", 2, [])], schema)
    got = {r["source_uri"]: r["acl_teams"] for r in gates.upsert_source_items(before, after).collect()}
    assert got == {"same": ["c"], "gone": ["b"], "new": ["d"], "open": []}


def test_all_live_paths_are_resolved(spark):
    sf = "/root/testdata/sf0.001"
    live = table(spark, sf, "knowledge_artifact").where("invalidated_at_seq is null")
    paths = table(spark, sf, "source_item").where("not is_deleted").join(live.select("source_id"), "source_id").select("repo", "path").distinct()
    got = queries.queries()["resolve_targets"](spark, sf).select("repo", "path")
    assert got.count() == paths.count() and paths.exceptAll(got).isEmpty()


def test_no_input_denies(spark):
    assert spark.range(1).select(access.strictest(F.array().cast("array<array<string>>")).alias("x")).first()["x"] == [access.NO_TEAM]
    assert spark.range(1).select(access.strictest(F.array(F.array().cast("array<string>"))).alias("x")).first()["x"] == []


def test_exact_phrase_beats_a_permutation(spark):
    q = spark.createDataFrame([(1, "retry the queue")], "query_id int, query_text string")
    a = spark.createDataFrame([("queue retry", 9), ("retry queue", 1)], "alias string, confirmations int")
    assert resolve.fuzzy_resolve(q, a).first()["alias"] == "retry queue"


def test_fuzzy_resolve_makes_no_pairs_of_a_frequent_token(spark):
    """Every query and alias holds one word: the join gives as many rows as there are offers, and the best ones are those of all pairs."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    said = lambda n: " ".join(["hot", *r.sample(words, n)])
    queries_ = [(i, said(r.choice([0, 1, 2, 3, 9, 14]))) for i in range(300)] + [(900, "the"), (901, None), (902, "nothing alike"), (5, "w1 hot")]
    aliases = sorted({said(r.choice([0, 1, 2, 3, 9, 14])) for _ in range(300)})
    counts = [(x, r.choice([None, 1, 2, 3])) for x in aliases]
    best = {}
    for i, q in queries_:
        for x, n in counts if q else []:
            p, o = set(q.split()), set(x.split())
            score = 1.0 if q == x else round(len(p & o) / len(p | o), 6)
            if p & o and score >= 0.3:
                best.setdefault(i, []).append((q != x, -score, n is None, -(n or 0), x))
    told = {i: (min(v)[4], -min(v)[1]) for i, v in best.items()}
    got = resolve.fuzzy_resolve(spark.createDataFrame(queries_, "query_id int, query_text string"), spark.createDataFrame(counts, "alias string, confirmations long"))
    assert {x["query_id"]: (x["alias"], x["score"]) for x in got.collect()} == told and len(told) > 250
    # Alike pairs were as many as queries times aliases.
    many = lambda n: spark.range(n).select("id", F.concat(F.lit("hot x"), F.col("id").cast("string")).alias("t"))
    big = resolve.fuzzy_resolve(many(20_000).select(F.col("id").alias("query_id"), F.concat("t", F.lit("q")).alias("query_text")), many(20_000).select(F.col("t").alias("alias"), F.lit(1).cast("long").alias("confirmations")))
    assert big.where("alias = 'hot x0'").count() == 20_000


def test_sha_refs_once_and_short_tokens_searched(spark):
    assert one(spark, text.sha_refs(F.col("t")), t="abcdef1 abcdef1 1234567") == ["abcdef1"]
    a = spark.createDataFrame([("1", "x marks", None, "q", 0, None), ("2", "none", None, "", 0, None), ("3", "x", None, "", 5, None)], "artifact_id string, title string, search_text string, body_text string, valid_from_seq int, invalidated_at_seq int")
    q = spark.createDataFrame([(1, "X")], "query_id int, query_text string")
    assert [r["artifact_id"] for r in registry.keyword_search(q, a, 4).collect()] == ["1"]


def test_keyword_search_shuffles_only_the_best(spark, monkeypatch):
    """Both ways of the search give what brute force gives, ties over blocks included; a block hands on few rows."""
    import math

    from tessera.operators import scan

    monkeypatch.setattr(scan, "ROWS", 64)
    r = random.Random(8)
    words = ["abc", "zabcd", "bc", "e1", "x" * 70, "q"]
    said = lambda: " ".join(r.choice([*words, "none", "İbc", "w" + "x" * 80]) for _ in range(r.randrange(5)))
    rows = [(str(i), said() or None, said(), said(), 0, None if i % 9 else 2) for i in range(500)]
    asked = [(1, "ABC e1"), (2, "bc, bc " + "x" * 70), (3, "q abc absent"), (4, ""), (5, None)]
    a = spark.createDataFrame(rows, "artifact_id string, title string, search_text string, body_text string, valid_from_seq int, invalidated_at_seq int")
    q = spark.createDataFrame(asked, "query_id long, query_text string")
    live = [x for x in rows if x[5] is None]
    told = set()
    for i, said_ in asked:
        tokens = list(dict.fromkeys((said_ or "").lower().replace(",", " ").split()))
        holds = lambda x, t: any(x[k] and t in x[k].lower() for k in (1, 2, 3))
        idf = {t: math.log((len(live) + 1) / (sum(holds(x, t) for x in live) + 1)) + 1 for t in tokens}
        score = lambda x: round(sum(idf[t] * w for t in tokens for k, w in ((1, 4.0), (2, 1.5), (3, 1.0)) if x[k] and t in x[k].lower()), 6)
        best = sorted((-score(x), x[0]) for x in live if any(holds(x, t) for t in tokens))[:7]
        told |= {(i, x, -s, k) for k, (s, x) in enumerate(best, 1)}
    take = lambda: {(x["query_id"], x["artifact_id"], x["score"], x["rank"]) for x in registry.keyword_search(q, a, 4, 7).collect()}
    assert take() == told and len(told) == 21
    kept = scan.best_scores(scan.scanned_hits(["bc"], a.repartition(1)), q.selectExpr("query_id", "'bc' AS token"), {"bc": 1.0}, ["bc"], 7)
    assert kept.select("query_id").distinct().count() == 5
    monkeypatch.setattr(registry, "is_small", lambda d: False)
    assert take() == told


def test_many_queries_share_what_they_have_in_common(spark, monkeypatch):
    """300 queries of a few frequent tokens and a number each: what brute force gives, ties included; no query has rows by block."""
    import math

    from tessera.operators import scan

    monkeypatch.setattr(scan, "ROWS", 64)
    monkeypatch.setattr(scan, "RARE", 9, raising=False)
    r = random.Random(11)
    says = lambda k: " ".join([*r.sample(["see", "handle", "file", "in", "m1", "m2", "ation"], k), str(r.randrange(10_000))])
    rows = [(str(i), says(1) if i % 3 == 0 else None, says(2) if i % 2 else None, says(r.randrange(5)), 0, None) for i in range(400)]
    asked = [(f"q{i}", says(r.randrange(6)) + " see" * (i % 2)) for i in range(300)]
    a = spark.createDataFrame(rows, "artifact_id string, title string, search_text string, body_text string, valid_from_seq int, invalidated_at_seq int").repartition(1)
    q = spark.createDataFrame(asked, "query_id string, query_text string")
    every = sorted({t for _, x in asked for t in x.split()})
    weight = {(x[0], t): sum(w for k, w in ((1, 4.0), (2, 1.5), (3, 1.0)) if x[k] and t in x[k]) for x in rows for t in every}
    gain = {t: math.log(401 / (sum(weight[x[0], t] > 0 for x in rows) + 1)) + 1 for t in every}
    told = set()
    for i, said in asked:
        tokens = list(dict.fromkeys(said.split()))
        scores = [(round(sum(gain[t] * weight[x[0], t] for t in tokens), 6), x[0]) for x in rows]
        told |= {(i, x, s, k) for k, (s, x) in enumerate(sorted((y for y in scores if y[0] > 0), key=lambda y: (-y[0], y[1]))[:5], 1)}
    assert {(x["query_id"], x["artifact_id"], x["score"], x["rank"]) for x in registry.keyword_search(q, a, 4, 5).collect()} == told
    kept = scan.best_scores(scan.scanned_hits(every, a), registry.query_tokens(q), gain, every, 5)
    assert kept.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 + 9
    last, depth, parent, whole = scan.prefixes([[7, 3, 1], [7, 3], [], [7, 2], [4]])
    assert (last, depth, parent, whole) == ([7, 3, 1, 2, 4], [0, 1, 2, 1, 0], [-1, 0, 1, 0, -1], [2, 1, -1, 3, 4])


def test_pieces_of_runs_as_numbers():
    """Words of up to 70 characters in runs, some of one number's length and just over it, against the plain search; blocks keep to their rows and hits."""
    import pyarrow as pa

    from tessera.operators import scan

    r = random.Random(3)
    some = lambda n: "".join(r.choice("ab01") for _ in range(n))
    words = sorted({some(r.choice([1, 2, 3, 5, 11, 12, 13, 14, 30, 70])) for _ in range(300)})
    runs = [some(r.randrange(1, 200)) + r.choice(words) + some(r.randrange(3)) for _ in range(200)]
    assert [sorted(set(x.tolist())) for x in scan.cutter(words)(runs)] == [[i for i, w in enumerate(words) if w in x] for x in runs]
    assert [x.tolist() for x in scan.cutter([])(["abc"])] == [[]] and scan.cutter(words)([]) == []
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(30)]), pa.array([[0] * (i % 4 or 9) for i in range(30)], pa.list_(pa.int32()))], ["id", "places"])
    got = list(scan.blocks(iter([batch, batch]), 7, 8))
    assert sorted(x for b in got for x in b["id"].to_pylist()) == sorted([str(i) for i in range(30)] * 2)
    assert all(b.num_rows <= 7 and (b.num_rows == 1 or sum(map(len, b["places"].to_pylist())) <= 8) for b in got)


def test_runs_holding_slices_long_runs(spark):
    """A run of 200,000 letters and digits and short ones; tokens at its start, over borders of slices, at its end."""
    r = random.Random(5)
    long = "".join(r.choice("abcdeé0123😀") for _ in range(200_000))
    runs = [long, "abc0", "zz", "", long[:600]]
    tokens = sorted({long[:7], long[250:262], long[511:513], long[-9:], long[1000:1300], "abc0", "bc", "zz", "zzz", "nothere"})
    df = spark.createDataFrame([(x,) for x in runs], "run string")
    got = {(x["run"], x["token"]) for x in matching.runs_holding(df, spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert got == {(x, t) for x in runs for t in tokens if t in x}
