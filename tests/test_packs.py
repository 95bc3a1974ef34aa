"""Packs, replays, reviews, files and sinks against brute force or literal cases."""

import math
import os
import random
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import builds, claims, ledger, linking, packs, reviews
from tessera.plans import packs as pack_plans
from tessera.sources import files, sinks
from tessera.sources.registry import table

SF = "/root/testdata/sf0.001"


def cosine(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    norm = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
    return sum(n * b[t] for t, n in a.items()) / norm if norm else 0.0


def test_collapse_is_greedy_in_order(spark):
    said = ["a b c d", "a b c d e", "x y", "", "", "a b c d", "x y z w v", "e d c b a"]
    rows = [(q, f"r{i}", i, t) for q in (1, 2) for i, t in enumerate(said[q - 1 :])]
    got = {(r["query_id"], r["artifact_id"]): r["kept_id"] for r in packs.collapse_near_dupes(spark.createDataFrame(rows, "query_id long, artifact_id string, place int, dedupe string"), 0.85).collect()}
    told = {}
    for q in (1, 2):
        kept = []
        for qq, i, _, t in rows:
            if qq == q:
                of = next((k for k, u in kept if cosine(t, u) >= 0.85), None)
                if of is None:
                    kept.append((i, t))
                told[q, i] = of or i
    assert got == told


def test_cards_keep_access_order_and_bound(spark):
    q, a, s = (table(spark, SF, t) for t in pack_plans.S)
    got = pack_plans._cards(q, a, s).collect()
    acl = {r["source_id"]: r["acl_teams"] for r in s.collect()}
    assert got and all(not acl[r["artifact_id"]] or "team_a" in acl[r["artifact_id"]] for r in got)
    by = Counter(r["query_id"] for r in got)
    assert max(by.values()) <= packs.CARDS
    for n in by:
        mine = sorted((r for r in got if r["query_id"] == n), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        keys = [(r["confidence"], r["authority"]) for r in mine]
        assert keys == sorted(keys, reverse=True)


def brute_policy(rows, most, tokens, budget):
    """Rows: run, agent, teams, id, time, query, asked, cards."""
    out, runs = {}, {}
    for run, agent, teams, rid, _, query, asked, cards in sorted(rows, key=lambda r: (r[4], r[3])):
        st = runs.setdefault(run, {"asked": [], "used": {}, "left": budget})
        n, t = st["used"].get(agent, (0, 0))
        norm = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split())
        offers = [("exact_reuse", ev) for q, ev in st["asked"] if q == norm][:1]
        near = sorted(((-cosine(norm, q), i) for i, (q, _) in enumerate(st["asked"]) if cosine(norm, q) >= 0.9))
        offers += [("semantic_reuse", st["asked"][near[0][1]][1])] if near else []
        for what, ev in offers:
            seen = [i for i, acl in ev if not acl or set(acl) & set(teams)]
            if seen or not ev:
                out[rid] = (what, seen, 0)
                break
        else:
            if n + 1 > most:
                out[rid] = ("denied_requests", [], 0)
            elif t + asked > tokens:
                out[rid] = ("denied_tokens", [], 0)
            elif asked > st["left"]:
                out[rid] = ("needs_human_approval", [], 0)
            else:
                had = {i for _, ev in st["asked"] for i, _ in ev}
                got, cost = [], 0
                for i, c, acl in cards:
                    if i not in had:
                        if cost + c > asked:
                            break
                        got.append((i, acl))
                        cost += c
                out[rid] = ("approved", [i for i, _ in got], cost)
                st["asked"].append((norm, got))
                st["used"][agent] = (n + 1, t + cost)
                st["left"] -= cost
    return out


def test_request_policy_filters_evidence_for_the_next_requester(spark):
    r = random.Random(6)
    words = ["please find the retry queue of orders", "Please find the retry queue of orders!", "please find the retry queue of orders now", "who owns orders", "what calls pay", "why", "how", "which team has pages"]
    rows = []
    for i in range(150):
        team = r.choice(["a", "b"])
        cards = [(f"c{r.randint(0, 12)}", r.choice([5, 20, 40]), r.choice([[], ["a"], ["b"], ["a", "b"]])) for _ in range(r.randint(0, 3))]
        cards = [c for c in {c[0]: c for c in cards}.values() if not c[2] or team in c[2]]
        rows.append((f"run{i % 10}", f"agent{r.randint(0, 1)}{team}", [team], f"id{i:03}", i // 2, r.choice(words), r.choice([30, 60, 90]), cards))
    kind = "run_id string, agent_name string, teams array<string>, retrieval_id string, created_at long, query_text string, asked_tokens long, cards array<struct<artifact_id: string, tokens: long, acl_teams: array<string>>>"
    got = packs.request_policy_replay(spark.createDataFrame(rows, kind), 2, 110, 190)
    told = brute_policy(rows, 2, 110, 190)
    assert {x["retrieval_id"]: (x["outcome"], x["evidence_ids"], x["tokens"]) for x in got.collect()} == told
    assert len({w for w, _, _ in told.values()}) >= 5


def test_openings_charge_run_and_agent(spark):
    bodies = spark.createDataFrame([("x", "a" * 400), ("y", "b" * 80), ("z", None)], "artifact_id string, body_text string")
    asks = [("1", "r", "p", 1, "x", 50), ("2", "r", "p", 2, "x", 60), ("3", "r", "q", 3, "x", 60), ("4", "r", "q", 4, "y", 90), ("5", "r", "p", 5, "z", 10), ("6", "s", "p", 0, "x", 100), ("7", "r", "p", 9, "gone", 1)]
    out = packs.open_evidence(spark.createDataFrame(asks, "request_id string, run_id string, agent_name string, created_at long, artifact_id string, max_tokens long"), bodies, 115, 100)
    got = {r["request_id"]: (r["status"], r["tokens"], r["run_left"], len(r["content"] or "")) for r in out.collect()}
    assert got == {"1": ("approved", 50, 65, 200), "2": ("denied_agent", 0, 65, 0), "3": ("approved", 60, 5, 240), "4": ("denied_run", 0, 5, 0), "5": ("approved", 0, 5, 0), "6": ("approved", 100, 15, 400)}


def test_budget_skip_takes_later_items(spark):
    items = spark.createDataFrame([("t", 1, 60), ("t", 2, 50), ("t", 3, 40), ("t", 4, 1), ("u", 1, 101)], "g string, n int, cost long")
    assert sorted((r["g"], r["n"]) for r in ledger.budget_skip(items, 100, "g", ("n",), "cost").collect()) == [("t", 1), ("t", 3)]


def test_findings_merge_into_growing_words(spark):
    f = [
        (0, "bug", 0, "minor", "null check missing in parse order handler", ["e1"]), (1, "security", 0, "blocker", "null check missing in parse order handler loop", ["e2"]),
        (2, "quality", 0, "note", "check missing in parse order handler loop", ["e1"]), (2, "quality", 1, "note", "naming is odd", ["e3"]),
    ]
    df = spark.createDataFrame([("r1", *x) for x in f], "review_id string, lens_order int, lens string, n int, severity string, finding string, evidence_ids array<string>")
    merged = reviews.reconcile_findings(df)
    got = [(r["place"], r["severity"], r["finding"], r["evidence_ids"], r["lenses"]) for r in merged.orderBy("place").collect()]
    assert got == [(1, "blocker", f[1][4], ["e1", "e2"], ["bug", "quality", "security"]), (2, "note", "naming is odd", ["e3"], ["quality"])]
    assert merged.where("place = 1").first()["disagreement"] == "severity disputed (bug=minor, quality=note, security=blocker); highest kept"
    body = reviews.render_comments(merged).where("place = 2").first()["body"]
    assert body == "**[note]** naming is odd\nEvidence: `e3` (lenses: quality)"
    r = spark.createDataFrame([("r1", "repo#7", "approve", 3), ("r2", "repo#8", "approve", 1)], "review_id string, title string, verdict string, lenses int")
    q = spark.createDataFrame([("r1", 1, "why?"), ("r1", 2, "how?"), ("r1", 3, "why?")], "review_id string, n int, question string")
    out = {x["review_id"]: x["markdown"] for x in reviews.render_summaries(r, merged, q).collect()}
    assert out["r1"].endswith("### Open questions\n- why?\n- how?") and "1. **[blocker]**" in out["r1"] and "No findings from any lens." in out["r2"]


def test_text_tree_and_commit_log(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for p in ("src/a/b.py", "src/c.py", "src/a/deep/d.py", ".git/x.py", "node_modules/y.py", "src/skip/e.py", "readme.md", "src/.hid/f.py"):
        os.makedirs(os.path.dirname(f"{root}/{p}") or root, exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(f"text of\n{p}")
    got = {r["path"]: r["text"] for r in files.read_text_tree(spark, root, ["src/**/*.py"], ["src/skip/*"]).collect()}
    assert got == {p: f"text of\n{p}" for p in ("src/a/b.py", "src/c.py", "src/a/deep/d.py")}
    only = spark.createDataFrame([("a.py",), ("b/a.py",), ("ab.py",)], "path string").where(files.path_kept(F.col("path"), ["?.py"], []))
    assert [r["path"] for r in only.collect()] == ["a.py"]
    log = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{log}/log.txt", "w") as f:
        f.write("s1\x1fsubject one\x1fbody\nline\x1fb.py\na.py\nb.py\x1e\ns2\x1fsubject two\x1e\n")
    rows = files.read_commit_log(spark, f"{log}/log.txt").orderBy("sha").collect()
    assert [tuple(r) for r in rows] == [("s1", "subject one", "body\nline", ["a.py", "b.py"]), ("s2", "subject two", "", [])]


def test_commit_text_round_trip_is_not_poisoned(spark):
    df = spark.createDataFrame([("s", "text\n--- changed files ---\nfake.py", ["b.py", "a.py"]), ("only", None, [])], "subject string, body string, files array<string>")
    got = df.select(text.parse_changed_files(text.render_commit(F.col("subject"), F.col("body"), F.col("files"))).alias("x"), text.parse_changed_files(F.col("subject")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == [(["a.py", "b.py"], []), ([], [])]


def test_sinks_write_the_same_twice(spark):
    a, e, s = (table(spark, SF, t) for t in ("knowledge_artifact", "doc_edge", "source_item"))
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = a.select("artifact_id", "artifact_type", "title")
    for _ in range(2):
        sinks.write_search_docs(docs, f"{where}/docs")
        back = spark.read.parquet(f"{where}/docs").select("artifact_id", F.col("artifact_type").cast("string"), "title")
        assert back.exceptAll(docs).isEmpty() and back.count() == docs.count()
    notes = sinks.export_notes(a, e, s, 4)
    assert notes.count() == notes.select("folder", "slug").distinct().count()
    sinks.write_notes(notes, f"{where}/notes")
    one = notes.where("markdown like '%- to %'").first()["markdown"]
    assert one.startswith("---\nid: ") and "## Links" in one and "[[" in one


def test_slugs(spark):
    df = spark.createDataFrame([("Héllo, Wörld! ",), ("日本",), ("a" * 90,), (None,)], "t string")
    assert [r[0] for r in df.select(text.slugify(F.col("t"), F.lit("none"))).collect()] == ["hello-world", "none", "a" * 80, "none"]


def test_titles_keep_their_borders(spark):
    titles = spark.createDataFrame([(1, "get_user", "symbol"), (2, "src/a.py", "path"), (3, "Order Queue", "phrase"), (4, "C++", "symbol")], "title_id int, title string, rule string")
    texts = ["get_user()", "get_user_embedding", "Service.get_user", "other/src/a.py", "in src/a.py now", "the order queue.", "border queue", "reorder queues", "C++ here", "xC++", None]
    got = linking.titles_in_texts(titles, spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"))
    assert sorted((r["title_id"], r["text_id"]) for r in got.collect()) == [(1, 0), (2, 4), (3, 5), (4, 8)]


def test_build_twice_changes_nothing(spark):
    a, e, s = (table(spark, SF, t) for t in ("knowledge_artifact", "doc_edge", "source_item"))
    snapshot = s.where(~F.col("is_deleted"))
    arts, edges, sources = builds.apply_build(a, e, s, snapshot, 9, 10**9)
    for before, after in ((a, arts), (e, edges), (s, sources)):
        cols = [c for c in before.columns]
        b, c = before.select(cols), after.select(cols)
        assert b.exceptAll(c.select(*(F.col(f.name).cast(f.dataType) for f in b.schema))).isEmpty()


def test_renamed_artifact_takes_its_edges(spark):
    a = spark.createDataFrame([("o", "s1", None), ("n", "s2", None), ("x", "s3", None)], "artifact_id string, source_id string, invalidated_at_seq long")
    e = spark.createDataFrame([("o", "x", "m", None), ("o", "n", "m", None), ("x", "o", "m", 3)], "from_artifact_id string, to_artifact_id string, edge_type string, invalidated_at_seq long")
    pairs = spark.createDataFrame([("o", "n")], "old_id string, new_id string")
    arts, edges, gone = builds.apply_renames(a, e, pairs, 5)
    assert sorted(map(tuple, edges.collect()), key=str) == sorted([("n", "x", "m", None), ("o", "n", "m", 5), ("x", "o", "m", 3)], key=str)
    assert {r["artifact_id"]: (r["invalidated_at_seq"], r["prior_artifact_id"]) for r in arts.collect()} == {"o": (5, None), "n": (None, "o"), "x": (None, None)}
    assert [r["source_id"] for r in gone.collect()] == ["s1"]


def test_ledger_rules(spark):
    """Thin answers count for searches, tokens per run leave out run-less rows, follow-ups count when charged."""
    cols = "retrieval_id string, created_at timestamp, run_id string, agent_name string, tool_name string, status string, query_text string, returned_artifact_ids array<string>, cache_hit boolean, semantic_reuse boolean, tokens_returned long, reused_evidence_ids array<string>, new_evidence_ids array<string>"
    row = lambda i, run, tool, status, ids, tokens: (str(i), __import__("datetime").datetime(2024, 1, 1, 0, i), run, "a", tool, status, "q", ids, False, False, tokens, [], [])
    e = spark.createDataFrame([
        row(1, "r", "context.create_pack", "approved", ["x"], 10), row(2, "r", "context.open_evidence", "approved", ["x"], 7), row(3, "r", "context.open_evidence", "approved", ["x"], 5),
        row(4, "-", "kb_search", "approved", [], 100), row(5, "r", "context.request_more", "denied", [], 0), row(6, "r", "context.request_more", "approved", ["y"], 3000),
        row(7, "s", "context.create_pack", "denied", ["z"], 0), row(8, "s", "context.create_pack", "approved", ["z"], 4), row(9, "s", "context.open_evidence", "denied", ["z"], 0), row(10, "s", "context.open_evidence", "approved", ["z"], 6),
    ], cols)
    h = ledger.retrieval_health_daily(e).first()
    assert (h["kb_search_answered"], h["kb_search_zero_thin"], h["events"]) == (1, 1, 10)
    assert ledger.token_economics_daily(e).first()["context_tokens_per_run"] == (10 + 7 + 5 + 3000 + 4 + 6) / 2
    b = ledger.budget_adherence(e, spark.createDataFrame([("b", 1, 1)], "agent_name string, max_requests int, max_tokens int")).where("run_id = 'r'").first()
    assert (b["follow_up_requests"], b["follow_up_tokens"], b["over_agent_requests"], b["over_agent_tokens"]) == (1, 3000, False, True)
    # Opening a carded id is new, opening it again isn't; a denied card still counts as delivered.
    assert {r["run_id"]: (r["calls"], r["tokens"]) for r in ledger.duplicate_tokens(e).collect()} == {"r": (1, 5), "s": (1, 4)}


def test_receipt_folds_levels(spark):
    c = spark.createDataFrame([(i,) for i in range(5)], "claim_id int")
    level = lambda passed: spark.createDataFrame([(i, i not in passed, ["r"] if i in passed else []) for i in range(5)], "claim_id int, passed boolean, reasons array<string>")
    l2 = spark.createDataFrame([(2, False), (4, True)], "claim_id int, passed boolean")
    l3 = spark.createDataFrame([(3, False), (4, False)], "claim_id int, entailed boolean")
    got = {r["claim_id"]: (r["passed"], r["reasons"]) for r in claims.receipt(c, level({0}), level({1}), l2, l3).collect()}
    assert got == {0: (False, ["r"]), 1: (False, ["r"]), 2: (False, ["typed_fact_unsupported"]), 3: (False, ["not_entailed"]), 4: (True, [])}
