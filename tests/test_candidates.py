"""Candidate pairs against brute force, with hot tokens, hot folders and hubs."""

import random
import re

import pytest

from tessera.operators import linking

KIND = "artifact_id string, artifact_type string, title string, body_text string, path string, external_id string, source_type string"


def domain(r):
    if r[6] == "git_metadata":
        return "commit"
    return "card" if r[6] == "ado_card" else "doc" if r[6] in ("azure_wiki", "github_doc") else "code"


def brute(rows, existing, similar):
    known = {frozenset(x) for x in existing}
    sets = {r[0]: {t for t in re.split("[^a-z0-9]+", " ".join(x for x in (r[2], r[4], r[5]) if x).lower()) if len(t) >= 3} for r in rows}
    out = {}
    for x in rows:
        found = []
        for y in rows:
            if domain(x) == domain(y) or frozenset((x[0], y[0])) in known:
                continue
            signals = {}
            both = sets[x[0]] | sets[y[0]]
            if both and len(sets[x[0]] & sets[y[0]]) / len(both) >= 0.1:
                signals["token_overlap"] = len(sets[x[0]] & sets[y[0]]) / len(both)
            needle = (y[4] or y[2] or "").lower()
            if len(needle) >= 4 and needle in (x[3] or "").lower():
                signals["section_proximity"] = 0.6
            if x[4] and y[4] and "/" in x[4] and "/" in y[4] and x[4].rsplit("/", 1)[0] == y[4].rsplit("/", 1)[0]:
                signals["path_colocation"] = 0.4
            if similar.get((x[0], y[0]), 0) >= 0.8:
                signals["embedding_similarity"] = similar[x[0], y[0]]
            if signals:
                found.append((-max(signals.values()), y[0], signals))
        for score, b, signals in sorted(found, key=lambda f: f[:2])[:10]:
            out[x[0], b] = (round(-score, 9), {k: round(v, 9) for k, v in signals.items()})
    return out


@pytest.mark.parametrize(("hot", "links"), [(4, 3), (100, 50)])
def test_pairs_are_those_of_brute_force(spark, hot, links):
    r = random.Random(12)
    kinds = [("code_file", "github_code"), ("summary", "github_doc"), ("commit", "git_metadata"), ("concept", "ado_card")]
    rows = []
    for i in range(160):
        kind, source = r.choice(kinds)
        words = " ".join(r.choice(["common", "shared", "often", f"rare{r.randint(0, 40)}", f"only{i}", "mid%d" % r.randint(0, 6)]) for _ in range(r.randint(0, 5)))
        path = r.choice([None, f"src/hot/f{i}.py", f"src/m{r.randint(0, 9)}/f{i}.py"])
        rows.append((f"a{i:03}", kind, words or None, r.choice([None, "", f"see src/hot/f{r.randint(0, 159)}.py and common things"]), path, r.choice([None, f"AB#{i}"]), source))
    ids = [x[0] for x in rows]
    existing = [tuple(r.sample(ids, 2)) for _ in range(60)] + [("a007", x) for x in r.sample(ids, 30) if x != "a007"]
    similar = {tuple(r.sample(ids, 2)): r.choice([0.5, 0.8, 0.95]) for _ in range(60)}
    got = linking.candidate_pairs(
        spark.createDataFrame(rows, KIND), spark.createDataFrame(existing, "a string, b string"), spark.createDataFrame([(a, b, x) for (a, b), x in similar.items()], "a string, b string, similarity double"), hot=hot, links=links
    )
    got = {(x["from_artifact_id"], x["to_artifact_id"]): (round(x["score"], 9), {k: round(v, 9) for k, v in x["signals"].items()}) for x in got.collect()}
    assert got == brute(rows, existing, similar)


def test_a_hot_token_makes_no_square(spark):
    """4,000 artifacts share a token, a folder and nothing else."""
    rows = [(f"a{i:04}", "code_file", f"common t{i:04}", None, f"src/hot/f{i:04}.py", None, "github_code" if i % 2 else "github_doc") for i in range(4000)]
    df = spark.createDataFrame(rows, KIND)
    none = spark.createDataFrame([], "a string, b string")
    sets = df.selectExpr("artifact_id", "IF(source_type = 'github_doc', 'doc', 'code') AS domain", "filter(split(concat_ws(' ', title, 'src hot'), ' '), t -> length(t) > 2) AS tokens", "'src/hot' AS folder").selectExpr("*", "size(tokens) AS n")
    hubs = spark.createDataFrame([], "artifact_id string")
    assert linking._overlap_partners(sets, hubs, 60, 100).count() <= 4000 * 60
    assert linking._folder_partners(sets, hubs, 60).count() <= 4000 * 60
    assert linking.candidate_pairs(df, none).count() == 40_000


def test_titles_meet_only_texts_with_their_neighbouring_words(spark, monkeypatch):
    """Titles of two frequent words: texts that hold the words apart are no candidates; borders, case and odd titles as by their rules."""
    made = {}
    monkeypatch.setattr(linking, "written", lambda d, name, write=linking.written: made.setdefault(name, write(d, name)))
    titles = [(1, "The and", "phrase"), (2, "the AND", "phrase"), (3, "-and then", "phrase"), (4, "a.b", "symbol"), (5, "src/x.py", "path"), (6, "one", "symbol"), (7, "!!", "phrase"), (8, "and the.", "phrase"), (9, None, "phrase"), (10, "x\\Ey z", "symbol")]
    texts = [(1, "so the and more"), (2, "bathe andes; the, and"), (3, "THE AND"), (4, "x-and then"), (5, " -and then"), (6, "use a.b and c"), (7, "c.a.b or a.bc"), (8, "in src/x.py now"), (9, "in /src/x.py"), (10, "one"), (11, None), (12, "and the.y"), (13, "and the. "), (14, "q x\\Ey z"), (15, "none")]
    texts += [(100 + i, f"the w{i} and v{i}") for i in range(200)]
    told = {(1, 1), (2, 1), (1, 3), (2, 3), (3, 4), (4, 6), (5, 8), (6, 10), (8, 12), (10, 14)}
    got = linking.titles_in_texts(spark.createDataFrame(titles, "title_id int, title string, rule string"), spark.createDataFrame(texts, "text_id int, text string"))
    assert {tuple(r) for r in got.collect()} == told and got.count() == len(told)
    assert made["having"].where("text_id >= 100").isEmpty()


def test_bodies_are_searched_once_and_sure_phrases_need_no_pattern(spark, monkeypatch):
    """before, bodies were cut into runs for phrases and again for symbols and paths, and each candidate had a pattern of its own."""
    made = []
    monkeypatch.setattr(linking, "written", lambda d, name, write=linking.written: made.append(name) or write(d, name))
    rows = [("c1", "concept", "The And", "none", None, None, "ado_card"), ("c2", "concept", "Stra\u00dfe \u00c9t\u00e9", "x", None, None, "ado_card"), ("c3", "concept", "i the", "y", None, None, "ado_card")]
    rows += [("s1", "code_symbol", "run_it", None, None, None, "github_code"), ("f1", "code_file", "src/a.py", None, None, None, "github_code")]
    bodies = ["so THE and more", "the and", "bathe and", "the\nand", "the and.", "(the and)", "the ands", "in stra\u00dfe \u00e9t\u00e9 now", "\u0130 the x", "I THE", "run_it src/a.py", "Run_it"]
    rows += [(f"d{i:02}", "summary", None, b, None, None, "ado_card" if i % 2 else "github_doc") for i, b in enumerate(bodies)]
    got = sorted((r["from_artifact_id"], r["to_artifact_id"], r["edge_type"]) for r in linking.phrase_links(spark.createDataFrame(rows, KIND)).collect())
    told = [(f"d{i:02}", "c1") for i in (0, 1, 4, 5)] + [("d07", "c2"), ("d09", "c3")]
    assert got == sorted([(a, b, "requests" if int(a[1:]) % 2 else "documents") for a, b in told] + [("d10", "s1", "mentions"), ("d10", "f1", "mentions")])
    assert made.count("having") == 2
