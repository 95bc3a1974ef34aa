"""Needles in texts by neighbouring runs, and the bound on named partners (F2)."""

import random

import pytest

from tessera.operators import linking, matching

NEEDLES = ["ab cd", "b c", "b cd e", " ab", "ab.", "x", "zz", "--", "a1/b2_c3.py", "b2_c", "é ü", "ab  cd", "cd e ", "\\E x", "", None, "ab cd"]
TEXTS = ["ab cd ef", "xab cdx e", "ab  cd e f", "a1/b2_c3.py", "xé ü", "--", "", None, "ab. cd", "b c b c b cd e", "q\\E x", "cd e"]


def test_strings_in_texts(spark):
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "text_id int, text string")
    got = sorted((r["text_id"], r["needle"]) for r in matching.strings_in_texts(needles, texts).collect())
    assert got == sorted((i, n) for i, t in enumerate(TEXTS) for n in {n for n in NEEDLES if n} if t is not None and n in t)


def test_named_partners_are_bounded_by_text(spark):
    """Before, each of the 300 texts met each of the 300 artifacts of that title: 90,000 rows."""
    needles = spark.createDataFrame([(f"{i:03}", "card" if i < 300 else "doc", "same title" if i < 300 else "") for i in range(600)], "artifact_id string, domain string, needle string")
    named = spark.createDataFrame([(f"{i:03}", "same title") for i in range(600)], "a string, needle string")
    hubs = spark.createDataFrame([("599",)], "artifact_id string")
    got = linking._named_partners(named, needles, hubs, 5).distinct().collect()
    of = {}
    for r in got:
        of.setdefault(r["a"], set()).add(r["b"])
    assert set(of) == {f"{i:03}" for i in range(300, 600)}
    assert all(of[a] == {f"{i:03}" for i in range(5)} for a in of if a != "599")
    assert len(of["599"]) == 300


@pytest.mark.parametrize("at_once", [3, 60, 2_000_000])
def test_scan_finds_what_stands_in_texts(monkeypatch, at_once):
    """before, neighbouring runs of all texts were shuffled and joined with those of needles."""
    monkeypatch.setattr(matching, "LOOKED_UP_AT_ONCE", at_once)
    r = random.Random(at_once)
    made = lambda k: "".join(r.choice(["a", "b", "ab", "ba", "é", "1", "aa"]) + r.choice([" ", "_", "/", ". ", "--", " é ", ".", ""]) for _ in range(k))
    for _ in range(60):
        texts = [(r.choice(["", " "]) + made(r.randint(0, 30))).encode() for _ in range(20)]
        needles = [n.encode() for n in sorted({r.choice(["", "."]) + made(r.randint(1, 4)) for _ in range(30)})]
        text, which = matching._scanned(texts, needles, matching._scanner(needles))
        assert sorted(zip(text.tolist(), which.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if n in t]


def test_scan_and_joins_agree(spark, monkeypatch):
    r = random.Random(4)
    words = ["the", "and", "then", "bathe", "x1", "é", "—", "日本", "a"]
    made = lambda k: "".join(r.choice(words) + r.choice([" ", "-", "/", "—", "  "]) for _ in range(k)).strip()
    texts = spark.createDataFrame([(i, made(r.randint(0, 40)) or None) for i in range(60)], "text_id int, text string")
    needles = spark.createDataFrame([(n,) for n in ["", "----", "—", "- ", "the", "日本", *(made(r.randint(1, 3)) for _ in range(60))]], "needle string")
    monkeypatch.setattr(matching, "SCANNED_AT_ONCE", 100)
    ask = lambda: sorted(tuple(x) for x in matching.strings_in_texts(needles, texts).collect())
    scanned = ask()
    assert "Exchange" not in matching._by_scan(needles.where("needle <> '' and needle rlike '[a-z]'"), texts)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "SMALL", 0)
    assert ask() == scanned and len(scanned) > 300


def test_an_artifact_is_offered_as_many_more_as_it_has_links(spark):
    """before, each artifact was offered 60 partners by folder, overlap and name, links or not."""
    rows = [(f"a{i:04}", "code" if i % 2 else "doc", ["hot", f"t{i}"], 2, "src/hot") for i in range(400)]
    sets = spark.createDataFrame(rows, "artifact_id string, domain string, tokens array<string>, n int, folder string")
    hubs = spark.createDataFrame([], "artifact_id string")
    taken = spark.createDataFrame([("a0007", 3)], "artifact_id string, links long")
    for made in (linking._overlap_partners(sets, hubs, 10, 100, taken, 50), linking._folder_partners(sets, hubs, 10, taken, 50)):
        n = {x["a"]: x["count"] for x in made.groupBy("a").count().collect()}
        assert n.pop("a0007") == 13 and len(n) == 399 and set(n.values()) == {10}
