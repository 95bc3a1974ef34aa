"""Operators 11 to 13 against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import best_fit, filter_audit, merkle
from tessera.llm.queries import byte_tokenizer_path
from tessera.llm.token_ids import ByteIds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- 11

def brute_audit(docs, labels):
    """docs: (doc_id, text, part)."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rank = lambda i: (i is None, i or 0)
    out = {}
    for part in {p for _, _, p in docs}:
        rows = []
        for i, t, p in docs:
            if p != part:
                continue
            w = WORD.findall(t)
            fails = {
                "A": len(w) < 200,
                "B": 100 * len(set(w)) < 50 * len(w),
                "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": any(u == t and rank(j) < rank(i) for j, u, _ in docs),
            }
            rows.append((i, {f for f in fails if fails[f]}))
        removed_of = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_of[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_of[order[step - 1]])
    return out


def test_audit_counts_every_step(spark):
    r = random.Random(3)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [long, long + " #", "few words", "SHOUT " * 250, None, "", "a b " * 120, long.upper(), long + " tail", "ünï " * 201]
    docs = [(i, r.choice(texts), r.choice(["x", "y", None, ""])) for i in range(90)]
    docs += [(None, texts[0], "x"), (None, texts[0], "y"), (None, "only without an id", "x"), (None, "only without an id", "x"), docs[5], docs[5], (7, texts[0], "z")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, digest string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(df, told).collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), told).count() == 0
    assert filter_audit.audit(df, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_a_long_text_and_many_parts(spark):
    rows = [(i, "same text", f"part {i % 40}") for i in range(400)] + [(1000, "word " * 400_000 + "#", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), held=3)
    first = {r["part"]: r for r in got.where("filter_order = 'EDBAC' AND step = 1").collect()}
    assert sum(r["removed"] for r in first.values()) == 399 and first["part 0"]["kept"] == 1 and len(first) == 41
    assert got.where("part = 'long' AND filter_order = 'BADCE' AND step = 3").first()["redundant"] == 1


def test_wide_counters_do_not_run_over():
    one = filter_audit.outcomes(0b10011, True, False)
    counts = filter_audit.unpack(one * (2**62) + filter_audit.outcomes(0, False, True))
    kept, removed, redundant, alone, good, toxic = counts
    at = filter_audit.ORDERS.index("EABCD")
    assert removed[at].tolist() == [2**62, 0, 0, 0, 0] and redundant[at].tolist() == [0, 2**62, 2**62, 0, 0]
    assert kept[at].tolist() == [1] * 5 and not alone.any() and (good == removed).all() and not toxic.any()


# -- 12

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    """docs: (doc_id, source, lang, n_chars, text) in order of ids; proofs and versions by hand."""
    def leaf(d):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in d))

    def climb(nodes, at, mine):
        sides, h = [], mine
        while len(nodes) > 1:
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            sides += [x for k, x in enumerate(run) if k != at % 8]
            h = h and sha(*(h if k == at % 8 else x for k, x in enumerate(run)))
            nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
            at //= 8
        return nodes[0], sides, h

    by = collections.defaultdict(list)
    for d in docs:
        by[d[2]].append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: [leaf(d) for d in by[x]] for x in langs}
    subroots = [climb(of[x], 0, None)[0] for x in langs]
    out = {}
    for k, x in enumerate(langs):
        for at, d in enumerate(by[x]):
            changed = d
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[4] is not None:
                changed = (*d[:4], d[4].translate({c: c + 32 for c in range(65, 91)}))
            _, low, h = climb(of[x], at, leaf(changed))
            root, high, h = climb(subroots, k, h)
            out[d[0]] = (of[x][at], subroots[k], root, sha(*low, *high), h)
    return out


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_proofs_and_versions(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "STRETCH", 2)
    r = random.Random(4)
    langs = [None, "", "en", "de", "ü", "lone", *(f"l{i}" for i in range(9))]
    docs = [(i, r.choice(["web", None, ""]), "en" if i % 2 else r.choice(langs[:5]), r.choice([None, i]), r.choice([None, "", f"Text {i} ÀB", f"small {i}"])) for i in range(-3, 1300)]
    docs += [(2000 + i, None, x, None, "One") for i, x in enumerate(langs[5:])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    made = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, depth=depth)
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], sha(r["proof"]), r["folded_root"]) for r in made.collect()}
    assert got == brute_manifest(docs)
    assert {got[2000][0]} == {got[2000][1]}


def test_manifest_of_nothing_nulls_and_repeats(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame([(None, None, None, None, None), (None, "a", None, 1, "B"), (5, "a", None, 1, "Same"), (5, "a", None, 1, "Same"), (6, "a", None, 1, "x" * 200_000)], kind)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = merkle.manifest(df, tampered).collect()
    assert len(rows) == 5 and len({r["root"] for r in rows}) == 1
    assert {r["folded_root"] == r["root"] for r in rows if r["doc_id"] is None} == {True}
    same = [r for r in rows if r["doc_id"] == 5]
    assert same[0]["leaf"] == same[1]["leaf"]
    assert merkle.manifest(df.limit(0), tampered).count() == 0
    lone = merkle.manifest(df.where("doc_id = 6"), tampered).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof"] == ""


def test_versions_share_untouched_nodes():
    node = merkle.tree([sha(str(i)) for i in range(300)], None)
    version = merkle.copied(node, merkle.height(node), 77, sha("other"))
    assert version[0] == merkle.tree([sha("other" if i == 77 else str(i)) for i in range(300)], None)[0]

    def nodes(n):
        yield n
        for c in n[1]:
            yield from nodes(c)

    old = {id(n) for n in nodes(node)}
    assert sum(id(n) not in old for n in nodes(version)) == merkle.height(node) + 1


# -- 13

def odd_texts(n):
    r = random.Random(1)
    parts = ["a", "b ", "  ", " ", "\n", "\t", "'s", "é", "\xa0", " ", "　", "\x1c", "\x85", "<|endoftext|>", " <|", "1", "23", "!", " xyz", "日本", "\U0001f600", " Ω", "\r\n", " word", " É"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_byte_ids_equal_library():
    library = tokenizers.Tokenizer.from_file(byte_tokenizer_path())
    texts = odd_texts(1500) + ["", "x" * 20_000, "word " * 5000]
    mine = ByteIds(byte_tokenizer_path())
    for _ in range(2):
        assert [i.tolist() for i in mine.ids(pa.array(texts))] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def decreasing(sizes, capacity):
    """Number of sequences of best fit, largest first, in one go."""
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            n += 1
            gaps.append(capacity - s)
    return n


@pytest.mark.parametrize(("kind", "slack"), [("mixed", 1.03), ("tiny", 1.03), ("same", 1.01), ("middle", 1.06)])
def test_supersteps_pack_like_best_fit(spark, monkeypatch, kind, slack):
    monkeypatch.setattr(best_fit, "RANGE_ROWS", 100)
    r = np.random.default_rng(2)
    sizes = {"mixed": r.integers(1, 101, 1500), "tiny": r.integers(1, 5, 1500), "same": np.full(900, 30), "middle": r.integers(20, 42, 900)}[kind]
    rows = [(i // 2, 0, 0, int(s), 0, i) for i, s in enumerate(sizes)]
    placed = best_fit.best_fit(spark.createDataFrame(rows, best_fit.PIECE), 100).collect()
    assert sorted(p["key"] for p in placed) == list(range(len(sizes)))
    filled = collections.Counter()
    for p in placed:
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= 100
    assert len(filled) <= slack * decreasing(sizes.tolist(), 100) + 1


def test_best_fit_covers_every_id_once(spark):
    r = random.Random(7)
    texts = [*odd_texts(40), None, "", *(" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice([3, 90, 400, 1023, 1024, 2500]))) for _ in range(60)), "same text here", "same text here"]
    rows = [(None if i == 3 else i // 2 if i > 95 else i, t, 1, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, key string")
    got = best_fit.pack(df, byte_tokenizer_path()).collect()
    library = tokenizers.Tokenizer.from_file(byte_tokenizer_path())
    want = collections.Counter()
    for (i, t, *_) in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        low, high, n = 0, len(ids) % 1024 or 1024, 0
        while low < len(ids):
            want[i, n, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())] += 1
            low, high, n = high, high + 1024, n + 1
    assert collections.Counter(tuple(g)[:5] for g in got) == want
    by = collections.defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(k[3] * v for k, v in want.items()) // 1024) + 2
    assert best_fit.pack(df.limit(0), byte_tokenizer_path()).count() == 0
    assert best_fit.pack(df.where("doc_id = 40"), byte_tokenizer_path()).count() == 1


def test_runs_of_ranges_meet_the_nearest_gaps():
    ranges = [
        {"part": 0, "docs": 0, "largest": None, "gaps": 2, "smallest": 90},
        {"part": 1, "docs": 0, "largest": None, "gaps": 1, "smallest": 50},
        {"part": 2, "docs": 5, "largest": 40, "gaps": 0, "smallest": None},
        {"part": 3, "docs": 4, "largest": 10, "gaps": 0, "smallest": None},
    ]
    runs, covered = best_fit.across(ranges)
    assert runs == [(2, 0, 1, 1, 0, 1), (2, 1, 5, 0, 0, 2)] and covered == {0: 0, 1: 0, 2: 5, 3: 0}
