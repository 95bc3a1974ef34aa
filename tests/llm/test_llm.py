"""The ten operators against brute force on small tables, with nulls, empties, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, elias_fano, language_model, nearest, ngram_join, packing, pii, quality_classifier, quality_rules, substring_dedup
from tessera.llm.queries import tokenizer_path
from tessera.llm.words import split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, short and empty texts, nulls, repeated ids."""
    r = random.Random(5)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + r.choice("xyz") for _ in range(80)) for _ in range(6)]
    passage = " ".join(f"p{i}" for i in range(30))
    out = [*base, base[0], base[1].upper(), base[2] + " tail", base[3].replace(" ", "\n", 9), f"start {passage} end", f"{passage} other words here", passage]
    words = base[4].split()
    for i in range(12):
        out.append(" ".join(w if k % 20 != i else "changed" for k, w in enumerate(words)))
    out += ["", None, "one", "one two three", "x " * 60, "\t\n ", "ünï cødé \U0001f600 " * 8, "a" * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_words_of_batches():
    t = ["", "  a\x0bb ", "c", None, "d e", "é\x85f"]
    w = split(pa.array(t))
    assert [w.bytes_of(i).decode() for i in range(len(w.start))] == [x for s in t for x in WORD.findall(s or "")]
    assert np.diff(w.first).tolist() == [0, 2, 1, 0, 2, 1]
    h = w.hashes()
    assert len(set(h.tolist())) == len(h)


# -- 1

def test_chat_reads_back(spark):
    r = random.Random(1)
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (None, 0, None, None), (3, None, "assistant", "<turn:user>\n\\l")]
    for c in range(4):
        rows += [(c, i, "system" if i == 0 and c % 2 else "user" if i % 2 else "assistant", " ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows.append(rows[-1])
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, window_id int")
    windows = chat.format_windows(df, 300, 60)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, i, role, t in rows:
        by[c].append((-1 if i is None else i, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = windows.where("conv_id = 1").collect()
    assert len(many) > 3 and all(w["n_tokens"] <= 300 or w["n_new"] == 1 for w in many)
    assert all(w["formatted"].startswith("<again:system>") for w in many if w["window_id"] > 0)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_chat_long_conversation(spark):
    """One conversation of 50,000 turns, in the memory that tests have."""
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 40)).alias("text"))
    got = chat.read_back(chat.format_windows(rows)).collect()
    told, loss = hashlib.sha256(), hashlib.sha256()
    for i in range(n):
        text = f"{i}" + " word" * 40
        told.update(f"{'assistant' if i % 2 else 'user'}\n{text}\n".encode())
        if i % 2:
            loss.update(text.encode())
    assert [(r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in got] == [(n, told.hexdigest(), loss.hexdigest())]


# -- 2

def brute_components(texts, k=5):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("hot", [64, 2])
def test_jaccard_components(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs.withColumn("n", F.lit("clash"))).collect()}
    assert got == brute_components(texts)


def test_jaccard_empty_and_repeated_rows(spark):
    assert ngram_join.join_documents(empty(spark)).count() == 0
    rows = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, None)], DOCS)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.join_documents(rows).collect()) == [(-1, 4), (2, 2), (4, 4), (4, 4)]


def test_forest_spans_all_links():
    r = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    left = [np.sort(np.r_[r.choice(base, 90, replace=False), r.integers(1000, 2000, 5).astype(np.uint64)]) for _ in range(30)]
    left = [np.unique(x) for x in left]
    near = lambda a, b: 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))

    def roots(links, n):
        root = list(range(n))
        for _ in range(n):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    every = [(i, j) for i in range(30) for j in range(i) if near(left[i], left[j])]
    found = ngram_join.forest(left, None, (75, 100))
    assert roots(every, 30) == roots(found, 30) and len(found) < 30


# -- 3

def test_pii_base_spans(spark):
    t = ["mail a@b.com_x@y.zz. and a.b@c", "ip 1.2.3.4.5 999.1.1.1 0001.2.3.255", "4111 1111 1111 1111 and 1234-5678", "+1 (386) 555-3733, +12", "card 4111111111111112 é 4111111111111111", None, "", "call (386) 555-3733 now", "password=abc12345xyz", "1 " * 4000, "9" * 5000]
    df = spark.createDataFrame(list(enumerate(t)), DOCS).withColumn("kind", F.lit(1))
    got = {r["doc_id"]: r["s"] for r in pii.detect(df, keep_text=False).select("doc_id", pii.named(F.filter("spans", lambda s: s["base"])).alias("s")).collect()}
    assert [got[i] for i in range(7)] == ["email:5:12,email:12:19", "ip:3:10,ip:23:35", "card:0:19", "phone:0:17", "card:24:40", "", ""]
    more = {r["doc_id"]: r["s"] for r in pii.detect(df, pii.SpanModel()).select("doc_id", pii.named(F.col("spans")).alias("s")).collect()}
    assert more[8].startswith("secret:0:") and more[7] == "phone:5:19"
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df, pii.SpanModel()).collect()}
    assert masked[3] == "[PHONE], +12" and masked[5] is None and masked[0].startswith("mail [EMAIL][EMAIL]. and")
    assert pii.detect(df.limit(0)).count() == 0


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(t):
    """Base spans of a text, kind by kind, straight from the rules."""
    out = []
    for rank, (kind, pattern, fine) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if fine(m.group())]
    return ",".join(x for *_, x in sorted(out))


def test_pii_base_spans_of_all_documents(spark, texts):
    """The base columns of the query's operator against the rules in Python, and base spans stay."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], DOCS))
    said = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    found = pii.detect(d.withColumn("spans_", F.lit(1)), keep_text=False)
    for r in found.select("doc_id", pii.named(F.filter("spans", lambda s: s["base"])).alias("base"), pii.named(F.col("spans")).alias("all")).collect():
        assert r["base"] == brute_base(said[r["doc_id"]])
        assert set(filter(None, r["base"].split(","))) <= set(r["all"].split(","))


def test_reliabilities_are_estimated_from_votes(spark):
    """Votes drawn with known reliabilities: estimates come near them, and the classifier follows the good labelers."""
    r = random.Random(21)
    right = (0.95, 0.85, 0.7, 0.55)
    counts = collections.Counter()
    for _ in range(20_000):
        true = r.random() < 0.4
        votes = tuple((2 if true else 0) if r.random() < q else (0 if true else 2) for q in right)
        counts[votes] += 1
    rows = [(0, v, float(n)) for v, n in counts.items()]
    p, got = pii._posteriors(rows, 60)
    assert all(abs(a - b) < 0.05 for a, b in zip(got, right, strict=True))
    each = {v: q for (_, v, _), q in zip(rows, p, strict=True)}
    assert each[2, 2, 2, 2] > 0.95 and each[0, 0, 0, 0] < 0.05 and each[2, 2, 0, 0] > each[0, 0, 2, 2]
    found = spark.createDataFrame([(i % 2, *v, 0) for v, n in counts.items() for i in range(int(n) // 8)], "kind int, v0 int, v1 int, v2 int, v3 int, shape int").select(F.array(F.struct("*")).alias("c"))
    model = pii.fit(found, "c")
    spread = [w[2] - w[0] for w in model.votes]
    assert spread[0] > spread[3] and spread[1] > spread[3]


# -- 4

def test_classifier_on_held_out(spark):
    d, l = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(d.unionByName(d.limit(1).withColumn("text", F.lit(None).cast("string"))), l).join(l, "doc_id")
    out = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert out["a"] > 0.9 and 0 <= out["lo"] <= out["hi"] <= 1
    none = quality_classifier.classify(d.select("doc_id", "text"), l.limit(0))
    assert {r["score"] for r in none.select("score").distinct().collect()} == {0.5}


def test_dual_descent_finds_the_best_margin():
    """Against the objective itself, on a small dense problem: no small move of the weights is better."""
    r = np.random.default_rng(3)
    ratio = r.normal(size=12)
    x = [np.flatnonzero(r.random(12) < 0.4) for _ in range(30)]
    y = np.where(r.random(30) < 0.5, 1.0, -1.0)
    cost = np.full(30, 0.7)
    w, bias = quality_classifier._descend(x, ratio, y, cost, 3000)

    def loss(w, bias):
        margin = np.array([(w[a] @ ratio[a]) / np.sqrt(max(len(a), 1)) + bias for a in x])
        return 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - y * margin)).sum()

    best = loss(w, bias)
    assert all(best <= loss(w + s * r.normal(size=12), bias + s * r.normal()) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_classifier_of_one_class_and_clashes(spark):
    rows = [(i, "word " * (i % 7), 5, 5) for i in range(40)] + [(3, None, 1, 1), (None, "x", 1, 1)]
    d = spark.createDataFrame(rows, DOCS + ", score int, y int")
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = quality_classifier.classify(d, one).collect()
    assert len(got) == len(rows) and {round(r["score"], 6) for r in got} == {0.99}
    assert quality_classifier.classify(d.limit(0), one).count() == 0
    two = one.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    assert len(quality_classifier.classify(d, two.unionByName(two), sample_chars=60).collect()) == len(rows)


# -- 5

def test_quality_counts(spark, texts):
    t = [*texts, "a b c d e a b c d e", "x\nx\n \n\ny # $\nx", "*|* <b>"]
    df = spark.createDataFrame(list(enumerate(t)), DOCS).withColumn("n_words", F.lit("clash"))
    for r in quality_rules.judge(df, keep=["doc_id"]).collect():
        s = t[r["doc_id"]] or ""
        w = WORD.findall(s)
        seen = collections.defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in s.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    kept = quality_rules.filter_quality(df)
    assert kept.columns == df.columns and quality_rules.filter_quality(df.limit(0)).count() == 0


def test_automaton_of_few_merges():
    """Every string over two symbols has one accepted token sequence: the one that the merges give in order."""
    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("a", "a"), ("aba", "bb"), ("b#", "b#"), ("a", "b#")][:5] + [("a", "b#")]
    vocab = {}
    for s in ("a", "b", "a#", "b#", *(u + v for u, v in merges)):
        vocab.setdefault(s, len(vocab))
    auto = bpe.Automaton(vocab, merges, "#")
    for n in range(1, 11):
        for bits in range(2**n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            seq = [*word[:-1], word[-1] + "#"]
            for u, v in merges:
                i = 0
                while i < len(seq) - 1:
                    if (seq[i], seq[i + 1]) == (u, v):
                        seq[i : i + 2] = [u + v]
                    i += 1
            assert [auto.labels[x] for x in auto.encode(word)] == seq
            # Of all ways to spell the word, the automaton accepts this one alone.
            if n <= 7:
                ways = [[]]
                for at in range(n):
                    ways = [w + [x] for w in ways for x in vocab if vocab[x] not in auto.dead and (at == len("".join(w).replace("#", ""))) and (word + "#").startswith("".join(w) + x) and (x.endswith("#") or len("".join(w) + x) < n)] + [w for w in ways if len("".join(w).replace("#", "")) > at]
                whole = [w for w in ways if "".join(w) == word + "#"]
                fine = [w for w in whole if all(auto.step(vocab[p], vocab[q]) for p, q in zip(w, w[1:]))]
                assert fine == [seq]


# -- 6, 8

def test_bpe_equals_library(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library, mine = Tokenizer.from_file(path), bpe.encoder(path)
    r = random.Random(3)
    pool = [t or "" for t in texts] + ["it's WE'VE a<|endoftext|>b", "ΑΣ Σ İI", "  x 　y\x1cz", "haha" * 9, "!" * 30, "é x́"]
    pool += ["".join(r.choice("aeinorstéß'. 1_") for _ in range(r.randint(1, 25))) for _ in range(300)]
    for t in pool:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids
        assert mine.digests(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    df = spark.createDataFrame(list(enumerate(pool)), DOCS)
    assert bpe.encode_documents(df, path).where("doc_id = 0").first()["ids"] == library.encode(pool[0], add_special_tokens=False).ids
    assert bpe.digest_documents(empty(spark), path).count() == 0


def test_packing_covers_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    t = [*texts, "word " * 9000]
    rows = packing.pack(spark.createDataFrame(list(enumerate(t)), DOCS).repartition(2), path).collect()
    by, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, s in enumerate(t):
        ids = np.array([*library.encode(s or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        fill = sum(r["length"] for r in w)
        assert [r["offset"] for r in w] == [sum(x["length"] for x in w[:k]) for k in range(len(w))]
        assert fill <= 4096 and fill & (fill - 1) == 0 or fill == 4096


# -- 7

def test_nearest_against_all(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 16)).astype(np.float32) * r.uniform(0.5, 2, (600, 1)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3 + [None]), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for g in nearest.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[g["query_id"]].append((g["vec_id"], g["score"]))
    d = x.astype(np.float64)
    hit = 0
    for q in range(0, 600, 20):
        s = d @ d[q]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert len(got[q]) == 20
        np.testing.assert_allclose([v for _, v in got[q]], [s[i] for i, _ in got[q]], rtol=1e-12)
        hit += len(set(best) & {i for i, _ in got[q]})
    assert hit / (30 * 20) >= 0.9 and set(got) == set(range(0, 600, 20))
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_several_shards(spark, monkeypatch):
    """Several shards, ties across them and vectors of two lengths."""
    r = np.random.default_rng(14)
    x = r.normal(size=(900, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, r.normal(size=5).astype(np.float32).tolist()) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    v = df.select("vec_id", F.col("embedding").alias("vector"))
    graphs = nearest.index(v, 20, shard=100)
    assert graphs.count() >= 9
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = collections.defaultdict(set)
    for g in nearest.search(graphs, asked, 20, block=16).collect():
        got[g["query_id"]].add((g["score"], -g["vec_id"]))
    hit = total = 0
    said = {i: np.array(e, np.float64) for i, e in rows}
    for q, found in got.items():
        told = sorted(((float(said[q] @ e), -i) for i, e in said.items() if i != q and len(e) == len(said[q])), reverse=True)[:20]
        best = sorted(found, reverse=True)[:20]
        hit += len({b[1] for b in best} & {b[1] for b in told})
        total += len(told)
    assert len(got) == 45 + 3 and hit / total >= 0.9


# -- 9

def brute_kept(texts, n=20):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            if x in seen:
                keep[i : i + n] = [False] * n
            seen.add(x)
        out.append((len(w), len(w) - sum(keep), [a for a, k in zip(w, keep, strict=True) if k]))
    return out


@pytest.mark.parametrize("shard", [20_000, 3])
def test_substring_dedup(spark, docs, texts, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_MINIMISERS", shard)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    told = brute_kept(texts)
    for i, (n, removed, kept) in enumerate(told):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest())
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_texts(docs.withColumn("cuts", F.lit(1))).collect()}
    assert all(WORD.findall(cut[i] or "") == kept for i, (*_, kept) in enumerate(told))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_substring_dedup_of_null_and_repeated_ids(spark):
    """A null id comes first; one id with equal texts is one document; one id with two texts goes by their hashes."""
    p = " ".join(f"p{i}" for i in range(25))
    q = " ".join(f"q{i}" for i in range(25))
    rows = [(None, p), (1, p + " more"), (2, q), (2, q), (3, "x " + q), (4, p), (4, q), (5, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", th int, cuts int")
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect()))
    assert got == [(False, 0, 25, 0), (True, 1, 26, 25), (True, 2, 25, 0), (True, 2, 25, 0), (True, 3, 26, 25), (True, 4, 25, 25), (True, 4, 25, 25), (True, 5, 0, 0)]
    assert substring_dedup.dedup_texts(df).columns == df.columns


@pytest.mark.parametrize("hot", [256, 20])
def test_substring_dedup_of_a_hot_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_MINIMISERS", 20)
    r = random.Random(9)
    passage = [f"h{i}" for i in range(90)]
    texts = []
    for i in range(300):
        a = r.choice([0, 0, 0, 7, 30])
        texts.append(" ".join([f"{r.randrange(10**6)}" for _ in range(r.randrange(30))] + passage[a : r.choice([90, 90, 40, 25])] + passage[: r.choice([0, 0, 45])] + ["end", f"{i // 2}"] * 12))
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, " ".join(passage[:50])), (None, " ".join(passage[10:60]))]
    got = {}
    for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect():
        if x["doc_id"] is not None:
            assert got.setdefault(x["doc_id"], x) == x
    nulls = sorted((t for i, t in rows if i is None), key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    for i, (n, removed, kept) in list(enumerate(brute_kept(nulls + texts)))[2:]:
        x = got[i - 2]
        assert (x["n_words"], x["n_removed"], x["kept_sha256"]) == (n, removed, hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_substring_dedup_spreads_a_hot_passage(spark, monkeypatch):
    """A passage of 40 words between unlike words, in a fifth of the documents: no shard gets over three times the median."""
    monkeypatch.setattr(substring_dedup, "HOT", 64)
    monkeypatch.setattr(substring_dedup, "SHARD_MINIMISERS", 200)
    r = random.Random(4)
    word = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    passage = word(40)
    pieces = [word(30) for _ in range(800)]
    texts = [word(30) + passage + word(30) for _ in range(500)] + [word(20) + r.choice(pieces) + word(10) for _ in range(2000)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    rows, shards = substring_dedup.find_segments(substring_dedup._keyed(df, "doc_id", "text"))
    sizes = sorted(x["count"] for x in rows.groupBy(F.pmod("shard", F.lit(shards))).count().collect())
    assert len(sizes) > 20 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    held = rows.where("words is not null").groupBy("shard").count().agg(F.max("count")).first()[0]
    assert held <= 3 * sizes[len(sizes) // 2]


# -- 10

def test_elias_fano_round_trip():
    r = np.random.default_rng(6)
    for n, top in ((0, 1), (1, 1), (1000, 50), (5000, 10**9), (300, 2**40)):
        v = np.sort(r.integers(0, top, n))
        e = elias_fano.EliasFano(elias_fano.EliasFano.parts(v, "x"), "x")
        assert (e.get(np.arange(n)) == v).all()
    for v in (np.unique(r.integers(0, 10**6, 3000)), np.r_[np.arange(700, 1900), 10**9 + np.arange(0, 4000, 3)]):
        e = elias_fano.EliasFano(elias_fano.EliasFano.parts(v, "x"), "x")
        asked = r.integers(0, int(v[-1]) + 1000, 2000)
        asked[:500] = r.choice(v, 500)
        found = e.find(asked)
        assert [(f >= 0) for f in found] == [a in set(v.tolist()) for a in asked] and all(v[f] == a for f, a in zip(found, asked, strict=True) if f >= 0)


def brute_scores(rows):
    """Every n-gram of every count, straight from the definition."""
    toks = {i: ["<s>", *WORD.findall(low(t)), "</s>"] for i, t in rows}
    train = [w for i, w in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    near = lambda x, k: (x[max(k - 2, 0)], x[k - 1], x[k])
    c1 = collections.Counter(w for x in train for w in x[1:])
    n, v = sum(c1.values()), len(c1)
    c3 = collections.Counter(near(x, k) for x in train for k in range(1, len(x)))
    c2, t1, t2, k1, k2 = (collections.Counter() for _ in range(5))
    for (a, b, c), m in c3.items():
        c2[b, c] += m
        t2[a, b] += m
        k2[a, b] += 1
    for (b, _), m in c2.items():
        t1[b] += m
        k1[b] += 1
    d = language_model.DISCOUNT
    p1 = lambda w: (c1[w] + 1) / (n + v + 1)
    p2 = lambda b, w: (max(c2[b, w] - d, 0) + d * k1[b] * p1(w)) / t1[b] if t1[b] else p1(w)
    p3 = lambda a, b, w: (max(c3[a, b, w] - d, 0) + d * k2[a, b] * p2(b, w)) / t2[a, b] if t2[a, b] else p2(b, w)
    out = {}
    for i, x in toks.items():
        score = sum(math.log10(p3(*near(x, k))) for k in range(1, len(x)))
        out[i] = (len(x) - 1, sum(c1[w] > 0 for w in x[1:]), n, sum(math.log10(p1(w)) for w in x[1:]), score)
    return out


def scores_hold(spark, rows, **layout):
    told = brute_scores(rows)
    got = language_model.score_documents(spark.createDataFrame(rows, DOCS).repartition(3), **layout).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = told[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=0.02, abs=0.1)  # shares are quantised


@pytest.mark.parametrize("shard", [language_model.SHARD_TOKENS, 500, 60])
def test_language_model(spark, texts, shard):
    """One shard, several, and frequent words in shards of their own; copies give counts of 1, 2 and more."""
    scores_hold(spark, list(enumerate(texts + texts[:9] + texts[:4])), shard_tokens=shard)


def test_language_model_in_small_blocks(spark, texts, monkeypatch):
    """N-grams and texts that lie across the borders of blocks."""
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 64)
    words, first = language_model.tokens(pa.array(texts))
    keys = [[tuple(w[k >> np.uint64(s) & np.uint64((1 << 21) - 1)] for s in (42, 21, 0)) for k in k_] for w, k_ in language_model.trigrams(words)]
    told = [(x[max(k - 1, 0)], x[max(k - 2, 0)], x[k]) for x in (words[a:z] for a, z in zip(first, first[1:])) for k in range(1, len(x))]
    assert [k for x in keys for k in x] == told
    scores_hold(spark, [(i, texts[i % len(texts)]) for i in range(40)], shard_tokens=300)


def test_language_model_of_nothing(spark):
    assert language_model.score_documents(empty(spark)).count() == 0
    none = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    for r in language_model.score_documents(spark.createDataFrame([(i, "a b") for i in none], DOCS)).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0, 0)
    one = next(i for i in range(60) if i not in none)
    clash = spark.createDataFrame([(one, "a b a b", 3, 4), (None, "a", 1, 1), (one, "a b a b", 3, 4)], DOCS + ", score int, shard int")
    got = language_model.score_documents(clash).collect()
    assert len(got) == 3 and {r["train_tokens"] for r in got} == {12} and not any(r["held_out"] for r in got)


def test_windows_come_from_the_rule():
    """Of what partitions pack, only their last window is cut into powers of two; past the bound the rule stays too."""
    r = np.random.default_rng(3)
    for bound in (4096, 20):
        packer, windows, sizes = packing.Packer(256, bound), [], r.integers(1, 300, 4000)
        for i, n in enumerate(sizes):
            windows += packer.place(i, np.arange(n, dtype=np.uint32))
            assert packer.open <= bound
        windows += packer.flush()
        fill = [sum(len(p[2]) for p in w) for w in windows]
        assert sum(fill) == sizes.sum() and sum(f < 256 for f in fill) <= 8
        assert all(f == 256 or f & (f - 1) == 0 for f in fill)
        starts = collections.defaultdict(list)
        for w in windows:
            for tag, start, ids, n in w:
                assert n == sizes[tag] and ids[0] == start
                starts[tag] += range(start, start + len(ids))
        assert all(sorted(starts[i]) == list(range(n)) for i, n in enumerate(sizes))


def test_packing_of_nothing_nulls_and_clashes(spark):
    path = tokenizer_path()
    rows = spark.createDataFrame([(None, None, 1, 1), (None, "", 1, 1), (5, "same words", 1, 1), (5, "same words", 1, 1)], "doc_id long, text string, start int, offset int")
    got = packing.pack(rows, path).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in got if r["start"] == 0) == [(-1, 1), (-1, 1), (5, 3), (5, 3)]
    assert packing.pack(rows.limit(0), path).count() == 0


def test_texts_of_near_copies_are_moved_once(spark, monkeypatch):
    """before, each pair of near copies carried both whole sets through a shuffle; some pairs here fall short of the threshold."""
    made = {}
    monkeypatch.setattr(ngram_join, "written", lambda d, name, write=ngram_join.written: made.setdefault(name, write(d, name)))
    r = random.Random(5)
    words = [f"w{i}" for i in range(800)]
    rows = []
    for i in range(120):
        own = [*words[(i % 2) * 300 :]]
        for at in r.sample(range(len(own)), 1 + i % 4):
            own[at] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert made["pairs"].count() > 1000 and made["places"].count() <= 120
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert got == dict(enumerate(root))


def test_a_large_group_of_pairs_is_dealt_to_parts(spark, monkeypatch):
    """groups over the block's bytes, and many buckets, give the same components."""
    r = random.Random(8)
    base = [[f"v{b}_{i}" for i in range(120)] for b in range(6)]
    rows = []
    for i in range(180):
        own = [*base[i % 6]]
        for at in r.sample(range(120), r.randint(0, 6)):
            own[at] = f"y{r.randint(0, 30)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ask = lambda: {x["doc_id"]: x["component_id"] for x in ngram_join.join_documents(df).collect()}
    whole = ask()
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 1)
    assert ask() == whole and 6 <= len(set(whole.values())) < 180
