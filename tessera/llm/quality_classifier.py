"""Quality classifier: naive Bayes support vectors (operator 4).

Features are indicators of n-grams, hashed into ``1 << BITS`` places: words (1 and 2), the signs
at a word's end, and word shapes (1 to 3; case, digits, symbols, length, and whether the word
equals the one before).  Class log-count ratios scale the indicators; a linear hinge-loss model is
fitted to them by dual coordinate descent; the margin goes through a logistic curve.

Log-count ratios come from all labelled training rows, summed by Spark.  The linear model is
fitted on a sample of at most ``SAMPLE`` of them and ``SAMPLE_CHARS`` characters in all, those with
the smallest hashed ids: bounds stated here and parameters of ``fit``.  A character gives less than one
place of four bytes, so the sample takes 400 MB at most (135 MB as measured on words of usual length).
Scoring is one pass over whole texts with the broadcast weights (one number for each place, 2 MB),
without a shuffle.

Defined results: a null or empty text has no features and scores by the bias; labels other than 0
and 1 are not used; with one class every text scores 0.01 or 0.99, without labels 0.5;
rows that repeat in ``labels`` count each time; very long texts count whole; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_ROWS

BITS = 18
SAMPLE = 20_000
SAMPLE_CHARS = 25_000_000 * 4
ROUNDS = 12
COST = 1.0
SMOOTHING = 1.0
CUT = 0.7
HELD_OUT = (4, 2)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[128:] = 2
for _signs, _code in (("!?", 4), (".,;:", 5), ("#*$%&|<>", 6)):
    _CLASS[np.frombuffer(_signs.encode(), np.uint8)] = _code
_CLASS[(_CLASS == 0) & (np.arange(256) > 32)] = 7


def _shapes(w: W.Words, h: np.ndarray) -> np.ndarray:
    """A small code of each word's look."""
    code = _CLASS[w.data]
    n = len(w.start)
    if not n:
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    at = np.cumsum(size) - size
    take = np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(w.start, size)
    held = np.bitwise_or.reduceat(np.left_shift(1, code[take]).astype(np.int64), at)
    last, before = code[w.end - 1], code[np.maximum(w.end - 2, w.start)]
    same = np.zeros(n, np.int64)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = held | last.astype(np.int64) << 8 | before.astype(np.int64) << 11 | code[w.start].astype(np.int64) << 14 | np.minimum(size // 4, 7) << 17 | same << 20
    return W.mix64(shape.astype(np.uint64) + np.uint64(0xF00D))


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places of each text's n-grams without repeats, ends of the texts in that array)."""
    plain = W.split(texts)
    low = W.split(texts, lower=True)
    h, shape = low.hashes(), _shapes(plain, plain.hashes())
    grams, owners = [], []
    for base, sizes in ((h, (1, 2)), (shape, (1, 2, 3))):
        for k in sizes:
            g = W.windows(base, k)
            inside = low.doc[: len(g)] == low.doc[k - 1 :] if len(g) else np.zeros(0, bool)
            grams.append(g[inside] >> np.uint64(64 - bits))
            owners.append(low.doc[: len(g)][inside])
    place = np.concatenate(grams).astype(np.int64)
    owner = np.concatenate(owners).astype(np.int64)
    both = np.unique(owner << bits | place)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(1, low.docs + 1))


@dataclass
class Model:
    """Weights by place, scaled ratios included, and the logistic curve of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.cumsum(np.r_[0.0, self.weights[places]])
        margin = sums[ends] - sums[np.r_[0, ends[:-1]]] if len(ends) else np.zeros(0)
        n = np.diff(np.r_[0, ends])
        margin = margin / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def _sums(labelled: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that hold a place, over all labelled rows: 2 arrays of 1 << bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for b in W.chunks(batches):
            places, ends = features(b.column(0), bits)
            y = np.repeat(b.column(1).to_numpy(), np.diff(np.r_[0, ends]))
            for k in (0, 1):
                total[k] += np.bincount(places[y == k], minlength=1 << bits)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["place", "bad", "good"])

    t = labelled.select("text", "y").mapInArrow(run, "place long, bad long, good long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((2, 1 << bits))
    at = t["place"].to_numpy()
    out[0, at], out[1, at] = t["bad"].to_numpy(), t["good"].to_numpy()
    return out[0], out[1]


def _descend(x: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is one more feature of value 1.

    A text's values are its places' ratios over the root of their number; they are looked up again
    at each visit, so memory holds the places only.
    """
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    scale = np.array([1 / np.sqrt(max(len(a), 1)) for a in x])
    norm = np.array([float((ratio[a] ** 2).sum()) for a in x]) * scale**2 + 1.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            v = ratio[x[i]] * scale[i]
            grad = y[i] * (float(w[x[i]] @ v) + bias) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x[i]] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of the margins by Newton steps, with smoothed targets."""
    good, bad = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, s = target - p, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * margin).sum(), d.sum()])
        hess = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _join_small(docs: DataFrame, told: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(told) if told.count() <= BROADCAST_ROWS else told, "doc_id")


def fit(docs: DataFrame, told: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, bits: int = BITS, rounds: int = ROUNDS, cost: float = COST) -> Model:
    """``docs``: doc_id, text; ``told``: doc_id, y (0 or 1)."""
    told = told.where("y in (0, 1)").select("doc_id", F.col("y").cast("long").alias("y"))
    labelled = _join_small(docs, told)
    bad, good = _sums(labelled, bits)
    n = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    if len(n) < 2:
        share = {(): 0.5, (0,): 0.01, (1,): 0.99}[tuple(n)]
        return Model(np.zeros(1 << bits), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = good + SMOOTHING, bad + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(good + bad) < 2] = 0.0  # seen once: says nothing of other documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches):
            places, ends = features(b.column(0), bits)
            rows = [r.astype(np.int32).tobytes() for r in np.split(places, ends[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.binary())], ["y", "places"])

    few = told.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # At most ``sample`` rows without their texts: a running sum of lengths cuts them to the second bound.
    sized = _join_small(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars")), few)
    upto = F.sum("chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = sized.withColumn("upto", upto).where(F.col("upto") <= sample_chars).select("doc_id", "y").distinct()
    t = _join_small(docs, few).select("text", "y").mapInArrow(run, "y long, places binary").toArrow()
    y = np.where(t["y"].to_numpy() == 1, 1.0, -1.0)
    x = [np.frombuffer(r.as_buffer(), np.int32) for r in t["places"]]
    # Both classes weigh the same in all.
    each = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) * cost
    fold = np.arange(len(y)) % 5
    # Margins of rows not fitted calibrate the curve.
    w, bias = _descend([x[i] for i in np.flatnonzero(fold)], ratio, y[fold > 0], each[fold > 0], rounds)
    rest = np.flatnonzero(fold == 0)
    margin = np.array([float(w[x[i]] @ ratio[x[i]]) / np.sqrt(max(len(x[i]), 1)) + bias for i in rest])
    slope, shift = _curve(margin, y[rest])
    return Model((w * ratio).astype(np.float32), bias, slope, shift)


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, score) for every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(*features(b.column(1), bits)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column, parts: tuple[int, int] = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts[0] == parts[1], F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> DataFrame:
    """Rows: doc_id, held_out, score, predicted; learns from labelled rows that aren't held out."""
    told = labels.select("doc_id", F.col(label).alias("y")).where(~held_out(F.col("doc_id")))
    model = fit(docs.select("doc_id", "text"), told, **options)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
