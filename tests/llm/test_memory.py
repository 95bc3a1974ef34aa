"""What tasks hold: hashing by blocks, words that a Python worker keeps, files of component rounds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import graph, packing
from tessera.llm import words as W


def traced(run):
    """(result, bytes held afterwards, most bytes meanwhile)."""
    tracemalloc.start()
    try:
        out = run()
        return out, *tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_hashing_holds_a_block_at_a_time():
    long = "é" * W.HASHED_BYTES  # longer than a block
    words = [f"word{i}" for i in range(200_000)]
    texts = pa.array([" ".join(words[:150_000]), None, long + " x", " ".join(words[150_000:])])
    w = W.split(texts)
    h, _, peak = traced(w.hashes)
    assert peak < 30_000_000  # 2 MB of words
    order = [*words[:150_000], long, "x", *words[150_000:]]
    some = [0, 1, 12_345, 149_999, 150_000, 150_001, 150_002, len(order) - 1]
    assert [int(h[i]) for i in some] == [int(W.split(pa.array([order[i]])).hashes()[0]) for i in some]
    assert len(np.unique(h)) == len(h) == len(order)


class Lengths(packing.LibraryIds):
    """The ids of a word: its length, and its last sign's code."""

    def __init__(self):
        self.most = 0
        self._forget()

    def _encode(self, words):
        self.most = max(self.most, len(words))
        return np.array([i for w in words for i in (len(w), ord(w[-1]))], np.uint32), np.full(len(words), 2)


def test_kept_words_take_few_bytes():
    ids = Lengths()
    blocks = [[f"{block}_{i}" for i in range(50_000)] for block in range(4)]

    def run():
        for words in blocks:
            found = ids.ids(pa.array([" ".join(words), None, words[0]]))
            assert found[0].tolist() == [i for w in words for i in (len(w), ord(w[-1]))]
            assert (len(found[1]), found[2].tolist()) == (0, found[0][:2].tolist())

    _, held, _ = traced(run)
    assert held < 200_000 * 40  # 24 bytes a word, two ids of 4
    assert ids.most <= packing.LEARNED_WORDS
    again = ids.ids(pa.array([blocks[1][7] + " new " + blocks[3][9]]))[0]
    assert again.tolist() == [len(blocks[1][7]), ord("7"), 3, ord("w"), len(blocks[3][9]), ord("9")]


def test_few_edges_are_few_files(spark):
    pairs = [(i, i + 1) for i in range(0, 600, 2)] + [(1000, i) for i in range(1001, 1300)]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = graph.components(spark.createDataFrame(pairs, "a long, b long"))
        assert len(set(found.inputFiles())) <= graph.LEAST_FILES
        roots = {r["node"]: r["root"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert roots == {n: (n - n % 2 if n < 1000 else 1000) for p in pairs for n in p}
