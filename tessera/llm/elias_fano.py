"""Elias-Fano sequences and an n-gram trie made of them, as flat bytes.

An image is one run of bytes that numpy views read in place: ``Trie.mapped`` maps a file, so only
the pages that are asked for are read.
"""

from __future__ import annotations

import json
import os

import numpy as np

_WORD = 64


def pack_arrays(parts: dict[str, np.ndarray]) -> list[bytes]:
    """Named arrays one after the other, each on a border of 8 bytes, behind a directory."""
    body, directory, at = [], {}, 0
    for name, a in parts.items():
        directory[name] = (at, len(a), a.dtype.str)
        body += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
        at += a.nbytes + len(body[-1])
    head = json.dumps(directory).encode()
    head += b" " * (-len(head) % 8)
    return [len(head).to_bytes(8, "little"), head, *body]


def view_arrays(image) -> dict[str, np.ndarray]:
    size = int.from_bytes(bytes(image[:8]), "little")
    directory = json.loads(bytes(image[8 : 8 + size]))
    return {k: np.frombuffer(image, np.dtype(t), n, 8 + size + at) for k, (at, n, t) in directory.items()}


_L8, _H8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _byte_places() -> np.ndarray:
    """For a rank r and a byte x, at r * 256 + x: where the r-th one of x stands."""
    out = np.zeros((8, 256), np.int64)
    for x in range(256):
        ones = [i for i in range(8) if x >> i & 1]
        out[: len(ones), x] = ones
    return out.ravel()


_PLACES = _byte_places()


def _in_word(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the rank-th one of each word stands, by sums of bytes side by side."""
    s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _L8
    r = rank.astype(np.uint64)
    byte = np.bitwise_count(((r * _L8 | _H8) - s) & _H8).astype(np.uint64) << np.uint64(3)
    inside = (r - ((s << np.uint64(8)) >> byte & np.uint64(255))).astype(np.int64)
    return byte.astype(np.int64) + _PLACES[inside << 8 | (x >> byte & np.uint64(255)).astype(np.int64)]


class EliasFano:
    """A sequence of numbers that never falls: low bits packed, high parts in unary with a count of ones for each word."""

    def __init__(self, parts: dict[str, np.ndarray], name: str):
        self.low, self.high, self.ones = (parts[f"{name}.{p}"] for p in ("low", "high", "ones"))
        self.n, self.bits, self.top = map(int, parts[f"{name}.shape"])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * _WORD - self.ones

    @staticmethod
    def parts(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + _WORD - 1) // _WORD + 1, np.uint64)
        if bits and n:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        last = (top - 1) >> bits
        marks = np.zeros(-(-(n + last + 2) // _WORD) * _WORD + _WORD, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks[ones] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        before = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        return {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": before.astype(np.uint32 if n < 2**32 else np.int64), f"{name}.shape": np.array([n, bits, last], np.int64)}

    def _select(self, i: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Where the i-th one (or zero) of the high bits stands."""
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, i, "right") - 1
        bits = ~self.high[word] if zeros else self.high[word]
        return (word << 6) + _in_word(bits, i - before[word])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        over = np.flatnonzero(shift + np.uint64(self.bits) > 64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (value & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        high = (self._select(i) - i) << self.bits
        return high + self._lows(i) if self.bits else high

    def find(self, value: np.ndarray) -> np.ndarray:
        """Where each value stands, -1 if it doesn't: the places of its high part, then a search of the low bits there."""
        out = np.full(len(value), -1, np.int64)
        high = value >> self.bits
        some = np.flatnonzero((high <= self.top) & (value >= 0)) if self.n else np.zeros(0, np.int64)
        if not len(some):
            return out
        high = high[some]
        # Behind the zero number h - 1 stand the ones of the high part h, up to the zero number h.
        end = self._select(high, True) - high
        low = np.zeros(len(some), np.int64)
        inner = np.flatnonzero(high > 0)
        low[inner] = self._select(high[inner] - 1, True) + 1 - high[inner]
        live = np.flatnonzero(low < end)
        some, low, end = some[live], low[live], end[live]
        if not self.bits:
            out[some] = low
            return out
        asked = value[some] & ((1 << self.bits) - 1)
        live = np.flatnonzero(end - low > 1)
        while len(live):
            mid = (low[live] + end[live]) >> 1
            more = self._lows(mid) <= asked[live]
            low[live[more]] = mid[more]
            end[live[~more]] = mid[~more]
            live = live[end[live] - low[live] > 1]
        hit = self._lows(low) == asked
        out[some[hit]] = low[hit]
        return out


def quantised(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes of one byte, codebook): half the levels at equal shares of the values, half at equal distances.

    Each stands for the mean of its values; up to ``levels`` different values are kept as they are.
    """
    v = values.astype(np.float64)
    if not len(v):
        return np.zeros(0, np.uint8), np.zeros(1)
    different = np.unique(v)
    if len(different) <= levels:
        return np.searchsorted(different, v).astype(np.uint8), different
    shares = np.quantile(v, np.linspace(0, 1, levels // 2 + 1)[1:-1], method="nearest")
    edges = np.unique(np.r_[shares, np.linspace(different[0], different[-1], levels // 2 + 1)[1:-1]])
    code = np.searchsorted(edges, v, side="left")
    total, n = np.bincount(code, v, len(edges) + 1), np.bincount(code, minlength=len(edges) + 1)
    return code.astype(np.uint8), np.where(n > 0, total / np.maximum(n, 1), 0.0)


class Trie:
    """The n-grams (a, b, c) of some middle words b, as levels that are read in place.

    ``middle`` are the words b in order with their exact counts, ``outer`` the words beside them.
    Below each b hang its successors c, and its contexts a; below a context hang its trigrams.
    Monotone pointers lead from b to its first successor and context.  The nodes of all owners of a
    level are one rising sequence, in which each owner has a range of its own.  A trigram's last
    word is its place among the successors of b, a small number that asking that level gives, so
    the range of a context is as long as b has successors.
    """

    def __init__(self, image):
        p = view_arrays(image)
        self.middle, self.count, self.outer = p["middle"], p["count"], p["outer"]
        self.pointers, self.nodes = ({k: EliasFano(p, f"{what}{k}") for k in ("2", "c", "3")} for what in ("pointers", "nodes"))
        self.coded = {k: (p[k], p[f"{k}.book"]) for k in ("own2", "own3", "rest1", "rest2")}

    @classmethod
    def mapped(cls, path: str) -> Trie | None:
        """The trie of a file, as a memory map; None where no n-gram belongs to it."""
        if not os.path.exists(path):
            return None
        return cls(np.memmap(path, np.uint8, "r"))

    @staticmethod
    def image(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, discount: float) -> tuple[list[bytes], int, int]:
        """(parts of the image, number of tokens, number of middle words) of trigrams with counts, in any order, repeated or not."""
        middle, rb = np.unique(b, return_inverse=True)
        outer, rank = np.unique(np.concatenate([a, c]), return_inverse=True)
        ra, rc = rank[: len(a)], rank[len(a) :]
        width = max(1, int(len(outer) - 1).bit_length())
        if width * 2 + int(len(middle)).bit_length() <= 63:
            order = np.argsort(rb << 2 * width | ra << width | rc)
        else:
            order = np.lexsort((rc, ra, rb))
        rb, ra, rc, n = rb[order], ra[order], rc[order], n[order].astype(np.int64)
        ends = lambda *xs: np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in xs])])
        first = ends(rb, ra, rc)
        rb, ra, rc, n3 = rb[first], ra[first], rc[first], np.add.reduceat(n, first)
        context = ends(rb, ra)
        owner3 = np.repeat(np.arange(len(context)), np.diff(np.r_[context, len(rb)]))
        total3, kinds3 = np.add.reduceat(n3, context), np.bincount(owner3)
        order = np.argsort(rb << width | rc, kind="stable")
        sb, sc = rb[order], rc[order]
        pair = ends(sb, sc)
        n2, place = np.add.reduceat(n3[order], pair), np.empty(len(rb), np.int64)
        place[order] = np.repeat(np.arange(len(pair)), np.diff(np.r_[pair, len(rb)]))
        sb, sc = sb[pair], sc[pair]
        count = np.bincount(sb, n2, len(middle)).astype(np.int64)
        starts = np.searchsorted(sb, np.arange(len(middle) + 1))
        parts = {"middle": middle, "count": count if count.max(initial=0) >= 2**32 else count.astype(np.uint32), "outer": outer}
        cb, ca = rb[context], ra[context]
        kinds = np.diff(starts)
        begin = np.searchsorted(cb, np.arange(len(middle) + 1))
        # The ranges of b's contexts, each as long as b has successors, begin here.
        range3 = np.r_[0, np.cumsum(np.diff(begin) * kinds)]
        parts |= EliasFano.parts(starts, "pointers2") | EliasFano.parts(begin, "pointersc") | EliasFano.parts(range3, "pointers3")
        parts |= EliasFano.parts(sb * len(outer) + sc, "nodes2") | EliasFano.parts(cb * len(outer) + ca, "nodesc")
        parts |= EliasFano.parts(range3[rb] + (owner3 - begin[rb]) * kinds[rb] + place - starts[rb], "nodes3")
        shares = {
            "own2": (n2 - discount) / count[sb],
            "rest1": discount * kinds / count,
            "own3": (n3 - discount) / total3[owner3],
            "rest2": discount * kinds3 / total3,
        }
        for name, v in shares.items():
            parts[name], book = quantised(np.log10(v))
            parts[f"{name}.book"] = 10**book
        return pack_arrays(parts), int(count.sum()), len(middle)

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of words whose home this is; 0 for words that no training text has."""
        at = np.minimum(np.searchsorted(self.middle, words), len(self.middle) - 1)
        return np.where(self.middle[at] == words, self.count[at], 0)

    def _below(self, k: str, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes for middle words and outer words by number; -1 where the pair isn't there."""
        key = owner * len(self.outer) + word
        fresh = np.r_[True, key[1:] != key[:-1]]
        return self.nodes[k].find(key[fresh])[np.cumsum(fresh) - 1]

    def _outer(self, words: np.ndarray) -> np.ndarray:
        u, back = np.unique(words.astype(np.uint32), return_inverse=True)
        at = np.minimum(np.searchsorted(self.outer, u), len(self.outer) - 1)
        return np.where(self.outer[at] == u, at, -1)[back]

    def shares(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """(share of c after b, mass that b leaves, share of c after a b, mass that a b leaves); 0 and 1 where unknown."""
        own2, rest1, own3, rest2 = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(a)), np.ones(len(a))
        at = np.minimum(np.searchsorted(self.middle, b), len(self.middle) - 1)
        some = np.flatnonzero(self.middle[at] == b)
        if not len(some):
            return own2, rest1, own3, rest2
        mid = at[some]
        rest1[some] = self._value("rest1", mid)
        ra, rc = self._outer(a[some]), self._outer(c[some])
        pair, context = (np.full(len(some), -1, np.int64) for _ in range(2))
        has = np.flatnonzero(rc >= 0)
        has = has[np.argsort(mid[has] * len(self.outer) + rc[has])]
        if len(has):
            pair[has] = self._below("2", mid[has], rc[has])
        hit = np.flatnonzero(pair >= 0)
        own2[some[hit]] = self._value("own2", pair[hit])
        # Items come in order of b and a, so equal contexts stand together.
        has = np.flatnonzero(ra >= 0)
        if len(has):
            context[has] = self._below("c", mid[has], ra[has])
        hit = np.flatnonzero(context >= 0)
        rest2[some[hit]] = self._value("rest2", context[hit])
        both = np.flatnonzero((context >= 0) & (pair >= 0))
        if len(both):
            owner = mid[both]
            u, back = np.unique(owner, return_inverse=True)
            first, begin, range3 = (self.pointers[k].get(u)[back] for k in ("2", "c", "3"))
            kinds = (self.pointers["2"].get(u + 1) - self.pointers["2"].get(u))[back]
            node = self.nodes["3"].find(range3 + (context[both] - begin) * kinds + pair[both] - first)
            hit = np.flatnonzero(node >= 0)
            own3[some[both[hit]]] = self._value("own3", node[hit])
        return own2, rest1, own3, rest2

    def _value(self, name: str, node: np.ndarray) -> np.ndarray:
        code, book = self.coded[name]
        return book[code[node]]
