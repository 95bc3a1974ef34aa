"""BPE encoding and decoding by a deterministic automaton (operator 6).

``Automaton`` takes the merges one after the other, as merge gadgets, into the automaton that at
first accepts every sequence of base symbols.  The gadget for (u, v) -> uv gives the arc u a copy of
its target state without the arc v, and adds the arc uv wherever u and then v could be read.  What
the automaton accepts in the end are exactly the token sequences that the merges produce.

All arcs of one token lead to one state, so states are named by tokens.  Written out, the table would
have a billion arcs; it is compiled as a default table with differences instead.  A state has the
state that it was copied from, with the time of the copy, and the arcs that gadgets took from it since;
an arc has the arc beside which it was added.  ``Automaton.step`` reads them like a failure chain;
each entry that was read is kept in a plain table.

``Automaton.encode`` reads a pre-split word once from left to right.  Each prefix has one token
sequence that the automaton accepts, so each place has one state at most: from it, the arcs that spell
what follows lead to the places where they end.  Nothing is taken back.  Decoding emits the labels of
the arcs.

Texts are split first, as the tokenizer file says: NFC, runs of white space, lower case, then
contractions, letters, single digits and other signs; special tokens stand for themselves.  What
a stretch without white space encodes to is kept, within a bound, so frequent words cost a lookup.

Each document is encoded in its own row, without a shuffle.  Defined results: a null or empty
text has no tokens; repeated rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

#: White space as the tokenizer's \\s; Python's own split also takes the four separators 1C..1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_KEPT_WORDS = 300_000
#: Longer stretches are encoded anew each time, so what is kept is bounded in bytes too.
_KEPT_CHARS = 64
#: Stands for the end of a word in the spelling tree; white space is no base symbol.
END = "\n"


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """Deterministic automaton over tokens, made from a merge list by successive merge gadgets.

    A state is the target of a token's arcs; ``START`` is where a word begins.
    """

    START = -1

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.labels = {i: s for s, i in vocab.items()}
        n = max(vocab.values(), default=-1) + 1
        # Default table: the state that a state was copied from, the arc that an arc was added beside, and when.
        self.default, self.beside, self.born = list(range(n)), list(range(n)), [0] * n
        # Differences: when the state of the first token lost the arc of the second.
        self.lost: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        #: Tokens that no sequence comes to: they have no arc.
        self.dead = dead = {uv for when, (u, v) in enumerate(merges, 1) if (uv := self._gadget(vocab[u], vocab[v], vocab[u + v], when)) is not None}
        self.end_of_time = len(merges) + 1
        # Arcs by what they spell: a tree of characters, with "" at the node where a token ends.
        self.spelling: dict = {}
        for spelled, i in vocab.items():
            if i in dead:
                continue
            node = self.spelling
            for c in spelled.removesuffix(suffix):
                node = node.setdefault(c, {})
            if spelled.endswith(suffix):
                node = node.setdefault(END, {})
            node[""] = i

    def _gadget(self, u: int, v: int, uv: int, when: int) -> int | None:
        """The state of u loses the arc v; the arc uv stands beside u and leads to a copy of the state of v.

        Where the state of u has no arc v, no sequence comes to the merge: uv, which is returned, has no arc.
        """
        if not self._reads(u, v, when):
            return uv
        self.lost[u << 20 | v] = when
        self.default[uv], self.beside[uv], self.born[uv] = v, u, when
        return None

    def _reads(self, state: int, arc: int, time: int) -> bool:
        """Whether the state had the arc at that time, by the default table and the differences."""
        lost, born, s, a = self.lost, self.born, state, arc
        while True:
            gone = lost.get(s << 20 | a)
            if gone is not None and gone <= time:
                return False
            if born[s] > born[a]:
                time = min(time, born[s] - 1)
                s = self.default[s]
            elif born[a]:
                time = min(time, born[a])
                a = self.beside[a]
            else:
                return True

    def step(self, state: int, arc: int) -> bool:
        """Whether the state has the arc; the arc's token is then the next state."""
        out = self._reads(state, arc, self.end_of_time)
        if len(self.table) > 400_000:
            self.table.clear()
        self.table[state << 20 | arc] = out
        return out

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word, spelled in base symbols: one pass over its places."""
        word += END
        n, table, spelling = len(word), self.table, self.spelling
        come = [-1] * (n + 1)  # where the arc into each place began
        state = [self.START] * (n + 1)
        come[0] = 0
        for i in range(n):
            if come[i] < 0:
                continue
            here, node = state[i], spelling
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                arc = node.get("")
                if arc is None or come[j + 1] >= 0:
                    continue
                if i:
                    ok = table.get(here << 20 | arc)
                    if not (self.step(here, arc) if ok is None else ok):
                        continue
                come[j + 1], state[j + 1] = i, arc
        if come[n] < 0:
            raise ValueError(f"no path for {word!r}")
        out, i = [], n
        while i:
            out.append(state[i])
            i = come[i]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, as the library joins them where no decoder is set."""
        return " ".join(self.labels[i] for i in ids)


class Splitter:
    """Text to pre-split words, as the tokenizer file of word pieces with word ends states it."""

    def __init__(self, spec: dict):
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.bytes = byte_symbols()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.library_split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        self.library_form = tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()])

    def stretches(self, text: str) -> list[str]:
        """Pieces without white space; special tokens are pieces of their own."""
        if self.special and "<|" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self._spaced(text[at : m.start()])
                out.append(m.group())
                at = m.end()
            return out + self._spaced(text[at:])
        return self._spaced(text)

    @staticmethod
    def _spaced(text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def words(self, stretch: str) -> list[str]:
        if stretch.isascii():
            stretch = stretch.lower()
            if stretch.isalpha():
                return [stretch]
            if stretch[-1] in ".,;:!?" and stretch[:-1].isalpha():
                return [stretch[:-1], stretch[-1]]
            return self.pattern.findall(stretch)
        if max(stretch) < "\u0250":
            return self.pattern.findall(unicodedata.normalize("NFC", stretch).lower())
        # Beyond Latin, Unicode versions differ: the library's own tables decide.
        return [w for w, _ in self.library_split.pre_tokenize_str(self.library_form.normalize_str(stretch))]

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode()])


class Kept(dict):
    """A dictionary that makes missing values and holds two generations of at most ``bound`` each."""

    def __init__(self, make: Callable, bound: int = _KEPT_WORDS):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= _KEPT_CHARS:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def lacks(self, keys: set) -> list:
        """Those of the keys that would have to be made."""
        return [k for k in keys if k not in self and k not in self.old]


class Encoder:
    """Encodes and decodes whole texts with one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        self.splitter = Splitter(spec)
        self.automaton = Automaton(spec["model"]["vocab"], merges, self.splitter.suffix)
        self.automaton.labels |= {i: s for s, i in self.splitter.specials.items()}
        self.word_ids = Kept(lambda w: self.automaton.encode(self.splitter.symbols(w)))
        self.digest_of = Kept(self._digest_parts)

    def _stretch_ids(self, stretch: str) -> list[int]:
        if stretch in self.splitter.specials:
            return [self.splitter.specials[stretch]]
        return [i for w in self.splitter.words(stretch) for i in self.word_ids[w]]

    def _digest_parts(self, stretch: str) -> tuple[str, str, int]:
        ids = self._stretch_ids(stretch)
        return " ".join(map(str, ids)), self.automaton.decode(ids), len(ids)

    def encode(self, text: str | None) -> list[int]:
        return [i for s in self.splitter.stretches(text or "") for i in self._stretch_ids(s)]

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, the ids and the decoded text as strings."""
        parts = [self.digest_of[s] for s in self.splitter.stretches(text or "")]
        return sum(p[2] for p in parts), " ".join([p[0] for p in parts if p[2]]), " ".join([p[1] for p in parts if p[2]])


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and tokenizer file."""
    return Encoder(path)


def encode_documents(df: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows: the id and ``ids``, the tokens of the whole text."""
    field = df.schema[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = pa.array([e.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_column, "ids"])

    return df.select(id_column, text).mapInArrow(run, f"`{id_column}` {field.dataType.simpleString()}, ids array<int>")


def digest_documents(df: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = []
            for t in b.column(1):
                n, ids, decoded = e.digests(t.as_py())
                rows.append((n, sha(ids), sha(decoded)))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
