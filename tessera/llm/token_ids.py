"""Token ids of whole texts by a byte-level tokenizer file, each different piece encoded once.

A text is cut before each space that ordinary signs follow; the tokenizer's own pre-split never has
a piece across such a place, so the ids of the pieces are the ids of the text.  Where white space of
several characters, white space beyond ASCII or the first sign of a special token comes next, the text is
not cut: a longer piece is always right.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken

from .bpe import byte_symbols
from .packing import LibraryIds
from .words import Words, _text_buffers

#: Bytes behind a space that may go on with white space (ASCII, or lead bytes of other white space) or begin ``<|``.
_JOINED = np.zeros(256, dtype=bool)
_JOINED[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def cut(texts: pa.Array) -> Words:
    """The pieces of every text; together they are the text."""
    raw, at = _text_buffers(texts)
    starts = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw):
        starts[:-2] = (raw[:-1] == 0x20) & ~_JOINED[raw[1:]]
        starts[at[1:] - 1] = False
    starts[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(starts[:-1])
    end = np.r_[start[1:], len(raw)] if len(start) else start
    first = np.searchsorted(start, at, side="left")
    return Words(raw, start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first, at)


#: The pre-split of byte-level files, a fixed value: contractions, letters, digits and other signs with a space before them, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here libraries of other Unicode versions agree on what is a letter.
_PLAIN = "\u0250"


class ByteIds(LibraryIds):
    """Ids of a byte-level tokenizer; what is kept is bounded in pieces and in ids.

    Plain pieces that begin with a space are laid end to end and encoded as one text by the faster of two libraries
    (tiktoken, with the ranks that the file's ids are); where a piece ends is known by the bytes of its tokens.  All others
    go to the tokenizers library one by one.
    """

    split = staticmethod(cut)

    def __init__(self, path: str):
        super().__init__(path)
        back = {c: b for b, c in enumerate(byte_symbols())}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=True).items() if t not in special}
        self.special = special
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([w[0] == " " and (w.isascii() or max(w) < _PLAIN) and not ("<" in w and any(s in w for s in self.special)) for w in words], bool)
        count = np.zeros(len(words), np.int64)
        line = np.array(self.fast.encode_ordinary("".join([words[k] for k in np.flatnonzero(plain)])), np.uint32)
        if len(line):
            ends = np.cumsum([len(words[k].encode()) for k in np.flatnonzero(plain)])
            count[plain] = np.diff(np.searchsorted(np.cumsum(self.size[line]), ends), prepend=-1)
        rest = np.flatnonzero(~plain)
        found = [e.ids for e in self.library.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        count[rest] = [len(i) for i in found]
        out = np.zeros(int(count.sum()), np.uint32)
        mine = np.repeat(plain, count)
        out[mine] = line
        out[~mine] = np.fromiter(chain.from_iterable(found), np.uint32)
        return out, count


@cache
def byte_ids(path: str) -> ByteIds:
    """One for each Python worker and tokenizer file."""
    return ByteIds(path)
