"""Byte-level BPE texts: cutting into pre-tokens with numpy, and ids of whole texts through a table of pre-tokens."""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: The one string that the vocabulary treats as a token by itself.
SPECIAL = "<|endoftext|>"

_MARK = 0x10FFFF  # no character; put between pre-tokens to have them split at once

_OTHER, _SPACE, _LETTER, _NUMBER, _UNSURE = range(5)
#: White space of the pattern that cuts pre-tokens, and the endings it cuts off after an apostrophe.
_BLANKS = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14), 32)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def tokenizer(name: str = VOCABULARY) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def _classes() -> np.ndarray:
    """By code point. Those that Python's tables don't assign yet may be letters for the library: they are unsure."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter(
        (_UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], _OTHER) for i in range(0x110000)),
        np.uint8, 0x110000)
    out[list(_BLANKS)] = _SPACE
    return out


def _starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of one text start.

    A pre-token is a run of letters, of numbers, of white space or of anything else. A run that is not white space takes
    the one blank in front of it; white space before it otherwise ends one place early, so that its last place stands
    alone. An apostrophe that starts a pre-token takes a known ending with it.
    """
    n = len(points)
    first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    length = np.diff(np.r_[first, n])
    space = kind[first] == _SPACE
    cuts = np.zeros(n + 1, bool)
    cuts[first] = True
    inner = first[1:][~space[1:] & (points[first[1:] - 1] == 32)]  # runs with a blank in front
    cuts[inner] = False
    cuts[inner - 1] = True
    last = (first + length - 1)[space & (length > 1) & (first + length < n)]
    cuts[last] = True
    quote = first[(points[first] == 39) & (length == 1) & cuts[first]]
    for at in quote.tolist():
        run = bytes(x if x < 128 else 0 for x in points[at + 1:at + 3].tolist()).decode()
        for ending in _ENDINGS:
            if run.startswith(ending):
                cuts[at + 1] = False
                cuts[at + 1 + len(ending)] = True
                break
    return np.flatnonzero(cuts[:n])


def cut(text: str) -> list[str]:
    """The pre-tokens of a text without special strings, in order; together they are the text."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    if (kind == _UNSURE).any():
        return [text[a:b] for _, (a, b) in tokenizer().pre_tokenizer.pre_tokenize_str(text)]
    starts = _starts(points, kind)
    if (points == _MARK).any():
        at = starts.tolist()
        return list(map(text.__getitem__, map(slice, at, [*at[1:], None])))
    marked = np.empty(len(points) + len(starts) - 1, np.uint32)
    marked[starts[1:] + np.arange(len(starts) - 1)] = _MARK
    marked[np.arange(len(points)) + np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(points)]))] = points
    return marked.tobytes().decode("utf-32-le").split(chr(_MARK))


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The library encodes each new pre-token of a batch, joined to long strings; ids of pre-tokens are kept while there are
    fewer than room of them. A text with a special string goes to the library as it is.
    """

    def __init__(self, room: int = 1_000_000) -> None:
        self.known: dict[str, bytes] = {}
        self.room = room
        vocabulary = tokenizer().get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte is one character of the vocabulary
        for token, number in vocabulary.items():
            self.width[number] = len(token)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.room:
            self.known.clear()
        pieces = [None if SPECIAL in x else cut(x) for x in texts]
        found = [x and list(map(self.known.get, x)) for x in pieces]
        gaps = [x and [k for k, ids in enumerate(x) if ids is None] for x in found]
        self._learn(list({x[k] for x, g in zip(pieces, gaps, strict=True) if g for k in g}))
        out = []
        for text, x, ids, gap in zip(texts, pieces, found, gaps, strict=True):
            if x is None:
                out.append(np.array(tokenizer().encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            for k in gap:
                ids[k] = self.known[x[k]]
            out.append(b"".join(ids))
        return out

    def _learn(self, new: list[str]) -> None:
        """Pre-tokens of one blank and letters stay apart when joined; the others are encoded one by one."""
        joined = [x for x in new if x[0] == " " and x[-1].isalpha()]
        for k in range(0, len(joined), 1000):
            part = joined[k:k + 1000]
            ids = np.array(tokenizer().encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(x.encode()) for x in part])
            cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[4 * a:4 * b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())), strict=True))
        rest = [x for x in new if not (x[0] == " " and x[-1].isalpha())]
        for k in range(0, len(rest), 1000):
            part = rest[k:k + 1000]
            for text, x in zip(part, tokenizer().encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[text] = np.array(x.ids, "<u4").tobytes()


@cache
def encoder() -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder()
