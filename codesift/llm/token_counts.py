"""Token counts by rank-synchronous merging of pre-tokens in numpy arrays."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codesift.llm import pretokens, rows

_NONE = np.iinfo(np.int64).max
#: Bytes of a string from which on its places are kept by rank: a round over all places would cost too much.
LONG = 192


class Merges:
    """The merge table of a byte-level vocabulary: pairs of symbols, sorted, with their rank and what they merge to."""

    def __init__(self, name: str = pretokens.VOCABULARY) -> None:
        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            model = json.load(file)["model"]
        number = model["vocab"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([number[a] for a, _ in pairs], np.int64)
        right = np.array([number[b] for _, b in pairs], np.int64)
        self.base = max(number.values()) + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], _NONE)
        self.rank = np.append(order, _NONE)
        self.merged = np.array([number[a + b] for a, b in pairs], np.int64)
        # bytes that are printable in Latin-1 stand for themselves, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.of_byte = np.array([number[chr(b if b in plain else next(rest))] for b in range(256)], np.int64)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string, none empty, when no pair can be merged any more."""
        out = np.zeros(len(tokens), np.int64)
        sizes = np.array([len(x) for x in tokens], np.int64)
        for merge, which in ((self._short, sizes < LONG), (self._long, sizes >= LONG)):
            if which.any():
                out[which] = merge([tokens[k] for k in np.flatnonzero(which).tolist()])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, _NONE where there is none; symbol -1 stands for an end."""
        key = left * self.base + right
        at = np.searchsorted(self.key, key)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], _NONE)

    def _short(self, tokens: list[bytes]) -> np.ndarray:
        """All strings lie in one array. In each round every string merges its pair of lowest rank, at all places at once
        (from the left where they overlap); strings without a pair are done and leave the array.
        """
        out = np.array([len(x) for x in tokens], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), out)
        while len(symbols) > 1:
            rank = self._ranks(symbols[:-1], symbols[1:])
            rank = np.append(np.where(owner[:-1] == owner[1:], rank, _NONE), _NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            hit = (rank == least) & (rank != _NONE)
            hit[hit] = _alternate(np.flatnonzero(hit), np.flatnonzero(hit) + 1)
            symbols[hit] = self.merged[rank[hit]]
            stay = (least != _NONE) & ~np.r_[False, hit[:-1]]
            out -= np.bincount(owner[hit], minlength=len(out))
            symbols, owner = symbols[stay], owner[stay]
        return out

    def _long(self, tokens: list[bytes]) -> np.ndarray:
        """The same rounds, with an end after each string, and places listed by the rank of the pair that starts there.

        A round takes the lowest rank of all strings, which is the lowest of each string that has it; only the places next
        to a merged one get a new rank. So all rounds together take time about in proportion to the bytes.
        """
        symbols = np.concatenate([np.append(self.of_byte[np.frombuffer(x, np.uint8)], -1) for x in tokens])
        owner = np.repeat(np.arange(len(tokens)), [len(x) + 1 for x in tokens])
        out = np.array([len(x) for x in tokens], np.int64)
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        rank = np.append(self._ranks(symbols[:-1], symbols[1:]), _NONE)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def list_places(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for part in np.split(at, cuts):
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(part)

        list_places(np.arange(len(symbols)))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            at = at[_alternate(at, after[at])]
            gone = after[at]
            symbols[at] = self.merged[r]
            rank[gone] = _NONE
            after[at] = after[gone]
            before[after[at]] = at
            out -= np.bincount(owner[at], minlength=len(out))
            touched = np.union1d(at, before[at][before[at] >= 0])
            rank[touched] = self._ranks(symbols[touched], symbols[after[touched]])
            list_places(touched)
        return out


def _alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of rising places, each with the place after it: every other one of those that follow each other, the first taken."""
    place = np.arange(len(at))
    follows = np.r_[False, at[1:] == after[:-1]][:len(at)]
    return (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0


class Counter:
    """Token counts of whole texts; counts of pre-tokens are kept while there are fewer than room of them."""

    def __init__(self, room: int = 500_000) -> None:
        self.merges = Merges()
        self.known: dict[str, int] = {}
        self.room = room

    def count(self, texts: list[str]) -> list[int]:
        """The special string of the vocabulary counts as one token wherever it stands."""
        pieces = [
            pretokens.cut(x) if pretokens.SPECIAL not in x
            else [p for part in x.split(pretokens.SPECIAL) for p in pretokens.cut(part)] for x in texts]
        if len(self.known) > self.room:
            self.known.clear()
        new = list({p for x in pieces for p in x if p not in self.known})
        if new:
            self.known.update(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
        known = self.known.__getitem__
        return [sum(map(known, p)) + x.count(pretokens.SPECIAL) for p, x in zip(pieces, texts, strict=True)]


@cache
def counter() -> Counter:
    """One per Python worker, kept from task to task."""
    return Counter()


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (struct of all columns of docs), n_bytes and n_tokens (long) of the whole text; null and empty texts have 0.

    Each row gives one row, repeated rows too; an empty table gives none. A pre-token, however long, is merged as a whole, in
    time about in proportion to its length. Where places of the lowest rank overlap, the one on the left is merged.
    """

    def start() -> Callable[[list[bytes]], list[list]]:
        count = counter().count
        return lambda batch: [[len(x) for x in batch], count([x.decode() for x in batch])]

    return rows.map_texts(
        docs, text, start, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
