"""Language identification: script ranges, scores of letter groups per word, and Viterbi over the words of a text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import rows

#: First code points of ranges of letters that belong to one script each; a range ends where the next starts.
_SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "cherokee"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2C00, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "yi"),
    (0xA640, "cyrillic"), (0xA700, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in _SCRIPTS))
_BITS = 16
_ROWS = 1 << _BITS
#: Share of the mean of all languages in the probability of a letter group, the same for each language.
_POOLED = 0.05


@cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 outside words, 1 for marks inside them, 2 for letters; and the number of the script."""
    kind = np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for low, name in _SCRIPTS:
        script[low:] = SCRIPTS.index(name)
    return kind, script


@dataclass
class Words:
    """The words of some texts: where each starts among the letters, and which text has it."""

    groups: np.ndarray  # (3, letters): hashed groups of one to three neighbours, with word edges
    starts: np.ndarray
    letters: np.ndarray  # of each word
    script: np.ndarray
    text: np.ndarray


def split(texts: list[str]) -> Words:
    points = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le"), np.uint32).copy()
    # lower-casing may add marks but no NUL; NULs inside texts are blanks as well, so texts are told by their own sizes
    sizes = np.fromiter((len(x.lower()) + 1 for x in texts), np.int64, len(texts))
    kind, script = _points()
    inside = kind[points] > 0
    letter = kind[points] == 2
    points[~inside] = 0
    wide = points.astype(np.uint64)
    at = np.flatnonzero(inside)
    a, b, c = wide[at - 1], wide[at], wide[at + 1]
    mix = np.array([b * 0x9E3779B97F4A7C15, (b * 0x9E3779B1 + c) * 0xC2B2AE3D27D4EB4F + 1,
                    ((a * 0x85EBCA77 + b) * 0x9E3779B1 + c) * 0x165667B19E3779F9 + 2], np.uint64)
    starts = np.flatnonzero(~inside[at - 1])
    letters = np.add.reduceat(letter[at].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    owner = np.searchsorted(np.cumsum(sizes), at[starts] - 1, side="right")
    return Words((mix >> np.uint64(64 - _BITS)).astype(np.int64), starts, letters, script[points[at[starts]]], owner)


@dataclass(frozen=True)
class Model:
    """languages, sorted; table[group, language]: log probability; allowed[script, language]."""

    languages: tuple[str, ...]
    table: np.ndarray
    allowed: np.ndarray
    penalty: float

    def scores(self, words: Words) -> np.ndarray:
        """Log probability of each word by language; a language that doesn't use the word's script can't have it."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)))
        each = self.table[words.groups[0]] + self.table[words.groups[1]] + self.table[words.groups[2]]
        out = np.add.reduceat(each, words.starts, axis=0).astype(np.float64)
        allowed = self.allowed[words.script]
        some = allowed.any(axis=1)
        out[some] = np.where(allowed[some], out[some], out[some] - 1000.0)
        out[~some] = 0.0  # a script that no language uses tells nothing
        return out

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word: the best sum of scores, less penalty for each change of language.

        One language for all words is the best path if no stretch of words, added up by its best other language, gains
        more than penalty: leaving and coming back costs that at least. Most texts end there.
        """
        best = int(np.argmax(scores.sum(axis=0)))
        if scores.shape[1] == 1:
            return np.zeros(len(scores), np.int64)
        gain = (np.delete(scores, best, axis=1) - scores[:, [best]]).max(axis=1)
        total = np.r_[0.0, np.cumsum(gain)]
        if (total - np.minimum.accumulate(total)).max() <= self.penalty:
            return np.full(len(scores), best)
        return self.viterbi(scores)

    def viterbi(self, scores: np.ndarray, block: int = 8192) -> np.ndarray:
        """The best path word by word. Only where it would come from is kept: a byte for each language and word."""
        n, k = scores.shape
        value = [0.0] * k
        tops, leaves = np.empty(n, np.uint8), np.empty((n, k), bool)
        for a in range(0, n, block):
            before = []
            for row in scores[a:a + block].tolist():
                before.append(value)
                floor = max(value) - self.penalty
                value = [(v if v >= floor else floor) + s for v, s in zip(value, row, strict=True)]
            values = np.array(before)
            tops[a:a + block] = values.argmax(axis=1)
            leaves[a:a + block] = values < values.max(axis=1, keepdims=True) - self.penalty
        state, out, places = int(np.argmax(value)), np.empty(n, np.int64), [np.flatnonzero(leaves[1:, x]) + 1 for x in range(k)]
        end = n
        while end:  # back to the last word at which the state is taken up from the top one
            at = np.searchsorted(places[state], end) - 1
            start = int(places[state][at]) if at >= 0 else 0
            out[start:end] = state
            state, end = int(tops[start]), start
        return out


_COUNTS = "lang string, kind int, g int, n double"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter groups (kind 0 to 2) and of letters by script (kind 3) of each language in one task."""
    held: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in rows.pieces(batches):
        langs = batch.column("lang").to_pylist()
        texts = [x.decode() for x in rows.texts(batch.column("t"))]
        for lang in set(langs):
            words = split([t for t, x in zip(texts, langs, strict=True) if x == lang])
            total = held.setdefault(lang, np.zeros((3, _ROWS)))
            for k in range(3):
                total[k] += np.bincount(words.groups[k], minlength=_ROWS)
            scripts.setdefault(lang, np.zeros(len(SCRIPTS)))
            scripts[lang] += np.bincount(words.script, weights=words.letters, minlength=len(SCRIPTS))
    for lang, total in held.items():
        kind, group = np.nonzero(total)
        used = np.flatnonzero(scripts[lang])
        n = len(group) + len(used)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * n), pa.array(np.r_[kind, np.full(len(used), 3)], pa.int32()),
            pa.array(np.r_[group, used], pa.int32()), pa.array(np.r_[total[kind, group], scripts[lang][used]]),
        ], names=["lang", "kind", "g", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 20_000,
        penalty: float = 12.0) -> Model | None:
    """Learns from about rows_per_language whole texts of each language, picked by a hash of the whole row; all if fewer.

    Rows that share a text are picked one by one, so that copies are in the sample as often as among the rows. Rows without
    a language are not learned from. Texts of any length count whole. The model has 2**16 hashed letter groups for each language. None
    without rows.
    """
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(*docs.columns).alias("h")).filter(
        "lang IS NOT NULL AND t IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    wide = 1 << 30
    pick = F.lit(False)
    for name, n in sizes.items():
        pick = pick | ((F.col("lang") == name) & (
            F.pmod("h", F.lit(wide)) < int(wide * min(1.0, rows_per_language / n))))
    parts = rows.map_arrow(known.filter(pick).drop("h"), _counted, _COUNTS).groupBy("lang", "kind", "g").agg(F.sum("n").alias("n"))
    found = parts.toPandas()  # at most 3 * 2**16 rows and the scripts for each language
    languages = tuple(sorted(sizes))
    table, used = np.zeros((3, _ROWS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    column = found["lang"].map(languages.index).to_numpy(np.int64)
    kind, g, n = found["kind"].to_numpy(), found["g"].to_numpy(), found["n"].to_numpy()
    groups = kind < 3
    table[kind[groups], g[groups], column[groups]] = n[groups]
    used[g[~groups], column[~groups]] = n[~groups]
    # groups of all three sizes share one table: their hashes are salted by size
    counts = table.sum(axis=0)
    total = counts.sum(axis=0)
    pooled = ((counts + 0.5) / (total + 0.5 * _ROWS)).mean(axis=1, keepdims=True)
    # a group that no language has seen tells nothing of any, however little a language was learned from
    own = counts / np.maximum(total, 1)
    # the mean over the three sizes, as they tell of the same letters
    table = np.log(np.where(total > 0, (1 - _POOLED) * own + _POOLED * pooled, pooled)) / 3
    share = used / np.maximum(used.sum(axis=0), 1)
    return Model(languages, table.astype(np.float32), share > 0.005, penalty)


_SPANS = T.ArrayType(T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """row (struct of all columns of docs), lang_pred, score (0 to 1), spans (lang, first, end: ranges of words).

    lang_pred has most letters of the whole text on the best path, the first in order if several have; score is its share
    of them. Texts that are null or have no letter are und with score 0, as all are without a model. Each row gives one row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 numbers for each language

    def start() -> Callable[[list[bytes]], list[list]]:
        model = sent.value

        def work(batch: list[bytes]) -> list[list]:
            langs, shares, spans = ["und"] * len(batch), [0.0] * len(batch), [[] for _ in batch]
            if model is None:
                return [langs, shares, spans]
            words = split([x.decode() for x in batch])
            scores = model.scores(words)
            cuts = np.searchsorted(words.text, np.arange(len(batch) + 1))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                letters = words.letters[a:b]
                if not letters.sum():
                    continue
                path = model.path(scores[a:b])
                share = np.bincount(path, weights=letters, minlength=len(model.languages))
                langs[k] = model.languages[int(np.argmax(share))]
                shares[k] = float(share.max() / share.sum())
                edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                spans[k] = [
                    {"lang": model.languages[path[i]], "first": int(i), "end": int(j)}
                    for i, j in zip(edges, np.r_[edges[1:], len(path)], strict=True)]
            return [langs, shares, spans]

        return work

    return rows.map_texts(docs, text, start, [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", _SPANS)])


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. A null id is in another one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
