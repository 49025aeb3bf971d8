"""Ranked search against a brute-force ranking; bounds; hard and empty tables."""

import math
import random
import re

import numpy as np
import pytest

from codesift.llm import lexical_search as search
from tests.llm.conftest import TEXTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string, row string, t int, key string, rank int, score long, doc_id string"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranking(texts, items, top):
    docs = [(i, terms(t)) for i, t in texts]
    docs = [(i, t) for i, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in docs:
            m = 100 - 50 + 50 * len(t) * n // length
            score = 0
            for x in set(terms(text)):
                if x in df and (tf := t.count(x)):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10 ** 9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def asked(spark, items):
    return spark.createDataFrame([(i, t, "r", 1, "k", 2, 3, "d") for i, t in items], ITEMS)


def found(spark, docs, items, **options):
    got = search.ranked(docs, asked(spark, items), **options)
    return sorted(map(tuple, got.select("row.item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "naïve", "x9"]
    weight = [1 / (k + 1) for k in range(len(words))]
    texts = [(k, " ".join(pick.choices(words, weight, k=pick.randrange(1, 60)))) for k in range(n)]
    texts += [(n + k, texts[0][1]) for k in range(n // 2)]  # a third of the rows are copies
    items = [(k, " ".join(pick.choices(words, weight, k=pick.randrange(1, 14))) + ".") for k in range(25)]
    return texts, items


@pytest.mark.parametrize("postings", [40, 700, 1 << 18])
def test_against_brute_force(spark, make, monkeypatch, postings):
    monkeypatch.setattr(search, "SEGMENT_POSTINGS", postings)
    texts, items = corpus(postings, 600)
    docs = make(texts).repartition(3)
    for top in (1, 7, 50):
        assert found(spark, docs, items, top=top) == ranking(texts, items, top)


def test_hard_rows(spark, hard):
    items = [(1, "stone river"), (1, "stone river"), (None, "again and WORD"), (2, None), (3, "... --"), (4, "nowhere"),
             (5, "café 中文 \U0001f600 ͸"), (6, "a" * 5000), (7, "the " * 9), (8, "")]
    assert found(spark, hard, items) == ranking(TEXTS, items, 50)


def test_blocks_of_items_give_the_same(spark, make):
    texts, items = corpus(5, 200)
    assert found(spark, make(texts), items, block_bytes=300) == ranking(texts, items, 50)


def test_empty_tables(spark, hard, none):
    assert found(spark, none, [(1, "stone")]) == []
    assert found(spark, hard, []) == [] == found(spark, none, [])
    assert found(spark, hard, [(1, None), (2, "!")]) == []


def segment(seed, docs=900, vocabulary=12):
    pick = np.random.default_rng(seed)
    doc, term = np.nonzero(pick.random((docs, vocabulary)) < pick.random(vocabulary) * 0.4)
    impact = pick.integers(1, 1000, len(doc))
    wanted = np.array(sorted(a * vocabulary + b for a in range(vocabulary) for b in range(a + 1, vocabulary)))
    fields = search.Segment.built(term.astype(np.int32), doc, impact, wanted, vocabulary)
    whole = np.zeros((docs, vocabulary), np.int64)
    whole[doc, term] = impact
    return search.Segment(fields, docs), whole


def test_bounds_hold_and_pairs_tighten_them():
    tighter = 0
    for seed in range(5):
        one, whole = segment(seed)
        for a in range(12):
            for b in range(a + 1, 12):
                bound = one.bounds((a, b), 12)
                for k in range(one.blocks):
                    most = (whole[k * 64:(k + 1) * 64, a] + whole[k * 64:(k + 1) * 64, b]).max()
                    assert most == bound[k]  # a pair by itself: nothing is larger than what a document has
                tighter += (bound < one.bounds((a,), 12) + one.bounds((b,), 12)).sum()
    assert tighter > 0


def test_search_loses_nothing_above_the_bound():
    for seed in range(20):
        one, whole = segment(seed)
        pick = random.Random(seed)
        own = pick.sample(range(12), 7)
        query = search.Query(0, (*[tuple(sorted(own[k:k + 2])) for k in (0, 2, 4)], (own[6],)))
        scores = whole[:, own].sum(axis=1)
        for least in (1, int(np.median(scores)), int(np.sort(scores)[-9]), int(scores.max()), int(scores.max()) + 1):
            places, got = one.search(query, least, 12)
            assert (got <= scores[places]).all()
            best = {p: s for p, s in zip(places.tolist(), got.tolist()) if s >= least}
            assert best == {p: int(scores[p]) for p in np.flatnonzero(scores >= least).tolist()}


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(search, "_STEP", 10)
    text = "Ab12-cde éé " * 50 + "x" * 100
    assert [t.decode() for part in search.terms(text.encode()) for t in part] == terms(text)
