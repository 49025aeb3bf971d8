"""Fingerprints, Golay keys, components and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from codesift.llm import decontamination, graph, rows, simhash
from tests.llm.conftest import TEXTS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def slow_groups(prints, bits=2):
    """Root of each distinct fingerprint."""
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in up:
        for y in up:
            if x < y and (x ^ y).bit_count() <= bits:
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_fingerprint(monkeypatch):
    texts = [t for _, t in TEXTS if t is None or len(t) < 10_000] + ["One  TWO\tthree", "one two", "Ä ä A"]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) % (1 << 64) == slow_print(t)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint(prose(3, 100).encode()) % (1 << 64) == slow_print(prose(3, 100))


def test_code_has_distance_seven():
    data = np.arange(4096) << 11
    weights = np.bitwise_count(data | simhash._checks(data))
    assert sorted(set(weights.tolist())) == [0, 7, 8, 11, 12, 15, 16, 23]


def test_prints_within_two_bits_meet():
    pick = random.Random(4)
    for _ in range(400):
        x = pick.getrandbits(64)
        y = x
        for b in pick.sample(range(64), pick.randint(0, 2)):
            y ^= 1 << b
        (_, kx, ox), (_, ky, oy) = (simhash.keys(np.array([v], np.uint64).view(np.int64)) for v in (x, y))
        assert set(kx[ox]) & set(ky) and set(ky[oy]) & set(kx)


@pytest.mark.parametrize("part", [4096, 5])
def test_components(spark, monkeypatch, part):
    """Chains, dense balls and single prints; with small parts, large buckets are compared part by part."""
    monkeypatch.setattr(simhash, "PART", part)
    pick = random.Random(6)
    prints = [0, (1 << 64) - 1] + [pick.getrandbits(64) for _ in range(100)]
    for center in prints[5:10]:
        prints += [center ^ sum(1 << b for b in pick.sample(range(64), pick.randint(1, 3))) for _ in range(60)]
    chain = pick.getrandbits(64)
    for k in range(40):
        chain ^= 1 << k | 1 << 63 - k if k < 31 else 1 << k
        prints.append(chain)
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    got = {r["f"]: r["root"] for r in simhash.components(spark.createDataFrame([(p,) for p in signed], "f long")).collect()}
    want = slow_groups(prints)
    named = {np.array([f], np.int64).view(np.uint64)[0]: np.array([r], np.int64).view(np.uint64)[0] for f, r in got.items()}
    groups = lambda roots: {frozenset(int(x) for x in roots if roots[x] == r) for r in set(roots.values())}
    assert groups(named) == groups(want)
    assert all(r == min(f for f in got if got[f] == r) for r in set(got.values()))


def test_graph(spark):
    pick = random.Random(7)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    up = {x: x for pair in links for x in pair}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: up[x] for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(pick, words, n):
    words = list(words)
    for _ in range(n):
        words[pick.randrange(len(words))] = "changed"
    return " ".join(words)


def test_near_duplicates(make, none):
    pick = random.Random(8)
    base = prose(50, 900).split()
    texts = TEXTS + [(200 + k, near(pick, base, k % 4)) for k in range(40)]
    got = simhash.near_duplicates(make(texts)).collect()
    assert len(got) == len(texts)
    prints = {i: slow_print(t) for i, t in ((i, t) for i, t in texts)}
    roots = slow_groups({slow_print(t) for _, t in texts})
    least = {}
    for i, t in texts:
        r = roots[slow_print(t)]
        least[r] = min(x for x in (least.get(r), i) if x is not None) if i is not None or r in least else None
    want = sorted(((i, slow_print(t), least[roots[slow_print(t)]]) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["f"] % (1 << 64), r["component_id"]) for r in got), key=str) == want
    assert prints[1] == 0 and simhash.near_duplicates(none).count() == 0


def test_deduplicated(make, none):
    texts = TEXTS + [(300 + k, prose(60 + k // 3, 300)) for k in range(9)]
    docs = make(texts)
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    roots = slow_groups({slow_print(t) for _, t in texts})
    first = {}
    for i, t in texts:
        r = roots[slow_print(t)]
        key = (i is None, i)
        first[r] = min(first.get(r, key), key, key=lambda x: (x[0], x[1] or 0))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((k[1] for k in first.values()), key=str)
    assert simhash.deduplicated(none).count() == 0


def slow_hits(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, names = fold(text), set(), set()
    for name, item in items:
        own = fold(item)
        windows = {tuple(own[k:k + 10]) for k in range(max(1, len(own) - 9))} if own else set()
        for w in windows:
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k:k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    if name is not None:
                        names.add(str(name))
    return len(words), len(hit), sorted(names)


ITEMS = [(1, prose(31, 30)), (2, prose(32, 12)), (3, "short item"), (4, "a"), (5, None), (6, ""), (7, "?!"), (None, prose(33, 15)),
         (2, prose(32, 12)), (10, prose(31, 30)), (11, "ünïcode wörds Ab")]


def leaky():
    pick = random.Random(9)
    out = list(TEXTS[:-4])
    for k in range(60):
        name, item = ITEMS[pick.choice([0, 1, 7, 2, 10])]
        words = item.split()
        a = pick.randrange(len(words))
        part = words[a:a + pick.randint(1, 20)]
        out.append((400 + k, " ".join([prose(500 + k, 20), "-".join(part).upper() if k % 2 else ", ".join(part), prose(600 + k, 20)])))
    return out


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 26), (200, 1 << 26), (200, 700), (8, 1 << 26)])
def test_contamination(spark, make, none, sizes):
    texts = [(i, t) for i, t in leaky() if t is None or len(t) < 5000]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make(texts)
    sizes = {"block_bytes": sizes[0], "pass_bytes": sizes[1]}
    got = decontamination.contamination(docs, items, **sizes).select(
        "row.text", "n_words", "n_hit", "hits", "items").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == slow_hits(r["text"], ITEMS)
        assert sum(h["end"] - h["first"] for h in r["hits"]) == r["n_hit"]
    assert sum(r["n_hit"] > 0 for r in got) > 20
    clean = decontamination.clean_documents(docs, items, **sizes)
    assert clean.columns == docs.columns and clean.count() == sum(r["n_hit"] == 0 for r in got)
    assert decontamination.contamination(none, items, **sizes).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean_documents(docs, empty).count() == len(texts)


def test_repeated_and_long_items_in_blocks(spark):
    """A repeated item is sent once; a long one in parts that lose no window."""
    long, often = prose(40, 3000), prose(41, 40)
    items = spark.createDataFrame([("long", long)] + [("often", often)] * 500, "k string, t string")
    parts = decontamination._parts(items, 10, 256).collect()
    assert sum(p["k"] == "often" for p in parts) <= 2 and max(len(p["t"]) for p in parts) < 600
    whole = decontamination.Windows([("long", long.encode()), ("often", often.encode())], 10)
    cut = decontamination.Windows([(p["k"], bytes(p["t"])) for p in parts], 10)
    assert cut.owners == whole.owners and cut.width == whole.width


def test_steps_by_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (1 << 22)] * 20 + ["y"] * 300 + ["z" * (1 << 26)] * 2})
    got = list(rows.pieces([batch]))
    assert pa.Table.from_batches(got).column("t") == pa.Table.from_batches([batch]).column("t")
    assert all(p.num_rows <= rows.STEP_ROWS and (p.num_rows == 1 or p.nbytes <= rows.STEP_BYTES) for p in got)


def test_search_against_find():
    pick = random.Random(10)
    for _ in range(300):
        text = bytes(pick.choice(b"ab ") for _ in range(200))
        patterns = list({bytes(pick.choice(b"ab ") for _ in range(pick.randint(1, 12))) for _ in range(8)})
        got = sorted(decontamination.WuManber(patterns).find(text))
        assert got == sorted((k, i) for i, p in enumerate(patterns) for k in range(len(text)) if text.startswith(p, k))


def test_items_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
