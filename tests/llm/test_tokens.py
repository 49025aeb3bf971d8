"""Token files, counts and packing against the tokenizer library and plain Python."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codesift.llm import packing, pretokens, rows, token_counts, token_files
from tests.llm.conftest import TEXTS, prose


def ids(text):
    return pretokens.tokenizer().encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_cut_like_the_library():
    pick = random.Random(5)
    parts = ["a", "é", "中", "1", "²", " ", "  ", "\n", "\t", " ", " ", "'", "'s", "'ll", "'S", "!", "...", "\U0001f600",
             "́", "\x1c", "\x00", "​", "_", "'tis", "\r\n", "͸", "\U0010ffff"]
    for _ in range(5000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(12)))
        want = [text[a:b] for _, (a, b) in pretokens.tokenizer().pre_tokenizer.pre_tokenize_str(text)]
        assert pretokens.cut(text) == want


def test_classes_like_the_library():
    """Every code point next to a letter, a number and a mark. Characters Python doesn't know go to the library."""
    table = pretokens._classes()
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF and table[c] != pretokens._UNSURE]
    for kind, start in ((pretokens._LETTER, "a"), (pretokens._NUMBER, "1"), (pretokens._OTHER, "!")):
        spans = pretokens.tokenizer().pre_tokenizer.pre_tokenize_str("".join(f" {start}{chr(c)}" for c in points))
        whole = {a // 3 for _, (a, b) in spans if b - a == 3 and a % 3 == 0}
        assert whole == {k for k, c in enumerate(points) if table[c] == kind}


def test_encoder_and_counter_forget_nothing():
    texts = [t or "" for _, t in TEXTS if t is None or len(t) < 10_000]
    encoder, counter = pretokens.Encoder(room=50), token_counts.Counter(room=50)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids(t) for t in texts]
        assert counter.count(texts) == [len(ids(t)) for t in texts]


def test_counts_of_long_runs():
    pick = np.random.default_rng(3)

    def run(letters: str, n: int) -> str:
        return "".join(np.array(list(letters))[pick.integers(0, len(letters), n)].tolist())

    n = token_counts.LONG
    texts = ["a" * 100_001, "ab" * 30_000, "aaab" * 9_000, "\u00e9" * 30_000, "=" * 40_001, "the" * 30_000, "x" * (n - 1), "x" * n,
             *[run("abeinst\u00c9\u4e2d", n - 50 + k) for k in range(150)]]
    counter = token_counts.Counter()
    assert counter.count(texts) == [len(ids(t)) for t in texts]
    assert [token_counts.Counter().count([t])[0] for t in texts[:12]] == [len(ids(t)) for t in texts[:12]]
    text = run("abcdefghijklmnopqrstuvwxyz", 320_000)
    start = time.time()
    assert counter.count([text])[0] == len(ids(text))
    assert time.time() - start < 10


def test_counts(hard, none):
    got = token_counts.counted(hard).select("row.doc_id", "row.text", "n_bytes", "n_tokens").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), len(ids(r["text"])))
    assert token_counts.counted(none).count() == 0


def test_codes_give_any_number():
    pick = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        numbers = np.where(pick.random(n) < 0.4, pick.integers(0, 256, n), pick.integers(0, 1 << 32, n) >> pick.integers(0, 32, n))
        codes = token_files.Codes(token_files.Codes.image(numbers))
        assert len(codes) == n and codes.between(0, n).tolist() == numbers.tolist()
        assert [codes[i] for i in range(n)] == numbers.tolist()
        for a, b in np.sort(pick.integers(0, n + 1, (30, 2))).tolist():
            assert codes.between(a, b).tolist() == numbers[a:b].tolist()
    with pytest.raises(IndexError):
        token_files.Codes(token_files.Codes.image(np.array([1])))[1]
    with pytest.raises(ValueError):
        token_files.Codes(b"something")


def test_token_files_round_trip(spark, hard, none, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 1 << 20)
    path = rows.shared_path(spark, "tokens")
    token_files.write(hard, path)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    stream = []
    left = defaultdict(list)
    for i, t in TEXTS:
        left[i].append(ids(t) + [0])
    for r in got:
        own = next(x for x in left[r["doc_id"]] if (len(x), crc(x)) == (r["n_tokens"], r["ids_crc32"]))
        left[r["doc_id"]].remove(own)
        assert r["start"] == len(stream)
        stream += own
    places = [0, 1, 17, len(stream) - 1, len(stream), 400, 400]
    at = token_files.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted((r["place"], r["token"]) for r in at if r["token"] is not None) == sorted(
        (p, stream[p]) for p in places if p < len(stream))
    assert len(at) == len(places)
    path = rows.shared_path(spark, "tokens")
    token_files.write(none, path)
    assert token_files.read(spark, path).count() == 0


def test_fullest_against_all_combinations():
    pick = random.Random(2)
    for _ in range(300):
        counts = {pick.randint(1, 20): pick.randint(1, 3) for _ in range(pick.randint(0, 5))}
        space = pick.randint(0, 40)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        use = packing.fullest(counts, space)
        assert sum(x * k for x, k in use.items()) == max(s for s in sums if s <= space)
        assert all(0 < k <= counts[x] for x, k in use.items())


def test_plan_uses_every_piece_once():
    pick = random.Random(3)
    counts = {pick.randint(1, 100): pick.randint(1, 500) for _ in range(60)}
    used = defaultdict(int)
    made = packing.plan(counts, 100)
    for times, use in made:
        assert sum(x * k for x, k in use.items()) <= 100
        for x, k in use.items():
            used[x] += times * k
    assert used == counts
    assert sum(times for times, _ in made) <= 1.005 * best_fit(counts, 100)


def test_plan_fills_sequences():
    pick = random.Random(4)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(1023, max(3, int(pick.lognormvariate(5.6, 1))))] += 1
    least = -(-sum(x * n for x, n in counts.items()) // 1024)
    assert sum(times for times, _ in packing.plan(counts, 1024)) <= least + 2 <= best_fit(counts, 1024) + 2


def best_fit(counts, size):
    """Sequences of best-fit decreasing."""
    space, made = [0] * (size + 1), 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            r = next((r for r in range(x, size + 1) if space[r]), None)
            if r is None:
                r, made = size, made + 1
            else:
                space[r] -= 1
            space[r - x] += 1
    return made


def test_packing(make, hard, none):
    texts = TEXTS + [(100 + k, prose(k, 20 + 37 * k % 900)) for k in range(150)]
    docs = make(texts)
    placed = packing.packed(packing.pieces(docs, with_ids=True))
    got = placed.collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for i, t in texts:
        whole, at = ids(t) + [2], 0
        while at < len(whole):
            n = len(whole) if len(whole) <= 1024 else 1024 if at else len(whole) % 1024 or 1024
            assert any((r["start"], r["length"], r["ids_crc32"]) == (at, n, crc(whole[at:at + n])) for r in pieces[i])
            at += n
    total = sum(r["length"] for r in got)
    assert total == sum(len(ids(t)) + 1 for _, t in texts)
    joined = packing.sequences(placed).collect()
    assert len(joined) == len(sequences) and sum(len(r["ids"]) for r in joined) == 4 * total
    for r in joined:
        assert r["length"] * 4 == len(r["ids"])
        assert bytes(r["ids"]) == b"".join(bytes(x["ids"]) for x in sorted(sequences[r["sequence_id"]], key=lambda x: x["offset"]))
    assert packing.packed(packing.pieces(none)).count() == 0
