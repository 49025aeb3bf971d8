"""Secrets beside placeholders, and tokens of one case."""

import random

from codesift.llm import secret_scan


def token(seed, letters, n):
    pick = random.Random(seed)
    return "".join(pick.choice(letters) for _ in range(n))


LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LOWER


def test_allowed_part_hides_no_other_part(make):
    texts = [(k, f"see {a}{token(k, MIXED, 48)}{b} end") for k, (a, b) in enumerate([
        ("sample/conf/", ""), ("", "/xxxx"), ("AAAAAAAA/", ""), ("1234567890-", "-dummy"), ("", "=" * 8)])]
    texts += [(50, f"see {token(50, MIXED, 40)}AAAAAA{token(51, MIXED, 40)} end")]
    for (_, text), r in zip(texts, sorted(secret_scan.redacted(make(texts)).collect(), key=lambda r: r["doc_id"]), strict=True):
        secret = token(r["doc_id"], MIXED, 40 if r["doc_id"] == 50 else 48)
        assert "[REDACTED]" in r["text"] and secret[8:40] not in r["text"], (text, r["text"])
    plain = [(1, "sha512-" + token(9, MIXED, 86) + "=="), (2, "EXAMPLE" + token(10, MIXED, 20) + "sample"), (3, "a sample of 1234567890")]
    assert [r["text"] for r in secret_scan.redacted(make(plain)).orderBy("doc_id").collect()] == [t for _, t in plain]


def test_tokens_of_one_case(make):
    texts = [(k, f"key {token(k, LOWER if k % 2 else UPPER, 32)} end") for k in range(60)]
    kinds = [[s["kind"] for s in r["spans"]] for r in secret_scan.scan(make(texts)).orderBy("row.doc_id").collect()]
    assert all(kinds[k] == ["entropy_lower" if k % 2 else "entropy_upper"] for k in range(60))
