"""Documents with all that tables can hold: nulls, empty and very long texts, repeated rows, clashing column names."""

import random

import pytest

CLASHES = {"row": 1.5, "t": 7, "f": "x", "kept": "no", "k": 3, "spans": "s", "hits": "h", "x": 0, "d": "d", "w": None,
           "length": 9, "digest": b"0", "file": "p", "at": 1, "score": 0.1, "text2": None}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row double, t int, f string, kept string, "
          "k long, spans string, hits string, x int, d string, w string, length int, digest binary, file string, at long, "
          "score double, text2 string")


def prose(seed: int, n: int, words: str = "stone river light of the and cold morning under grey hills we walked in to a far town") -> str:
    pick = random.Random(seed)
    out, pool = [], words.split()
    while len(out) < n:
        out.append(pick.choice(pool) + (str(pick.randrange(100, 999)) if pick.random() < 0.25 else "") + pick.choice(["", "", ".", "\n"]))
    return " ".join(out)


def rows(texts):
    """(doc_id, text) pairs as full rows."""
    return [(i, t, "en", "src0", len(t or ""), *CLASHES.values()) for i, t in texts]


LONG = prose(99, 60_000)
TEXTS = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "word"), (None, prose(1, 80)), (5, prose(5, 80)), (5, prose(5, 80)),
    (6, prose(5, 80)), (7, prose(5, 80) + " end"), (8, prose(8, 120)), (9, LONG), (10, "naïve café 中文 \U0001f600 " + prose(10, 60)),
    (11, "#" * 400 + " " + "% $ & " * 60), (12, "again and again " * 60), (13, "a" * 5000), (14, "Stop.\n" * 70),
    (15, prose(15, 60).replace(" ", " ", 3) + "\x00\x1f"), (None, None), (16, "͸ <|endoftext|> 's \r\n\r\n x"),
]


@pytest.fixture
def hard(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)
