"""WARC archives: written, read back, held against a brute-force resolution; hard payloads and tables."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from codesift.llm import warc

SCHEMA = "page_id long, url string, html string, digest binary, record string, size int, payload string, first long, nth int"


def table(spark, pages):
    return spark.createDataFrame([(*p, b"x", "r", 1, "p", 9, 2) for p in pages], SCHEMA)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def resolved(pages, least=0):
    """Every page's row, by brute force."""
    order = sorted(range(len(pages)), key=lambda k: tuple((x is None, x) for x in pages[k][:2]))
    first, out = {}, []
    for k in order:
        i, _, html = pages[k]
        size, digest = len((html or "").encode()), sha1(html)
        if size < least or digest not in first:
            first.setdefault(digest, i)
            out.append((i, size, digest, "response", None))
        else:
            out.append((i, size, digest, "revisit", first[digest]))
    return sorted(out, key=repr)


def back(spark, pages, path, **options):
    warc.write(table(spark, pages), path, **options)
    found = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, found.collect()), key=repr)


NASTY = [
    "", None, "\r\n", "\r", "\n", "\r\r\n", "a\r\n", "a\r\r\n\r", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "WARC/1.1",
    "﻿é\U0001f600\0", " \t", "x" * 300_000, "ab\r\n" * 20_000, "\r" * 9_999 + "\n", "Content-Length: 1",
]


def test_payloads_come_back_whole(spark, tmp_path):
    pages = [(k, f"http://h/{k}", t) for k, t in enumerate(NASTY)]
    path = os.path.join(tmp_path, "a")
    warc.write(table(spark, pages), path)
    found = {r["page_id"]: r for r in warc.read(spark, path, payloads=True).collect()}
    for i, url, html in pages:
        if found[i]["record_type"] == "response":
            assert found[i]["payload"] == (html or "") and found[i]["url"] == url
    assert found[1]["record_type"] == "revisit" and found[1]["refers_to"] == 0
    assert found[1]["refers_to_record"] == found[0]["record_id"]
    assert len({r["record_id"] for r in found.values()}) == len(pages)


def test_against_brute_force(spark, tmp_path):
    pick = random.Random(3)
    pages = [(k, f"http://h/{pick.randrange(9)}", pick.choice(NASTY)) for k in range(300)]
    pages += [(1000 + k, "http://h/x", "one page that holds a third of the rows") for k in range(200)]
    pages += pages[:40] + pages[:10]  # rows that repeat
    pages += [(None, None, "ab"), (None, None, "ab"), (None, "http://h", "ab"), (7000, None, "ab"), (8000, " a\r\nX-Page-ID: 5 b", "u")]
    for least in (0, 5):
        assert back(spark, pages, os.path.join(tmp_path, str(least)), least_bytes=least) == resolved(pages, least)


def test_the_least_bytes_itself_is_shared(spark, tmp_path):
    pages = [(1, "u", "abcde"), (2, "u", "abcde"), (3, "u", "abcd"), (4, "u", "abcd")]
    got = back(spark, pages, os.path.join(tmp_path, "a"), least_bytes=5)
    assert [r[3:] for r in got] == [("response", None), ("revisit", 1), ("response", None), ("response", None)]


def test_files_are_archives(spark, tmp_path):
    """The files, read by a plain reader of the format: header lines, empty line, block, two line ends."""
    path = os.path.join(tmp_path, "a")
    warc.write(table(spark, [(1, "http://h/a b", "<p>é</p>"), (2, "http://h/c", "<p>é</p>")]), path, date="2024-01-02T03:04:05Z")
    data = b"".join(gzip.open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    kinds = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block, data = data[:n], data[n:]
        assert data[:4] == b"\r\n\r\n"
        data = data[4:]
        kinds.append(fields["WARC-Type"])
        assert fields["WARC-Date"] == "2024-01-02T03:04:05Z" and fields["WARC-Payload-Digest"] == "sha1:" + sha1("<p>é</p>")
        assert b"\r\nContent-Length: 9\r\n" in block
        if fields["WARC-Type"] == "response":
            assert block.endswith(b"\r\n\r\n<p>\xc3\xa9</p>") and fields["WARC-Target-URI"] == "http://h/a%20b"
        else:
            assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To-Target-URI"] == "http://h/a%20b"
    assert sorted(kinds) == ["response", "revisit"]


def test_empty_table_and_damage(spark, tmp_path):
    assert back(spark, [], os.path.join(tmp_path, "none")) == []
    path = os.path.join(tmp_path, "bad")
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nWARC-Record-ID: <x>\r\nContent-Length: 30\r\n\r\n"
    os.makedirs(path)
    for body, message in ((good + "HTTP/1.1 200\r\nContent-Length: 0", "damaged|does not end"), ("junk\r\n", "not the start"), (good + "x", "ends within")):
        with open(os.path.join(path, "part-0.txt"), "w", newline="") as f:
            f.write(body)
        with pytest.raises(Exception, match=message):
            warc.read(spark, path).collect()
