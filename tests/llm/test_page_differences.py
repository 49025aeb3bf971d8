"""Pairing of pages, and what shared lines tell, against brute force and on hosts made for the purpose."""

import random
from collections import Counter

from codesift.llm import html_text
from tests.llm.conftest import prose

FRAME = "".join(f"<div>Frame line {k} of this place with some words in it</div>" for k in range(8))


def texts(spark, pages):
    docs = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id int, url string, html string")
    got = html_text.extracted(docs).select("row.page_id", "text").collect()
    return [t for _, t in sorted((r["page_id"], r["text"]) for r in got)]


def paragraphs(*parts):
    return "".join(f"<p>{p}</p>" for p in parts)


def test_long_frame_without_article(spark):
    own = [prose(k, 25).replace("\n", " ") for k in range(6)]
    pages = [(f"http://a.org/n/{k}", FRAME + paragraphs(x) + "<div>Below all pages</div>") for k, x in enumerate(own)]
    copies = [(f"http://a.org/m/{k}", pages[2][1]) for k in range(20)] + [(f"http://a.org/n/2-{k}", pages[2][1]) for k in range(3)]
    got = texts(spark, pages + copies)
    assert got == [" ".join(x.split()) for x in own] + [" ".join(own[2].split())] * 23


def test_near_copies_without_article_stay(spark):
    same = [f"Paragraph {k} that all of them have in common" for k in range(10)]
    for n in (2, 5, 40, 90):
        pages = [paragraphs(*(f"{x} but for {k}" if j == k % 10 else x for j, x in enumerate(same))) for k in range(n)]
        got = texts(spark, [(f"http://b.org/{k:03}", p) for k, p in enumerate(pages)])
        assert [len(t.split("\n")) for t in got] == [10] * n


def test_prose_in_articles(spark):
    own = [f"Own text number {k} with words of its own" for k in range(12)]
    pages = [f"<article>{paragraphs(x, *(['A passage that neighbours repeat'] if k < 4 else []), 'Get our weekly mail')}</article>"
             for k, x in enumerate(own)]
    got = texts(spark, [(f"http://c.org/{k:02}", p) for k, p in enumerate(pages)])
    assert got == [x + ("\nA passage that neighbours repeat" if k < 4 else "") for k, x in enumerate(own)]
    few = texts(spark, [(f"http://c.org/{k:02}", p) for k, p in enumerate(pages[:7])])
    assert all(t.endswith("Get our weekly mail") for t in few)  # too few pages to be sure


def slow(pages):
    """By url and html: the same decisions, with every page of a host at hand and a table of subsequences."""
    seen = {}
    for url, page in pages:
        lines = html_text.blocks(page or "")
        host, path = html_text._address(url)
        key = (host, tuple(x.text for x in lines))
        if lines:
            seen[key] = min(path, seen.get(key, path))
    order = sorted(seen, key=lambda k: (k[0], seen[k], html_text._content(k[0], [hashed(t) for t in k[1]])))
    out = {}
    for pos, key in enumerate(order):
        first = pos // 64 * 64
        group = [k for k in order[max(0, first - 1):first + 65] if k[0] == key[0]]
        near = [k for k in order[max(0, pos - 1):pos] + order[pos + 1:pos + 2] if k[0] == key[0] and key[0]]
        if not near:
            continue
        partner = max(near, key=lambda k: html_text._nearness(seen[key], seen[k]))
        shared = html_text.common([hashed(t) for t in key[1]], [hashed(t) for t in partner[1]])
        have = Counter(t for k in group for t in set(k[1]))
        frame = {t for t in have if have[t] >= 0.95 * len(group)} if len(group) >= 4 else set()
        rest = [t for t in key[1] if t not in frame]
        share = sum(len(t) * (have[t] - 1) / max(1, len(group) - 1) for t in rest)
        own = rest and share < sum(map(len, rest)) / 4
        out[key] = shared, [k for k in shared if own and key[1][k] in frame], len(group) >= 8
    done = []
    for url, page in pages:
        lines = html_text.blocks(page or "")
        shared, framed, sure = out.get((html_text._address(url)[0], tuple(x.text for x in lines)), ([], [], False))
        done.append(html_text.main_text(lines, shared, framed, sure))
    return done


def hashed(text):
    return html_text._hashes([html_text.Line(text, False, False, False, 0)])[0]


def test_against_brute_force(spark):
    pick = random.Random(4)
    pages = []
    for host, n in (("x.org", 150), ("y.org", 20), ("z.org", 5), ("w.org", 2), ("", 6)):
        frame = [f"Frame {k} of {host} {prose(k, 4)}" for k in range(pick.randint(2, 6))]
        pool = [prose(100 + k, pick.randint(2, 30)) for k in range(n)]
        for k in range(n):
            text = paragraphs(*(pick.choice(pool) for _ in range(pick.randint(0, 3))), f"Number {k} {prose(900 + k, 9)}")
            text = f"<article>{text}</article>" if pick.random() < 0.3 else text
            lines = "".join(f"<div>{x}</div>" for x in frame if pick.random() < 0.99)
            path = "/".join(pick.choice("ab") for _ in range(3)) + f"/{k}"
            pages.append((f"http://{host}/{path}" if host else None, pick.choice([lines + text, text + lines])))
        pages += pick.choices(pages, k=n // 3)
    pages += [("http://x.org/e", None), ("http://x.org/e", ""), (None, None), ("http://[bad", "<p>text</p>")]
    assert texts(spark, pages) == slow(pages)
