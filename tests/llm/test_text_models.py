"""HTML extraction, language identification and the quality classifier."""

import html
import math
import random
import re

import numpy as np
import pytest

from codesift.llm import html_text, language, quality_qda
from tests.llm.conftest import TEXTS, prose


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 26, 10])
def test_common(cells):
    pick = random.Random(1)
    for _ in range(800):
        a, b = ([pick.randint(0, 4) for _ in range(pick.randint(0, 14))] for _ in range(2))
        got = html_text.common(a, b, cells)
        left = iter(b)
        assert got == sorted(set(got)) and all(a[i] in left for i in got) and len(got) == lcs(a, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<div id="cookie-banner">We use cookies</div><header class="site-header"><a href="/">Home</a></header>
<div class="menu"><ul><li><a href=a>A</a></ul></div><main><article class="post"><header><h1>Big &amp; title</h1>
<p class=byline>By X</p></header><p>First   <i>para</i>&nbsp;one<p>Second<br>line <script>if (a<b) x("</p>")</script> end
<ul><li>one<li>two</ul><div class="ad-slot">Buy</div><aside>See also</aside><blockquote>Quote &#x41;</blockquote>
<table><tr><td>c1<td>c2</table><form><input> Subscribe</form><!-- <p>no</p> --><p hidden>Unseen</p></article>
<section id="comments"><article class="comment"><p>Reader says</p></article></section></main><div class=sidebar>Side</div>
<footer>Foot</footer></body></html>"""


def test_structure():
    lines = html_text.blocks(PAGE)
    assert html_text.main_text(lines, []) == "Big & title\nFirst para one\nSecond line end\none\ntwo\nQuote A\nc1\nc2"
    assert html_text.main_text(html_text.blocks(""), []) == ""
    assert html_text.main_text(html_text.blocks("just text & more < 3 <b>bold"), []) == "just text & more < 3 bold"
    assert html_text.blocks("<script>never ends") == []


def test_divisions_by_name():
    """Pages without elements that tell: names of classes do, and lists of links stand out."""
    page = """<body class="with-sidebar page"><div id="siteheader">My site</div><ul><li><a href=a>News</a><li><a href=b>About us</a></ul>
    <div id="main" class="clearfix"><h2>Report</h2><p>The first <a href=c>paragraph</a> of the report.</p><div class="ad-300x250">Buy</div>
    <div class="post-content">Bare text in it</div><form action=s>Your mail <input></form></div><div class="commentbox"><p>Nice!</p></div>
    <div class="cookiebar">Cookies</div><div class="hidden">Unseen</div><div id="pagefooter">(c) site</div></body>"""
    assert html_text.main_text(html_text.blocks(page), []) == "Report\nThe first paragraph of the report.\nBare text in it"
    plain = "<div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><p>Running text.</p><div class=menu>M</div>"
    assert html_text.main_text(html_text.blocks(plain), []) == "Title\nRunning text."


def site(k, own):
    """A page without an article element: only its neighbours show what is its frame."""
    return (f"<html><body><div>Welcome to the site</div><div>All you want to read</div><div>{own}</div><p>{own} again {k}</p>"
            f"<div>Copyright of the site</div></body></html>")


def plain(page):
    """The article of the tables' pages, by pattern."""
    body = re.search("<article>(.*?)</article>", page, re.S)
    parts = re.split("</?(?:p|h1)>", body[1]) if body else []
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub("<(?:b|/b|br)>", " ", x))).strip() for x in parts)
    return "\n".join(x for x in texts if x)


def test_pages(spark):
    pages = [(k, f"http://a.example.org/x/{k}", site(k, f"Own words of page number {k}, long enough to stand out"), 1) for k in range(200)]
    article = "<html><nav>N</nav><article><h1>H</h1><p>Same for all</p><p>Text {}</p></article><footer>F</footer></html>"
    pages += [(1000 + k, f"http://b.example.org/y/{k % 3}", article.format(k % 4), 2) for k in range(30)]
    pages += [(2000, None, PAGE, 3), (2001, "http://[bad", "<p>x</p>", 3), (2002, "", None, 3), (None, None, None, None),
              (2003, "http://a.example.org/x/7", "", 3), (2004, "http://c.example.org", "<div>" * 3000 + "deep", 3),
              (2005, "http://d.example.org/l", "<p>" + prose(1, 50_000) + "</p>", 3), (2005, "http://d.example.org/l", None, 3)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = html_text.extracted(docs).select("row.page_id", "row.url", "row.text", "text").toDF("id", "url", "other", "text").collect()
    assert len(got) == len(pages)
    by_id = {r["id"]: r["text"] for r in got if r["id"] != 2005}
    for k in range(200):
        own = f"Own words of page number {k}, long enough to stand out"
        assert by_id[k] == f"{own}\n{own} again {k}"
    for k in range(30):
        assert by_id[1000 + k] == f"H\nSame for all\nText {k % 4}"
    assert by_id[2000].startswith("Big & title") and by_id[2001] == "x" and by_id[2002] == "" and by_id[None] == ""
    assert by_id[2004] == "deep"
    assert sorted(len(r["text"]) for r in got if r["id"] == 2005) == [0, len(re.sub(r"\s+", " ", prose(1, 50_000)))]
    assert html_text.extracted(docs.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"] or "") for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extracted(pages).select("row.page_id", "text").collect()}
    assert got == want


LANGS = {
    "en": "the of and to in is that it for was with as this from they have which there",
    "de": "der die und in den von zu das mit sich des auf für ist nicht eine werden straße",
    "el": "και το να είναι για από με που της στην των ένα αυτό",
}


def spoken(seed, lang, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(LANGS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    learn = [(spoken(k, lang, 60), lang) for k in range(60) for lang in LANGS] + [("no language", None), (None, "en")]
    return language.fit(spark.createDataFrame(learn, "text string, lang string"))


def slow_path(scores, penalty):
    n, k = scores.shape
    value, back = scores[0].copy(), []
    for i in range(1, n):
        step = value[:, None] - penalty * (1 - np.eye(k))
        back.append(step.argmax(axis=0))
        value = step.max(axis=0) + scores[i]
    return value.max()


def worth(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_path_is_best(model):
    pick = np.random.default_rng(3)
    for k in range(200):
        scores = pick.normal(0, 6, (pick.integers(1, 40), 3)) + np.array([k % 7, 0, 0])
        path = model.path(scores)
        assert math.isclose(worth(scores, path, model.penalty), slow_path(scores, model.penalty), abs_tol=1e-6)


def test_languages(spark, model, hard, none):
    texts = [(spoken(1000 + k, lang, 3 + k), lang) for k in range(40) for lang in LANGS]
    got = language.predicted(spark.createDataFrame(texts, "text string, lang string"), model).collect()
    right = sum(r["lang_pred"] == r["row"]["lang"] for r in got)
    assert right >= 0.99 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    mixed = " ".join([spoken(1, "en", 30), spoken(2, "de", 40), spoken(3, "el", 20)])
    one = language.predicted(spark.createDataFrame([(mixed,)], "text string"), model).first()
    assert one["lang_pred"] == "de" and [s["lang"] for s in one["spans"]] == ["en", "de", "el"]
    assert abs(one["spans"][1]["first"] - 30) <= 3 and abs(one["spans"][1]["end"] - 70) <= 3
    odd = {r["row"]["doc_id"]: r for r in language.predicted(hard, model).collect()}
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 11)] == ["und"] * 4 and odd[9]["lang_pred"] == "en"
    assert language.predicted(hard, model).count() == len(TEXTS) and language.predicted(none, model).count() == 0
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predicted(hard, None).collect()} == {"und"}


def test_words_belong_to_their_text():
    words = language.split(["İstanbul a", "", "1 2", "\0b\0c d", "e"])
    assert np.bincount(words.text, minlength=5).tolist() == [2, 0, 0, 3, 1]


def test_quality(spark, make):
    pick = random.Random(4)
    texts, labels = [], []
    for k in range(400):
        good = pick.random() < 0.7
        text = prose(k, pick.randint(3, 200))
        if not good:
            text = pick.choice([lambda t: t.replace(" ", "### "), lambda t: " | ".join(t.split()), lambda t: (t.split()[0] + " ") * 80])(text)
        texts.append((k, text))
        labels.append((k, int(good)))
    docs = make(texts + TEXTS)
    marks = spark.createDataFrame([*labels, (5000, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = quality_qda.scored(docs, marks).collect()
    assert len(got) == len(texts) + len(TEXTS)
    known = dict(labels)
    held = [(r["score"] >= 0.7, known[r["doc_id"]] == 1) for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_qda.scored(docs, marks.limit(0)).collect()} == {0.5}
    assert quality_qda.scored(docs.limit(0), marks).count() == 0


def test_density_difference():
    """Scores against densities written out."""
    pick = np.random.default_rng(5)
    x = pick.normal(size=(50, len(quality_qda.FEATURES)))
    means = pick.normal(size=(2, x.shape[1]))
    spread = [np.eye(x.shape[1]) * s + 0.1 for s in (1.0, 2.0)]
    lower = [np.linalg.cholesky(c) for c in spread]
    offsets = tuple(math.log(p) - float(np.log(np.diag(m)).sum()) for p, m in zip((0.3, 0.7), lower, strict=True))
    model = quality_qda.Model(offsets, means, np.array([np.linalg.inv(m) for m in lower]), 1.0)
    logs = [math.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            for p, c, m in zip((0.3, 0.7), spread, means, strict=True)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_fold():
    from zlib import crc32

    assert [crc32(str(k).encode()) % 4 == 2 for k in range(3)] == [crc32(b"0") % 4 == 2, crc32(b"1") % 4 == 2, crc32(b"2") % 4 == 2]
