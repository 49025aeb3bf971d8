"""Names that say what a text is about drop nothing; deep pages are read in time in proportion to their length."""

import time

import pytest

from codesift.llm import html_text

KEPT = [
    '<article><h2 id="discussion">{}</h2></article>', '<article><section id="related-work"><h3>A</h3><p>{}</p></section></article>',
    '<article class="post category-advertising"><p>{}</p></article>', '<div class="commentary"><p>{}</p></div>',
    '<article><section class="search-results"><p>{}</p></section></article>', "<article><div><div><div><div><p>{}</p></div></div></div></div></article>",
]
DROPPED = [
    '<article><p>A</p><div class="comment-list"><p>{}</p></div></article>', '<article><p>A</p><div id="comments">{}</div></article>',
    '<article><p>A</p><section class="related-posts"><p>{}</p></section></article>', '<main><p>A</p></main><div id="site-footer">{}</div>',
    "<article><p>A</p><aside>{}</aside></article>", '<div role="search">{}</div>', '<div class="searchbox">{}</div>',
]


@pytest.mark.parametrize("page", KEPT)
def test_kept(page):
    assert "the text" in html_text.main_text(html_text.blocks(page.format("the text")), [])


@pytest.mark.parametrize("page", DROPPED)
def test_dropped(page):
    assert "the text" not in html_text.main_text(html_text.blocks(page.format("the text")), [])


def test_text_deep_in_a_link_is_linked():
    line = html_text.blocks("<div><a href='/'><b><i><u><s><em>read on</em></s></u></i></b></a></div>")[0]
    assert line.linked == len("read on")


def test_deep_pages():
    for page in ("<div>a" * 80_000, "<p><ul><li>a" * 30_000, "<table><tr><td>a" * 30_000):
        start = time.time()
        assert len(html_text.blocks(page)) >= 30_000
        assert time.time() - start < 5


def test_markup_without_an_end():
    for page in ('<a b="' * 40_000 + ">", '<a b="' * 40_000, "<a " * 40_000, "<svg>x" * 40_000, "<p a='x>\"" * 40_001, "<![CDATA[ x" * 40_000):
        start = time.time()
        html_text.blocks(page)
        assert time.time() - start < 5
    for page, text in (('<p a="1>one</p><p>two', "one\ntwo"), ("<p>one<!-- > two", "one"), ("<p>one <b two", "one <b two"),
                       ("<p>one</p><![CDATA[ > two", "one\n> two"), ("<p title='a > b'>one", "one")):
        assert html_text.main_text(html_text.blocks(page), []) == text
