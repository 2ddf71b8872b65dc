"""Extraction on pages written for the test, unlike those the tree learns from."""

from __future__ import annotations

import re

import pytest

from millrace.llm import html

TREE = html.train(html.labelled_table())
CASES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Head &amp; tail</h1><p>One &lt;b&gt; two.<p>Three\n\n  four"
    "<script>var a='</p><p>no';</script></article><footer>&copy; me</footer>": "Head & tail\n\nOne <b> two.\n\nThree four",
    '<body><div class="site-header">Name</div><main><p>First.</p><div class="advert">Buy!</div><p>Second &#233; &eacute; &amp;amp; &nbsp; end</p></main><div id="comments"><p>I agree with this.</p></div>':
        "First.\n\nSecond é é &amp; end",
    '<article><p>Text <b>bold</b> and <a href="#">a link</a> inline.</p><form><p>Your mail</p><input></form><aside>Side</aside><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>':
        "Text bold and a link inline.\n\none\n\ntwo\n\na\n\nb",
    '<div class="cookie-banner">We use cookies.</div><article>loose text<br>next line<!-- no --><p>p</article><div class="sidebar">x</div>': "loose text next line\n\np",
    '<article><header class="entry-header"><h2>Title</h2></header><p>Body</p><section class="comments"><div>Nice</div></section><footer>By me</footer></article>': "Title\n\nBody",
    '<article><p>a</p><div class="notice">Note!</div><textarea><p>no</p></textarea><p title="x > y">b</p></article>': "a\n\nb",
    "": "", "   ": "", "<p></p><br>": "", "<article><p>cut off &am": "cut off &am", "<article></p></div><p>x</article></p>": "x",
}


@pytest.mark.parametrize("page", list(CASES))
def test_main_text(page):
    assert html.main_text(page, TREE) == CASES[page]


def test_tree_fits_its_table():
    table = html.labelled_table()
    assert len(table) >= 40 and 0.3 < table["label"].mean() < 0.7
    assert (TREE.predict(table[list(html.FEATURES)].to_numpy(float)) == (table["label"] > 0)).all()


def test_tree_uses_words_and_both_neighbours():
    """The method's features decide: own word count, and a feature of the block before and of the one behind."""
    used = {html.FEATURES[f] for f in TREE.feature if f >= 0}
    assert "words" in used, used
    assert used & {"before_words", "before_links"} and used & {"after_words", "after_links"}, used
    table = html.labelled_table()
    assert table.loc[table["named"] > 0, "label"].nunique() == 2


LONG = "The water came back to the valley after eleven years, and people walked out of three villages to see it."


@pytest.mark.parametrize("page", [
    f'<article><p>{LONG}</p><p><a class="nav-link">Paris</a> is the capital of the old country and its largest town by far.</p><p>{LONG}</p></article>',
    f'<article><h1>Wells</h1><section id="discussion"><p>{LONG}</p><p>{LONG}</p></section></article>',
    f'<article><section id="search-methods"><p>{LONG}</p><p>{LONG}</p></section><p>{LONG}</p></article>',
    f'<article><p>{LONG}</p><h2 id="related-work">Related work</h2><p>{LONG}</p></article>',
    f'<article><p>{LONG}</p><div class="side-effects"><p>{LONG}</p></div><h3 class="menu-title">Side effects</h3><p>{LONG}</p></article>',
])
def test_names_inside_the_story_drop_nothing(page):
    plain = [" ".join(re.sub("<[^>]*>", " ", p).split()) for p in re.split("</p>|</h[123]>", page)]
    assert html.main_text(page, TREE) == "\n\n".join(filter(None, plain))


@pytest.mark.parametrize("part", ['<div class="ad">', '<div class="top-banner">', '<section id="comments">', '<div class="user-comments">', '<ul class="nav-menu"><li>', '<div class="site-footer">',
                                  '<div id="cookie-notice">', '<aside>', '<nav>', '<form>', '<div role="navigation">', '<div class="sidebar-left">', '<div class="newsletter-form">'])
def test_named_parts_go_however_long(part):
    page = f"<article><p>{LONG}</p>{part}{LONG} {LONG}</{re.match('<([a-z]+)', part)[1]}><p>{LONG}</p></article>"
    assert html.main_text(page, TREE) == f"{LONG}\n\n{LONG}"


def test_tree_generalises_to_left_out_pages(monkeypatch):
    right = total = 0
    pages = html.LABELLED
    whole = html.labelled_table()
    sizes = [len(html.blocks(p)) for p in pages]
    at = 0
    for n in sizes:
        part = whole.iloc[at:at + n]
        tree = html.train(whole.drop(part.index))
        right += int((tree.predict(part[list(html.FEATURES)].to_numpy(float)) == (part["label"] > 0)).sum())
        total += n
        at += n
    assert right / total > 0.85


def test_long_and_broken_pages_end():
    assert html.main_text("<a" * 20000, TREE) is not None
    body = "<article>" + "<p>word " * 20000
    assert html.main_text(body, TREE).count("word") == 20000
    assert html.main_text("<div>" * 5000 + "x" + '"' * 5000, TREE) is not None


def test_rows(spark):
    page = next(iter(CASES))
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (None, "v", "", None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(1, "u", CASES[page], len(CASES[page]))] * 2 + [(2, None, "", 0), (None, "v", "", 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_only_a_hidden_attribute_hides():
    body = "<p>The first line of a long story about water.</p>"
    for tag in ('<article data-title="a hidden river">', "<article data-x='hidden'>", "<article data-x=hidden>", '<article data-a="x = hidden y">'):
        assert html.main_text(f"{tag}{body}</article>", TREE) == "The first line of a long story about water.", tag
    for tag in ("<p hidden>", '<p HIDDEN="">', "<p class=x hidden=until-found>", '<p title="a"hidden>'):
        assert html.main_text(f"<article>{body}{tag}gone</p></article>", TREE) == "The first line of a long story about water.", tag


def test_formulas_and_fallbacks_stay():
    page = "<article><p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p><p><object data=x>A map of the town.</object></p></article>"
    assert html.main_text(page, TREE) == "So a=b holds.\n\nA map of the town."
