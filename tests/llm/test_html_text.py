import re

import pytest

from signbridge.llm import html_text
from signbridge.llm.common import table

LONG = "A sentence of some length, with commas, that makes a paragraph of prose for the article. "

CASES = [
    ("", ""), (None, ""), ("   ", ""), ("plain &amp; simple &lt;b&gt; &#233; &nbsp; x", "plain & simple <b> é x"),
    ("<p>a<p>b<script>x<y</script>c", "a b c"), ("<p>unclosed <b>bold", "unclosed bold"), ("<!-- never closed <p>x</p>", ""),
    ("<p>one<br>two</p>", "one two"), ("<p>in<b>li</b>ne</p>", "inline"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>cut <a href='x", "cut"),
    ("<article><h1>T</h1><p>x</p><section class='comments'><p>Nice, post, thanks, very much, indeed.</p></section></article>", "T x"),
    ("<div class='ad'>" + LONG * 3 + "</div><article><h1>Short.</h1></article>", "Short."),
    ("<nav>" + LONG + "</nav><div class='sidebar-right'><p>" + LONG + "</p></div><div id=c><h2>Head</h2><div><p>" + LONG + "</p><p>Short, too.</p></div></div>"
     "<div id='cookie_notice'><p>" + LONG + "</p></div><form><p>" + LONG + "</p></form><aside>" + LONG + "</aside><footer>" + LONG + "</footer>",
     "Head " + LONG.strip() + " Short, too."),
    ("<div class='page has-sidebar'><p>" + LONG + "</p><p>" + LONG + "</p><p>" + LONG + "</p></div>", " ".join([LONG.strip()] * 3)),
    ("<main><section><h2>A</h2><p>Short.</p></section><section><p>" + LONG + "</p></section><aside>no</aside></main>", "A Short. " + LONG.strip()),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>" + LONG + "</p></article>", "Title " + LONG.strip()),
    ("<div hidden><p>" + LONG + "</p></div><div><p style='display:none'>" + LONG + "</p><p>" + LONG + "</p></div>", LONG.strip()),
    ("<article><p>" + LONG + "</p><div class='search-method'><p>" + LONG + "</p></div><p id='replies-1'>" + LONG + "</p>"
     "<section class='discussion'><p>" + LONG + "</p></section><div class='ad-box'><p>" + LONG + "</p></div><div id='comments-section'><p>" + LONG
     + "</p></div><div class='search'><a href='/'>find</a></div><div class='notice'>" + LONG + "</div></article>", " ".join([LONG.strip()] * 4)),
    ("<p>in<img src='x'>line a<x-tag>b</x-tag>c <picture>d</picture>e</p>", "inline abc de"),
    ("<article><p>" + LONG + "</p></article><article><p>" + LONG * 2 + "</p></article>", (LONG * 2).strip()),
    ("<div>a</section>b</p>c</li>d</b>e</div>", "abcde"), ("<ul><li><span>a<li>b<ul><li>c</ul>d</ul>", "a b c d"),
    ("<div><a href='it's'>x</a><p title=\"a > b\">" + LONG + "</p></div>", "x " + LONG.strip()),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG.strip()
    assert html_text.main_text("<article>" + f"<p>{LONG}</p>" * 20000) == " ".join([LONG.strip()] * 20000)


@pytest.mark.parametrize("unit", ["<div></section>", "<span></b>", "<header>", "<ul><li>", "<span><p>x</p></i>", "<p><i>", "<x-y></z-z>", "<article><b></article>",
                                  "<div><p>x,", "<table><tr><td>", "<dl><dt></dd>"])
def test_time_grows_with_the_page(unit):
    import time
    start = time.process_time()
    html_text.main_text(unit * 30_000)
    assert time.process_time() - start < 8


def test_every_page(spark):
    """Against the pages' own article element, its tags taken out by hand."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    out = {r.page_id: r for r in html_text.extract(pages).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    import html
    for r in rows:
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", article)]
        assert out[r.page_id].text == " ".join(x for x in parts if x)
        assert out[r.page_id].n_chars == len(out[r.page_id].text) and out[r.page_id].url == r.url


def test_rows(spark):
    rows = [(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(pages).collect()), key=str) == sorted([(1, "u", "x", 1)] * 2 + [(None, None, "", 0)], key=str)
    assert html_text.extract(pages.where("false")).count() == 0
