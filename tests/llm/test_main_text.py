import html
import itertools
import re
import time

import numpy as np
import pytest

from tests.llm.cases import table
from vigilar.llm.main_text import Model, Page, extract_main_text, fixed_model, main_text, marginals, parse, train


@pytest.fixture(scope="module")
def model():
    return fixed_model()


def expected(page):
    """The given pages have one article of a heading and paragraphs."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", article[1]) if article else []
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf):
    pages = table(spark, sf, "pages")
    want = {r["page_id"]: (r["url"], expected(r["html"])) for r in pages.collect()}
    rows = extract_main_text(pages).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=/a>Home</a></nav><div class="cookie-notice">We use cookies here.</div>
%s
<aside class="sidebar"><p>Look at this as well, it is nice.</p></aside><form><p>Your mail address please.</p></form>
<section class="comments"><h2>Comments</h2><p>I liked this a lot, said a reader.</p></section><footer>&copy; all rights</footer></body></html>"""
BODY = "<h1>The   title &amp; more</h1><p>First&nbsp;<b>bold</b> words<br>and others.\n More.<p>Second one.<ul><li>A point<li>Another</ul>"
TEXT = "The title & more\nFirst bold words and others. More.\nSecond one.\nA point\nAnother"


@pytest.mark.parametrize("root", ["<article>%s</article>", "<main>%s</main>", "<div class='wrapper'><div id='content'>%s</div></div>", "<article class='post'><div>%s</div></article>"])
def test_traps_around_and_inside(model, root):
    assert main_text(PAGE % (root % BODY), model) == TEXT
    traps = (
        "<div class='ad'>Buy it now, it is cheap.</div>", "<aside><p>Related reading for you.</p></aside>", "<form><p>Send us your mail.</p><input></form>",
        "<div class='comments'><div class='comment'><p>Nice text, thank you.</p></div></div>", "<p class='notice'>This site uses cookies.</p>",
        "<nav><ul><li><a href='#'>Up</a></li></ul></nav>", "<script>x()</script><style>y{}</style><!-- <p>z</p> -->",
    )
    for trap in traps:
        assert main_text(PAGE % (root % (BODY + trap)), model) == TEXT, trap
        assert main_text(PAGE % (root % (trap + BODY)), model) == TEXT, trap


def test_special_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<<<>>> &am &amp"), (4, "u", PAGE % f"<article>{BODY}</article>"), (4, "u", PAGE % f"<article>{BODY}</article>"), (5, "u", "<article>" + "<p>word word.</p>" * 5000), (6, "u", "<div>" * 3000 + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "content", "parent"):
        pages = pages.withColumn(name, pages["url"])
    got = sorted((str(r["page_id"]), str(r["url"]), r["n_chars"], r["text"][:40]) for r in extract_main_text(pages).collect())
    assert len(got) == len(rows) and got[0][2] == 0
    assert [g[2] for g in got if g[0] == "4"] == [len(TEXT)] * 2
    assert [g[2] for g in got if g[0] == "5"] == [5000 * 11 - 1]
    assert extract_main_text(pages.limit(0)).collect() == []


def test_messages_give_exact_marginals():
    """Against the sum over all states of a small tree."""
    rng = np.random.default_rng(3)
    page = Page(parent=[-1, 0, 0, 1, 1, 2, 4], tag=["#page", *"abcabc"], tokens=[[] for _ in range(7)], label=[None] * 7, words=[0, 3, 1, 9, 30, 2, 5], linked=[0] * 7)
    pair = {t: tuple(rng.random(4)) for t in "abc"} | {"*": (0.2, 0.8, 0.3, 0.7)}
    model = Model(rng.normal(0, 1, 1 << 12).tolist(), pair)
    from vigilar.llm.main_text import _features

    unary = [1 / (1 + np.exp(-sum(model.unary[f] for f in features))) for features in _features(page)]
    total, content = 0.0, np.zeros(7)
    for state in itertools.product((0, 1), repeat=7):
        p = 1.0
        for i in range(7):
            p *= unary[i] if state[i] else 1 - unary[i]
            if i:
                p *= pair[page.tag[i]][2 * state[page.parent[i]] + state[i]]
        total += p
        content += p * np.array(state)
    assert np.allclose(marginals(page, model), content / total, atol=1e-6)


def test_parser_closes_what_is_left_open():
    page = parse("<ul><li>a<li>b</ul><p>c<div>d</div>")
    assert [page.tag[i] for i in range(1, len(page.tag))] == ["ul", "li", "li", "p", "div"]
    assert [page.parent[i] for i in range(1, len(page.tag))] == [0, 1, 1, 0, 0]
    page = parse("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f")
    assert [page.tag[i] for i in range(1, len(page.tag))] == ["table", "tr", "td", "td", "tr", "td", "table", "tr", "td"]
    assert [page.parent[i] for i in range(1, len(page.tag))] == [0, 1, 2, 2, 1, 5, 6, 7, 8]


PLAIN = "<h1>A heading of it</h1><p>First paragraph with some words in it, and more.</p><p>Second paragraph follows, it is short.</p>"
SHAPES = {
    "body": "<html><body>%s</body></html>", "div": "<html><body><div>%s</div></body></html>", "div.page": "<body><div class='page'>%s</div></body>", "no body": "%s",
    "section": "<body><section>%s</section></body>", "table": "<body><table><tr><td>%s</td></tr></table></body>", "article": "<body><article>%s</article></body>",
    "main": "<main>%s</main>", "div.content": "<div class='content'>%s</div>", "entry-content": "<body><div class='entry-content'>%s</div></body>", "center": "<body><center>%s</center></body>",
    "unknown names": "<body><div class='foo'><div id='bar'><div>%s</div></div></div></body>", "span": "<body><span class='z'>%s</span></body>",
    "body with menu": "<body><nav><a href=/>Home</a></nav>%s<footer>(c) me</footer></body>",
    "divs with menu": "<body><div id='menu'><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></div><div id='wrap'>%s</div><div id='footer'>imprint</div></body>",
}
PLAIN_TEXT = "A heading of it\nFirst paragraph with some words in it, and more.\nSecond paragraph follows, it is short."


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_alone_in_a_table(spark, shape):
    """The text of a page does not come from the other pages of the table."""
    pages = spark.createDataFrame([(1, "u", SHAPES[shape] % PLAIN)], "page_id long, url string, html string")
    assert [r["text"] for r in extract_main_text(pages).collect()] == [PLAIN_TEXT]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("Just a text. Two sentences, no tags.", "Just a text. Two sentences, no tags."), ("<body>Just <b>bold</b> words.<br>And more.</body>", "Just bold words. And more."),
        ("<article><p>Words here and more words.</p><div class='x", "Words here and more words."), ("<article><p>Words here, a &lt; b and 1 < 2.</p></article><!-- open", "Words here, a < b and 1 < 2."),
        ("<article><p title=a>b>One > two.</p><p title='x>y'>Some words.</p></article>", "b>One > two.\nSome words."), ("<article><p>It's a \"quote</p><p>Don't.</p></article>", "It's a \"quote\nDon't."),
        ("<article><p>One&nbsp;two\u2003three\n four.</p></article>", "One two three four."), ("<article><p x='>Words with a quote left open.</p></article>", "Words with a quote left open."),
    ],
)
def test_text_without_tags_and_unfinished_tags(model, html, text):
    assert main_text(html, model) == text


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 20_000 + "</span>" * 20_000, "<a " * 300_000, "<a href=\"" * 100_000, "<p x='" * 150_000 + ">", "<" * 1_000_000, "<!--" * 250_000, "<div>" + "<b>" * 20_000 + "<h1></h1>" * 20_000,
        "<li>" * 150_000, "<div><p>" * 60_000 + "x", "<a " + "= " * 500_000, "<table><tr><td>" * 30_000, "&" * 1_000_000, ("<div class=\"x\">" * 10 + "<p>a<b>") * 6000, "<script>" * 100_000, "<a>" * 100_000 + "</a></b>" * 100_000,
    ],
)
def test_long_and_broken_pages_take_seconds(model, html):
    began = time.time()
    main_text(html, model)
    assert time.time() - began < 20
