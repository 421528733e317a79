"""Main text of web pages by a tree-structured graphical model over the elements of a page.

Every block element (and every inline element with a class, id or role) is a binary variable:
content or not. Its own features (tag, attribute words, parent, amount of text and share of link text
of its own and below it) give a unary potential; its tag gives a potential on the pair of its parent's
state and its own. Sum-product messages pass from the leaves to the root and back, which yields the
exact marginals of the tree.

All potentials are trained together by the likelihood of labelled pages, with the same messages over
all pages at once. The operator's model comes from the labelled pages below and from nothing else, so
a page has the same text in whatever table it stands; callers may train one on pages of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilar.llm import words as W

BITS = 12
STEPS = 120

# Element names of HTML by their role here.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
NEVER = set("script style template noscript head title meta link iframe object svg math canvas select option textarea button input audio video map noembed noframes xmp datalist".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = {"table", "ul", "ol", "dl", "td", "th", "select", "button", "article", "section", "aside", "div", "nav", "form", "body"}
# Attribute words of adverts, notices and comments: inside an <article> they tell nothing about the label.
UNSURE = set("ad ads advert adverts advertisement sponsor sponsored promo promotion banner notice cookie cookies consent gdpr alert popup modal overlay paywall subscribe newsletter signup comment comments discussion responses reply replies disqus thread".split())
ROOTS = ("article", "main")
TEXTY = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre".split())

# What may follow "<", the end of a tag or the begin of a quoted value, and the end of raw text.
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_EDGE = re.compile(r">|=[ \t\n\r\f]*[\"']")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Elements of a page (element 0 is the page itself) and its blocks of (text, element) pieces."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    tokens: list[list[str]] = field(default_factory=lambda: [[]])
    label: list[int | None] = field(default_factory=lambda: [None])
    words: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    blocks: list[list[tuple[str, int]]] = field(default_factory=list)


def _tag_end(html: str, at: int, closing: dict[str, bool]) -> int:
    """Where the tag whose attributes start at ``at`` ends, or -1. Only quotes after "=" hide a ">"."""
    while True:
        edge = _EDGE.search(html, at)
        if edge is None:
            return -1
        quote = html[edge.end() - 1]
        if quote == ">":
            return edge.end() - 1
        close = html.find(quote, edge.end()) if closing[quote] else -1
        if close < 0:
            closing[quote] = False  # none left: do not look again
        at = edge.end() if close < 0 else close + 1


class _Stack:
    """Open elements, with the number of each tag that is open, and since the last one that bounds implied ends."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("#page", 0)]
        self.count: dict[str, int] = {}
        self.frames: list[dict[str, int]] = [{}]

    def push(self, tag: str, element: int) -> None:
        self.open.append((tag, element))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in SCOPES:
            self.frames.append({})
        else:
            self.frames[-1][tag] = self.frames[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag, _ = self.open.pop()
        self.count[tag] -= 1
        if tag in SCOPES:
            self.frames.pop()
        else:
            self.frames[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        """An end tag: closes the innermost element of the name, if there is one."""
        if self.count.get(tag):
            while self.pop() != tag:
                pass

    def imply(self, tags: set[str]) -> None:
        """Close open elements of these names up to the innermost bound."""
        while True:
            frame = self.frames[-1]
            if any(frame.get(t) for t in tags):
                while self.pop() not in tags:
                    pass
            elif len(self.frames) > 1 and self.bound() in tags:
                while self.pop() not in SCOPES:
                    pass
            else:
                return

    def bound(self) -> str:
        return self.open[len(self.open) - 1 - sum(self.frames[-1].values())][0]


def parse(html: str) -> Page:
    """One pass from left to right; every step takes time in proportion to what it consumes or closes.

    An unfinished tag or comment at the end is dropped, end tags without an open element are ignored.
    """
    page = Page()
    stack = _Stack()
    block: list[tuple[str, int]] = []
    closing = {'"': True, "'": True}

    def end_block() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def add_text(text: str) -> None:
        if text:
            at = stack.open[-1][1]
            if page.tag[at] not in NEVER:
                text = unescape(text)
                count = len(text.split())
                page.words[at] += count
                page.linked[at] += count if stack.count.get("a") else 0
                block.append((text, at))

    at = text_from = 0
    while True:
        at = html.find("<", at)
        if at < 0:
            break
        found = _OPEN.match(html, at)
        if not found:  # a sign in a text
            at += 1
            continue
        add_text(html[text_from:at])
        if found[2] is None:
            comment = html.startswith("<!--", at)
            stop = html.find("-->", at + 2) if comment else html.find(">", at + 1)
            text_from = at = len(html) if stop < 0 else stop + (3 if comment else 1)
            continue
        tag = found[2].lower()
        stop = _tag_end(html, found.end(), closing)
        if stop < 0:
            text_from = len(html)
            break
        attributes = html[found.end() : stop]
        text_from = at = stop + 1
        if tag not in INLINE:
            end_block()
        if found[1]:
            stack.end(tag)
            continue
        if tag == "br":
            block.append((" ", stack.open[-1][1]))
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if shut:
            stack.imply(shut)
        tokens, label, hidden = [], None, False
        if attributes.strip(" /\n\t\r"):
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role", "itemprop"):
                    tokens += [x for x in _SPLIT.split(value.lower()) if x]
                elif name == "data-label" and value in ("0", "1"):
                    label = int(value)
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                    hidden = True
        element = stack.open[-1][1]
        if tag not in INLINE or tokens or hidden:
            page.parent.append(element)
            page.tag.append("template" if hidden else tag)
            page.tokens.append(tokens)
            page.label.append(label)
            page.words.append(0)
            page.linked.append(0)
            element = len(page.parent) - 1
        if tag in RAW:
            stack.push(tag, element)
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
        elif tag not in VOID:
            stack.push(tag, element)
    add_text(html[text_from:])
    end_block()
    return page


_bucket_cache: dict[str, int] = {}


def _bucket(name: str) -> int:
    known = _bucket_cache.get(name)
    if known is None:
        if len(_bucket_cache) > 100_000:
            _bucket_cache.clear()
        known = _bucket_cache[name] = crc32(name.encode()) & ((1 << BITS) - 1)
    return known


def _features(page: Page) -> list[list[int]]:
    """Hashed features of every element."""
    n = len(page.parent)
    words, linked, kids = page.words[:], page.linked[:], [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        words[p] += words[i]
        linked[p] += linked[i]
        kids[p] += page.tag[i] in TEXTY
    rooted = int(not set(ROOTS).isdisjoint(page.tag))
    out = []
    for i in range(n):
        own, tag = page.words[i], page.tag[i]
        names = [
            "bias", f"tag:{tag}", f"words:{min(own, 63).bit_length()}", f"links:{(4 * page.linked[i]) // own if own else 0}",
            f"below:{min(words[i], 255).bit_length()}", f"linked:{(4 * linked[i]) // words[i] if words[i] else 5}",
            f"kids:{min(kids[i], 7)}", f"kids:{tag}:{min(kids[i], 3)}", f"under:{page.tag[page.parent[i]] if i else ''}", f"rooted:{rooted}:{tag}",
        ]
        out.append([_bucket(x) for x in names + [f"is:{t}" for t in page.tokens[i]]])
    return out


@dataclass
class Model:
    unary: list[float]  # log odds by hashed feature
    pair: dict[str, tuple[float, float, float, float]]  # by tag: potentials of (parent, own) in 00, 01, 10, 11


def marginals(page: Page, model: Model) -> list[float]:
    """Probability of content of every element, by messages up and down the tree."""
    n = len(page.parent)
    unary, pair = model.unary, model.pair
    other = pair["*"]
    features = _features(page)
    in0, in1 = [1.0] * n, [1.0] * n  # own potential, then times the messages of all children
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n):
        if page.tag[i] in NEVER:
            in0[i], in1[i] = 1.0, 1e-9
        else:
            z = 0.0
            for f in features[i]:
                z += unary[f]
            z = min(20.0, max(-20.0, z))
            in1[i] = 1.0 / (1.0 + 2.718281828459045**-z)
            in0[i] = 1.0 - in1[i] + 1e-12
    for i in range(n - 1, 0, -1):  # children follow their parents
        t00, t01, t10, t11 = pair.get(page.tag[i], other)
        m0, m1 = t00 * in0[i] + t01 * in1[i], t10 * in0[i] + t11 * in1[i]
        s = m0 + m1
        up0[i], up1[i] = m0 / s, m1 / s
        p = page.parent[i]
        x, y = in0[p] * up0[i], in1[p] * up1[i]
        s = x + y or 1.0
        in0[p], in1[p] = x / s, y / s
    out = [0.0] * n
    down0, down1 = [1.0] * n, [1.0] * n
    for i in range(n):
        if i:
            p = page.parent[i]
            t00, t01, t10, t11 = pair.get(page.tag[i], other)
            r0, r1 = down0[p] * in0[p] / max(up0[i], 1e-12), down1[p] * in1[p] / max(up1[i], 1e-12)
            x, y = r0 * t00 + r1 * t10, r0 * t01 + r1 * t11
            s = x + y or 1.0
            down0[i], down1[i] = x / s, y / s
        x, y = down0[i] * in0[i], down1[i] * in1[i]
        out[i] = y / (x + y or 1.0)
    return out


def main_text(html: str, model: Model) -> str:
    page = parse(html)
    content = marginals(page, model)
    lines = []
    for block in page.blocks:
        text = _SPACE.sub(" ", "".join(t for t, i in block if content[i] > 0.5)).strip(" ")
        if text:
            lines.append(text)
    return "\n".join(lines)


# Labelled pages: data-label holds for an element and all below it, until another one says otherwise.
_SHORT = "<p>One of them.</p>"
_TEXT = "<p>Some longer words that a reader came for, with a sentence or two. And one more of them.</p>"
_LONG = "<p>" + "A paragraph goes on for many words, as such paragraphs do, and says what it has to say in full. " * 6 + "</p>"
_LINKS = "<ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li><li><a href='/c'>Three</a></li></ul>"
_PARTS_OUT = (
    f"<nav>{_LINKS}</nav>",
    f"<div class='menu'>{_LINKS}</div>",
    f"<div id='nav' class='navbar navigation'>{_LINKS}</div>",
    f"<ul class='breadcrumb breadcrumbs'><li><a href='/'>Home</a></li></ul>",
    f"<header class='site-header'><h1>Site name</h1>{_TEXT}</header>",
    "<div class='header banner masthead'><h2>Site name</h2></div>",
    f"<footer>{_TEXT}&copy; site</footer>",
    "<div id='footer' class='site-footer copyright'>&copy; site, all rights</div>",
    f"<aside>{_TEXT}</aside>",
    f"<aside class='sidebar'><h3>More</h3>{_LINKS}</aside>",
    f"<div class='sidebar widget side'><h3>More</h3>{_TEXT}</div>",
    f"<div class='ad'>{_TEXT}</div>",
    "<div class='ads advert advertisement sponsor sponsored promo promotion'><p>Buy this now, it is cheap.</p></div>",
    "<div class='ad banner'>Buy this now.</div>",
    f"<div class='notice'>{_TEXT}</div>",
    "<div class='cookie cookies consent gdpr notice banner'><p>We use cookies to do things. Accept them.</p></div>",
    "<div class='alert popup modal overlay paywall subscribe newsletter signup'><p>Sign up for our letter, it is free.</p></div>",
    "<p class='notice'>This page uses cookies, as many do.</p>",
    f"<form><label>Mail</label><input name='m'><p>Send us your address, please do.</p></form>",
    "<div class='form search'><form class='search-form'>Search</form></div>",
    f"<section class='comments'><h2>Comments</h2><div class='comment'>{_TEXT}</div></section>",
    f"<div id='comments' class='comments discussion responses'><ol><li class='comment'>{_TEXT}</li><li>{_TEXT}</li></ol></div>",
    f"<div class='comment reply reader'><p>I liked this, said a reader. Me too.</p></div>",
    f"<section id='disqus' class='comment-list thread'><article class='comment'>{_TEXT}</article></section>",
    "<div class='share social sharing buttons tools toolbar'><a href='#'>Share</a><a href='#'>Post</a></div>",
    f"<div class='related recommended recommendations more teaser'><h3>Read on</h3>{_LINKS}</div>",
    f"<section class='related'>{_LINKS}</section>",
    "<div class='meta byline tags author pagination pager'><a href='/x'>Tag</a></div>",
    "<menu><li>Open</li><li>Close</li></menu>",
    "<dialog><p>Are you sure that you want this?</p></dialog>",
    f"<div class='comments'>{_LONG}{_TEXT}</div>",
    f"<div class='ad sponsored'>{_LONG}</div>",
    f"<footer class='footer'>{_LONG}<ul><li><a href='/i'>Imprint</a></li></ul></footer>",
    f"<aside class='widget'>{_SHORT}{_SHORT}</aside>",
    "<nav><a href='/'>Home</a> <a href='/n'>News</a></nav>",
    "<header><a href='/'>Site</a></header>",
    "<footer>&copy; site</footer>",
    f"<form>{_TEXT}<textarea>write</textarea></form>",
)
# Names of such parts, each with every kind of filling in turn.
_NAMES_OUT = (
    "ad ads advert advertisement sponsor sponsored promo promotion banner notice cookie cookies consent alert popup modal overlay paywall subscribe newsletter "
    "signup comment comments discussion responses reply thread nav navigation navbar menu header masthead footer copyright imprint sidebar widget related "
    "recommended breadcrumb breadcrumbs share social login search pagination toolbar"
).split()
_FILLING = ("Buy this now, it is cheap.", _TEXT, "imprint", _LINKS, _SHORT + _SHORT, "<p>This site does some things, as many do. See <a href='/m'>more</a>.</p>", _LONG, "<h3>More</h3>" + _TEXT)
_PARTS_OUT += tuple(f"<div {('class', 'id')[k % 2]}='{name}'>{_FILLING[k % 8]}</div>" for k, name in enumerate(_NAMES_OUT))
_PARTS_OUT += tuple(f"<section class='{name}'><h2>Title</h2>{_FILLING[(k + 3) % 8]}</section>" for k, name in enumerate(_NAMES_OUT) if k % 2)
_PARTS_IN = (
    _TEXT,
    "<h1>A title of some words</h1>",
    "<h2>A heading</h2>" + _TEXT,
    "<p><b>Bold words, all of them.</b><br></p>",
    "<ul><li>First point of the text.</li><li>Second point, a <a href='/s'>source</a> too.</li></ul>",
    "<ol><li>First step of it.</li><li>Second step.</li></ol>",
    "<blockquote>" + _TEXT + "</blockquote>",
    "<pre>some code</pre>",
    "<table><thead><tr><th>Year</th></tr></thead><tbody><tr><td>Amount of it</td></tr></tbody></table>",
    "<div>" + _TEXT + "</div>",
    "<section>" + _TEXT + "<h3>Part</h3>" + _TEXT + "</section>",
    "<dl><dt>Name</dt><dd>What it means.</dd></dl>",
    "<figure><figcaption>What the picture shows.</figcaption></figure>",
    "<p>One.</p>",
    _SHORT + _SHORT,
    _LONG,
    "Words that stand in no paragraph of their own, as some pages have them.",
    "<h1>A title</h1>" + _SHORT + _TEXT,
    "<p>See <span class='term'>this term</span> and <em class='x'>that</em>.</p>",
    "<p class='lead intro'>The first words of it.</p>",
    "<div class='text paragraph'>" + _TEXT + "</div>",
)
_ROOTS = (
    "<article>{}</article>",
    "<main>{}</main>",
    "<article class='post entry story'>{}</article>",
    "<div class='article'>{}</div>",
    "<div class='content'>{}</div>",
    "<div class='post'>{}</div>",
    "<div class='post'><div>{}</div></div>",
    "<div id='content' class='post entry body'>{}</div>",
    "<div class='article-body post-content entry-content story-body main-content'>{}</div>",
    "<section class='article content'>{}</section>",
    "<div role='main' itemprop='articleBody'>{}</div>",
    # Pages that name nothing.
    "<div>{}</div>",
    "<div><div>{}</div></div>",
    "<div class='page'>{}</div>",
    "<section>{}</section>",
    "<div class='x y'>{}</div>",
    "<center>{}</center>",
    "<table><tr><td>{}</td></tr></table>",
    "<table class='layout'><tbody><tr><td>{}</td></tr></tbody></table>",
)
_BODY = "<html><head><title>t</title></head><body{}>{}</body></html>"
_PLAIN = ("Just a text, with two sentences. It has no tags at all.", "A few words", "Some <b>bold</b> words and a <a href='/s'>link</a> among others.", _LONG[3:-4], "One")


def _marked(part: str, state: int) -> str:
    """The first element of a part, labelled."""
    return part.replace(">", f" data-label='{state}'>", 1) if part.startswith("<") else part


def labelled_pages() -> list[str]:
    """Built-in labelled pages: every root with every kind of part, inside and around it or not, and text right in the body or page."""
    pages = []
    n_in, n_out = len(_PARTS_IN), len(_PARTS_OUT)
    for r, root in enumerate(_ROOTS):
        for k in range(r % 2, n_out + 12, 2):
            inner = [_PARTS_IN[(k + r + j * j) % n_in] for j in range(1 + (k + r) % 5)]
            if k >= n_out:  # nothing around it
                inner = inner if k % 4 > 1 else ["<h1>A title of some words</h1>", *inner]
                alone = _marked(root, 1).format("".join(inner))
                pages.append(_BODY.format("", alone) if k % 6 > 1 else alone)
                continue
            before, after = _PARTS_OUT[(k + r + 1) % n_out], _PARTS_OUT[(k + 3 * r + 2) % n_out]
            if k % 3:
                inner.insert(k % (len(inner) + 1), _marked(_PARTS_OUT[k], 0))
            body = _marked(root, 1).format("".join(inner))
            wrapper = ("{}", "<div class='wrapper container page' data-label='1'>{}</div>", "<div data-label='1'><div id='main' class='row'>{}</div></div>")[(k + r) % 3]
            pages.append(_BODY.format("", f"{before}{wrapper.format(body)}{after}"))
        for few in (_SHORT, "<p>Some more words in one paragraph.</p>", "<h1>A title</h1>" + _SHORT, "<h2>Title</h2>" + _TEXT, "Words right in it, a few."):
            alone = _marked(root, 1).format(few)
            pages += [_BODY.format("", alone), alone]
    for k in range(2 * n_out + 12):
        inner = [_PARTS_IN[(k + j * j) % n_in] for j in range(2 + k % 4)]
        if k < 2 * n_out:
            around = [_marked(_PARTS_OUT[(k + 7 * j) % n_out], 0) for j in range(1 + k % 3)]
            inner = [*around[:1], *inner, *around[1:]]
        pages.append(_BODY.format(" data-label='1'", "".join(inner)))
        pages.append("".join(inner))  # no body: the page itself is the root
    for k, text in enumerate(_PLAIN):
        pages += [text, _BODY.format(" data-label='1'", text), _BODY.format(" data-label='1'", f"{text}<br>{_PLAIN[k - 1]}"), f"{text}<br>{_PLAIN[k - 2]}"] * 6
    return pages


def _labels(page: Page, by_rule: bool) -> list[int | None]:
    """States of all elements; by the rule None for those that it cannot tell (see ``UNSURE``) and all below them."""
    bare = not by_rule and "body" not in page.tag
    out: list[int | None] = [int(bare)] * len(page.parent)
    for i in range(1, len(out)):
        above = out[page.parent[i]]
        if by_rule:
            bad = page.tag[i] in ("nav", "aside", "footer", "header", "form") or page.tag[i] in NEVER
            inside = above or page.tag[i] in ROOTS
            unsure = above is None or (inside and not UNSURE.isdisjoint(page.tokens[i]))
            out[i] = 0 if bad and above is not None else None if unsure else int(inside)
        else:
            out[i] = above if page.label[i] is None else page.label[i]
        if page.tag[i] in NEVER:
            out[i] = 0
    return out


def _both_ways(levels: list[np.ndarray], parent: np.ndarray, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all elements [element, state] and of all pairs [element, parent's state, own state], of many trees at once.

    ``levels`` are the elements by depth, ``own`` and ``pair`` logarithms of potentials.
    """
    inward, up = own.copy(), np.zeros_like(own)
    for level in reversed(levels[1:]):
        up[level] = np.logaddexp.reduce(pair[level] + inward[level][:, None, :], axis=2)
        for state in (0, 1):
            inward[:, state] += np.bincount(parent[level], weights=up[level, state], minlength=len(own))
    down = np.zeros_like(own)
    joint = np.zeros((len(own), 2, 2))
    for level in levels[1:]:
        above = (down + inward)[parent[level]] - up[level]
        joint[level] = above[:, :, None] + pair[level] + inward[level][:, None, :]
        down[level] = np.logaddexp.reduce(above[:, :, None] + pair[level], axis=1)
        down[level] -= down[level].max(axis=1, keepdims=True)
    single = np.exp((both := down + inward) - np.logaddexp.reduce(both, axis=1, keepdims=True))
    joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
    return single, joint


def train(given: list[str] = ()) -> Model:
    """Potentials of the highest likelihood of the labelled pages, by gradient steps.

    ``given`` are further pages with an <article> or <main>, labelled by these; others among them
    are left out. States that the rule cannot tell are summed over. The gradient of each
    potential is its expectation by the model, less that with the known states held.
    """
    parsed = [page for page in map(parse, given) if not set(ROOTS).isdisjoint(page.tag)]
    pages = [(page, _labels(page, False)) for page in map(parse, labelled_pages())] + [(page, _labels(page, True)) for page in parsed]
    tags = {t: k for k, t in enumerate(sorted({t for page, _ in pages for t in page.tag}))}
    parent, depth, tag, known, index, starts = [], [], [], [], [], []
    for page, states in pages:
        first = len(parent)
        for i, features in enumerate(_features(page)):
            p = page.parent[i]
            parent.append(first + max(p, 0))
            depth.append(depth[first + p] + 1 if i else 0)
            tag.append(tags[page.tag[i]])
            known.append(-1 if states[i] is None else states[i])
            starts.append(len(index))
            index += features
    parent, depth, tag, known = (np.array(x) for x in (parent, depth, tag, known))
    index, starts = np.array(index), np.array(starts)
    row = np.repeat(np.arange(len(starts)), np.diff([*starts, len(index)]))
    never = np.isin(tag, [k for t, k in tags.items() if t in NEVER])
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    held = np.zeros((len(known), 2))
    held[known == 0, 1] = held[known == 1, 0] = -40.0
    told = None
    if (known >= 0).all():  # all states known: these are the expectations
        states = np.eye(2)[known]
        told = states, states[parent][:, :, None] * states[:, None, :]
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    shared, own_pair = np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros((len(tags), 2, 2))
    seen_shared, seen_pair = np.full((2, 2), 1e-6), np.full((len(tags), 2, 2), 1e-6)
    for _ in range(STEPS):
        own = np.zeros((len(known), 2))
        own[:, 1] = np.add.reduceat(w[index], starts)
        own[never] = (0.0, -40.0)
        pair = (shared + own_pair)[tag]
        single, joint = _both_ways(levels, parent, own, pair)
        fixed, fixed_joint = told or _both_ways(levels, parent, own + held, pair)
        gap = np.where(never, 0.0, single[:, 1] - fixed[:, 1])
        step = np.bincount(index, weights=gap[row], minlength=1 << BITS) + 0.003 * w
        seen += step * step
        w -= 0.8 * step / np.sqrt(seen)
        gaps = joint - fixed_joint
        gaps[depth == 0] = 0.0
        by_tag = np.zeros_like(own_pair)
        np.add.at(by_tag, tag, gaps)
        total = by_tag.sum(axis=0) + 0.05 * shared
        by_tag += 0.05 * own_pair
        seen_shared += total * total
        seen_pair += by_tag * by_tag
        shared = shared - 0.1 * total / np.sqrt(seen_shared)
        own_pair = own_pair - 0.1 * by_tag / np.sqrt(seen_pair)
    as_pair = lambda x: tuple(np.exp(x - x.max()).ravel().tolist())
    return Model(w.tolist(), {"*": as_pair(shared), **{t: as_pair(shared + own_pair[k]) for t, k in tags.items()}})


@cache
def fixed_model() -> Model:
    """The model of the built-in pages."""
    return train()


def _rows(model_of) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_of.value
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages`` (page_id, url, html).

    The text of a page depends on its html and the model (``fixed_model``, unless one is given) alone.
    White space is what Unicode takes for it, no-break spaces included. A null or empty html has
    an empty text, as has a page without content. Repeated rows each give a row, null ids and urls
    stay null, other columns are ignored, an empty table gives an empty result.
    """
    spark = pages.sparkSession
    W.bounded_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    known = spark.sparkContext.broadcast(fixed_model() if model is None else model)  # 2 ** BITS weights and four numbers a tag
    return rows.mapInArrow(_rows(known), "page_id long, url string, text string, n_chars long")
