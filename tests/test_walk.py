"""The queries on pages as they are, against a plain recursive walk over nested lists."""

import os
import re

import pytest

from convlake.operators import html
from convlake.plans import blocks
from convlake.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
ONE = re.compile(r"[ \t\n\x0b\f\r]+")


class Node:
    def __init__(self, kind, tag, attrs, text):
        self.kind, self.tag, self.attrs, self.text, self.children = kind, tag, dict(attrs), text, []

    def all(self):
        for x in self.children:
            yield x
            yield from x.all()


def nested(page):
    t, top = html.tree(page), Node("element", "#top", {}, None)
    made = []
    for i in range(len(t["kind"])):
        made.append(Node(t["kind"][i], t["tag"][i], t["attrs"][i], t["text"][i]))
        (top if t["parent_id"][i] is None else made[t["parent_id"][i]]).children.append(made[-1])
    return top


def is_chrome(x, verbatim):
    classes, style = x.attrs.get("class", "").split(), x.attrs.get("style", "").lower().replace(" ", "")
    if x.kind == "comment":
        return True
    if x.kind != "element":
        return False
    hidden = x.tag in ("button", "script", "style", "template", "head") or x.attrs.get("role") == "button" or {"sr-only", "visually-hidden"} & {*classes} or x.attrs.get("aria-hidden") == "true"
    return hidden or "position:absolute" in style and re.search("(^|;)(width|height):1px", style) or not verbatim and (x.tag == "svg" or {"copy-code", "copy-btn", "icon", "avatar"} & {*classes})


def shows(x):
    return x.kind == "text" and x.text.strip() or x.tag in ("img", "br", "hr", "video", "audio")


def cleaned(x, verbatim=False):
    verbatim = verbatim or x.tag in ("pre", "code")
    x.children = [c for c in x.children if not is_chrome(c, verbatim or c.tag in ("pre", "code"))]
    for c in x.children:
        cleaned(c, verbatim)
    return x


def without_empty(x):
    x.children = [c for c in x.children if c.tag not in ("div", "span") or any(map(shows, c.all()))]
    for c in x.children:
        without_empty(c)
    return x


def texts(x, block=None, cell=None, row=None, verbatim=False):
    """(text, block, cell, row, verbatim) of all texts."""
    for c in x.children:
        if c.kind == "text":
            yield c.text, block, cell, row, verbatim
        elif c.kind == "element":
            yield from texts(c, c if c.tag in html.BLOCK else block, c if c.tag in ("td", "th") else cell, c if c.tag == "tr" else row, verbatim or c.tag in ("pre", "code"))


def flat(top):
    out, before = "", None
    for t in texts(top):
        if not t[0].strip():
            continue
        if before:
            out += " | " if t[2] and before[2] and t[2] is not before[2] and t[3] is before[3] else "" if t[1] is before[1] else "\n"
        out, before = out + (t[0] if t[4] else ONE.sub(" ", t[0])), t
    return out.strip(" ")


def line(x, items=True):
    """The texts of a node as one line; without those of items below it where ``items`` isn't set."""
    def inside(n, block):
        for c in n.children:
            if c.kind == "text":
                yield c.text, block
            elif c.kind == "element" and (items or c.tag != "li"):
                yield from inside(c, c if c.tag in html.BLOCK else block)

    out, before = "", object()
    for t, block in ([(x.text, None)] if x.kind == "text" else inside(x, x if x.tag in html.BLOCK else None)):
        out, before = out + (t if block is before else f" {t}"), block
    return ONE.sub(" ", out).strip(" ")


def walked(x, depth=0):
    """(type, text, depth) of the blocks below ``x``."""
    for c in x.children:
        if c.kind == "text":
            yield ("paragraph", line(c), depth) if line(c) else None
        elif c.tag == "blockquote":
            if any(n.kind == "text" and n.text.strip() or n.tag in ("img", "hr", "li") for n in c.all()):
                yield "blockquote", "", depth
                yield from walked(c, depth + 1)
            else:
                yield from walked(c, depth)
        elif c.tag not in html.WHOLE and any(n.tag in html.HELD for n in c.all()):
            yield from walked(c, depth)
        elif c.kind == "element":
            yield from whole(c, depth)


def whole(c, depth):
    picture = [n for n in [c, *c.all()] if n.tag == "img" and n.attrs.get("src")]
    if c.tag in ("img", "a") and picture:
        yield "image", "", depth
    elif c.tag == "hr":
        yield "hr", "", depth
    elif c.tag == "table":
        yield ("table", "", depth) if any(n.kind == "text" and n.text.strip() or n.tag in ("img", "hr", "li") for n in c.all()) else None
    elif c.tag == "pre":
        said = "".join(n.text for n in c.all() if n.kind == "text").strip(" ")
        yield ("code", said, depth) if said else None
    elif c.tag in ("ul", "ol"):
        if any(n.kind == "text" and n.text.strip() or n.tag in ("img", "hr", "li") for n in c.all()):
            yield "list", "", depth
            yield from items(c, depth + 1)
    elif line(c):
        yield "heading" if re.fullmatch("h[1-6]", c.tag) else "paragraph", line(c), depth


def items(x, depth):
    for c in x.children:
        if c.tag == "li":
            yield "list_item", line(c, items=False), depth
            yield from items(c, depth + 1)
        elif c.tag in ("ul", "ol"):
            yield from whole(c, depth)
        else:
            yield from items(c, depth)


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect()
    return {r.page_id: without_empty(cleaned(nested(r.html))) for r in rows}


def test_text_of_pages(spark, pages):
    got = {r.page_id: r.text for r in QUERIES["flatten_text_of_pages"](spark, DATA).collect()}
    assert got == {k: flat(p) for k, p in pages.items() if flat(p)}


def test_blocks_of_pages(spark, pages):
    got = {k: [] for k in pages}
    for r in sorted(QUERIES["extract_blocks_of_pages"](spark, DATA).collect(), key=lambda r: (r.page_id, r.ordinal)):
        got[r.page_id].append((r.type, r.text, r.depth))
    assert got == {k: [b for b in walked(p) if b] for k, p in pages.items()}


def test_sanitized_pages(spark):
    gone = {r.page_id: r.html for r in QUERIES["sanitize_html_of_pages"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        def keep(x):
            x.children = [c for c in x.children if c.kind == "text" or c.kind == "element" and c.tag in {*html.ALLOWED, "html", "body"}]
            for c in x.children:
                keep(c)
            return x

        top = keep(nested(r.html))
        # what is left has the same elements and texts in the same order
        again = nested(gone[r.page_id])
        shape = lambda t: [(n.tag, n.text) for n in t.all() if n.tag not in ("html", "body")]
        assert shape(again) == shape(top)


@pytest.mark.parametrize(("page", "kind", "expected"), [
    ("<blockquote><blockquote>a</blockquote>b</blockquote>", "md", "> > a\n> >\n>\n> b\n>"),
    ("<ol><li>a</li><li><ul><li>b</li></ul></li></ol>", "md", "1. a\n   - b"),
    ("<h2>a</h2><h5>b</h5><h2>c</h2>", "md", "## a\n\n### b\n\n## c"),
    ("<pre>a\n```\nb</pre>", "md", "````code\na\n```\nb\n````"),
    ("<ul><li>a</li></ul><p>b</p>", "txt", "- a\n\nb"),
    ("<ul><li>a<ul><li>b</li><li>c</li></ul></li></ul>", "html", "<ul><li>a<ul><li>b</li>\n<li>c</li></ul></li></ul>"),
    ("<p>a &lt; b</p><blockquote><hr></blockquote>", "html", "<p>a &lt; b</p>\n<blockquote><hr></blockquote>"),
])
def test_rendered(spark, page, kind, expected):
    df = spark.createDataFrame([(0, page), (1, None)], "page_id long, html string")
    assert [r.text for r in blocks.render_pages(html.trees(df), kind).collect()] == [expected]
