"""Captured pages as trees of nodes, and what is extracted from them.

``trees`` parses every page once, the one step that runs Python in tasks: a row for each page, whose
``nodes`` are in document order.  A node's place is its id, and ``node_id .. end_id`` is its subtree, so
subtrees are slices and ancestor tests comparisons of intervals; the nearest cell, list, link and so on
are known from the parse.  What follows are column expressions on that array, without shuffles, until
rows leave their page.  ``dom_nodes`` is the same as a table, a row for each node.

Dropped nodes stay in their place with the kind ``dropped``.  Elements nest as deep as they do in the
page; malformed markup never fails, and null pages have no nodes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.naming import domain, escape_html, safe_url
from convlake.functions.text import parse_span
from convlake.operators.grid import contents
from convlake.operators.reports import Report
from convlake.operators.selectors import Automaton, attr, matcher, parse
from convlake.session import byte_slices, ship, small_batches

#: Fixed value: how titles of widgets' frames begin.
WIDGET = "internal://"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "article", "section", "nav", "header", "footer", "main", "aside", "figure", "figcaption", "dl", "dt", "dd", "hr", "body", "html",
    "address", "details", "fieldset", "form",
}
CLOSES_P = BLOCK - {"li", "td", "th", "tr", "thead", "tbody", "tfoot", "dt", "dd", "body", "html"}
#: What a start tag closes, up to the named container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
INLINE = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "code": "code", "a": "link", "s": "strikethrough", "del": "strikethrough"}
#: Of each node, the nearest element of these tags, itself included.
NEAREST = {
    "block_id": BLOCK, "cell_id": {"td", "th"}, "row_id": {"tr"}, "table_id": {"table"}, "item_id": {"li"}, "list_id": {"ul", "ol"},
    "link_id": {"a"}, "quote_id": {"blockquote"}, "section_id": {"thead", "tbody", "tfoot"},
}
INTS, TEXTS = pa.int32(), pa.list_(pa.string())
NODE = (
    ("node_id", INTS, "int"), ("parent_id", INTS, "int"), ("depth", INTS, "int"), ("ordinal", INTS, "int"), ("kind", pa.string(), "string"),
    ("tag", pa.string(), "string"), ("classes", TEXTS, "array<string>"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"),
    ("text", pa.string(), "string"), ("end_id", INTS, "int"), *((k, INTS, "int") for k in NEAREST), ("list_depth", INTS, "int"),
    ("item_index", INTS, "int"), ("verbatim", pa.bool_(), "boolean"), ("marks", TEXTS, "array<string>"), ("mark_id", INTS, "int"),
    # of the selectors that the parse was given: those that fit, and the nearest element that fits ``turn`` and ``message``
    ("hits", TEXTS, "array<string>"), ("turn_id", INTS, "int"), ("message_id", INTS, "int"),
)
FIELDS = tuple(name for name, _, _ in NODE)
#: Pages, and about as many bytes, that are Python objects at a time.
SLICE = (50, 1 << 20)


#: What a tag makes a node itself the nearest of.
MAKES = {tag: tuple(k for k, tags in NEAREST.items() if tag in tags) for tag in set().union(*NEAREST.values())}
#: What a node has from the element around it unless it is one itself, and where that stands in its tuple.
FROM_ABOVE = {k: i for i, k in enumerate((*NEAREST, "turn_id", "message_id", "list_depth", "verbatim", "marks", "mark_id"))}
NONE: list = []  # shared, never changed
NOT_P = BLOCK - {"p"}


class Tree(HTMLParser):
    """The nodes of one page as columns; open elements close at the end."""

    def __init__(self, selectors: Automaton | None = None, graft: str | None = None, fields: Iterable[str] = FIELDS) -> None:
        super().__init__(convert_charrefs=True)
        self.inherits = bool(graft) or not {*FROM_ABOVE, "item_index"}.isdisjoint(fields)  # else what is around a node isn't kept
        self.selectors, self.states = selectors, [0]
        self.graft, self.floor = graft, 0  # of open elements, those below ``floor`` aren't closed
        self.nodes: dict[str, list] = {name: [] for name, _, _ in NODE if name not in FROM_ABOVE or name == "block_id"}
        self.size = 0
        self.open: list[int] = []
        self.children: dict[int | None, int] = {}
        self.items: dict[int | None, int] = {}
        # of each node, and of what is around a node of each depth, the values of FROM_ABOVE
        self.inherited: list[tuple] = []
        self.above: list[tuple] = [tuple({"list_depth": -1, "verbatim": False, "marks": NONE}.get(k) for k in FROM_ABOVE)]

    def add(self, kind: str, tag: str | None, attrs: list, text: str | None) -> int:
        me, n, depth = self.size, self.nodes, len(self.open)
        up = self.open[-1] if depth else None
        self.size += 1
        self.children[up] = ordinal = self.children.get(up, -1) + 1
        has, classes, pairs, hits, item_index = self.above[depth], NONE, NONE, NONE, None
        if kind == "element":
            kept = {k: v or "" for k, v in attrs} if attrs else {}
            pairs = list(kept.items()) if kept else NONE
            classes = kept["class"].split() if "class" in kept else NONE
            if self.selectors:
                state, hits = self.selectors.step(self.states[depth], tag, classes, kept)
                self.states[depth + 1 :] = [state]
            mark = "math" if "data-math-display" in kept else INLINE.get(tag)
            if self.inherits and (mark or hits or tag in MAKES):
                has = self.made(me, has, tag, mark, hits)
            self.above[depth + 1 :] = [has]
            if tag == "li":
                around = has[FROM_ABOVE["list_id"]]
                item_index = self.items[around] = self.items.get(around, -1) + 1
        self.inherited.append(has)
        n["parent_id"].append(up)
        n["depth"].append(depth)
        n["ordinal"].append(ordinal)
        n["kind"].append(kind)
        n["tag"].append(tag)
        n["classes"].append(classes)
        n["attrs"].append(pairs)
        n["text"].append(text)
        n["end_id"].append(me)
        n["block_id"].append(has[0])
        n["item_index"].append(item_index)
        n["hits"].append(hits)
        return me

    def made(self, me: int, above: tuple, tag: str, mark: str | None, hits: list) -> tuple:
        """The values of FROM_ABOVE of an element that changes some of them."""
        has = dict(zip(FROM_ABOVE, above, strict=True))
        for k in (*MAKES.get(tag, ()), *(f"{name}_id" for name in hits if name in ("turn", "message"))):
            has[k] = me
        if mark:
            marks = has["marks"]
            has["marks"], has["mark_id"] = marks if mark in marks else [*marks, mark], has["mark_id"] if marks else me
        has["list_depth"] += tag in ("ul", "ol")
        has["verbatim"] = has["verbatim"] or tag in ("pre", "code")
        return tuple(has.values())

    def columns(self, names: Iterable[str]) -> dict[str, list]:
        self.nodes["node_id"] = list(range(self.size))
        return {k: self.nodes[k] if k in self.nodes else [has[FROM_ABOVE[k]] for has in self.inherited] for k in names}

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.nodes["end_id"][self.open.pop()] = self.size - 1

    def close_open(self, tags: set, until: set) -> None:
        for i in range(len(self.open) - 1, self.floor - 1, -1):
            tag = self.nodes["tag"][self.open[i]]
            if tag in until:
                return
            if tag in tags:
                self.close_to(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self.close_open({"p"}, NOT_P)  # through inline elements, which end with it
        if tag in SIBLINGS:
            self.close_open(*SIBLINGS[tag])
        me = self.add("element", tag, attrs, None)
        if tag not in VOID:
            self.open.append(me)
        if tag == "iframe" and self.graft and not self.floor:
            self.relayed(me, dict(attrs))

    def relayed(self, frame: int, attrs: dict) -> None:
        """The html that an attribute of a widget's frame holds, as the frame's content; no selector fits in it."""
        if not (attrs.get("title") or "").startswith(WIDGET) or not (attrs.get(self.graft) or "").strip():
            return
        selectors, self.selectors, self.floor = self.selectors, None, len(self.open)
        inside = Relayed(self)
        inside.feed(attrs[self.graft])
        inside.close()
        self.close_to(self.floor)
        self.selectors, self.floor = selectors, 0
        Report(self.nodes, frame + 1, self.size).tidy({*ALLOWED, "html", "body"})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, self.floor - 1, -1):
            if self.nodes["tag"][self.open[i]] == tag:
                return self.close_to(i)

    def handle_data(self, data: str) -> None:
        self.add("text", None, [], data)

    def handle_comment(self, data: str) -> None:
        self.add("comment", None, [], data)


class Relayed(HTMLParser):
    """Reads html of its own into a tree that is being built."""

    def __init__(self, into: Tree) -> None:
        super().__init__(convert_charrefs=True)
        self.handle_starttag = self.handle_startendtag = into.handle_starttag
        self.handle_endtag, self.handle_data, self.handle_comment = into.handle_endtag, into.handle_data, into.handle_comment


def tree(html: str | None, selectors: Automaton | None = None, graft: str | None = None, fields: Iterable[str] = FIELDS) -> dict[str, list]:
    """The nodes of a page, a list for each of their fields."""
    t = Tree(selectors, graft, fields)
    t.feed(html or "")
    t.close()
    t.close_to(0)
    return t.columns(fields)


def html_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, token): tags, comments and texts in order, without Python."""
    tokens = F.regexp_extract_all("html", F.lit(r"<!--[^>]*-->|</?[A-Za-z][^>]*>|[^<]+"), F.lit(0))
    return pages.select("page_id", F.posexplode(tokens).alias("pos", "token"))


def trees(pages: DataFrame, keep: tuple[str, ...] = (), selectors: dict | None = None, by: str | None = None, graft: str | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(page_id, ``keep``, nodes): every page parsed once, some pages of a batch at a time.

    ``hits`` of a node are the names of the ``selectors`` that it matches.  With ``by``, one of ``keep``, there is a
    dictionary of selectors for each value of that column.  ``graft`` is the attribute of widgets' frames whose html
    becomes the frame's content, tidied (``reports``).  Nodes have the ``fields`` that are asked for.
    """
    ship(pages.sparkSession)
    small_batches(pages.sparkSession)
    automata = {k: Automaton(v) for k, v in (selectors if by else {None: selectors}).items() if v}
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), *keep, F.col("html").cast("string").alias("html"))
    kept = narrow.columns[:-1]
    of = [x for x in NODE if x[0] in fields]
    types = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches, *SLICE):
            which = some.column(kept.index(by)).to_pylist() if by else [None] * some.num_rows
            pages = [tree(h, automata.get(k), graft, fields) for h, k in zip(some.column(len(kept)).to_pylist(), which, strict=True)]
            flat = [pa.array([v for p in pages for v in p[name]], t) for name, t, _ in of]
            ends = pa.array([0, *accumulate(len(p[fields[0]]) for p in pages)], pa.int32())
            nodes = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, [name for name, _, _ in of]))
            yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], nodes], [*kept, "nodes"])

    return narrow.mapInArrow(run, f"{types}, nodes array<struct<{', '.join(f'{n}:{t}' for n, _, t in of)}>>")


def node_rows(trees: DataFrame) -> DataFrame:
    return rows(trees, F.col("nodes"))


def dom_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of every page, a row each, in document order."""
    return node_rows(trees(pages))


# ---- expressions on the nodes of a page -----------------------------------------------

Items = Callable[[Column], Column]


def rows(trees: DataFrame, items: Column) -> DataFrame:
    """A row for each struct in ``items``.

    Not by ``explode``: Spark infers a filter on the array's size from it, pushes that below the columns that made the array, and puts
    them in the filter's place of each, so what a page needs once is done again for each of its nodes.
    """
    return trees.select("page_id", F.explode_outer(items).alias("x")).where("x IS NOT NULL").select("page_id", "x.*")


def filtered(where: Items) -> Column:
    return F.filter("nodes", lambda x: F.coalesce(where(x), F.lit(False)))


def element(x: Column, *tags: str) -> Column:
    return (x["kind"] == "element") & x["tag"].isin(*tags)


def is_text(x: Column) -> Column:
    return (x["kind"] == "text") & x["text"].rlike(r"(?U)\S")


def hit(x: Column, *names: str) -> Column:
    """Whether a node matches one of the selectors of these names, which the parse was given."""
    return F.arrays_overlap(x["hits"], F.array(*map(F.lit, names)))


def subtree(x: Column) -> Column:
    """The nodes from ``x`` to its last descendant."""
    return F.slice("nodes", x["node_id"] + 1, x["end_id"] - x["node_id"] + 1)


def inner(x: Column) -> Column:
    return F.slice("nodes", x["node_id"] + 2, x["end_id"] - x["node_id"])


def at(node_id: Column) -> Column:
    return F.get("nodes", node_id)


def within(x: Column, places: Column) -> Column:
    """Whether ``x`` is one of, or below, the intervals ``places`` (a, b)."""
    return F.exists(places, lambda g: (g["a"] <= x["node_id"]) & (x["node_id"] <= g["b"]))


def outermost(nodes: Column) -> Column:
    """Intervals (a, b) of those of ``nodes``, which are in order, that aren't below another one."""
    start = F.struct(F.lit(-1).alias("until"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))
    return F.aggregate(
        nodes, start,
        lambda acc, x: F.when(
            x["node_id"] > acc["until"],
            F.struct(x["end_id"].alias("until"), F.array_append(acc["found"], F.struct(x["node_id"].alias("a"), x["end_id"].alias("b"))).alias("found")),
        ).otherwise(acc),
    )["found"]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def exact_text(x: Column, of: Items | None = None) -> Column:
    """The text nodes of a subtree put together, or those for which ``of`` holds."""
    texts = F.filter(subtree(x), lambda n: (n["kind"] == "text") & (of(n) if of else F.lit(True)))
    return F.array_join(F.transform(texts, lambda n: n["text"]), "")


def prose(x: Column, of: Items | None = None) -> Column:
    """The text of a subtree as one line; what stands in different blocks is a space apart."""
    texts = F.filter(subtree(x), lambda n: (n["kind"] == "text") & (of(n) if of else F.lit(True)))
    start = F.struct(F.lit(None).cast("int").alias("block"), F.lit("").alias("said"))
    step = lambda acc, n: F.struct(
        n["block_id"].alias("block"), F.concat(acc["said"], F.when(acc["block"].eqNullSafe(n["block_id"]), "").otherwise(" "), n["text"]).alias("said")
    )
    return squeezed(F.aggregate(texts, start, step)["said"])


def drop_nodes(trees: DataFrame, dropped: Items) -> DataFrame:
    """Subtrees of the nodes for which ``dropped`` holds get the kind ``dropped``."""
    gone = trees.withColumn("__gone", outermost(filtered(dropped)))
    left = F.transform("nodes", lambda x: F.when(within(x, F.col("__gone")), x.withField("kind", F.lit("dropped"))).otherwise(x))
    # named twice, ``__gone`` is computed once for a page and not inside the loop
    return gone.withColumn("nodes", F.when(F.size("__gone") == 0, F.col("nodes")).otherwise(left)).drop("__gone")


def strip_chrome(trees: DataFrame, also: tuple[str, ...] = ("script", "style", "template", "head")) -> DataFrame:
    """Without buttons, hidden and icon nodes, comments, and then empty ``div`` and ``span``."""
    has = lambda x, *names: F.arrays_overlap(x["classes"], F.array(*map(F.lit, names)))
    style = lambda x: F.regexp_replace(F.lower(attr(x, "style")), " ", "")
    one_pixel = lambda x: style(x).contains("position:absolute") & style(x).rlike(r"(^|;)(width|height):1px")
    hidden = lambda x: (
        x["tag"].isin("button", *also) | F.coalesce(attr(x, "role") == "button", F.lit(False)) | has(x, "sr-only", "visually-hidden")
        | F.coalesce(attr(x, "aria-hidden") == "true", F.lit(False)) | F.coalesce(one_pixel(x), F.lit(False))
    )
    icons = lambda x: ~x["verbatim"] & ((x["tag"] == "svg") | has(x, "copy-code", "copy-btn", "icon", "avatar"))
    left = drop_nodes(trees, lambda x: (x["kind"] == "comment") | ((x["kind"] == "element") & (hidden(x) | icons(x))))
    filled = lambda n: is_text(n) | element(n, "img", "br", "hr", "video", "audio")
    return drop_nodes(left, lambda x: element(x, "div", "span") & ~F.exists(subtree(x), lambda n: F.coalesce(filled(n), F.lit(False))))


def collapse_math(trees: DataFrame) -> DataFrame:
    """Each outermost formula becomes one text node of the mark ``math``: its TeX source, else its MathML, else its text."""
    root = lambda x: (x["kind"] == "element") & ((x["tag"] == "mjx-container") | F.array_contains(x["classes"], "katex"))
    first = lambda x, tag: F.get(F.filter(subtree(x), lambda n: element(n, tag)), F.lit(0))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    said = lambda x: F.coalesce(full(exact_text(first(x, "annotation"))), full(exact_text(first(x, "math"))), full(exact_text(x)))
    display = lambda x: F.coalesce(attr(x, "display") == "true", F.lit(False)) | F.coalesce(
        F.array_contains(at(x["parent_id"])["classes"], "katex-display"), F.lit(False)
    )
    sign = lambda x: F.when(display(x), "$$").otherwise("$")
    marked = trees.withColumn("__math", outermost(filtered(root)))
    begins = lambda x: F.exists("__math", lambda g: g["a"] == x["node_id"])
    formula = lambda x: (
        x.withField("kind", F.lit("text")).withField("text", F.concat(sign(x), said(x), sign(x))).withField("end_id", x["node_id"])
        .withField("marks", F.array_union(x["marks"], F.array(F.lit("math")))).withField("mark_id", F.coalesce(x["mark_id"], x["node_id"]))
    )
    return marked.withColumn(
        "nodes",
        F.transform("nodes", lambda x: F.when(begins(x), formula(x)).when(within(x, F.col("__math")), x.withField("kind", F.lit("dropped"))).otherwise(x)),
    ).drop("__math")


def flat_text(texts: str) -> Column:
    """The column ``texts`` of text nodes put together: cells apart by `` | ``, blocks by a line feed, white space collapsed outside ``pre``."""

    def piece(x: Column, i: Column) -> Column:
        before = F.get(texts, i - 1)
        cells = x["cell_id"].isNotNull() & before["cell_id"].isNotNull() & (x["cell_id"] != before["cell_id"]) & x["row_id"].eqNullSafe(before["row_id"])
        sep = F.when(i == 0, "").when(cells, " | ").when(~before["block_id"].eqNullSafe(x["block_id"]), "\n").otherwise("")
        return F.concat(sep, F.when(x["verbatim"], x["text"]).otherwise(F.regexp_replace(x["text"], r"\s+", " ")))

    return F.trim(F.array_join(F.transform(texts, piece), ""))


def flatten_text(trees: DataFrame) -> DataFrame:
    """(page_id, text) of whole pages; pages without text are left out."""
    texts = trees.select("page_id", filtered(is_text).alias("t"))
    # a filter on the texts would be pushed like that of ``explode`` (``rows``)
    return rows(texts, F.when(F.size("t") > 0, F.array(F.struct(flat_text("t").alias("text")))))


# ---- elements ----------------------------------------------------------------------------


def extract_headings(trees: DataFrame) -> DataFrame:
    found = F.transform(
        filtered(lambda x: (x["kind"] == "element") & x["tag"].rlike("^h[1-6]$")),
        lambda x: F.struct(x["node_id"].alias("node_id"), F.substring(x["tag"], 2, 1).cast("int").alias("level"), prose(x).alias("text")),
    )
    return rows(trees, found).where("text <> ''")


def code_language(x: Column) -> Column:
    """What the class of the ``code`` inside, or of the element itself, names; else ``code``."""
    code = F.get(F.filter(inner(x), lambda n: element(n, "code")), F.lit(0))
    named = F.regexp_extract(F.array_join(F.coalesce(code["classes"], x["classes"]), " "), r"language-(\w+)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("code"))


def extract_code(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, language, code); the language is ``code`` if no class names one."""
    found = F.transform(
        filtered(lambda x: element(x, "pre")),
        lambda x: F.struct(x["node_id"].alias("node_id"), code_language(x).alias("language"), F.trim(exact_text(x)).alias("code")),
    )
    return rows(trees, found).where("code <> ''")


def own_item_text(x: Column) -> Column:
    return prose(x, lambda n: n["item_id"] == x["node_id"])


def extract_lists(trees: DataFrame) -> DataFrame:
    """(page_id, list_id, item_index, depth, ordered, text) of items, each with its own text only."""
    found = F.transform(
        filtered(lambda x: element(x, "li") & x["list_id"].isNotNull()),
        lambda x: F.struct(
            x["list_id"].alias("list_id"), x["item_index"].alias("item_index"), x["list_depth"].alias("depth"),
            (at(x["list_id"])["tag"] == "ol").alias("ordered"), own_item_text(x).alias("text"),
        ),
    )
    return rows(trees, found)


def links(x: Column) -> Column:
    return F.struct(x["node_id"].alias("node_id"), attr(x, "href").alias("href"), prose(x).alias("text"))


def extract_links(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, href, text) of anchors that have both."""
    return rows(trees, F.transform(filtered(lambda x: element(x, "a")), links)).where("href <> '' AND text <> ''")


#: Fixed value: where citations stand.
CITATION = '[data-testid="webpage-citation-pill"] a'


def extract_citations(trees: DataFrame, selector: str = CITATION) -> DataFrame:
    """One search for each page with citations: its query, its results in order, and how many there are.

    Urls are kept as they are; whoever renders them asks ``safe_url``.
    """
    found = F.filter(F.transform(filtered(matcher(selector)), links), lambda x: (x["href"] != "") & (x["text"] != ""))
    result = lambda x: F.struct(x["node_id"].alias("node_id"), x["text"].alias("title"), x["href"].alias("url"), domain(x["href"]).alias("domain"))
    return trees.select("page_id", F.lit("Web Search").alias("query"), F.transform(found, result).alias("results")).where(F.size("results") > 0).select(
        "page_id", "query", F.size("results").alias("result_count"), "results"
    )


def number_of(x: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(attr(x, name), r"^\s*(\d+)", 1), F.lit("")).try_cast("int").alias(name)


#: Pictures below these aren't content.
PICTURE_CHROME = ("button", '[data-testid="webpage-citation-pill"]', "pre.overflow-visible\\!")


def extract_images(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, src, alt, title, width, height, link_url, chrome): the link is the nearest anchor around it."""
    chrome = filtered(matcher(", ".join(PICTURE_CHROME)))
    marked = trees.withColumn("__chrome", outermost(chrome))
    found = F.transform(
        filtered(lambda x: element(x, "img") & (attr(x, "src") != "")),
        lambda x: F.struct(
            x["node_id"].alias("node_id"), attr(x, "src").alias("src"), attr(x, "alt").alias("alt"), attr(x, "title").alias("title"),
            number_of(x, "width"), number_of(x, "height"), attr(at(x["link_id"]), "href").alias("link_url"), ((F.size("__chrome") > 0) & within(x, F.col("__chrome"))).alias("chrome"),
        ),
    )
    return rows(marked, found)


def filter_content_images(images: DataFrame) -> DataFrame:
    """Without sprites and icons, and without what stands in a code artifact, a citation pill or a button."""
    return images.where(~F.col("src").contains("sprites-core") & ~F.col("src").contains("icon") & ~F.col("chrome"))


def image_inventory(images: DataFrame) -> DataFrame:
    """(page_id, src, first, times): different images, by where they stand first."""
    return images.groupBy("page_id", "src").agg(F.min("node_id").alias("first"), F.count("*").alias("times"))


def extract_media(trees: DataFrame) -> DataFrame:
    """Video and audio with the source of the element, else of its first ``source``."""
    def item(x: Column) -> Column:
        source = F.get(F.filter(subtree(x), lambda n: element(n, "source")), F.lit(0))
        return F.struct(
            x["node_id"].alias("node_id"), x["tag"].alias("kind"), F.coalesce(F.nullif(attr(x, "src"), F.lit("")), attr(source, "src")).alias("src"),
            F.coalesce(attr(x, "aria-label"), attr(x, "title")).alias("alt"), attr(source, "type").alias("mime"),
        )

    return rows(trees, F.transform(filtered(lambda x: element(x, "video", "audio")), item)).where("src IS NOT NULL")


def coalesce_runs(df: DataFrame, keys: list[str], order: str, same: list[str], text: str) -> DataFrame:
    """Neighbours alike in ``same`` put together: (keys, run, same, text)."""
    w = Window.partitionBy(*keys).orderBy(order)
    now = F.struct(*same)
    new = F.when(F.lag(now).over(w).eqNullSafe(now), 0).otherwise(1)
    runs = df.withColumn("__new", new).withColumn("run", (F.sum("__new").over(w) - 1).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "")
    return runs.groupBy(*keys, "run", *same).agg(joined.alias(text))


def extract_inlines(trees: DataFrame) -> DataFrame:
    """(page_id, block_id, ordinal, type, marks, url, text): runs of text outside of ``pre``.

    ``marks`` are all inline elements around a run, the outermost first, and ``type`` is that one (``text``
    if there is none); a run ends where its outermost element ends.
    """
    found = F.transform(
        filtered(lambda x: is_text(x) & (~x["verbatim"] | F.array_contains(x["marks"], "code"))),
        lambda x: F.struct(
            x["node_id"].alias("node_id"), x["block_id"].alias("block_id"), F.coalesce(F.get(x["marks"], F.lit(0)), F.lit("text")).alias("type"),
            x["marks"].alias("marks"), attr(at(x["link_id"]), "href").alias("url"), x["mark_id"].alias("mark_id"), F.regexp_replace(x["text"], r"\s+", " ").alias("text"),
            (at(x["block_id"])["tag"] == "pre").alias("pre"),
        ),
    )
    texts = rows(trees, found).where("pre IS NULL OR NOT pre").drop("pre")
    runs = coalesce_runs(texts, ["page_id", "block_id"], "node_id", ["type", "marks", "url", "mark_id"], "text")
    return runs.withColumnRenamed("run", "ordinal").drop("mark_id")


# ---- blocks --------------------------------------------------------------------------------

#: Elements that make the ones around them containers of blocks.
HELD = ("table", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "hr", "img")
#: Elements that are blocks of their own, whatever they hold.
WHOLE = ("pre", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "hr", "img", "table", "a")


SPACES = re.compile("[ \\t\\n\\x0b\\f\\r]+")
#: What the walk over a page's nodes looks at, as columns of values.
WALKED = ("kind", "tag", "text", "parent_id", "end_id", "block_id", "list_id", "item_id", "item_index", "quote_id", "link_id")
BLOCK_ROWS = (
    ("block_id", INTS, "int"), ("parent_block_id", INTS, "int"), ("ordinal", INTS, "int"), ("depth", INTS, "int"), ("type", pa.string(), "string"),
    ("level", INTS, "int"), ("language", pa.string(), "string"), ("ordered", pa.bool_(), "boolean"), ("item_index", INTS, "int"), ("url", pa.string(), "string"),
    ("alt", pa.string(), "string"), ("link_url", pa.string(), "string"), ("text", pa.string(), "string"),
    # what it stands in, from the outside (``quote``, ``list`` or the mark of an item), its last block inside, its number among those of its
    # parent, and the mark of an item itself
    ("path", TEXTS, "array<string>"), ("last", INTS, "int"), ("nth", INTS, "int"), ("mark", pa.string(), "string"),
)


class Walk:
    """One walk over a page's nodes in order that settles its blocks; each node is looked at a fixed number of times."""

    def __init__(self, nodes: dict[str, list]) -> None:
        self.n, self.size = nodes, len(nodes["kind"])
        self.element = [k == "element" for k in nodes["kind"]]
        tags = nodes["tag"]
        # how many elements that hold others apart, and how many things that show, stand before each node
        self.held = self.sums(e and t in HELD for e, t in zip(self.element, tags, strict=True))
        self.shown = self.sums(
            e and t in ("img", "hr", "li") or k == "text" and bool(x.strip()) for e, t, k, x in zip(self.element, tags, nodes["kind"], nodes["text"], strict=True)
        )

    @staticmethod
    def sums(values: Iterator[bool]) -> list[int]:
        return [0, *accumulate(map(int, values))]

    def said(self, a: int, b: int, of: int | None = None) -> str:
        """The texts from ``a`` to ``b`` as one line, a space between blocks; those of the item ``of`` alone."""
        out, before = [], None
        for i in range(a, b + 1):
            if self.n["kind"][i] == "text" and (of is None or self.n["item_id"][i] == of):
                block = self.n["block_id"][i]
                out.append(self.n["text"][i] if block == before else f" {self.n['text'][i]}")
                before = block
        return SPACES.sub(" ", "".join(out)).strip(" ")

    def picture(self, a: int, b: int) -> int | None:
        return next((i for i in range(a, b + 1) if self.element[i] and self.n["tag"][i] == "img" and self.n["src"][i]), None)

    def block(self, i: int) -> dict | None:
        """What node ``i`` is as a block; none if it shows nothing."""
        n, tag = self.n, self.n["tag"][i]
        last, up = n["end_id"][i], n["parent_id"][i]
        parent = n["list_id"][i] if tag == "li" else n["item_id"][up] if tag in ("ul", "ol") and up is not None and n["item_id"][up] is not None else n["quote_id"][up] if up is not None else None
        out = {"block_id": i, "parent_block_id": parent, "type": "paragraph", "text": ""}
        filled = self.shown[last + 1] > self.shown[i]
        if n["kind"][i] == "text":
            out["text"] = self.said(i, i)
        elif tag in ("img", "a") and (at := self.picture(i, last)) is not None:
            link = n["link_id"][at]
            return out | {"type": "image", "url": n["src"][at], "alt": n["alt"][at] or "", "link_url": None if link is None else n["href"][link]}
        elif tag == "hr":
            return out | {"type": "hr"}
        elif tag == "li":
            return out | {"type": "list_item", "item_index": n["item_index"][i], "text": self.said(i, last, i)}
        elif tag in ("ul", "ol", "blockquote", "table"):
            kind = "list" if tag in ("ul", "ol") else tag
            return out | {"type": kind, "ordered": tag == "ol" if kind == "list" else None} if filled else None
        elif tag == "pre":
            code = next((j for j in range(i + 1, last + 1) if self.element[j] and n["tag"][j] == "code"), i)
            named = re.search(r"language-(\w+)", n["class"][code] or "")
            text = "".join(n["text"][j] for j in range(i, last + 1) if n["kind"][j] == "text").strip(" ")
            out |= {"type": "code", "language": named[1] if named else "code", "text": text}
        else:
            out["text"] = self.said(i, last)
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                out |= {"type": "heading", "level": int(tag[1])}
        return out if out["text"] else None

    def blocks(self) -> list[dict]:
        n, out = self.n, []
        if not any(e and (t in BLOCK or t == "img") for e, t in zip(self.element, n["tag"], strict=True)):
            text = self.said(0, self.size - 1)
            return [{"block_id": 0, "ordinal": 0, "depth": 0, "type": "paragraph", "text": text, "path": [], "last": 0, "nth": 0}] if text else []
        until, in_list, around = -1, False, []  # the end of the last whole element; of open quotes, lists and items the end, the mark and the block
        siblings: dict[int | None, int] = {}
        for i in range(self.size):
            tag, text = n["tag"][i], n["kind"][i] == "text"
            if not text and not self.element[i]:
                continue
            if i > until:
                held = self.held[n["end_id"][i] + 1] > self.held[i + 1]
                apart = not text and (tag == "blockquote" or tag not in WHOLE and held)
                if not apart:
                    until, in_list = n["end_id"][i], tag in ("ul", "ol")
                elif tag != "blockquote":
                    continue
            elif not (in_list and not text and tag in ("ul", "ol", "li") and n["list_id"][i] is not None):
                continue
            found = self.block(i)
            if found:
                while around and around[-1][0] < i:
                    around.pop()[2]["last"] = len(out) - 1
                up = around[-1][2]["block_id"] if around else None
                siblings[up] = siblings.get(up, -1) + 1
                found |= {"ordinal": len(out), "depth": len(around), "path": [mark for _, mark, _ in around], "last": len(out), "nth": siblings[up]}
                out.append(found)
                if found["type"] in ("blockquote", "list", "list_item"):
                    mark = {"blockquote": "quote", "list": "list"}.get(found["type"]) or (f"{found['item_index'] + 1}." if n["tag"][n["list_id"][i]] == "ol" else "-")
                    found["mark"] = mark if found["type"] == "list_item" else None
                    around.append((n["end_id"][i], mark, found))
        for _, _, block in around:
            block["last"] = len(out) - 1
        return out


def extract_blocks(trees: DataFrame) -> DataFrame:
    """The blocks of :func:`page_blocks`, a row each."""
    return rows(page_blocks(trees), F.col("blocks")).select("page_id", *(n for n, _, _ in BLOCK_ROWS))


#: Texts of a page's tables, by the block that each table is.
TABLE_TEXTS = (
    pa.map_(INTS, pa.struct([("header", TEXTS), ("body", pa.list_(TEXTS))])), "map<int,struct<header:array<string>,body:array<array<string>>>>"
)


def table_texts(cells: list[dict]) -> list[tuple[int, dict]]:
    """What ``grid.contents`` makes of each table of a page, by the table's id."""
    halves: dict[int, tuple[list, list]] = {}
    for c in cells:
        halves.setdefault(c["table_id"], ([], []))[not c["is_header"]].append((c["row_idx"], c["ordinal"], c["text"], c["rowspan"], c["colspan"]))
    return [(table, contents(*both)) for table, both in halves.items()]


def page_blocks(trees: DataFrame, with_tables: bool = False) -> DataFrame:
    """(page_id, blocks) with structs (block_id, parent_block_id, ordinal, depth, type, level, language, ordered, item_index, url, alt, link_url, text, path, last, nth, mark).

    Types: paragraph, heading, code, list and list_item, blockquote, hr, image, table.  An element that
    holds a block is taken apart, any other is one paragraph; a page without any block is one
    paragraph.  A quote holds its blocks, a list its items, an item the lists in it
    (``parent_block_id``); ``depth`` counts these.  The cells of tables are in ``table_cells``;
    ``with_tables`` adds ``tables``, a map from a table's block to its header and body rows as texts.
    """
    ship(trees.sparkSession)
    small_batches(trees.sparkSession)
    attrs = {"class": ("pre", "code"), "src": ("img",), "alt": ("img",), "href": ("a",)}
    of = lambda name, tags: F.transform("nodes", lambda x: F.when(x["tag"].isin(*tags), attr(x, name))).alias(name)
    cells = [cells_of_page().alias("cells")] if with_tables else []
    walked = trees.select("page_id", *(F.col("nodes")[k].alias(k) for k in WALKED), *(of(*a) for a in attrs.items()), *cells)
    kind, names = pa.list_(pa.struct([(name, t) for name, t, _ in BLOCK_ROWS])), [*WALKED, *attrs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches, *SLICE):
            pages = zip(*(some.column(k).to_pylist() for k in names), strict=True)
            found = [Walk(dict(zip(names, page, strict=True))).blocks() for page in pages]
            out = {"page_id": some.column("page_id"), "blocks": pa.array(found, kind)}
            if with_tables:
                out["tables"] = pa.array([table_texts(c or []) for c in some.column("cells").to_pylist()], TABLE_TEXTS[0])
            yield pa.RecordBatch.from_pydict(out)

    schema = f"page_id long, blocks array<struct<{', '.join(f'{n}:{t}' for n, _, t in BLOCK_ROWS)}>>"
    return walked.mapInArrow(run, f"{schema}, tables {TABLE_TEXTS[1]}" if with_tables else schema)


def table_cells(trees: DataFrame) -> DataFrame:
    """(page_id, table_id, is_header, row_idx, ordinal, text, rowspan, colspan) of all tables, as written.

    Header rows are those of ``thead``; they and the others are numbered on their own.
    """
    return rows(trees, cells_of_page())


def cells_of_page() -> Column:
    """The cells of all tables of a page, as an array."""
    tables = filtered(lambda x: element(x, "table"))

    def cells(table: Column, header: bool) -> Column:
        in_head = lambda r: F.coalesce(at(r["section_id"])["tag"] == "thead", F.lit(False))
        own = F.filter(subtree(table), lambda r: element(r, "tr") & (r["table_id"] == table["node_id"]) & (in_head(r) if header else ~in_head(r)))
        span = lambda x, name: parse_span(F.coalesce(attr(x, name), F.lit("1"))).cast("int").alias(name)
        return F.flatten(F.transform(own, lambda r, i: F.transform(
            F.filter(subtree(r), lambda x: element(x, "td", "th") & (x["row_id"] == r["node_id"])),
            lambda x, k: F.struct(
                table["node_id"].alias("table_id"), F.lit(header).alias("is_header"), i.cast("int").alias("row_idx"), k.cast("int").alias("ordinal"),
                prose(x).alias("text"), span(x, "rowspan"), span(x, "colspan"),
            ),
        )))

    return F.flatten(F.transform(tables, lambda t: F.concat(cells(t, True), cells(t, False))))


# ---- structure ---------------------------------------------------------------------------

#: Attributes whose values come from small vocabularies and never hold what somebody wrote.
SKELETON_ATTRS = ("data-turn", "data-message-author-role", "data-is-streaming", "role", "type")
BUDGET = {"nodes": 500, "bytes": 32_768, "depth": 12}
#: Fields of nodes that a skeleton is made of.
SKELETON_FIELDS = ("node_id", "parent_id", "depth", "kind", "tag", "attrs", "text")


def page_skeleton(trees: DataFrame, budget: dict[str, int] = BUDGET) -> DataFrame:
    """(page_id, skeleton, elided): tags, classes and attribute names; texts as their lengths.

    Values are shown of ``SKELETON_ATTRS`` alone.  Elements deeper than the budget are elided with all that
    is in them; once the budget of nodes or bytes is spent, so are elements whose parent is shown.
    """
    shown = lambda x: F.array_join(F.transform(
        F.filter(F.map_keys(x["attrs"]), lambda k: k != "class"),
        lambda k: F.when(k.isin(*SKELETON_ATTRS), F.concat(k, F.lit('="'), F.try_element_at(x["attrs"], k), F.lit('"'))).otherwise(k),
    ), "][")
    classes = lambda x: F.coalesce(F.concat(F.lit("."), F.nullif(F.trim(attr(x, "class")), F.lit(""))), F.lit(""))
    label = lambda x: F.when(x["kind"] == "text", F.concat(F.lit("text("), F.length(F.trim(x["text"])).cast("string"), F.lit(")"))).otherwise(
        F.concat(x["tag"], classes(x), F.coalesce(F.concat(F.lit("["), F.nullif(shown(x), F.lit("")), F.lit("]")), F.lit("")))
    )
    # what is a line, as long as there is budget: elements, and the texts right below them
    counts = lambda x: x["depth"] <= F.when(x["kind"] == "element", budget["depth"]).otherwise(budget["depth"] + 1)
    shows = lambda x: (x["kind"] == "element") | is_text(x)
    lines = trees.where(F.exists("nodes", lambda x: F.coalesce(shows(x), F.lit(False)))).select("page_id", F.transform(filtered(shows), lambda x: F.struct(
        x["node_id"].alias("node_id"), x["parent_id"].alias("parent_id"), (x["kind"] == "element").alias("e"), counts(x).alias("counts"),
        F.concat(F.repeat(F.lit("  "), x["depth"]), label(x)).alias("line"),
    )).alias("lines"))
    # one fold over a page's lines: elements and characters so far, and the first element for which the budget is spent
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("int").alias("cut"))
    spent = lambda acc, x: x["e"] & x["counts"] & ((acc["n"] >= budget["nodes"]) | (acc["size"] >= budget["bytes"]))
    step = lambda acc, x: F.struct(
        (acc["n"] + (x["e"] & x["counts"]).cast("int")).alias("n"),
        (acc["size"] + F.when(x["counts"], F.length(x["line"]) + 1).otherwise(0)).alias("size"), F.coalesce(acc["cut"], F.when(spent(acc, x), x["node_id"])).alias("cut"),
    )
    cut = lines.select("*", F.aggregate("lines", start, step)["cut"].alias("cut"))
    fresh = lambda c: F.coalesce(c < F.col("cut"), F.lit(True))
    kept = lambda x: x["counts"] & F.when(x["e"], fresh(x["node_id"])).otherwise(fresh(x["parent_id"]))
    gone = lambda x: x["e"] & F.when(x["counts"], ~fresh(x["node_id"]) & fresh(x["parent_id"])).otherwise(fresh(x["node_id"]))
    out = cut.select("page_id", F.filter("lines", kept).alias("k"), F.size(F.filter("lines", gone)).cast("long").alias("elided"))
    more = F.when(F.col("elided") > 0, F.array(F.concat(F.lit("…elided "), F.col("elided").cast("string"), F.lit(" nodes")))).otherwise(F.array().cast("array<string>"))
    return out.select("page_id", F.array_join(F.concat(F.transform("k", lambda x: x["line"]), more), "\n").alias("skeleton"), "elided")


def structure_signature(skeletons: DataFrame) -> DataFrame:
    """(signature, pages): how many pages share a layout."""
    return skeletons.groupBy(F.xxhash64("skeleton").alias("signature")).agg(F.count("*").alias("pages"))


Selectors = list[tuple[str, str, bool]]


def readable(selector: str) -> bool:
    try:
        return bool(parse(selector))
    except ValueError:
        return False


def selector_health(pages: DataFrame, selectors: Selectors) -> DataFrame:
    """(page_id, key, selector, required, matched) of a list of (key, selector, required); invalid selectors have -1.

    All selectors are asked for while the pages are parsed.
    """
    read = {f"{k}": selector for k, (_, selector, _) in enumerate(selectors) if readable(selector)}
    found = trees(pages, selectors=read, fields=("hits",)).withColumn("hits", F.flatten(F.col("nodes")["hits"]))

    def one(k: int, key: str, selector: str, required: bool) -> Column:
        n = F.size(F.filter("hits", lambda h: h == str(k))) if str(k) in read else F.lit(-1)
        return F.struct(F.lit(key).alias("key"), F.lit(selector).alias("selector"), F.lit(required).alias("required"), n.cast("long").alias("matched"))

    return rows(found, F.array(*(one(k, *s) for k, s in enumerate(selectors))))


def detect_platform(trees: DataFrame, platforms: list[tuple[str, str, str | None]]) -> DataFrame:
    """(page_id, platform): the first of (id, url pattern, container selector or None) that fits; ``trees`` keep the url."""
    fits = [
        F.when(F.col("url").rlike(pattern) & (F.lit(True) if container is None else F.exists("nodes", matcher(container))), F.lit(name))
        for name, pattern, container in platforms
    ]
    return trees.select("page_id", F.coalesce(*fits, F.lit(None).cast("string")).alias("platform"))


def first_match(selector: str) -> Column:
    """The first node that matches; null if there is none."""
    return F.get(filtered(matcher(selector)), F.lit(0))


def text_at(selector: str) -> Column:
    """The text of the first node that matches; null if there is none or it is blank."""
    return F.nullif(prose(first_match(selector)), F.lit(""))


def sidebar_title(path: str, inside: str) -> Column:
    """What the first link to the page's own conversation says in ``inside``; ``path`` is the url's part that names it."""
    own = F.nullif(F.regexp_extract("url", path, 0), F.lit(""))
    link = F.get(filtered(lambda x: element(x, "a") & attr(x, "href").contains(own)), F.lit(0))
    return F.nullif(prose(first_below(link, inside)), F.lit(""))


def extract_title(
    trees: DataFrame, selectors: tuple[str, ...], generic: tuple[str, ...], default: str, contained: str | None = None, sidebar: tuple[str, str] | None = None
) -> DataFrame:
    """(page_id, title): the first text of the selectors, in their order, that isn't a generic name.

    With ``sidebar``, the arguments of ``sidebar_title``, the conversation's entry there comes before the default; ``trees`` then keep the url.
    """
    def fine(selector: str) -> Column:
        said = text_at(selector)
        odd = said.isin(*generic) | (said.contains(contained) if contained else F.lit(False))
        return F.when(~odd, said)

    return trees.select("page_id", F.coalesce(*map(fine, selectors), *([sidebar_title(*sidebar)] if sidebar else []), F.lit(default)).alias("title"))


#: Where each platform names its model.
MODEL_AT = {
    "chatgpt": "[data-message-model-slug]", "claude": 'button[data-testid="model-selector-dropdown"] div.whitespace-nowrap',
    "gemini": '[data-test-id="bard-mode-menu-button"] .picker-primary-text',
}


def extract_model(trees: DataFrame, platform: Column) -> DataFrame:
    """(page_id, model): a slug, a name with ``Claude`` before it unless it holds that, or a mode; null if the page names none."""
    slug = F.nullif(F.trim(attr(first_match(MODEL_AT["chatgpt"]), "data-message-model-slug")), F.lit(""))
    name, mode = text_at(MODEL_AT["claude"]), text_at(MODEL_AT["gemini"])
    named = F.when(F.lower(name).contains("claude"), name).otherwise(F.concat(F.lit("Claude "), name))
    of = F.when(platform == "chatgpt", slug).when(platform == "claude", named).when(platform == "gemini", F.concat(F.lit("Gemini ("), mode, F.lit(" mode)")))
    return trees.select("page_id", of.alias("model"))


def first_below(x: Column, selector: str) -> Column:
    return F.get(F.filter(inner(x), matcher(selector)), F.lit(0))


#: A source that was used, and what it holds.
SOURCE, SOURCE_URL = ".source-list.used-sources browse-web-item", 'a[data-test-id="browse-web-item-link"]'
SOURCE_DOMAIN, SOURCE_TITLE = '[data-test-id="domain-name"]', '[data-test-id="sub-title"]'


def used_sources(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, title, url, domain) of the sources that a report cites; those only read are in another list.

    The title is the domain, and else the url, where there is none.
    """
    def source(x: Column) -> Column:
        url, said = attr(first_below(x, SOURCE_URL), "href"), lambda s: F.nullif(prose(first_below(x, s)), F.lit(""))
        return F.struct(x["node_id"].alias("node_id"), F.coalesce(said(SOURCE_TITLE), said(SOURCE_DOMAIN), url).alias("title"), url.alias("url"), said(SOURCE_DOMAIN).alias("domain"))

    return rows(trees, F.transform(filtered(matcher(SOURCE)), source)).where("url <> ''")


# ---- cleaning -----------------------------------------------------------------------------

#: Elements that stay, and the attributes that each may keep beside its class.
ALLOWED = (
    "p", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "thead", "tbody", "tr", "th", "td", "pre", "code", "a", "img",
    "blockquote", "hr", "em", "strong", "del", "br", "sup", "sub", "b", "i", "u", "svg", "title", "desc",
)
ALLOWED_ATTRS = {"a": ("href", "title"), "img": ("src", "alt", "title"), "svg": ("width", "height", "viewbox", "aria-label"), "pre": ("tabindex",)}
URL_ATTRS = ("href", "src")


def sanitize_html(trees: DataFrame) -> DataFrame:
    """(page_id, html): allowed elements only, others with their subtrees gone; allowed attributes, safe urls; texts escaped."""
    kept = drop_nodes(trees, lambda x: (x["kind"] == "comment") | ((x["kind"] == "element") & ~x["tag"].isin(*ALLOWED, "html", "body")))
    shown = lambda name, v: F.coalesce(F.concat(F.lit(f' {name}="'), escape_html(v), F.lit('"')), F.lit(""))

    def attrs(x: Column) -> Column:
        out = F.lit("")
        for tag, names in ALLOWED_ATTRS.items():
            value = lambda n, t=tag: safe_url(attr(x, n), t == "img") if n in URL_ATTRS else attr(x, n)
            out = F.when(x["tag"] == tag, F.concat(*(shown(n, value(n)) for n in names))).otherwise(out)
        return F.concat(shown("class", attr(x, "class")), out)

    part = lambda place, late, order, s: F.struct(place.alias("at"), F.lit(late).alias("late"), order.alias("inner"), s.alias("s"))
    live = filtered(lambda x: (x["kind"] == "text") | (x["kind"] == "element") & ~x["tag"].isin("html", "body"))
    opening = lambda x: F.when(x["kind"] == "text", escape_html(x["text"])).otherwise(F.concat(F.lit("<"), x["tag"], attrs(x), F.lit(">")))
    starts = F.transform(live, lambda x: part(x["node_id"], 0, F.lit(0), opening(x)))
    # closing tags go behind the last node of the subtree, the innermost first
    closed = filtered(lambda x: (x["kind"] == "element") & ~x["tag"].isin(*VOID, "html", "body"))
    ends = F.transform(closed, lambda x: part(x["end_id"], 1, -x["node_id"], F.concat(F.lit("</"), x["tag"], F.lit(">"))))
    return kept.select("page_id", F.array_join(F.transform(F.array_sort(F.concat(starts, ends)), lambda p: p["s"]), "").alias("html"))
