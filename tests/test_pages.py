import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convlake.operators import html, lines, selectors, widgets
from convlake.plans import blocks
from convlake.queries import QUERIES, SQL

PAGE = (
    '<html><body><div class="ad"><button>Copy</button></div><h1>T</h1><p>one <b>bold<p>two<ul><li>a<ul><li>b</li></ul></li><li>c</ul>'
    '<pre><code class="language-py">x\n  y</code></pre><table><tr><td>1</td><td>2</td></tr></table><script>if (a<b) {}</script><a href="javascript:x">bad</a><a href="/ok">good</a>'
)


def trees(spark, *pages):
    return html.trees(spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string"), ("url",))


def test_malformed_pages_never_fail(spark):
    t = trees(spark, PAGE, None, "", "<", "</p>", "<p" * 50, "<b>" * 300 + "x")
    n = html.node_rows(t)
    assert n.where("page_id = 0 AND tag = 'p'").count() == 2
    assert n.where("page_id = 6").selectExpr("max(depth)").first()[0] == 300  # as deep as the page
    # subtrees are intervals: a parent's holds its children's
    up = n.selectExpr("page_id", "node_id AS parent_id", "end_id AS last")
    assert n.join(up, ["page_id", "parent_id"]).where("node_id <= parent_id OR end_id > last").count() == 0
    for f in (html.flatten_text, html.extract_blocks, html.extract_inlines, html.page_skeleton, html.sanitize_html, html.table_cells):
        f(html.strip_chrome(t)).collect()


def test_text_and_blocks(spark):
    t = html.strip_chrome(trees(spark, PAGE))
    text = html.flatten_text(t).first().text
    assert "Copy" not in text and "if (a" not in text
    assert text.split("\n")[:3] == ["T", "one bold", "two"] and "1 | 2" in text and "x\n  y" in text
    blocks = [(r.type, r.text, r.depth) for r in html.extract_blocks(t).orderBy("ordinal").collect()]
    assert ("heading", "T", 0) in blocks and ("code", "x\n  y", 0) in blocks and ("list_item", "b", 3) in blocks and ("table", "", 0) in blocks


@pytest.mark.parametrize(
    "page,expected",
    [
        ("just <b>bold</b> text", [("paragraph", "just bold text", 0, None)]),
        ("<x-a><y-b><table><tr><td>1</td></tr></table></y-b> tail</x-a>", [("table", "", 0, None), ("paragraph", "tail", 0, None)]),
        ("<div><span>a</span><div>b</div></div>", [("paragraph", "a b", 0, None)]),
        ("<p>x <img src='/i' alt='k'> y</p>", [("paragraph", "x", 0, None), ("image", "", 0, "/i"), ("paragraph", "y", 0, None)]),
        ("<blockquote><ul><li>q</li></ul></blockquote>", [("blockquote", "", 0, None), ("list", "", 1, None), ("list_item", "q", 2, None)]),
        ("<ul></ul><p> </p><h2></h2><pre></pre><img><blockquote></blockquote>", []),
        ("<a href='/l'><img src='/i'></a>", [("image", "", 0, "/i")]),
    ],
)
def test_blocks_of_small_pages(spark, page, expected):
    got = html.extract_blocks(trees(spark, page)).orderBy("ordinal").collect()
    assert [(r.type, r.text, r.depth, r.url) for r in got] == expected


def test_lists_and_citations(spark):
    t = trees(spark, PAGE, '<i data-testid="webpage-citation-pill"><a href="javascript:x">t</a><a href="">u</a></i>')
    got = sorted((r.depth, r.item_index, r.text) for r in html.extract_lists(t).collect())
    assert got == [(0, 0, "a"), (0, 1, "c"), (1, 0, "b")]
    assert [(r.page_id, r.result_count, r.results[0].url) for r in html.extract_citations(t).collect()] == [(1, 1, "javascript:x")]


def test_sanitized_html_keeps_only_what_is_allowed(spark):
    out = html.sanitize_html(trees(spark, PAGE)).first().html
    assert "<script" not in out and "javascript" not in out and '<a href="/ok">good</a>' in out and "<button" not in out


SAFE = html.SKELETON_ATTRS
EVERYWHERE = "title id href src alt value name placeholder style content data-x data-turn-id data-testid aria-label aria-labelledby onclick lang dir".split()


def test_skeleton_leaks_nothing_that_was_written(spark):
    attrs = " ".join(f'{a}="SECRET"' for a in EVERYWHERE)
    page = f'<main class="a b" {attrs}><p role="x" data-turn="user" type="t">SECRET</p><!-- SECRET --><img {attrs}></main>'
    out = html.page_skeleton(trees(spark, page)).first()
    assert "SECRET" not in out.skeleton and 'p[role="x"][data-turn="user"][type="t"]' in out.skeleton and "text(6)" in out.skeleton and out.elided == 0
    assert out.skeleton.startswith("main.a b[title][id]") and set(SAFE) == {"data-turn", "data-message-author-role", "data-is-streaming", "role", "type"}


def test_skeleton_keeps_its_budget(spark):
    deep = "<div>" * 20 + "x"
    wide = "<main>" + "<p>y</p>" * 600 + "</main>"
    long = "<main>" + f"<p class='{'c' * 5000}'>y</p>" * 10 + "</main>"
    got = {r.page_id: r for r in html.page_skeleton(trees(spark, deep, wide, long)).collect()}
    assert got[0].elided == 7 and got[0].skeleton.endswith("…elided 7 nodes") and got[0].skeleton.count("div") == 13
    assert got[1].elided == 101 and got[1].skeleton.count("p\n") == 499
    assert got[2].elided == 3 and got[2].skeleton.count("text(1)") == 7


def test_grid_places_spans(spark):
    schema = "table_id long, is_header boolean, row_idx int, ordinal int, text string, rowspan int, colspan int"
    rows = [(1, False, 0, 0, "a", 2, 1), (1, False, 0, 1, "b", 1, 2), (1, False, 1, 0, "c", 1000, 1000)]
    out = lines.table_grid(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 3 + 1 + 1000
    assert sorted((r.row_idx, r.col_idx, r.text) for r in out)[:5] == [(0, 0, "a"), (0, 1, "b"), (0, 2, ""), (1, 0, ""), (1, 1, "c")]


def test_spans_that_cannot_be_read(spark):
    page = "<table><tr><td rowspan=0 colspan='-2'>a</td><td colspan=x>b</td></tr></table>"
    assert [(r.text, r.rowspan, r.colspan) for r in html.table_cells(trees(spark, page)).collect()] == [("a", 1, 1), ("b", 1, 1)]


def test_outermost_formula_only(spark):
    t = html.collapse_math(trees(spark, '<p>so <span class="katex"><span class="katex">x</span><annotation>x^2</annotation></span>!</p><mjx-container display="true"><math>y</math></mjx-container>'))
    assert sorted(r.marker for r in widgets.math_markers(t).collect()) == ["$$y$$", "$x^2$"]
    assert [r.text for r in html.extract_blocks(t).orderBy("ordinal").collect()] == ["so $x^2$!", "$$y$$"]
    assert ("math", "$x^2$") in [(r.type, r.text) for r in html.extract_inlines(t).collect()]


@pytest.mark.parametrize(
    "selector,matched",
    [("p", 2), ("P.k", 1), (".k", 2), ("#one", 1), ("[data-v]", 2), ('[data-v="ab"]', 1), ('[data-v^="a"]', 2), ('[data-v*="c"]', 1), ('[data-v$="b"]', 1), ("div p", 1), ("div .k", 1), ("p, .k", 3),
     ("main div > p", -1), ("", -1), ("p:first", -1), ('[data-v="x y"]', 0), ("div div", 0), ("main div p", 1), ("*", 4)],
)
def test_selectors(spark, selector, matched):
    page = '<main><div class="k"><p class="k" data-v="ab">x</p></div><p id="one" data-v="ac">y</p></main>'
    if selector == ".k" or selector == "p, .k":
        matched = {".k": 2, "p, .k": 3}[selector]
    pages = spark.createDataFrame([(0, page)], "page_id long, html string")
    (row,) = html.selector_health(pages, [("key", selector, True)]).collect()
    assert row.matched == matched
    if matched == -1:
        with pytest.raises(ValueError, match="can't be read"):
            selectors.matcher(selector)
    else:
        n = trees(spark, page).select(F.size(html.filtered(selectors.matcher(selector)))).first()[0]
        assert n == matched


#: Selectors with escapes, and an element that fits each.
ESCAPED = {
    "pre.overflow-visible\\!": '<pre class="a overflow-visible!">', ".group\\/imagegen-image, [class*=\"imagegen\"]": '<p class="group/imagegen-image">',
    "p.relative.bottom-\\[0\\.5px\\].pl-1": '<p class="pl-1 relative bottom-[0.5px]">', 'code.whitespace-pre\\!, code[class*="language-"]': '<code class="language-py">',
    'iframe[title^="internal://"]': '<iframe title="internal://x">', "div.relative.group\\/thumbnail img": '<div class="relative group/thumbnail"><b><img></b></div>',
}


def test_escapes_and_lists_in_one_pass():
    automaton = selectors.Automaton({s: s for s in ESCAPED})
    for selector, page in ESCAPED.items():
        assert [h for h in html.tree(page, automaton)["hits"] if h] == [[selector]]


def test_descendants_and_blocks_cost_a_node_once():
    automaton = selectors.Automaton({"deep": "main .k a", "turn": ".k"})
    times = []
    for n in (5_000, 50_000):
        began = time.perf_counter()
        nodes = html.tree("<main>" + '<h3 class="k"><a href="/">x</a></h3>' * n + "</main>", automaton)
        assert sum("deep" in h for h in nodes["hits"]) == n and nodes["turn_id"][-3:] == [3 * n - 2] * 3
        assert len(html.Walk(nodes | {k: [None] * len(nodes["kind"]) for k in ("class", "src", "alt", "href")}).blocks()) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * times[0]


@pytest.mark.parametrize("tag", "address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p section ul".split())
def test_every_block_tag_is_a_line(spark, tag):
    assert html.flatten_text(trees(spark, f"<{tag}>a</{tag}><{tag}>b</{tag}>c")).first().text == "a\nb\nc"


def test_white_space_between_blocks_is_no_text(spark):
    assert html.flatten_text(trees(spark, "<p>a</p>\n\u00a0<p>b</p>\n<table>\n<tr>\n<td>1</td>\n<td>2</td></tr></table>")).first().text == "a\nb\n1 | 2"


def test_headings_equal_their_sql_for_escaped_cut_and_blank_ones(spark, tmp_path):
    heads = ["&quot;q&quot; &#x27;s&#39;", "cut&amp;&amp", "cut &am", "&amp;lt; &lt;b&gt;", " ", "plain"]
    pages = [(i, f"u{i}", f"<h1>{h}</h1><p>x</p><h3>sub &quot{h}</h3>") for i, h in enumerate(heads)]
    spark.createDataFrame([*pages, (9, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.level, r.text) for r in QUERIES["extract_headings"](spark, str(tmp_path)).collect())
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert got == sorted(duck.execute(SQL["extract_headings"]).fetchall())
    assert (0, 1, "\"q\" 's'") in got and (1, 1, "cut&&") in got and (3, 1, "&lt; <b>") in got and len(got) == 11


def test_no_filter_repeats_what_a_page_needs_once(spark):
    left = html.strip_chrome(trees(spark, PAGE))
    for made in (html.flatten_text(left), html.node_rows(left), html.extract_headings(left)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "lambda" in line]
        assert plan.count("aggregate(filter(") <= 3  # the intervals of two droppings, and a heading's prose
    assert html.flatten_text(trees(spark, "", None, " ", "x")).collect() == [(3, "x")]


def test_skeletons_need_no_shuffle_and_few_fields(spark):
    pages = spark.createDataFrame([(i, p) for i, p in enumerate([PAGE, None, "", " ", "x", "<div>" * 20 + "y", "<i>y</i>" * 700])], "page_id long, html string")
    whole, few = (html.page_skeleton(html.trees(pages, fields=f)) for f in (html.FIELDS, html.SKELETON_FIELDS))
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, whole.collect())) and [g[0] for g in got] == [0, 4, 5, 6]
    assert got[1][1:] == ("text(1)", 0) and got[2][2] == 7 and got[3][1].count("text(1)") == 500 and got[3][2] == 200
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert html.tree("<ul><li>a</ul>", fields=("tag", "item_index")) == {"tag": ["ul", "li", None], "item_index": [None, 0, None]}


def test_tasks_hand_pages_to_python_in_small_batches(spark):
    from convlake.session import BATCH, byte_slices, small_batches

    spark.conf.unset(BATCH[0])
    page = "<div><p>one <b>two</b></p><table><tr><td>3</td></tr></table></div>" * 40
    df = spark.range(0, 800, 1, 1).select(F.col("id").alias("page_id"), F.lit(page).alias("html"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "mb": [b.nbytes / 1e6]})

    left = html.strip_chrome(html.trees(df))
    got = left.mapInArrow(sizes, "n long, mb double").collect()
    assert sum(r.n for r in got) == 800 and sum(r.mb for r in got) > 20 and max(r.mb for r in got) < 6
    blocks = html.extract_blocks(left).groupBy("page_id").count()
    assert blocks.where("count = 80").count() == 800
    # long pages are parsed and walked one by one, short ones fifty at a time
    batch = pa.RecordBatch.from_pydict({"html": ["x" * (2 << 20)] * 3 + ["y"] * 60})
    assert [s.num_rows for s in byte_slices([batch], *html.SLICE)] == [1, 1, 1, 50, 10]
    # a bound that the session names stays
    spark.conf.set(BATCH[0], "5m")
    small_batches(spark)
    assert spark.conf.get(BATCH[0]) == "5m"
    spark.conf.unset(BATCH[0])


@pytest.mark.parametrize("made", [html.extract_blocks, lambda nodes: blocks.render_pages(nodes, "md"), lambda nodes: blocks.render_pages(nodes, "txt")], ids=["blocks", "md", "txt"])
def test_parse_and_walk_get_small_batches(spark, monkeypatch, made):
    from convlake.session import BATCH, byte_slices

    def checked(batches, rows, size):
        for b in batches:
            assert b.nbytes < 6e6
            yield from byte_slices([b], rows, size)

    spark.conf.unset(BATCH[0])
    monkeypatch.setattr(html, "byte_slices", checked)
    page = "<div><p>one <b>two</b></p><ul><li>x</li></ul><table><tr><td>3</td></tr></table></div>" * 100
    stored = html.trees(spark.range(0, 300, 1, 1).select(F.col("id").alias("page_id"), F.lit(page).alias("html"))).localCheckpoint()
    spark.conf.unset(BATCH[0])  # nodes may have been stored by another session
    assert made(stored).select("page_id").distinct().count() == 300
    spark.conf.unset(BATCH[0])
