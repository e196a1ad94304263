"""Queries on captured pages.

What the tables' pages lack is added behind what they hold, in shapes that depend on the page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import drift, html, lines, widgets
from convlake.plans import blocks
from convlake.registry import query
from convlake.sources.tables import read_pages as scan_pages
from convlake.sources.tables import spread

c = F.col


def trees(spark, d, fields=html.FIELDS):
    return html.trees(spread(scan_pages(spark, d)), ("url",), fields=fields)


def pieces(*parts):
    """Text and columns put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def with_more(spark, d, more, alone=False, fields=html.FIELDS):
    """The pages with ``more`` behind what they hold, or with ``more`` alone."""
    return html.trees(spread(scan_pages(spark, d)).withColumn("html", more if alone else F.concat(F.coalesce("html", F.lit("")), more)), ("url",), fields=fields)


def number():
    return c("page_id").cast("string")


def rich(spark, d):
    """Pages with code, pictures and media added to what they hold."""
    n = number()
    return with_more(spark, d, pieces(
        '<pre><code class="language-py">x = ', n, '</code></pre><pre class="language-sql">select ', n, "</pre><pre> </pre>", '<a href="', c("url"), '"><img src="/i/', n,
        '.png" alt="pic" width="12"></a><img src="/sprites-core/a.svg"><img src="/i/', n, '.png" title="t"><button><img src="/b/', n, '.png"></button><pre class="overflow-visible!"><img src="/c.png"></pre>',
        '<video title="clip"><source src="/v/', n, '.mp4" type="video/mp4"></video><audio src="/a/', n, '.ogg" aria-label="sound"></audio><video></video>',
    ))


@query("SELECT page_id, url, html FROM pages")
def read_pages(spark, d):
    return scan_pages(spark, d)


@query("""WITH t AS (SELECT page_id, regexp_extract_all(html, '<!--[^>]*-->|</?[A-Za-z][^>]*>|[^<]+') AS t FROM pages)
SELECT page_id, (generate_subscripts(t, 1) - 1)::INTEGER AS pos, unnest(t) AS token FROM t""")
def html_tokens(spark, d):
    return html.html_tokens(scan_pages(spark, d))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def dom_nodes(spark, d):
    """The nodes, counted by tag: the parser sees each start tag once."""
    return html.dom_nodes(spread(scan_pages(spark, d))).where("kind = 'element'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


# ---- pages of a known shape ------------------------------------------------------------------

def shaped(spark, d):
    """Pages of one of two shapes: everything at the top, or inside a custom element within a ``div``."""
    n = number()
    body = pieces(
        "<h2>Title ", n, "</h2><p>one <b>two <a href=\"", c("url"), "\">three</a></b> end</p>loose<blockquote><p>quoted ", n, "</p><blockquote>deep</blockquote></blockquote>",
        "<ol><li>first<ul><li>inner ", n, "</li></ul></li><li>second</li></ol><pre><code class=\"language-sql\">select\n  ", n, "</code></pre><hr><a href=\"/l/", n, "\"><img src=\"/i/", n, ".png\" alt=\"pic\"></a>",
        "<table><thead><tr><th>a</th><th colspan=\"2\">b</th></tr><tr><th></th><th>c</th><th>d</th></tr></thead><tbody><tr><td rowspan=\"2\">", n, "</td><td>2</td><td>3</td></tr><tr><td>4</td></tr><tr><td>5</td></tr></tbody></table>",
        '<p style="position: absolute; width: 1px">hidden</p><p class="sr-only">hidden</p><button>Copy</button>',
    )
    odd = c("page_id") % 2 == 1
    return html.strip_chrome(with_more(spark, d, F.when(odd, pieces("<div><x-card>", body, "</x-card></div>")).otherwise(body), alone=True))


BLOCK_ROWS = """(VALUES (0, 'heading', 2, 0, 'Title '), (1, 'paragraph', NULL, 0, 'one two three end'), (2, 'paragraph', NULL, 0, 'loose'), (3, 'blockquote', NULL, 0, ''), (4, 'paragraph', NULL, 1, 'quoted '),
  (5, 'blockquote', NULL, 1, ''), (6, 'paragraph', NULL, 2, 'deep'), (7, 'list', NULL, 0, ''), (8, 'list_item', NULL, 1, 'first'), (9, 'list', NULL, 2, ''), (10, 'list_item', NULL, 3, 'inner '), (11, 'list_item', NULL, 1, 'second'),
  (12, 'code', NULL, 0, 'select' || chr(10) || '  '), (13, 'hr', NULL, 0, ''), (14, 'image', NULL, 0, ''), (15, 'table', NULL, 0, '')) b(ordinal, type, level, depth, said)"""


@query(f"""SELECT page_id, ordinal, type, level, depth, said || CASE WHEN ordinal IN (0, 4, 10, 12) THEN page_id::VARCHAR ELSE '' END AS text,
  CASE WHEN ordinal = 12 THEN 'sql' END AS language, CASE ordinal WHEN 7 THEN true WHEN 9 THEN false END AS ordered, CASE ordinal WHEN 8 THEN 0 WHEN 10 THEN 0 WHEN 11 THEN 1 END AS item_index,
  CASE WHEN ordinal = 14 THEN '/i/' || page_id || '.png' END AS url, CASE WHEN ordinal = 14 THEN '/l/' || page_id END AS link_url FROM pages, {BLOCK_ROWS}""")
def extract_blocks(spark, d):
    return html.extract_blocks(shaped(spark, d)).select("page_id", "ordinal", "type", "level", "depth", "text", "language", "ordered", "item_index", "url", "link_url")


@query()
def extract_blocks_of_pages(spark, d):
    """The blocks of the pages as they are."""
    return html.extract_blocks(html.strip_chrome(trees(spark, d)))


@query("""SELECT page_id, 'Title ' || page_id || chr(10) || 'one two three end' || chr(10) || 'loose' || chr(10) || 'quoted ' || page_id || chr(10) || 'deep' || chr(10) || 'first' || chr(10) || 'inner ' || page_id || chr(10) || 'second'
  || chr(10) || 'select' || chr(10) || '  ' || page_id || chr(10) || 'a | b' || chr(10) || 'c | d' || chr(10) || page_id || ' | 2 | 3' || chr(10) || '4' || chr(10) || '5' AS text FROM pages""")
def flatten_text(spark, d):
    return html.flatten_text(shaped(spark, d))


@query()
def flatten_text_of_pages(spark, d):
    return html.flatten_text(html.strip_chrome(trees(spark, d)))


@query("SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 2 ELSE 0 END + 35 AS elements, 21 AS texts, 0 AS hidden FROM pages")
def strip_chrome(spark, d):
    kinds = html.node_rows(shaped(spark, d))
    return kinds.groupBy("page_id").agg(
        F.count_if(c("kind") == "element").cast("int").alias("elements"), F.count_if((c("kind") == "text") & (F.trim("text") != "")).cast("int").alias("texts"),
        F.count_if((c("kind") == "text") & c("text").contains("hidden")).cast("int").alias("hidden"),
    )


@query("""SELECT page_id, type, marks, CASE type WHEN 'bold' THEN text ELSE text END AS text, CASE WHEN marks LIKE '%link' THEN url END AS url FROM pages,
  (VALUES ('text', '', 'one '), ('bold', 'bold', 'two '), ('bold', 'bold,link', 'three'), ('text', '', ' end')) r(type, marks, text)""")
def extract_inlines(spark, d):
    """The runs of the first paragraph."""
    out = html.extract_inlines(shaped(spark, d))
    runs = out.where("text IN ('one ', 'two ', 'three', ' end')")
    return runs.select("page_id", "type", F.array_join("marks", ",").alias("marks"), "text", "url")


@query()
def extract_inlines_of_pages(spark, d):
    return html.extract_inlines(html.strip_chrome(trees(spark, d)))


GRID = """g AS (SELECT page_id, h, r, k, CASE WHEN t = '#' THEN page_id::VARCHAR ELSE t END AS text FROM pages, (VALUES (true, 0, 0, 'a'), (true, 0, 1, 'b'), (true, 0, 2, ''), (true, 1, 0, ''), (true, 1, 1, 'c'), (true, 1, 2, 'd'),
  (false, 0, 0, '#'), (false, 0, 1, '2'), (false, 0, 2, '3'), (false, 1, 0, ''), (false, 1, 1, '4'), (false, 2, 0, '5')) v(h, r, k, t))"""


def page_grid(spark, d):
    cells = html.table_cells(shaped(spark, d))
    return lines.table_grid(cells, ["page_id", "table_id"])


@query(f"WITH {GRID} SELECT page_id, h AS is_header, r AS row_idx, k AS col_idx, text FROM g")
def table_grid(spark, d):
    """The tables of pages, with cells over several rows and columns at their real places."""
    return page_grid(spark, d).drop("table_id")


@query("""SELECT page_id, col_idx, text FROM pages, (VALUES (0, 'a'), (1, 'b c'), (2, 'd')) v(col_idx, text)""")
def merge_page_headers(spark, d):
    return lines.merge_header_rows(page_grid(spark, d), ["page_id", "table_id"]).drop("table_id")


@query(f"WITH {GRID} SELECT page_id, r AS row_idx, k AS col_idx, text FROM g WHERE NOT h UNION ALL SELECT page_id, r, k, '' FROM pages, (VALUES (1, 2), (2, 1), (2, 2)) v(r, k)")
def pad_page_rows(spark, d):
    return lines.pad_ragged_rows(page_grid(spark, d), ["page_id", "table_id"]).drop("table_id")


# ---- elements --------------------------------------------------------------------------------


@query("SELECT page_id, 'py' AS language, 'x = ' || page_id AS code FROM pages UNION ALL SELECT page_id, 'sql', 'select ' || page_id FROM pages")
def extract_code(spark, d):
    return html.extract_code(rich(spark, d)).select("page_id", "language", "code")


def decoded_sql(text):
    """The references that escaping writes, decoded once; as in HTML, one may lack its semicolon where a text was cut."""
    for reference, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#(39|x27)", "''"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{reference};?', '{sign}', 'g')"
    return text


HEADING_TEXT = decoded_sql(r"trim(regexp_replace(regexp_extract(h, '>([^<]*)', 1), '\s+', ' ', 'g'))")


@query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*')) AS h FROM pages),
t AS (SELECT page_id, substr(h, 3, 1)::INTEGER AS level, {HEADING_TEXT} AS text FROM a) SELECT * FROM t WHERE text <> ''""")
def extract_headings(spark, d):
    return html.extract_headings(trees(spark, d)).select("page_id", "level", "text")


@query("SELECT page_id, item_index, depth, ordered, said || CASE WHEN depth = 1 THEN page_id::VARCHAR ELSE '' END AS text FROM pages, (VALUES (0, 0, true, 'first'), (0, 1, false, 'inner '), (1, 0, true, 'second')) v(item_index, depth, ordered, said)")
def extract_lists(spark, d):
    return html.extract_lists(shaped(spark, d)).drop("list_id")


@query("SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS items FROM pages WHERE contains(html, '<li')")
def extract_lists_of_pages(spark, d):
    return html.extract_lists(trees(spark, d)).groupBy("page_id").agg(F.count("*").alias("items"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"[^>]*>[^<]*[^<\s][^<]*</a>', 1)) AS href FROM pages) SELECT page_id, count(*) AS links FROM a GROUP BY page_id""")
def extract_links(spark, d):
    return html.extract_links(trees(spark, d)).groupBy("page_id").agg(F.count("*").alias("links"))


@query("""SELECT page_id, 'Web Search' AS query, 2 AS result_count, 'page ' || page_id || ' (' || CASE WHEN page_id % 2 = 0 THEN 'news.example' ELSE '?' END || '), odd (?)' AS results FROM pages""")
def extract_citations(spark, d):
    """Two citations, one of which has no domain, among other anchors."""
    first = F.when(c("page_id") % 2 == 0, pieces("https://www.news.example/", number())).otherwise(pieces("mailto:", number()))
    t = with_more(spark, d, pieces(
        '<span data-testid="webpage-citation-pill"><a href="', first, '">page ', number(), '</a><a href="">none</a><a href="/x"> </a></span><a href="https://b.example/">plain</a>',
        '<span data-testid="webpage-citation-pill"><b><a href="javascript:x">odd</a></b></span>',
    ))
    shown = F.array_join(F.transform("results", lambda r: F.concat(r["title"], F.lit(" ("), F.coalesce(F.nullif(r["domain"], F.lit("")), F.lit("?")), F.lit(")"))), ", ")
    return html.extract_citations(t).select("page_id", "query", "result_count", shown.alias("results"))


IMAGES = """i AS (SELECT page_id, '/i/' || page_id || '.png' AS src, 'pic' AS alt, 12 AS width, url AS link_url, false AS chrome FROM pages UNION ALL SELECT page_id, '/sprites-core/a.svg', NULL, NULL, NULL, false FROM pages
UNION ALL SELECT page_id, '/i/' || page_id || '.png', NULL, NULL, NULL, false FROM pages UNION ALL SELECT page_id, '/b/' || page_id || '.png', NULL, NULL, NULL, true FROM pages UNION ALL SELECT page_id, '/c.png', NULL, NULL, NULL, true FROM pages)"""


@query(f"WITH {IMAGES} SELECT * FROM i")
def extract_images(spark, d):
    return html.extract_images(rich(spark, d)).select("page_id", "src", "alt", "width", "link_url", "chrome")


@query(f"WITH {IMAGES} SELECT page_id, src FROM i WHERE NOT chrome AND NOT contains(src, 'sprites')")
def filter_content_images(spark, d):
    return html.filter_content_images(html.extract_images(rich(spark, d))).select("page_id", "src")


@query(f"WITH {IMAGES} SELECT page_id, src, count(*) AS times FROM i GROUP BY ALL")
def image_inventory(spark, d):
    return html.image_inventory(html.extract_images(rich(spark, d))).drop("first")


@query("SELECT page_id, 'video' AS kind, '/v/' || page_id || '.mp4' AS src, 'clip' AS alt, 'video/mp4' AS mime FROM pages UNION ALL SELECT page_id, 'audio', '/a/' || page_id || '.ogg', 'sound', NULL FROM pages")
def extract_media(spark, d):
    return html.extract_media(rich(spark, d)).drop("node_id")


@query("""SELECT page_id, '<p class="k">a &amp; b<a href="/x/' || page_id || '" title="t">link</a><a>bad</a></p><img src="data:image/png;base64,AA==" alt="p"><svg width="9" aria-label="s"></svg><pre tabindex="0">x</pre><h3>' || page_id || '</h3>' AS html FROM pages""")
def sanitize_html(spark, d):
    n = number()
    return html.sanitize_html(with_more(spark, d, pieces(
        '<html><body><p class="k" onclick="x" id="i">a &amp; b<a href="/x/', n, '" title="t" target="_blank">link</a><a href="java\tscript:x">bad</a></p><script>bad</script><article><p>gone</p></article><!-- gone -->',
        '<img src="data:image/png;base64,AA==" alt="p" onerror="x"><s>gone</s><svg width="9" aria-label="s"><path d="x"></path></svg><pre tabindex="0" style="x">x</pre><iframe src="/x"></iframe><h3>', n, "</h3></body></html>",
    ), alone=True))


@query()
def sanitize_html_of_pages(spark, d):
    return html.sanitize_html(trees(spark, d))


# ---- structure and drift ----------------------------------------------------------------------


def layouts(spark, d):
    """Pages in one of three layouts, with text and ids in every other attribute."""
    n = number()
    items = F.repeat(F.lit("<i>y</i>"), (c("page_id") % 3 * 300).cast("int"))
    return with_more(spark, d, pieces(
        '<main class="a b" aria-label="', n, '" data-testid="', n, '"><p data-turn="user" title="', n, '" role="note">xx</p><!-- ', n, " --><div>", items, "</div></main>",
    ), alone=True, fields=html.SKELETON_FIELDS)


SKELETON = """s AS (SELECT page_id, (page_id % 3 * 300)::INTEGER AS k FROM pages),
o AS (SELECT page_id, 'main.a b[aria-label][data-testid]' || chr(10) || '  p[data-turn="user"][title][role="note"]' || chr(10) || '    text(2)' || chr(10) || '  div'
  || repeat(chr(10) || '    i' || chr(10) || '      text(1)', least(k, 497)) || CASE WHEN k > 497 THEN chr(10) || '…elided ' || (k - 497) || ' nodes' ELSE '' END AS skeleton, greatest(k - 497, 0)::BIGINT AS elided FROM s)"""


@query(f"WITH {SKELETON} SELECT * FROM o")
def page_skeleton(spark, d):
    return html.page_skeleton(layouts(spark, d))


@query()
def page_skeleton_of_pages(spark, d):
    return html.page_skeleton(trees(spark, d, html.SKELETON_FIELDS))


@query("SELECT count(*) AS pages FROM pages GROUP BY page_id % 3")
def structure_signature(spark, d):
    return html.structure_signature(html.page_skeleton(layouts(spark, d))).select("pages")


SELECTORS = [
    ("article", "article", True), ("ad", "div.ad", True), ("missing", "dialog", False), ("broken", "a >> b", False), ("link", "a[href]", True),
    ("either", "article, nav", False), ("secure", 'a[href^="https"]', False), ("deep", "article a", False),
]
HEALTH = """h AS (SELECT page_id, k.key, k.selector, k.required, CASE k.key WHEN 'article' THEN len(regexp_extract_all(html, '<article[ >]')) WHEN 'ad' THEN len(regexp_extract_all(html, '<div class="ad"')) WHEN 'missing' THEN 0 WHEN 'broken' THEN -1
  WHEN 'link' THEN len(regexp_extract_all(html, '<a [^>]*href=')) WHEN 'either' THEN len(regexp_extract_all(html, '<(article|nav)[ >]')) WHEN 'secure' THEN len(regexp_extract_all(html, '<a [^>]*href="https'))
  ELSE len(regexp_extract_all(list_reduce(list_prepend('', regexp_extract_all(html, '(?s)<article[ >].*?</article>')), lambda x, y: x || y), '<a[ >]')) END AS matched
FROM pages, (VALUES ('article', 'article', true), ('ad', 'div.ad', true), ('missing', 'dialog', false), ('broken', 'a >> b', false), ('link', 'a[href]', true), ('either', 'article, nav', false), ('secure', 'a[href^="https"]', false), ('deep', 'article a', false)) k(key, selector, required))"""


def health(spark, d):
    return html.selector_health(spread(scan_pages(spark, d)), SELECTORS)


query(f"WITH {HEALTH} SELECT page_id, key, required, matched FROM h", "selector_health")(lambda spark, d: health(spark, d).drop("selector"))


@query(f"WITH {HEALTH} SELECT page_id, bool_or(required AND matched <= 0) AS failed FROM h GROUP BY page_id")
def required_failure(spark, d):
    return drift.required_failure(health(spark, d))


PLATFORMS = [("chatgpt", r"\.example\.com", None), ("claude", r"\.example\.net", "article"), ("gemini", "example", "article")]


@query(r"""WITH k AS (SELECT page_id, url, regexp_matches(html, '<article[ >]') AS a FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '\.example\.com') THEN 'chatgpt' WHEN regexp_matches(url, '\.example\.net') AND a THEN 'claude' WHEN regexp_matches(url, 'example') AND a THEN 'gemini' END AS platform FROM k""")
def detect_platform(spark, d):
    return html.detect_platform(trees(spark, d), PLATFORMS)


@query("SELECT page_id, CASE WHEN contains(url, '.org') THEN 'mine' END AS platform FROM pages")
def register_platform(spark, d):
    """A platform of one's own is one more row of the list."""
    return html.detect_platform(trees(spark, d), [("mine", r"\.org", None)])


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Chat ' || page_id WHEN 1 THEN 'Doc ' || page_id ELSE 'Claude Conversation' END AS title FROM pages""")
def extract_title(spark, d):
    """From the header's button, else from the title element; generic names don't count."""
    n = number()
    button = F.when(c("page_id") % 4 == 0, pieces("Chat ", n)).when(c("page_id") % 4 == 1, "Claude").otherwise("")
    head = F.when(c("page_id") % 4 == 1, pieces("Doc ", n)).when(c("page_id") % 4 == 2, "About OpenAI").otherwise("Claude")
    t = with_more(spark, d, pieces("<title>", head, '</title><button data-testid="chat-title-button"><div class="truncate">', button, "</div></button>"), alone=True)
    return html.extract_title(t, ('button[data-testid="chat-title-button"] div.truncate', "title"), ("Claude", "ChatGPT"), "Claude Conversation", "OpenAI")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Mine ' || page_id WHEN 1 THEN 'Head ' || page_id ELSE 'Untitled' END AS title FROM pages""")
def titles_in_sidebars(spark, d):
    """Pages with links to conversations: their own, their own and a title, their own without a text, and others alone."""
    n, kind = number(), c("page_id") % 4
    own = F.when(kind < 3, pieces('<a href="https://x.example/c/0a-', n, '?m=1"><i>icon</i>', F.when(kind < 2, pieces('<div class="truncate"> Mine <b>', n, "</b></div>")).otherwise('<div class="truncate"> </div>'), "</a>")).otherwise("")
    head = F.when(kind == 1, pieces('<button data-testid="chat-title-button"><div class="truncate">Head ', n, "</div></button>")).otherwise("")
    more = pieces('<nav><a href="/c/0a"><div class="truncate">Other</div></a>', own, "</nav>", head)
    pages = spread(scan_pages(spark, d)).select("page_id", pieces("https://x.example/c/0a-", n).alias("url"), F.concat(F.coalesce("html", F.lit("")), more).alias("html"))
    return html.extract_title(html.trees(pages, ("url",)), ('button[data-testid="chat-title-button"] div.truncate',), (), "Untitled", sidebar=("/c/[a-f0-9-]+", "div.truncate"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'slug-' || page_id WHEN 1 THEN 'Claude M' || page_id WHEN 2 THEN 'Gemini (fast mode)' END AS model FROM pages""")
def extract_model(spark, d):
    n, kind = number(), c("page_id") % 4
    t = with_more(spark, d, pieces(
        '<article data-message-model-slug="slug-', n, '"></article><button data-testid="model-selector-dropdown"><div class="x whitespace-nowrap">', F.when(c("page_id") % 8 == 1, "").otherwise("Claude "), "M", n,
        '</div></button><div data-test-id="bard-mode-menu-button"><span class="picker-primary-text"> fast </span></div>',
    ))
    return html.extract_model(t, F.when(kind == 0, "chatgpt").when(kind == 1, "claude").when(kind == 2, "gemini"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Title ' || page_id WHEN 1 THEN 'x.example' ELSE 'https://x.example/' || page_id END AS title, 'https://x.example/' || page_id AS url, CASE WHEN page_id % 3 < 2 THEN 'x.example' END AS domain FROM pages""")
def used_sources_only(spark, d):
    """Cited sources stay, those only read go."""
    n = number()
    item = lambda url, title, domain: pieces(
        '<browse-web-item><a data-test-id="browse-web-item-link" href="', url, '"></a><b data-test-id="domain-name">', domain, '</b><i data-test-id="sub-title">', title, "</i></browse-web-item>"
    )
    title, domain = F.when(c("page_id") % 3 == 0, pieces("Title ", n)).otherwise(" "), F.when(c("page_id") % 3 < 2, "x.example").otherwise("")
    return html.used_sources(with_more(spark, d, pieces(
        '<div class="source-list used-sources">', item(pieces("https://x.example/", n), title, domain), item(F.lit(""), F.lit("no url"), F.lit("y")), "</div>",
        '<div class="source-list unused-sources">', item(F.lit("https://z.example/"), F.lit("only read"), F.lit("z.example")), "</div>",
    ))).drop("node_id")


# ---- widgets ---------------------------------------------------------------------------------


SEARCH = "ease-out transition-all flex flex-col font-ui leading-normal"


def built(spark, d):
    n = number()
    label = F.when(c("page_id") % 3 == 0, "Code · JSX").when(c("page_id") % 3 == 1, "Imagen").otherwise("")
    return with_more(spark, d, pieces(
        '<div class="', SEARCH, '"><button class="group/row"><div class="flex gap-2 relative font-base text-left">find ', n, '</div><p class="relative bottom-[0.5px] pl-1 text-text-500">about ', n,
        ' results</p></button><div class="flex flex-nowrap p-2 pt-0 flex-col"><a href="https://www.a.example/', n, '"><p class="relative text-[0.875rem]">Hit</p><p class="relative bottom-[1px] text-[0.75rem] text-text-500">a.example</p></a><a>none</a></div></div>',
        '<div class="', SEARCH, '"><button class="group/row"><div class="flex gap-2 relative font-base text-left"> </div></button></div><div class="', SEARCH, '"><div class="flex gap-2 relative font-base text-left">no button</div></div>',
        '<div id="textdoc-message-', n, '"><div class="prose">board ', n, '</div></div><p>so <span class="katex-display"><span class="katex"><span class="katex">x</span><annotation>x^', n, '</annotation></span></span> and <span class="katex">y', n, "</span></p>",
        '<pre class="overflow-visible!"><div class="h-9">Python</div><code class="whitespace-pre!">print(', n, ')</code></pre><pre class="a overflow-visible!"><div class="sticky">SQL<button>Copy</button></div><div class="cm-content"><code>a<img src="x.png"></code></div></pre>',
        '<pre class="overflow-visible!"><code class="language-x"> </code></pre>',
        '<div class="artifact-block-cell"><div class="leading-tight text-sm line-clamp-1">', F.when(c("page_id") % 2 == 0, pieces("Art ", n)).otherwise(" "), '</div><div class="text-xs line-clamp-1 text-text-400">', label, "</div></div>",
        '<div class="x-imagegen"><span class="font-medium">', F.when(c("page_id") % 3 == 0, pieces("Image • Cat ", n)).otherwise("Image"), '</span><img src="/g/', n, '.png"></div>',
    ))


@query("SELECT page_id, 'find ' || page_id AS query, page_id::INTEGER AS result_count, 1 AS results, 'a.example' AS domain, 'Hit' AS title FROM pages")
def extract_search_widgets(spark, d):
    return widgets.extract_search_widgets(built(spark, d)).select("page_id", "query", "result_count", F.size("results").alias("results"), F.get("results", F.lit(0))["domain"].alias("domain"), F.get("results", F.lit(0))["title"].alias("title"))


@query("SELECT page_id, '[Canvas Content]' || chr(10) || 'board ' || page_id AS content FROM pages")
def extract_canvas(spark, d):
    return widgets.extract_canvas(built(spark, d)).select("page_id", "content")


@query("SELECT page_id, '$$x^' || page_id || '$$' AS marker FROM pages UNION ALL SELECT page_id, '$y' || page_id || '$' FROM pages")
def collapse_math(spark, d):
    return widgets.math_markers(html.collapse_math(built(spark, d))).select("page_id", "marker")


@query("SELECT page_id, 'so $$x^' || page_id || '$$ and $y' || page_id || '$' AS text FROM pages")
def text_with_math(spark, d):
    """The formulas stand in the text of their paragraph."""
    return html.extract_blocks(html.collapse_math(built(spark, d))).where("text LIKE 'so $$x%'").select("page_id", "text")


@query("SELECT page_id, 'Python' AS title, 'code' AS type, 'python' AS language, 'print(' || page_id || ')' AS content FROM pages UNION ALL SELECT page_id, 'Sql', 'image', 'sql', 'a' FROM pages")
def extract_code_artifacts(spark, d):
    return widgets.extract_code_artifacts(built(spark, d)).drop("node_id")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Art ' || page_id ELSE 'Untitled Artifact' END AS title, CASE page_id % 3 WHEN 0 THEN 'Code · JSX' WHEN 1 THEN 'Imagen' ELSE '' END AS label, CASE WHEN page_id % 3 = 0 THEN 'jsx' ELSE '' END AS format,
  CASE page_id % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'image' ELSE 'unknown' END AS type, CASE page_id % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'svg' END AS language FROM pages""")
def extract_artifact_cells(spark, d):
    return widgets.extract_artifact_cells(built(spark, d)).drop("node_id")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '[Image: Cat ' || page_id || ']' ELSE '[Generated Image]' END AS content, '/g/' || page_id || '.png' AS src, 'Generated image' AS alt FROM pages""")
def extract_generated_image(spark, d):
    return widgets.extract_generated_image(built(spark, d)).drop("node_id")


# ---- blocks in three formats -------------------------------------------------------------------


def nested(spark, d):
    """Pages with quotes in quotes, lists in lists and in quotes, code and a table behind what they hold."""
    n = number()
    return html.strip_chrome(with_more(spark, d, pieces(
        "<p>Marker ", n, ":</p><h1>Part</h1><p># sign ", n, "</p><blockquote><p>q ", n, "</p><ol><li>one<ul><li>in ", n, "</li><li>in2</li></ul></li><li>two</li></ol><blockquote>deep</blockquote><pre>x\n\ny</pre></blockquote>",
        "<ul><li>a<ol><li>b ", n, '</li></ol></li><li>c</li></ul><hr><a href="/l"><img src="https://e.example/', n, '.png" alt="k"></a>',
        "<table><thead><tr><th>h1</th><th>h2</th></tr></thead><tbody><tr><td>1</td></tr><tr><td>a|b</td><td>22</td></tr></tbody></table><pre><code class=\"language-py\">p ", n, "</code></pre>end",
    )))


MD = """

## Part

\\# sign §

> q §
>
> 1. one
>    - in §
>    - in2
> 2. two
>
> > deep
> >
>
> ```code
> x
>
> y
> ```
>

- a
  1. b §
- c

---

![k](https://e.example/§.png)

| h1 | h2 |
| --- | --- |
| 1 |   |
| a\\|b | 22 |

```py
p §
```

end"""
TXT = f"""


Part
~~~~

# sign §


> q §
>
> 1. one
>   - in §
>   - in2
> 2. two
>
>
> > deep
> >
>
>
> ```code
> x
>
> y
> ```
>

- a
  1. b §
- c


{"-" * 72}


[Image: k] https://e.example/§.png


+-----+-----+
| h1  | h2  |
+=====+=====+
| 1   |     |
| a|b | 22  |
+-----+-----+


```py
p §
```

end"""
HTML = """</p>
<h2>Part</h2>
<p># sign §</p>
<blockquote><p>q §</p>
<ol><li>one<ul><li>in §</li>
<li>in2</li></ul></li>
<li>two</li></ol>
<blockquote><p>deep</p></blockquote>
<pre tabindex="0"><code class="language-code">x

y</code></pre></blockquote>
<ul><li>a<ol><li>b §</li></ol></li>
<li>c</li></ul>
<hr>
<a href="/l" target="_blank" rel="noopener noreferrer"><img src="https://e.example/§.png" alt="k"></a>
<table><thead><tr><th>h1</th><th>h2</th></tr></thead><tbody><tr><td>1</td><td></td></tr><tr><td>a|b</td><td>22</td></tr></tbody></table>
<pre tabindex="0"><code class="language-py">p §</code></pre>
<p>end</p>"""


def rendered(kind):
    """The whole pages in one format; what stands behind the marker is told."""
    def run(spark, d):
        return blocks.render_pages(nested(spark, d), kind).select("page_id", F.expr("substring_index(text, 'Marker ' || page_id || ':', -1)").alias("text"))

    return run


for kind, text in (("md", MD), ("txt", TXT), ("html", HTML)):
    query(f"SELECT page_id, replace('{text}', '§', page_id::VARCHAR) AS text FROM pages", f"{kind}_of_pages")(rendered(kind))


@query()
def md_of_pages_as_they_are(spark, d):
    return blocks.render_pages(html.strip_chrome(trees(spark, d)), "md")
