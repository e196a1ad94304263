"""Queries from captured pages to turns and pairs.

The tables' pages are of no known platform: each gets the url of one, and turns behind what it holds, in
one of six shapes that depend on the page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import capture, pairing
from convlake.operators.reports import DIAGRAM
from convlake.queries.pages import number, pieces
from convlake.registry import query
from convlake.sources.tables import read_pages, spread

c = F.col
SITES = ("https://chatgpt.com/c/", "https://claude.ai/chat/", "https://gemini.google.com/app/")


def asked(text):
    return ('<section data-turn="user"><h5 class="sr-only">You said:</h5><div data-message-author-role="user"><div class="user-message-bubble-color"><div class="whitespace-pre-wrap">', *text, "</div></div></div></section>")


def told(*texts):
    parts = [p for t in texts for p in ('<div data-message-author-role="assistant"><div class="markdown prose">', *t, "</div></div>")]
    return ('<section data-turn="assistant"><h6 class="sr-only">It said:</h6>', *parts, "</section>")


def held(question, *answers, more=()):
    parts = [p for a in answers for p in ("<message-content><div class=\"markdown\">", *a, "</div></message-content>")]
    asks = ("<user-query><user-query-content>", *question, "</user-query-content></user-query>") if question else ()
    return ('<div class="conversation-container">', *asks, "<model-response>", *parts, *more, "</model-response></div>")


def shapes(n):
    """Six pages: what a turn says comes from the page's number ``n``."""
    math = '<span class="katex"><span class="katex-mathml"><math><annotation encoding="application/x-tex">x^2</annotation></math></span><span aria-hidden="true">x2</span></span>'
    turn = '<div data-test-render-count="1">'
    return (
        (*asked(("  ask\n ", n)), *told(("<p>It is <b>y", n, "</b>.</p><button>Copy</button><table><tr><td>1</td><td>2</td></tr></table>"), ("more ", math)), *asked(("again ", n)), *asked(("last ", n)), *told(("<br>",))),
        (turn, '<div class="mb-1 mt-6 group"><div data-testid="user-message"><p class="whitespace-pre-wrap">ask ', n, "</p></div></div></div>", turn,
            '<div data-is-streaming="false"><div class="ease-out transition-all flex flex-col font-ui leading-normal"><button class="group/row"><div class="flex gap-2 relative font-base text-left">news ', n,
            '</div><p class="relative bottom-[0.5px] pl-1 text-text-500">about 7</p></button><div class="flex flex-nowrap p-2 pt-0 flex-col"><a href="/r">r</a></div></div><div class="standard-markdown"><p>answer ', n,
            '</p></div><div class="artifact-block-cell"><div class="leading-tight text-sm line-clamp-1">Doc ', n, '</div><div class="text-xs line-clamp-1 text-text-400">Code</div></div></div></div>'),
        (*held(("ask <i>", n, "</i>"), ("answer ", n)), *held((), more=("<video><source src=\"/v/", n, '.mp4"></video>'))),
        ('<section data-turn="user"><h5 class="sr-only">You said:</h5><img src="/u/', n, '.png" alt="cat ', n, '"><img src="/w.png"></section><section data-turn="assistant"><div id="textdoc-message-1"><div class="ProseMirror"><p>board ', n,
            "</p></div></div></section>", *asked(("next ", n)), '<section data-turn="assistant"><div class="message-role">It • fox ', n, '</div><div class="group/imagegen-image"><img src="/p/', n, '.png"></div></section>'),
        (turn, '<div data-user-message-bubble=""><div class="relative group/thumbnail"><img src="/u.png" alt="dog ', n, '"></div></div></div>', turn, '<div data-is-streaming="false"></div></div>', turn, "neither</div>",
            turn, '<div class="mb-1 mt-6 group"><div data-testid="user-message"><p class="whitespace-pre-wrap">bye ', n, "</p></div></div></div>"),
        (*held(("ask ", n), ("one ", n), ("two ", n)), *held(()), *held((), ("alone ", n))),
    )


def captured(spark, d):
    shape = c("page_id") % 6
    more, url = F.lit(""), F.lit("")
    for k, parts in enumerate(shapes(number())):
        more, url = F.when(shape == k, pieces(*parts)).otherwise(more), F.when(shape == k, pieces(SITES[k % 3], number())).otherwise(url)
    return spread(read_pages(spark, d)).select("page_id", url.alias("url"), F.concat(F.coalesce("html", F.lit("")), more).alias("html"))


EXPECTED = """e AS (SELECT page_id, turn, role, replace(replace(said, '#', page_id::VARCHAR), '/', chr(10)) AS content, images, media FROM pages, (VALUES
  (0, 0, 'user', 'ask #', 0, 0), (0, 1, 'assistant', 'It is y#./1 | 2//more $x^2$', 0, 0), (0, 2, 'user', 'again #', 0, 0), (0, 3, 'user', 'last #', 0, 0), (0, 4, 'assistant', '', 0, 0),
  (1, 0, 'user', 'ask #', 0, 0), (1, 1, 'assistant', '[Web Search: news #]//Found 7 results//answer #//[Code: Doc #]', 0, 0),
  (2, 0, 'user', 'ask #', 0, 0), (2, 1, 'assistant', 'answer #', 0, 0), (2, 2, 'user', '', 0, 0), (2, 3, 'assistant', '', 0, 1),
  (3, 0, 'user', '[Uploaded images: cat #, image]', 2, 0), (3, 1, 'assistant', '[Canvas Content]/board #', 0, 0), (3, 2, 'user', 'next #', 0, 0), (3, 3, 'assistant', '[Image: fox #]', 1, 0),
  (4, 0, 'user', '[Uploaded images: dog #]', 1, 0), (4, 1, 'assistant', '', 0, 0), (4, 2, 'user', 'bye #', 0, 0),
  (5, 0, 'user', 'ask #', 0, 0), (5, 1, 'assistant', 'one #//two #', 0, 0), (5, 2, 'user', '', 0, 0), (5, 3, 'assistant', 'alone #', 0, 0)) v(shape, turn, role, said, images, media) WHERE page_id % 6 = shape),
l AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM e WINDOW w AS (PARTITION BY page_id ORDER BY turn)),
p AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY turn) - 1)::INTEGER AS pair_index, content AS question, CASE WHEN nr = 'assistant' THEN nc ELSE '' END AS answer
  FROM l WHERE role = 'user' AND nr IS NOT NULL)"""


@query(f"WITH {EXPECTED} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'gemini' END AS platform, turn, role, content, images, media FROM e")
def message_from_nodes(spark, d):
    """The turns of all pages."""
    return capture.page_turns(captured(spark, d)).withColumn("images", F.size("images")).drop("turn_id")


@query(f"WITH {EXPECTED} SELECT page_id, pair_index, question, answer FROM p")
def pairs_of_pages(spark, d):
    """Turns of pages as pairs, on all platforms."""
    turns = capture.page_turns(captured(spark, d)).withColumnRenamed("page_id", "conv_id")
    return pairing.pair_turns(turns).select(c("conv_id").alias("page_id"), "pair_index", "question", "answer")


@query(f"WITH {EXPECTED} SELECT page_id, pair_index, question, answer, CASE WHEN page_id % 6 = 2 AND pair_index = 1 THEN 1 ELSE 0 END AS media FROM p WHERE page_id % 3 = 2")
def pair_containers(spark, d):
    """Containers of pages that hold both halves."""
    return pairing.pair_containers(capture.container_parts(capture.page_turns(captured(spark, d))))


def framed(attrs, behind=()):
    return ('<section data-turn="assistant"><h6 class="sr-only">It said:</h6><iframe ', *attrs, "></iframe>", *behind, "</section>")


def widgets(n):
    """Four pages that answer in frames: with a relayed report, a relayed text, neither, and in a frame that is no widget."""
    digits, name = range(10), 'title="internal://deep-research"'
    column = "".join(f"&lt;i>{k}&lt;/i>" for k in digits)
    report = (
        "&lt;div>Title ", n, "&lt;/div>&lt;h1>Title ", n, f"&lt;/h1>&lt;p>{column}&lt;/p>&lt;p>Research completed in 5m&lt;/p>&lt;ul>&lt;li>body ", n,
        '&lt;/li>&lt;/ul>&lt;svg width=&quot;300&quot; height=&quot;90&quot;>&lt;text>2020&lt;/text>&lt;/svg>&lt;script>x()&lt;/script>',
    )
    return (
        framed((name, ' data-report-html="', *report, '"')), framed((name, ' data-report-text="3 citations\n', "\n".join(map(str, digits)), "\nbody ", n, '\n7"')),
        framed((name,)), framed(('title="map" data-report-text="no"',), ("plain ", n)),
    )


@query(f"""SELECT page_id, 0 AS turn, 'assistant' AS role, CASE page_id % 4 WHEN 0 THEN 'Title ' || page_id || chr(10) || 'body ' || page_id || chr(10) || '{DIAGRAM}' WHEN 1 THEN 'body ' || page_id
WHEN 2 THEN '[Deep Research: rendered in an embedded viewer that the page does not expose]' ELSE 'plain ' || page_id END AS content FROM pages""")
def reports_of_pages(spark, d):
    """Turns of pages that answer in frames."""
    more = F.lit("")
    for k, parts in enumerate(widgets(number())):
        more = F.when(c("page_id") % 4 == k, pieces(*parts)).otherwise(more)
    pages = spread(read_pages(spark, d)).select("page_id", F.lit(SITES[0]).alias("url"), F.concat(F.coalesce("html", F.lit("")), more).alias("html"))
    return capture.page_turns(pages).select("page_id", "turn", "role", "content")
