"""Blocks of pages as Markdown, plain text and HTML.

Blocks stand in an array in the order of the page, each with what is around it (``path``) and its last block
inside.  So nothing is folded level by level: a line's indent and quote marks come from the path of its block, and
what ends a list or a quote is put behind the last block in it.  Headings are renumbered from 2, gaps closed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.markdown import md_code_block, md_escape_leading, md_table_row, md_table_separator
from convlake.functions.naming import escape_html, safe_url
from convlake.functions.text import wrap_text
from convlake.operators.html import page_blocks

WIDTH = 72


def lines_of(header: Column, body: Column, head: Callable, line: Callable) -> Column:
    return F.array_join(F.concat(F.when(header.isNotNull(), head(header)).otherwise(F.array().cast("array<string>")), F.transform(body, line)), "\n")


def md_table(header: Column, body: Column) -> Column:
    return lines_of(header, body, lambda h: F.array(md_table_row(h), md_table_separator(h)), md_table_row)


def txt_boxed(header: Column, body: Column) -> Column:
    """A boxed table; without a header its rows alone."""
    every = F.concat(F.when(header.isNotNull(), F.array(header)).otherwise(F.array().cast("array<array<string>>")), body)
    columns = F.sequence(F.lit(0), F.greatest(F.array_max(F.transform(every, F.size)), F.lit(1)) - 1)
    width = lambda k: F.greatest(F.array_max(F.transform(every, lambda r: F.length(F.coalesce(F.get(r, k), F.lit(""))))), F.lit(3))
    rule = lambda mark: F.concat(F.lit("+"), F.array_join(F.transform(columns, lambda k: F.repeat(F.lit(mark), width(k) + 2)), "+"), F.lit("+"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda k: F.rpad(F.coalesce(F.get(r, k), F.lit("")), width(k), F.lit(" "))), " | "), F.lit(" |"))
    inside = F.transform(body, line)
    return F.array_join(F.when(header.isNotNull(), F.concat(F.array(rule("-"), line(header), rule("=")), inside, F.array(rule("-")))).otherwise(inside), "\n")


def html_table(header: Column, body: Column) -> Column:
    row = lambda tag: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), escape_html(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    head = F.coalesce(F.concat(F.lit("<thead>"), row("th")(header), F.lit("</thead>")), F.lit(""))
    return F.concat(F.lit("<table>"), head, F.lit("<tbody>"), F.array_join(F.transform(body, row("td")), ""), F.lit("</tbody></table>"))


def led(text: Column, lead: Column) -> Column:
    """Each line behind ``lead``, whose last spaces go before a blank line."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x == "", F.rtrim(lead)).otherwise(F.concat(lead, x))), "\n")


def marks(path: Column, item: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(path, lambda m: F.when(m == "quote", "> ").when(m == "list", "").otherwise(item(m))), "")


def level_of(b: Column) -> Column:
    """A heading's place among the levels of its page, from 2 to 6."""
    return F.least(F.array_position("levels", b["level"]).cast("int") + 1, F.lit(6))


def table_of(b: Column, draw: Callable[[Column, Column], Column]) -> Column:
    t = F.try_element_at("tables", b["block_id"])
    return draw(t["header"], t["body"])


def md(b: Column) -> Column:
    lead = marks(b["path"], lambda m: F.repeat(F.lit(" "), F.length(m) + 1))
    text = (
        F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), level_of(b)), F.lit(" "), b["text"]))
        .when(b["type"] == "code", md_code_block(b["text"], b["language"])).when(b["type"] == "hr", "---").when(b["type"] == "table", table_of(b, md_table))
        .when(b["type"] == "image", F.concat(F.lit("!["), F.coalesce(F.nullif(b["alt"], F.lit("")), F.lit("image")), F.lit("]("), b["url"], F.lit(")")))
        .when(b["type"] == "paragraph", md_escape_leading(b["text"]))
    )
    item = F.when((b["type"] == "list_item") & (b["text"] != ""), F.concat(lead, b["mark"], F.lit(" "), b["text"]))
    return F.coalesce(item, led(F.concat(text, F.lit("\n")), lead))


def txt(b: Column) -> Column:
    lead = marks(b["path"], lambda m: F.lit(""))
    around = lambda text: F.concat(F.lit("\n"), text, F.lit("\n"))
    wrapped = F.array_join(wrap_text(b["text"], WIDTH), "\n")
    widest = F.array_max(F.transform(F.split(wrapped, "\n"), F.length))
    text = (
        F.when(b["type"] == "heading", around(F.concat(wrapped, F.lit("\n"), F.repeat(F.lit("~"), widest))))
        .when(b["type"] == "code", around(F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n```"))))
        .when(b["type"] == "hr", around(F.lit("-" * WIDTH))).when(b["type"] == "table", around(table_of(b, txt_boxed)))
        .when(b["type"] == "image", around(F.concat(F.lit("[Image: "), F.coalesce(F.nullif(b["alt"], F.lit("")), F.lit("image")), F.lit("] "), b["url"])))
        .when(b["type"] == "paragraph", F.concat(wrapped, F.lit("\n")))
    )
    deep = F.repeat(F.lit("  "), F.size(F.filter(b["path"], lambda m: m == "list")) - 1)
    mark = F.concat(b["mark"], F.lit(" "))
    body = F.array_join(wrap_text(b["text"], WIDTH - 2), "\n")
    hanging = F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), lead, deep, F.repeat(F.lit(" "), F.length(mark))))
    item = F.when((b["type"] == "list_item") & (b["text"] != ""), F.concat(lead, deep, mark, hanging))
    return F.coalesce(item, led(text, lead), F.when(b["type"] == "blockquote", F.rtrim(lead)))


def html(b: Column) -> Column:
    t, h = escape_html(b["text"]), level_of(b).cast("string")
    image = F.concat(F.lit('<img src="'), escape_html(safe_url(b["url"], True)), F.lit('" alt="'), escape_html(b["alt"]), F.lit('">'))
    linked = F.concat(F.lit('<a href="'), escape_html(safe_url(b["link_url"])), F.lit('" target="_blank" rel="noopener noreferrer">'), image, F.lit("</a>"))
    text = (
        F.when(b["type"] == "heading", F.concat(F.lit("<h"), h, F.lit(">"), t, F.lit("</h"), h, F.lit(">")))
        .when(b["type"] == "code", F.concat(F.lit('<pre tabindex="0"><code class="language-'), escape_html(F.coalesce(b["language"], F.lit(""))), F.lit('">'), t, F.lit("</code></pre>")))
        .when(b["type"] == "hr", "<hr>").when(b["type"] == "table", table_of(b, html_table)).when(b["type"] == "image", F.coalesce(linked, image))
        .when(b["type"] == "list", F.when(b["ordered"], "<ol>").otherwise("<ul>")).when(b["type"] == "list_item", F.concat(F.lit("<li>"), t)).when(b["type"] == "blockquote", "<blockquote>")
        .otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    )
    nested = (b["type"] == "list") & F.exists(b["path"], lambda m: m == "list")
    return F.concat(F.when((b["nth"] > 0) & ~nested, "\n").otherwise(""), text)


def blank_end(b: Column) -> Column:
    """What ends a quote or an outer list in Markdown and text: a blank line of what is around it."""
    outer = (b["type"] == "list") & ~F.exists(b["path"], lambda m: m == "list")
    return F.when(outer | (b["type"] == "blockquote"), F.rtrim(marks(b["path"], lambda m: F.lit(""))))


def html_end(b: Column) -> Column:
    return F.when(b["type"] == "list", F.when(b["ordered"], "</ol>").otherwise("</ul>")).when(b["type"] == "list_item", "</li>").when(b["type"] == "blockquote", "</blockquote>")


FORMATS = {"md": (md, blank_end, "\n"), "txt": (txt, blank_end, "\n"), "html": (html, html_end, "")}


def render_pages(trees: DataFrame, kind: str) -> DataFrame:
    """(page_id, text): the blocks of each page in one of ``FORMATS``; pages without blocks are left out.

    Nothing leaves its page, so there is one parse of each and no shuffle.
    """
    start, end, between = FORMATS[kind]
    pages = page_blocks(trees, with_tables=True).where(F.size("blocks") > 0)
    levels = F.array_sort(F.array_distinct(F.filter(F.col("blocks")["level"], lambda x: x.isNotNull())))
    pages = pages.withColumn("levels", levels)
    at = lambda place, late, inner, s: F.struct(place.alias("at"), F.lit(late).alias("late"), inner.alias("inner"), s.alias("s"))
    events = F.concat(
        F.transform("blocks", lambda b: at(b["ordinal"], 0, F.lit(0), start(b))), F.transform("blocks", lambda b: at(b["last"], 1, -b["ordinal"], end(b)))
    )
    shown = F.transform(F.filter(F.array_sort(events), lambda e: e["s"].isNotNull()), lambda e: e["s"])
    return pages.select("page_id", F.regexp_replace(F.array_join(shown, between), r"^\n+|\n+$", "").alias("text"))
