"""Rendering of inlines, rows and blocks as Markdown, plain text and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.functions.naming import escape_html, safe_url


def md_escape_leading(c: Column) -> Column:
    """A backslash before what would start a heading, quote or list."""
    out = F.regexp_replace(c, r"^(#{1,6}(?=\s|$)|>|[-+](?=\s|$))", r"\\$1")
    return F.regexp_replace(out, r"^(\d{1,9})([.)])(?=\s|$)", r"$1\\$2")


def md_code_fence(code: Column) -> Column:
    """One backtick more than the longest run in the code, three at least."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r) + 1)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0))))


def md_code_block(code: Column, language: Column) -> Column:
    fence = md_code_fence(code)
    return F.concat(fence, F.coalesce(language, F.lit("")), F.lit("\n"), code, F.lit("\n"), fence)


def md_table_cell(c: Column) -> Column:
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\r?\n", " ")
    return F.when(text == "", " ").otherwise(F.replace(text, F.lit("|"), F.lit("\\|")))


def md_table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, md_table_cell), " | "), F.lit(" |"))


def md_table_separator(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))


def md_inline(kind: Column, text: Column, url: Column) -> Column:
    q = lambda mark: F.concat(F.lit(mark), text, F.lit(mark))
    return (
        F.when(kind == "bold", q("**")).when(kind == "italic", q("*")).when(kind == "code", q("`")).when(kind == "strikethrough", q("~~"))
        .when(kind == "link", F.concat(F.lit("["), text, F.lit("]("), F.coalesce(url, F.lit("")), F.lit(")"))).otherwise(text)
    )


def txt_inline(kind: Column, text: Column, url: Column) -> Column:
    """Text alone; a link keeps its url unless that is its text."""
    shown = F.when(F.coalesce(url, F.lit("")).isin("") | (url == text), text).otherwise(F.concat(text, F.lit(" ("), url, F.lit(")")))
    return F.when(kind == "link", shown).otherwise(text)


def html_inline(kind: Column, text: Column, url: Column) -> Column:
    t = escape_html(text)
    tag = lambda name: F.concat(F.lit(f"<{name}>"), t, F.lit(f"</{name}>"))
    link = F.concat(F.lit('<a href="'), escape_html(safe_url(url)), F.lit('">'), t, F.lit("</a>"))
    return (
        F.when(kind == "bold", tag("strong")).when(kind == "italic", tag("em")).when(kind == "code", tag("code"))
        .when(kind == "strikethrough", tag("del")).when(kind == "link", F.coalesce(link, t)).otherwise(t)
    )


def md_block(kind: Column, text: Column, level: Column, language: Column, url: Column) -> Column:
    """One block without children, as Markdown."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(text)))
        .when(kind == "code", md_code_block(text, language))
        .when(kind == "hr", "---")
        .when(kind == "blockquote", F.concat(F.lit("> "), F.trim(text)))
        .when(kind == "image", F.concat(F.lit("!["), F.coalesce(F.nullif(text, F.lit("")), F.lit("image")), F.lit("]("), url, F.lit(")")))
        .when(kind == "list_item", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), F.trim(text)))
        .otherwise(md_escape_leading(F.trim(text)))
    )


def txt_block(kind: Column, text: Column, level: Column, url: Column) -> Column:
    return (
        F.when(kind == "heading", F.concat(F.upper(F.trim(text)), F.lit("\n"), F.repeat(F.lit("-"), F.least(F.length(F.trim(text)), F.lit(72)))))
        .when(kind == "hr", F.repeat(F.lit("-"), F.lit(72)))
        .when(kind == "blockquote", F.concat(F.lit("  "), F.trim(text)))
        .when(kind == "image", F.concat(F.lit("[Image: "), F.coalesce(F.nullif(text, F.lit("")), F.lit("image")), F.lit("] "), url))
        .when(kind == "list_item", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), F.trim(text)))
        .otherwise(F.trim(text))
    )


def html_block(kind: Column, text: Column, level: Column, language: Column, url: Column) -> Column:
    t = escape_html(F.trim(text))
    tag = lambda name: F.concat(F.lit(f"<{name}>"), t, F.lit(f"</{name}>"))
    h = level.cast("string")
    return (
        F.when(kind == "heading", F.concat(F.lit("<h"), h, F.lit(">"), t, F.lit("</h"), h, F.lit(">")))
        .when(kind == "code", F.concat(F.lit('<pre><code class="language-'), F.coalesce(language, F.lit("")), F.lit('">'), escape_html(text), F.lit("</code></pre>")))
        .when(kind == "hr", "<hr>").when(kind == "blockquote", tag("blockquote"))
        .when(kind == "image", F.coalesce(F.concat(F.lit('<img src="'), escape_html(safe_url(url, True)), F.lit('" alt="'), t, F.lit('">')), t))
        .when(kind == "list_item", tag("li")).otherwise(tag("p"))
    )


def md_list_indent(markers: Column) -> Column:
    """Indent of a nested item: for each parent marker its width and one space."""
    return F.aggregate(markers, F.lit(""), lambda acc, m: F.concat(acc, F.repeat(F.lit(" "), F.length(m) + 1)))


def md_quote(lines: Column) -> Column:
    """``> `` before each line, blank ones ``>``; blank ones at the end go, and one unquoted is added."""
    filled = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i) != "")
    kept = F.slice(lines, F.lit(1), F.coalesce(F.array_max(filled), F.lit(0)))
    return F.concat(F.transform(kept, lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), F.array(F.lit("")))


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def md_artifact(title: Column, kind: Column, label: Column, language: Column, content: Column) -> Column:
    head = F.concat(F.lit("#### "), title, F.coalesce(F.concat(F.lit("\n*Type: "), label, F.lit("*")), F.lit("")), F.lit("\n\n"))
    svg = F.concat(
        F.lit('<img src="data:image/svg+xml,'), percent_encode(content), F.lit('" alt="'), title, F.lit('" style="max-width: 100%; height: auto;">\n\n<details>\n<summary>View SVG code</summary>\n\n'),
        md_code_block(content, F.lit("svg")), F.lit("\n</details>"),
    )
    return F.concat(head, F.when((kind == "image") & (language == "svg"), svg).when(kind == "document", content).otherwise(md_code_block(content, language)))


def txt_artifact(title: Column, label: Column, content: Column) -> Column:
    return F.concat(F.lit("--- "), title, F.lit(" ---"), F.coalesce(F.concat(F.lit("\nType: "), label), F.lit("")), F.lit("\n\n"), content)


def html_artifact(title: Column, kind: Column, label: Column, language: Column, content: Column) -> Column:
    body = F.when(kind == "document", F.concat(F.lit("<div>"), escape_html(content), F.lit("</div>"))).otherwise(
        F.concat(F.lit('<pre><code class="language-'), F.coalesce(language, F.lit("")), F.lit('">'), escape_html(content), F.lit("</code></pre>"))
    )
    note = F.coalesce(F.concat(F.lit("<p><em>"), escape_html(label), F.lit("</em></p>")), F.lit(""))
    return F.concat(F.lit("<section><h4>"), escape_html(title), F.lit("</h4>"), note, body, F.lit("</section>"))
