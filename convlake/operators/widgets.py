"""Search widgets, canvases, generated pictures and artifacts inside pages, and messages as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.artifacts import artifact_type, format_token
from convlake.functions.text import initcap_first
from convlake.operators.capture import RULES
from convlake.operators.html import element, exact_text, filtered, first_below, inner, is_text, prose, rows
from convlake.operators.selectors import attr, matcher


def said(x: Column, selector: str) -> Column:
    """The text of the first match below ``x``; null if there is none or it is blank."""
    return F.nullif(prose(first_below(x, selector)), F.lit(""))


CLAUDE, CHATGPT = RULES["claude"], RULES["chatgpt"]
#: What holds the results of a search, and a result's title and domain.
RESULTS, RESULT_TITLE, RESULT_DOMAIN = "div.flex.flex-nowrap.p-2.pt-0.flex-col", "p.relative.text-\\[0\\.875rem\\]", "p.relative.bottom-\\[1px\\].text-\\[0\\.75rem\\].text-text-500"


def extract_search_widgets(
    trees: DataFrame, widget: str = CLAUDE["search"], button: str = CLAUDE["search_button"], query: str = CLAUDE["search_query"], count: str = CLAUDE["search_count"],
    results: str = RESULTS, title: str = RESULT_TITLE, domain_of: str = RESULT_DOMAIN,
) -> DataFrame:
    """(page_id, widget, query, result_count, results): widgets with a button and a query; a result's title and domain are those of its own nodes."""
    def result(x: Column) -> Column:
        return F.struct(
            x["node_id"].alias("node_id"), attr(x, "href").alias("href"), F.coalesce(said(x, title), F.lit("")).alias("title"), said(x, domain_of).alias("domain")
        )

    def found(x: Column) -> Column:
        anchors = F.filter(inner(first_below(x, results)), lambda n: element(n, "a") & (attr(n, "href") != ""))
        return F.struct(
            x["node_id"].alias("widget"), F.when(first_below(x, button).isNotNull(), said(x, query)).alias("query"),
            F.nullif(F.regexp_extract(said(x, count), r"(\d+)", 1), F.lit("")).cast("int").alias("result_count"),
            F.coalesce(F.transform(anchors, result), F.array()).alias("results"),
        )

    return rows(trees, F.transform(filtered(matcher(widget)), found)).where("query IS NOT NULL")


#: Where a canvas stands, and its text.
CANVAS, CANVAS_TEXT = CHATGPT["canvas"], CHATGPT["canvas_text"]


def extract_canvas(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, content): canvases with text, under their mark."""
    found = F.transform(filtered(matcher(CANVAS)), lambda x: F.struct(x["node_id"].alias("node_id"), said(x, CANVAS_TEXT).alias("content")))
    return rows(trees, found).where("content IS NOT NULL").withColumn("content", F.concat(F.lit("[Canvas Content]\n"), "content"))


def math_markers(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, marker) of the formulas that ``collapse_math`` put into the text."""
    found = filtered(lambda x: is_text(x) & F.array_contains(x["marks"], "math"))
    return rows(trees, F.transform(found, lambda x: F.struct(x["node_id"].alias("node_id"), x["text"].alias("marker"))))


#: A box of code, the two places of its language, and those of its text.
BOX, BOX_LABEL, BOX_STICKY = "pre.overflow-visible\\!", "div.h-9", ".sticky"
BOX_CODE, BOX_VIEWER = 'code.whitespace-pre\\!, code[class*="language-"]', ".cm-content, #code-block-viewer"


def extract_code_artifacts(trees: DataFrame, box: str = BOX, label: str = BOX_LABEL, sticky: str = BOX_STICKY, code: str = BOX_CODE, viewer: str = BOX_VIEWER) -> DataFrame:
    """(page_id, node_id, title, type, language, content): boxes of code that isn't blank.

    The language is that of the box's label, else of its sticky header without buttons, else ``code``; a
    picture with a source makes it an image.
    """
    def language_of(x: Column) -> Column:
        bar = first_below(x, sticky)
        buttons = F.filter(inner(bar), lambda n: element(n, "button"))
        clear = prose(bar, lambda n: ~F.exists(buttons, lambda b: (b["node_id"] <= n["node_id"]) & (n["node_id"] <= b["end_id"])))
        return F.lower(F.coalesce(said(x, label), F.nullif(clear, F.lit("")), F.lit("code")))

    def artifact(x: Column) -> Column:
        body, language = F.coalesce(first_below(x, code), first_below(first_below(x, viewer), "code")), language_of(x)
        picture = F.exists(inner(body), lambda n: element(n, "img") & (attr(n, "src") != ""))
        return F.struct(
            x["node_id"].alias("node_id"), initcap_first(language).alias("title"), F.when((language == "svg") | F.coalesce(picture, F.lit(False)), "image").otherwise("code").alias("type"),
            language.alias("language"), F.trim(exact_text(body)).alias("content"),
        )

    return rows(trees, F.transform(filtered(matcher(box)), artifact)).where("content <> ''")


#: An artifact's cell, its title and its label.
CELL, CELL_TITLE, CELL_LABEL = CLAUDE["artifact"], CLAUDE["artifact_title"], CLAUDE["artifact_label"]


def extract_artifact_cells(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, title, label, format, type, language) of the cells that announce artifacts."""
    def cell(x: Column) -> Column:
        label = F.coalesce(said(x, CELL_LABEL), F.lit(""))
        kind = artifact_type(label, format_token(label))
        return F.struct(
            x["node_id"].alias("node_id"), F.coalesce(said(x, CELL_TITLE), F.lit("Untitled Artifact")).alias("title"), label.alias("label"),
            format_token(label).alias("format"), kind["type"].alias("type"), kind["language"].alias("language"),
        )

    return rows(trees, F.transform(filtered(matcher(CELL)), cell))


#: A generated picture, and the header that names it.
GENERATED, GENERATED_HEADER = CHATGPT["picture"], CHATGPT["picture_title"]


def extract_generated_image(trees: DataFrame) -> DataFrame:
    """(page_id, node_id, content, src, alt): ``[Image: title]`` by what follows the header's ``•``, else ``[Generated Image]``."""
    def picture(x: Column) -> Column:
        name = F.nullif(F.trim(F.try_element_at(F.split(said(x, GENERATED_HEADER), "•"), F.lit(2))), F.lit(""))
        image = first_below(x, "img")
        return F.struct(
            x["node_id"].alias("node_id"), F.coalesce(F.concat(F.lit("[Image: "), name, F.lit("]")), F.lit("[Generated Image]")).alias("content"),
            attr(image, "src").alias("src"), F.coalesce(F.nullif(attr(image, "alt"), F.lit("")), F.lit("Generated image")).alias("alt"),
        )

    return rows(trees, F.transform(filtered(matcher(GENERATED)), picture))


def structured_messages(messages: DataFrame, blocks: DataFrame, markers: DataFrame) -> DataFrame:
    """(message_id, part, ordinal, type, text): blocks where html was there, else one paragraph; markers behind.

    ``messages``: (message_id, content); ``blocks``: (message_id, ordinal, type, text) of those
    with html; ``markers``: (message_id, ordinal, text).
    """
    plain = messages.join(blocks.select("message_id").distinct().hint("merge"), "message_id", "left_anti").where("trim(content) <> ''").select(
        "message_id", F.lit(0).alias("part"), F.lit(0).alias("ordinal"), F.lit("paragraph").alias("type"), F.trim("content").alias("text")
    )
    own = blocks.select("message_id", F.lit(0).alias("part"), "ordinal", "type", "text")
    marks = markers.select("message_id", F.lit(1).alias("part"), "ordinal", F.lit("paragraph").alias("type"), "text")
    return plain.unionByName(own).unionByName(marks)
