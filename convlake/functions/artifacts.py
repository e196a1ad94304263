"""Artifacts: types, languages, research figures, media labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.functions.text import format_duration, initcap_first

#: Format token, type, language.
FORMATS = (
    ("md", "document", "markdown"), ("markdown", "document", "markdown"), ("txt", "document", "text"), ("svg", "image", "svg"),
    ("mermaid", "diagram", "mermaid"), ("jsx", "react", "react"), ("tsx", "react", "react"),
)
#: Words of a visible label (Spanish, English), type, language.
LABELS = (
    ("Imagen", "Image", "image", "svg"), ("interactivo", "interactive", "react", "react"), ("Documento", "Document", "document", "markdown"),
    ("Diagrama", "Diagram", "diagram", "mermaid"), ("Código", "Code", "code", None),
)
#: The language of a code fence for a type that came without one.
LANGUAGES = (("image", "svg"), ("react", "tsx"), ("document", "markdown"), ("diagram", "mermaid"), ("code", "javascript"))


def _pair(kind: str, language: str | None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(language).cast("string").alias("language"))


def artifact_type(label: Column, token: Column) -> Column:
    """(type, language) by format token, else by the words of the label."""
    out = None
    for t, kind, language in FORMATS:
        out = F.when(token == t, _pair(kind, language)) if out is None else out.when(token == t, _pair(kind, language))
    out = out.when(F.coalesce(token, F.lit("")) != "", F.struct(F.lit("code").alias("type"), token.alias("language")))
    for es, en, kind, language in LABELS:
        out = out.when(label.contains(es) | label.contains(en), _pair(kind, language))
    return out.otherwise(_pair("unknown", None))


def format_token(label: Column) -> Column:
    """What stands after the last ``·`` of a label, in lower case; empty if there is none."""
    return F.when(label.contains("·"), F.lower(F.trim(F.element_at(F.split(label, "·"), -1)))).otherwise(F.lit(""))


def api_artifact_type(mime: Column, language: Column) -> Column:
    """(type, language) of an artifact block of the API."""
    react = (F.coalesce(language, F.lit("")) == "react") | mime.contains("vnd.ant.react")
    return (
        F.when(mime.contains("svg"), _pair("image", "svg"))
        .when(mime.contains("html") & react, _pair("react", "tsx"))
        .when(mime.contains("html"), _pair("react", "html"))
        .when(mime.contains("vnd.ant.react"), _pair("react", "tsx"))
        .when(mime.contains("markdown"), _pair("document", "markdown"))
        .when(language == "mermaid", _pair("diagram", "mermaid"))
        .otherwise(F.struct(F.lit("code").alias("type"), language.alias("language")))
    )


def is_artifact_block(block: Column) -> Column:
    """An artifacts call with content."""
    return F.coalesce((block["type"] == "tool_use") & (block["name"] == "artifacts") & block["input"]["content"].isNotNull(), F.lit(False))


def infer_code_language(kind: Column) -> Column:
    out = F.lit("")
    for k, language in LANGUAGES:
        out = F.when(kind == k, language).otherwise(out)
    return out


def research_stats(c: Column) -> Column:
    """(duration, sources, searches); null if the text has none of them."""
    duration = F.regexp_extract(c, r"(\d+[msh])", 1)
    sources = F.regexp_extract(c, r"(?i)(\d+)\s*(?:fuentes|sources)", 1)
    searches = F.regexp_extract(c, r"(?i)(\d+)\s*(?:búsquedas|searches)", 1)
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    return F.when(
        (duration != "") | (sources != "") | (searches != ""),
        F.struct(duration.alias("duration"), number(sources).alias("sources"), number(searches).alias("searches")),
    )


def media_label(kind: Column, alt: Column, seconds: Column) -> Column:
    """``Kind[: alt][ (duration)]``."""
    return F.concat(
        initcap_first(kind), F.coalesce(F.concat(F.lit(": "), F.nullif(alt, F.lit(""))), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), format_duration(seconds), F.lit(")")), F.lit("")),
    )


def is_diagram(width: Column, height: Column, view_box: Column, label: Column, least: int = 80) -> Column:
    """By size (attributes, else the view box), else by what the label says."""
    number = lambda c: F.regexp_extract(c, r"^\s*([0-9.]+)", 1).try_cast("double")
    box = F.split(F.trim(view_box), r"[\s,]+")
    full = F.size(box) == 4
    w = F.coalesce(number(width), F.when(full, F.try_element_at(box, F.lit(3)).try_cast("double")))
    h = F.coalesce(number(height), F.when(full, F.try_element_at(box, F.lit(4)).try_cast("double")))
    named = F.lower(F.coalesce(label, F.lit(""))).rlike("diagram|chart|graph|timeline|mermaid")
    return F.when(w.isNotNull() & h.isNotNull(), (w >= least) & (h >= least)).otherwise(named)


def widget_fallback(html: Column, text: Column, title: Column) -> Column:
    """Relayed html, else relayed text, else a marker with the widget's name; null if it has none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = blank(F.initcap(F.trim(F.translate(F.regexp_replace(title, "^internal://", ""), "-_", "  "))))
    marker = F.concat(F.lit("["), name, F.lit(": rendered in an embedded viewer that the page does not expose]"))
    return F.coalesce(blank(html), blank(text), marker)
