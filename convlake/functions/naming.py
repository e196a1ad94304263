"""File names, URLs, dates, HTML escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STEM_BYTES = 245  # 255 of a file system, less what the extension may need


def sanitize_filename(c: Column, most: int = MAX_STEM_BYTES) -> Column:
    """Without forbidden characters, white space as single hyphens, ``most`` UTF-8 bytes at most."""
    s = F.regexp_replace(c, r'[/\\:*?"<>|]', "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    # the longest prefix that fits: bytes are added up over the characters
    fit = F.aggregate(
        F.split(s, ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda acc, x: F.struct(
            (acc["bytes"] + F.octet_length(x)).alias("bytes"),
            F.when(acc["bytes"] + F.octet_length(x) <= most, acc["chars"] + F.length(x)).otherwise(acc["chars"]).alias("chars"),
        ),
        lambda acc: acc["chars"],
    )
    return F.when(F.octet_length(s) <= most, s).otherwise(F.regexp_replace(F.substring(s, F.lit(1), fit), "-+$", ""))


def filename_from_template(template: Column, variables: dict[str, Column], model: Column) -> Column:
    """``{name}`` filled in literally; without a model its underscore goes too; then sanitised."""
    out = template
    for name, value in variables.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    bare = out
    for mark in ("_{model}", "{model}_", "{model}"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    known = F.coalesce(model, F.lit("")) != ""
    out = F.when(known, F.replace(out, F.lit("{model}"), F.coalesce(model, F.lit("")))).otherwise(bare)
    out = F.regexp_replace(F.regexp_replace(out, "^_+|_+$", ""), "_+", "_")
    return sanitize_filename(out)


def template_from_pieces(pieces: Column) -> Column:
    """Pieces (type, text) joined by ``_``; a literal loses its braces."""
    one = lambda p: F.when(
        p["type"] == "literal", F.regexp_replace(F.coalesce(p["text"], F.lit("")), "[{}]", "")
    ).otherwise(F.concat(F.lit("{"), p["type"], F.lit("}")))
    return F.array_join(F.transform(pieces, one), "_")


def filename_from_pieces(pieces: Column, variables: dict[str, Column], model: Column) -> Column:
    """By pieces; what comes out empty is named by title and date."""
    stem = filename_from_template(template_from_pieces(pieces), variables, model)
    return F.coalesce(F.nullif(stem, F.lit("")), filename_from_template(F.lit("{title}_{date}"), variables, model))


def add_extension(stem: Column, extension: Column) -> Column:
    """The last extension replaced; an empty stem gives ``.ext``."""
    bare = F.regexp_replace(stem, r"\.[^.]*$", "")
    return F.concat(bare, F.lit("."), F.regexp_replace(extension, r"^\.", ""))


def filename_dates(ts: Column) -> dict[str, Column]:
    d, t = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH-mm")
    return {"date": d, "time": t, "datetime": F.concat(d, F.lit("_"), t)}


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def time_suffix(ts: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" ("), F.date_format(ts, "HH:mm"), F.lit(")")), F.lit(""))


def iso_with_offset(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def parse_api_time(c: Column) -> Column:
    """A timestamp, or null for what isn't one."""
    return F.try_to_timestamp(c)


def escape_html(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def safe_url(c: Column, images: bool = False) -> Column:
    """The url without tab, CR and LF if its scheme is safe or it has none; null otherwise."""
    u = F.nullif(F.translate(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), "\t\n\r", ""), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    fine = scheme.isin("", "http", "https", "mailto")
    if images:
        fine = fine | u.rlike(r"(?i)^data:image/(?:png|jpe?g|gif|webp|svg\+xml);base64,")
    return F.when(fine, u)


def domain(url: Column) -> Column:
    """Host name without ``www.``."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def conversation_key(url: Column) -> Column:
    """The id in ``/c/<id>`` or ``/chat/<id>``; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"/(?:c|chat)/([A-Za-z0-9-]+)", 1), F.lit(""))
