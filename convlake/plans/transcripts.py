"""Selected pairs as JSON, Markdown, text and HTML transcripts, and their sinks.

One row for each conversation.  Pairs are put in order inside the aggregate, and everything
before it keeps the partitioning by conversation, so that assembly costs one exchange.

Pairs: (conv_id, pair_index, question, answer, selected), and where they are known question_ts, answer_ts,
question_html, answer_html, answer_blocks (array of type, text, level, language, url), artifacts (array of
title, type, label, language, content) and searches (array of query, results of title, url, domain).
``about`` is what is known of each conversation: (conv_id, title, platform, model, url, exported); with it
documents have a head, days, times and the platform's name, without it they have none of these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.functions import markdown
from convlake.functions.naming import escape_html, iso_with_offset, safe_url
from convlake.functions.text import TXT_WIDTH, initcap_first, wrap_text
from convlake.operators.lines import metadata_header
from convlake.operators.pairing import date_bounds, date_range_label

Renderer = Callable[..., DataFrame]
RENDERERS: dict[str, Renderer] = {}
OPTIONAL = {
    "question_ts": "timestamp", "answer_ts": "timestamp", "question_html": "string", "answer_html": "string",
    "answer_blocks": "array<struct<type:string,text:string,level:int,language:string,url:string>>",
    "artifacts": "array<struct<title:string,type:string,label:string,language:string,content:string>>",
    "searches": "array<struct<query:string,results:array<struct<title:string,url:string,domain:string>>>>",
}
ABOUT = {"title": "string", "platform": "string", "model": "string", "url": "string", "exported": "timestamp"}


def register_renderer(name: str) -> Callable[[Renderer], Renderer]:
    """A new format is a function from pairs, and what is known about their conversations, to (conv_id, document)."""

    def add(f: Renderer) -> Renderer:
        RENDERERS[name] = f
        return f

    return add


def assemble(pairs: DataFrame, piece: Column, between: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pair_index", piece.alias("s"))))
    return pairs.where("selected").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), between).alias("body"))


def title() -> Column:
    return F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))


def prepared(pairs: DataFrame, about: DataFrame | None) -> DataFrame:
    """Selected pairs with all optional columns, the days to print before each half, and the assistant's name."""
    kept = pairs.where("selected")
    kept = kept.select("*", *(F.lit(None).cast(t).alias(n) for n, t in OPTIONAL.items() if n not in pairs.columns))
    if about is None:
        none = F.lit(None).cast("string")
        return kept.withColumns({"q_day": none, "a_day": none, "q_time": none, "a_time": none, "name": F.lit("Assistant")})
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    earlier = Window.partitionBy("conv_id").orderBy("pair_index").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("known", F.last(F.coalesce(day("answer_ts"), day("question_ts")), ignorenulls=True).over(earlier))
    changed = lambda before, now: F.when(before != now, now)
    named = about.select("conv_id", F.coalesce(platform_name(F.col("platform")), F.lit("Assistant")).alias("name"))
    return kept.withColumns({
        "q_day": changed(F.col("known"), day("question_ts")), "a_day": changed(F.coalesce(day("question_ts"), F.col("known")), day("answer_ts")),
        "q_time": F.date_format("question_ts", "HH:mm"), "a_time": F.date_format("answer_ts", "HH:mm"),
    }).drop("known").join(named, "conv_id", "left").withColumn("name", F.coalesce("name", F.lit("Assistant")))


def platform_name(platform: Column) -> Column:
    return F.when(platform == "chatgpt", "ChatGPT").otherwise(initcap_first(platform))


def headed(body: DataFrame, pairs: DataFrame, about: DataFrame | None) -> DataFrame:
    """``body`` with what is known about each conversation, and the days that it spans."""
    if about is None:
        return body.select("*", *(F.lit(None).cast(t).alias(n) for n, t in ABOUT.items() if n != "title"), F.lit(None).cast("string").alias("dates")).withColumn("title", title())
    bounds = date_bounds(pairs).select("conv_id", "first_ts", "last_ts", date_range_label(F.col("first_ts"), F.col("last_ts")).alias("dates"))
    return body.join(about.select("conv_id", *ABOUT), "conv_id", "left").join(bounds, "conv_id", "left").withColumn("title", F.coalesce("title", title()))


def maybe(*parts: Column | str) -> Column:
    """The parts put together; nothing if one is unknown."""
    return F.coalesce(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)), F.lit(""))


def each(items: Column, render: Callable[[Column], Column], before: str) -> Column:
    """Rendered items, each behind ``before``; nothing for null."""
    return F.coalesce(F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), render(x))), ""), F.lit(""))


def with_results(searches: Column) -> Column:
    return F.filter(searches, lambda s: F.size(s["results"]) > 0)


def filled(artifacts: Column) -> Column:
    return F.filter(artifacts, lambda a: F.coalesce(a["content"], F.lit("")) != "")


@register_renderer("markdown")
def md_transcripts(pairs: DataFrame, about: DataFrame | None = None) -> DataFrame:
    p = prepared(pairs, about)
    quoted = F.array_join(F.transform(F.split("question", "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")
    blocks = F.array_join(F.transform("answer_blocks", lambda b: markdown.md_block(b["type"], b["text"], b["level"], b["language"], b["url"])), "\n\n")
    line = lambda r: F.concat(F.lit("- ["), r["title"], F.lit("]("), r["url"], F.lit(")"), maybe(" — *", F.nullif(r["domain"], F.lit("")), "*"))
    sources = lambda s: F.concat(F.lit("### Sources — "), s["query"], F.lit("\n\n"), F.array_join(F.transform(s["results"], line), "\n"))
    piece = F.concat(
        maybe("**", F.col("q_day"), "**\n\n"), F.lit("**User**"), maybe(" · ", F.col("q_time")), F.lit("\n\n"), quoted, F.lit("\n\n"),
        maybe("**", F.col("a_day"), "**\n\n"), F.lit("**"), "name", F.lit("**"), maybe(" · ", F.col("a_time")), F.lit("\n\n"), F.coalesce(blocks, F.trim("answer")),
        each(filled(F.col("artifacts")), lambda a: markdown.md_artifact(a["title"], a["type"], a["label"], a["language"], a["content"]), "\n\n"),
        each(with_results(F.col("searches")), sources, "\n\n"),
    )
    out = headed(assemble(p, piece, "\n\n---\n\n"), p, about)
    exported = F.date_format("exported", "yyyy-MM-dd HH:mm:ss")
    head = F.concat(F.lit("# "), "title") if about is None else metadata_header(F.col("title"), platform_name(F.col("platform")), F.col("model"), F.col("dates"), F.col("url"), exported)
    return out.select("conv_id", F.concat(head, F.lit("\n\n---\n\n"), "body").alias("document"))


@register_renderer("text")
def txt_transcripts(pairs: DataFrame, about: DataFrame | None = None) -> DataFrame:
    p = prepared(pairs, about)

    def label(name: Column, time: str) -> Column:
        shown = F.concat(F.upper(name), maybe(" · ", F.col(time)))
        return F.concat(shown, F.lit("\n"), F.repeat(F.lit("-"), F.least(F.length(shown), F.lit(TXT_WIDTH))), F.lit("\n"))

    wrapped = lambda c, indent="": F.array_join(wrap_text(F.col(c), TXT_WIDTH, indent), "\n")
    blocks = F.array_join(F.transform("answer_blocks", lambda b: markdown.txt_block(b["type"], b["text"], b["level"], b["url"])), "\n\n")
    line = lambda r: F.concat(F.lit("- "), r["title"], maybe(" — ", F.nullif(r["domain"], F.lit(""))), F.lit("\n  "), r["url"])
    sources = lambda s: F.concat(F.lit("Sources — "), s["query"], F.lit("\n"), F.array_join(F.transform(s["results"], line), "\n"))
    piece = F.concat(
        maybe(F.col("q_day"), "\n\n"), label(F.lit("User"), "q_time"), wrapped("question", "  "), F.lit("\n\n"), maybe(F.col("a_day"), "\n\n"), label(F.col("name"), "a_time"),
        F.coalesce(blocks, wrapped("answer")), each(filled(F.col("artifacts")), lambda a: markdown.txt_artifact(a["title"], a["label"], a["content"]), "\n\n"),
        each(with_results(F.col("searches")), sources, "\n\n"),
    )
    rule = "-" * TXT_WIDTH
    out = headed(assemble(p, piece, f"\n\n{rule}\n\n"), p, about)
    known = F.filter(F.array(
        F.concat(F.lit("Platform: "), platform_name(F.col("platform"))), F.concat(F.lit("Model: "), "model"), F.concat(F.lit("Date range: "), "dates"),
        F.concat(F.lit("Exported: "), F.date_format("exported", "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("URL: "), "url"),
    ), lambda x: x.isNotNull())
    head = F.lit("") if about is None else F.concat(F.array_join(known, "\n"), F.lit(f"\n\n{rule}\n\n"))
    top = F.concat(F.array_join(wrap_text(F.col("title"), TXT_WIDTH, ""), "\n"), F.lit("\n"), F.repeat(F.lit("="), F.least(F.length("title"), F.lit(TXT_WIDTH))), F.lit("\n\n"))
    return out.select("conv_id", F.concat(top, head, "body").alias("document"))


@register_renderer("html")
def html_transcripts(pairs: DataFrame, about: DataFrame | None = None) -> DataFrame:
    p = prepared(pairs, about)
    day = lambda c: maybe('<div class="day">', F.col(c), "</div>")
    header = lambda name, time: F.lit("") if about is None else F.concat(F.lit('<p class="role">'), escape_html(name), maybe(" <span>", F.col(time), "</span>"), F.lit("</p>"))
    blocks = F.array_join(F.transform("answer_blocks", lambda b: markdown.html_block(b["type"], b["text"], b["level"], b["language"], b["url"])), "")
    link = lambda r: F.coalesce(F.concat(F.lit('<a href="'), escape_html(safe_url(r["url"])), F.lit('">'), escape_html(r["title"]), F.lit("</a>")), escape_html(r["title"]))
    item = lambda r: F.concat(F.lit("<li>"), link(r), maybe(" <small>", escape_html(F.nullif(r["domain"], F.lit(""))), "</small>"), F.lit("</li>"))
    sources = lambda s: F.concat(F.lit("<h4>Sources — "), escape_html(s["query"]), F.lit("</h4><ul>"), F.array_join(F.transform(s["results"], item), ""), F.lit("</ul>"))
    paragraph = lambda c: F.concat(F.lit("<p>"), escape_html(F.col(c)), F.lit("</p>"))
    piece = F.concat(
        day("q_day"), F.lit('<div class="user">'), header(F.lit("User"), "q_time"), paragraph("question"), F.lit("</div>"), day("a_day"), F.lit('<div class="assistant">'),
        header(F.col("name"), "a_time"), F.coalesce(blocks, paragraph("answer")),
        each(filled(F.col("artifacts")), lambda a: markdown.html_artifact(a["title"], a["type"], a["label"], a["language"], a["content"]), ""),
        each(with_results(F.col("searches")), sources, ""), F.lit("</div>"),
    )
    out = headed(assemble(p, piece, "<hr>"), p, about)
    row = lambda name, c: maybe(f"<dt>{name}</dt><dd>", escape_html(c), "</dd>")
    url = F.coalesce(F.concat(F.lit('<dt>URL</dt><dd><a href="'), escape_html(safe_url(F.col("url"))), F.lit('">'), escape_html(F.col("url")), F.lit("</a></dd>")), F.lit(""))
    head = F.lit("") if about is None else F.concat(
        F.lit("<dl>"), row("Platform", platform_name(F.col("platform"))), row("Model", F.col("model")), row("Date range", F.col("dates")),
        row("Exported", F.date_format("exported", "yyyy-MM-dd HH:mm:ss")), url, F.lit("</dl>"),
    )
    return out.select(
        "conv_id",
        F.concat(
            F.lit("<!doctype html><html><head><style>body{max-width:50em;margin:auto}</style></head><body><h1>"), escape_html(F.col("title")), F.lit("</h1>"), head, "body",
            F.lit("</body></html>"),
        ).alias("document"),
    )


def json_pair(pairs: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """(conv_id, pair_index, selected, pair): the pair object, keys in their declared order, absent ones dropped; empty contents stay."""
    full = pairs.select("*", *(F.lit(None).cast(t).alias(n) for n, t in OPTIONAL.items() if n not in pairs.columns))
    when = lambda c: F.lit(None).cast("string") if about is None else iso_with_offset(F.col(c))
    none = F.lit(None).cast("struct<artifacts:int>")
    known = F.when(F.col("artifacts").isNotNull() | F.col("searches").isNotNull(), F.struct("artifacts", F.col("searches").alias("webSearches")))

    def message(role: str, side: str, metadata: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"), F.coalesce(side, F.lit("")).alias("content"), F.nullif(f"{side}_html", F.lit("")).alias("htmlContent"),
            metadata.alias("metadata"), when(f"{side}_ts").alias("timestamp"),
        )

    pair = F.struct(F.col("pair_index").alias("index"), message("user", "question", none).alias("question"), message("assistant", "answer", known).alias("answer"))
    return full.select("conv_id", "pair_index", "selected", pair.alias("pair"))


@register_renderer("json")
def json_transcripts(pairs: DataFrame, about: DataFrame | None = None) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pair_index", F.col("pair"))), lambda x, y: x["pair_index"] - y["pair_index"])
    # selected pairs are numbered anew
    renumbered = F.transform(ordered, lambda x, i: F.struct(i.alias("index"), x["pair"]["question"].alias("question"), x["pair"]["answer"].alias("answer")))
    out = json_pair(pairs, about).where("selected").groupBy("conv_id").agg(renumbered.alias("pairs"))
    if about is None:
        document = F.struct(F.lit(2).alias("schemaVersion"), "pairs")
        return out.select("conv_id", F.to_json(document).alias("document"))
    full = pairs.where("selected").select("*", *(F.lit(None).cast(t).alias(n) for n, t in OPTIONAL.items() if n.endswith("_ts") and n not in pairs.columns))
    out = headed(out, full, about)
    span = F.when(F.col("first_ts").isNotNull(), F.struct(iso_with_offset(F.col("first_ts")).alias("from"), iso_with_offset(F.col("last_ts")).alias("to")))
    document = F.struct(F.lit(2).alias("schemaVersion"), "title", "platform", "model", "url", iso_with_offset(F.col("exported")).alias("exportedAt"), span.alias("dateRange"), "pairs")
    return out.select("conv_id", F.to_json(document).alias("document"))


def route_by_format(pairs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents by requested format, and rejects.  ``requests``: (conv_id, format, filename).

    Each format renders only the conversations that ask for it.
    """
    fine = F.col("format").isin(*RENDERERS) & (F.trim("filename") != "")
    reason = F.when(~F.col("format").isin(*RENDERERS), "unknown format").otherwise("blank filename")
    rejects = requests.where(~fine).select("conv_id", "format", reason.alias("reason"))
    done = None
    for name, render in RENDERERS.items():
        asked = requests.where(fine & (F.col("format") == name)).select("conv_id", "filename")
        out = render(pairs.join(asked.select("conv_id"), "conv_id", "left_semi")).join(asked, "conv_id").withColumn("format", F.lit(name))
        done = out if done is None else done.unionByName(out)
    return done, rejects


def transcript_places(documents: DataFrame, size: int = 8 << 20, buckets: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Add (bucket, file, start, length): where a document stands in files of about ``size`` bytes.

    A document is as long as its bytes and the line feed behind it.  Files are numbered within ``buckets`` of conversations
    (and the columns ``by``), so that places are counted in parts; a longer document has a file of its own.
    """
    own = (*by, "bucket")
    sized = documents.withColumn("bucket", F.pmod("conv_id", F.lit(buckets)).cast("int")).withColumn("length", (F.octet_length("document") + 1).cast("long"))
    w = Window.partitionBy(*own).orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("length").over(w), F.lit(0)))
    placed = placed.withColumn("part", F.expr(f"before div {size}"))
    first = F.min("before").over(Window.partitionBy(*own, "part"))
    return placed.withColumn("start", F.col("before") - first).withColumn("file", F.concat_ws("-", "bucket", "part")).drop("before", "part")


def write_transcripts(documents: DataFrame, path: str, size: int = 8 << 20, by: tuple[str, ...] = ()) -> None:
    """Documents packed into text files of about ``size`` bytes, and a manifest (conv_id, ``by``, file, start, length) beside them.

    Documents keep all their characters; ``read_transcripts`` finds each by its place.  Equal conversations in ``by`` groups are
    told apart by these columns.
    """
    total = documents.agg(F.sum(F.octet_length("document").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // (size * 16)))  # some files to a bucket
    placed = transcript_places(documents, size, buckets, by).select("conv_id", *by, "file", "start", "length", "document")
    dealt = placed.repartition(*by, "file").sortWithinPartitions(*by, "file", "start")
    dealt.select("document", *by, "file").write.mode("overwrite").partitionBy(*by, "file").option("lineSep", "\n").text(f"{path}/documents")
    placed.drop("document").write.mode("overwrite").parquet(f"{path}/manifest")


def read_transcripts(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, ``by``, document) of what ``write_transcripts`` wrote, each cut from its file by the manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    held = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1)).alias(name)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(f"{path}/documents").select(*map(held, (*by, "file")), "content")
    text = F.decode(F.expr("substring(content, cast(start + 1 AS int), cast(length - 1 AS int))"), "UTF-8")
    return manifest.join(files.hint("shuffle_hash"), [*by, "file"]).select("conv_id", *by, text.alias("document"))
