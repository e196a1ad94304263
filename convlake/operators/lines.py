"""Lines, table cells, headings and lists of sources: windows and aggregates over text rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.naming import escape_html
from convlake.functions.text import wrap_text
from convlake.operators.grid import placed
from convlake.operators.html import coalesce_runs  # noqa: F401  runs of pages and of code alike
from convlake.operators.reports import is_stats
from convlake.session import ship

GRID_CELL = ("row_idx", "ordinal", "text", "rowspan", "colspan")

NUMBER = r"^-?[\d,]+(\.\d+)?%?$"


def to_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "text"))


def drop_digit_runs(lines: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Without runs of ``least`` and more neighbouring lines of a single digit."""
    w = Window.partitionBy(key).orderBy("line")
    digit = F.trim("text").rlike(r"^\d$")
    marked = lines.withColumn("__d", digit).withColumn("__g", F.col("line") - F.sum(F.col("__d").cast("int")).over(w))
    # in a run of digits the line number less the count of digits so far stays the same
    run = F.count("*").over(Window.partitionBy(key, "__d", "__g"))
    return marked.withColumn("__n", run).where(~F.col("__d") | (F.col("__n") < least)).drop("__d", "__g", "__n")


def drop_stats_lines(lines: DataFrame) -> DataFrame:
    """Without lines of nothing but a search's figures; bare numbers count as such. Blank lines stay."""
    return lines.where(~is_stats(F.col("text")))


def dedupe_adjacent_titles(blocks: DataFrame, key: str) -> DataFrame:
    """Without a block whose next sibling is a heading of the same text."""
    w = Window.partitionBy(key).orderBy("ordinal")
    same = (F.lead("type").over(w) == "heading") & (F.trim(F.lead("text").over(w)) == F.trim("text")) & ~F.col("type").isin("cell", "list_item")
    return blocks.withColumn("__same", F.coalesce(same, F.lit(False))).where("NOT __same").drop("__same")


def heading_levels(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.where("type = 'heading'").select(key, "level").distinct()


def normalize_headings(blocks: DataFrame, key: str) -> DataFrame:
    """``doc_level``: source levels of a conversation ranked from 2, gaps closed, 6 at most."""
    w = Window.partitionBy(key).orderBy("level")
    ranks = heading_levels(blocks, key).withColumn("doc_level", F.least(F.dense_rank().over(w) + 1, F.lit(6)))
    return blocks.join(ranks.hint("merge"), [key, "level"], "left")


def merge_header_rows(cells: DataFrame, keys: list[str] = ["table_id"]) -> DataFrame:  # noqa: B006
    """Several header rows as one: the parts of a column that aren't empty, a space apart."""
    part = F.when(F.trim("text") != "", F.struct("row_idx", F.trim("text").alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), " ")
    return cells.where("is_header").groupBy(*keys, "col_idx").agg(joined.alias("text"))


def pad_ragged_rows(cells: DataFrame, keys: list[str] = ["table_id"]) -> DataFrame:  # noqa: B006
    """Body rows as wide as the header; wider rows stay.

    One exchange by table: a row's missing places are added to the list of its own cells.
    """
    rows = cells.groupBy(*keys, "is_header", "row_idx").agg(F.collect_list(F.struct("col_idx", "text")).alias("c"), (F.max("col_idx") + 1).alias("own"))
    width = F.max(F.when(F.col("is_header"), F.col("own"))).over(Window.partitionBy(*keys))
    body = rows.withColumn("width", F.greatest(F.coalesce(width, F.lit(0)), "own")).where("NOT is_header")
    held = F.transform("c", lambda x: x["col_idx"])
    missing = F.array_except(F.sequence(F.lit(0), F.col("width") - 1), held)
    blank = F.transform(missing, lambda i: F.struct(i.alias("col_idx"), F.lit("").alias("text")))
    return body.select(*keys, "row_idx", F.explode(F.concat("c", blank)).alias("x")).select(*keys, "row_idx", "x.col_idx", "x.text")


def numeric_columns(cells: DataFrame) -> DataFrame:
    filled = F.trim("text") != ""
    return cells.where("NOT is_header").groupBy("table_id", "col_idx").agg(
        (F.coalesce(F.bool_and(F.when(filled, F.trim("text").rlike(NUMBER))), F.lit(False))).alias("numeric")
    )


def column_widths(cells: DataFrame, least: int = 3) -> DataFrame:
    return cells.groupBy("table_id", "col_idx").agg(F.greatest(F.max(F.length("text")), F.lit(least)).alias("width"))


def txt_table(cells: DataFrame) -> DataFrame:
    """(table_id, text): a boxed table, a double rule below the header."""
    padded = cells.join(column_widths(cells).hint("merge"), ["table_id", "col_idx"]).withColumn("cell", F.rpad("text", F.col("width"), F.lit(" ")))
    rows = padded.groupBy("table_id", "is_header", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "cell", "width"))).alias("c")
    )
    rule = lambda mark: F.concat(F.lit("+"), F.array_join(F.transform("c", lambda x: F.repeat(F.lit(mark), x["width"] + 2)), "+"), F.lit("+"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["cell"]), " | "), F.lit(" |"))
    drawn = rows.select(
        "table_id", (~F.col("is_header")).alias("body"), "row_idx",
        F.when(F.col("is_header"), F.concat(rule("-"), F.lit("\n"), line, F.lit("\n"), rule("="))).otherwise(F.concat(line, F.lit("\n"), rule("-"))).alias("s"),
    )
    return drawn.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("body", "row_idx", "s"))), lambda x: x["s"]), "\n").alias("text"))


def table_grid(cells: DataFrame, keys: list[str] = ["table_id"]) -> DataFrame:  # noqa: B006
    """Cells (keys, is_header, row_idx, ordinal, text, rowspan, colspan) at their real places.

    Header and body are laid out on their own; each is one row of the exchange, many of which are laid out in one batch.
    Spans come from ``parse_span``, 1 to 1000.
    """
    ship(cells.sparkSession)
    own = [*keys, "is_header"]
    halves = cells.groupBy(*own).agg(F.collect_list(F.struct(*GRID_CELL)).alias("c"))
    types = ", ".join([*(f"`{k}` {t}" for k, t in halves.dtypes if k in own), "places array<struct<row_idx:int,col_idx:int,text:string>>"])
    kind = pa.list_(pa.struct([("row_idx", pa.int32()), ("col_idx", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                some = batch.slice(at, 50)
                found = [placed(tuple(x[k] for k in GRID_CELL) for x in c) for c in some.column("c").to_pylist()]
                places = pa.array([[dict(zip(("row_idx", "col_idx", "text"), p, strict=True)) for p in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in own), places], [*own, "places"])

    laid = halves.mapInArrow(run, types)
    return laid.select(*own, F.explode("places").alias("x")).select(*own, "x.row_idx", "x.col_idx", "x.text")


def sources_section(results: DataFrame) -> DataFrame:
    """(conv_id, text): ``Sources — query`` and a line for each result; searches without results are skipped.

    ``results``: (conv_id, search, query, pos, title, url, domain).
    """
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")"), F.coalesce(F.concat(F.lit(" — *"), F.nullif("domain", F.lit("")), F.lit("*")), F.lit("")))
    one = results.where("url IS NOT NULL").groupBy("conv_id", "search", "query").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("s")))).alias("l"))
    text = F.concat(F.lit("### Sources — "), "query", F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["s"]), "\n"))
    return one.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("search", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def metadata_header(title: Column, platform: Column, model: Column, dates: Column, url: Column, exported: Column | None = None) -> Column:
    """Lines of a document's head; what isn't known is left out."""
    line = lambda name, v: F.concat(F.lit(f"| {name} | "), v, F.lit(" |"))
    lines = F.filter(
        F.array(F.concat(F.lit("# "), title), F.lit(""), F.lit("| **Field** | **Value** |"), F.lit("|---|---|"), line("Platform", platform), line("Model", model), line("Date range", dates),
            line("Exported", F.lit(None).cast("string") if exported is None else exported), line("URL", url)),
        lambda x: x.isNotNull(),
    )
    return F.array_join(lines, "\n")


def merge_media(images: Column, media: Column) -> Column:
    """Images first, then media; items without a source are dropped.  Both: arrays of (kind, src)."""
    return F.filter(F.concat(images, media), lambda x: F.coalesce(x["src"], F.lit("")) != "")


def marker_blocks(searches: Column, research: Column, artifacts: Column) -> Column:
    """Texts that stand for what has no content: (query, n) searches, research figures, (label, title, content) artifacts."""
    s = F.transform(F.filter(searches, lambda x: x["n"] == 0), lambda x: F.concat(F.lit("[Web Search: "), x["query"], F.lit("]")))
    r = F.concat(F.lit("[Deep Research: "), research["duration"], F.lit(", "), research["sources"].cast("string"), F.lit(" sources, "), research["searches"].cast("string"), F.lit(" searches]"))
    a = F.transform(F.filter(artifacts, lambda x: F.coalesce(x["content"], F.lit("")) == ""), lambda x: F.concat(F.lit("["), x["label"], F.lit(": "), x["title"], F.lit("]")))
    return F.concat(s, F.filter(F.array(r), lambda x: x.isNotNull()), a)


def message_from_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ordinal, kind, text) as one message: searches first, then texts, then artifacts; null if all are empty."""
    rank = F.when(F.col("kind") == "search", 0).when(F.col("kind") == "artifact", 2).otherwise(1)
    shown = F.when(F.col("kind") == "search", F.concat(F.lit("[Web Search: "), "text", F.lit("]"))).when(
        F.col("kind") == "artifact", F.concat(F.lit("[Artifact: "), "text", F.lit("]"))
    ).otherwise(F.trim("text"))
    kept = parts.where("trim(text) <> ''").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "ordinal", shown.alias("t")))).alias("p"))
    joined = kept.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("content"))
    return parts.select(*keys).distinct().join(joined.hint("merge"), keys, "left")


def list_marks(items: DataFrame, key: str) -> DataFrame:
    """Items with ``number``: their place among those of their list; ``items``: (key, pos, depth, ordered, text).

    A list goes on until an item of a smaller depth comes.
    """
    w = Window.partitionBy(key).orderBy("pos")
    before = F.lag("depth").over(w)
    # where a list of a depth begins: below an item of a smaller depth
    begins = F.when(before.isNull() | (before < F.col("depth")), F.col("pos"))
    marked = items.withColumn("__begins", begins)
    same = Window.partitionBy(key, "depth").orderBy("pos")
    marked = marked.withColumn("__list", F.last("__begins", ignorenulls=True).over(same))
    return marked.withColumn("number", F.row_number().over(Window.partitionBy(key, "depth", "__list").orderBy("pos"))).drop("__begins", "__list")


def txt_list(items: DataFrame, key: str, width: int = 72) -> DataFrame:
    """(key, text): items two spaces in for each depth, numbered in ordered lists, wrapped with a hanging indent."""
    lead = F.repeat(F.lit("  "), F.col("depth"))
    mark = F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- ")
    body = F.array_join(wrap_text(F.col("text"), width - 2), "\n")
    hanging = F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), lead, F.repeat(F.lit(" "), F.length(mark))))
    line = F.concat(lead, mark, hanging)
    return list_marks(items, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


def html_list(items: DataFrame, key: str) -> DataFrame:
    """(key, html): nested lists, opened and closed where the depth changes between neighbours.

    All lists of a depth in one ``key`` are of the kind that ``ordered`` says for their items; depths rise by one.
    """
    gathered = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "depth", "ordered", "text"))).alias("l"))
    deepest = F.array_max(F.transform("l", lambda x: x["depth"])).cast("int")
    none = F.transform(F.sequence(F.lit(0), deepest), lambda _: F.lit("ul"))
    start = F.struct(none.alias("tags"), F.lit(-1).alias("before"), F.array().cast("array<string>").alias("out"))
    # ``tags``: of each depth, the kind of its last list; so an item costs no more than the lists that it ends
    closing = lambda tags, top, low: F.array_join(
        F.transform(F.when(top >= low, F.reverse(F.sequence(low, top))), lambda k: F.concat(F.lit("</li></"), F.get(tags, k), F.lit(">"))), ""
    )

    def step(acc: Column, x: Column) -> Column:
        depth, before, tag = x["depth"].cast("int"), acc["before"], F.when(x["ordered"], "ol").otherwise("ul")
        ended = (
            F.when(depth > before, F.concat(F.lit("<"), tag, F.lit(">"))).when(depth == before, "</li>")
            .otherwise(F.concat(closing(acc["tags"], before, depth + 1), F.lit("</li>")))
        )
        tags = F.transform(acc["tags"], lambda t, k: F.when(k == depth, tag).otherwise(t))
        return F.struct(tags.alias("tags"), depth.alias("before"), F.array_append(acc["out"], F.concat(ended, F.lit("<li>"), escape_html(x["text"]))).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), closing(acc["tags"], acc["before"], F.lit(0)))
    return gathered.select(key, F.aggregate("l", start, step, end).alias("html"))
