"""Captured pairs against the provider's own dump of the conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.artifacts import api_artifact_type, is_artifact_block
from convlake.functions.naming import parse_api_time


def api_message_text(message: Column) -> Column:
    """The message's text if there is one, else its text blocks, a blank line apart."""
    blocks = F.filter(message["content"], lambda b: b["type"] == "text")
    joined = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    return F.coalesce(F.nullif(message["text"], F.lit("")), joined, F.lit(""))


def numbered(messages: DataFrame, sender: str) -> DataFrame:
    """The n-th message of one side: (conv_id, n, uuid, body, created_at)."""
    w = Window.partitionBy("conv_id").orderBy("message_pos")
    return messages.where(F.col("message.sender") == sender).select(
        "conv_id", (F.row_number().over(w) - 1).alias("n"), F.col("message.uuid").alias("uuid"),
        api_message_text(F.col("message")).alias("body"), F.col("message.created_at").alias("created_at"),
    )


def api_pairs(messages: DataFrame) -> DataFrame:
    """Pairs from the dump alone: n-th human with n-th assistant message, named by the latter."""
    q, a = numbered(messages, "human"), numbered(messages, "assistant")
    return q.alias("q").join(a.alias("a").hint("merge"), ["conv_id", "n"]).select(
        "conv_id", F.col("n").alias("pair_index"), F.col("a.uuid").alias("pair_id"), F.col("q.body").alias("question"), F.col("a.body").alias("answer")
    )


def sides(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, humans, assistants, pairs) of every conversation that has a dump."""
    m = messages.groupBy("conv_id").agg(
        F.count_if(F.col("message.sender") == "human").alias("humans"), F.count_if(F.col("message.sender") == "assistant").alias("assistants")
    )
    p = pairs.groupBy("conv_id").agg(F.count("*").alias("pairs"))
    return m.join(p.hint("merge"), "conv_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def positional_match(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """Pairs with the uuids and times of the messages at their place, where all three counts agree.

    Pairs and messages meet in one shuffle by conversation; pairs without a conv_id match nothing.
    """
    m = messages.where(F.col("message.sender").isin("human", "assistant")).select(
        "conv_id", F.col("message.sender").alias("side"), F.col("message_pos").cast("long").alias("place"),
        F.struct(F.col("message.uuid").alias("uuid"), F.col("message.created_at").alias("time")).alias("m"),
    )
    p = pairs.where("conv_id IS NOT NULL").select("conv_id", F.lit("pair").alias("side"), F.col("pair_index").cast("long").alias("place"), F.struct("*").alias("pair"))
    all_of, own = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "side").orderBy("place")
    rows = m.unionByName(p, allowMissingColumns=True)
    rows = rows.withColumns({f"{side}s": F.count_if(F.col("side") == side).over(all_of) for side in ("human", "assistant", "pair")})
    at = F.when(F.col("side") == "pair", F.col("place")).otherwise(F.row_number().over(own) - 1)
    beside = Window.partitionBy("conv_id", "at")
    rows = rows.where("humans = pairs AND assistants = pairs").withColumn("at", at)
    rows = rows.withColumns({name: F.max(F.when(F.col("side") == side, F.col("m"))).over(beside) for side, name in (("human", "q"), ("assistant", "a"))})
    others = [F.col("pair")[k].alias(k) for k in pairs.columns if k not in ("conv_id", "pair_index")]
    told = [F.col(half)[k].alias(f"{name}_{k}") for half, name in (("q", "question"), ("a", "answer")) for k in ("uuid", "time")]
    return rows.where("side = 'pair' AND q IS NOT NULL AND a IS NOT NULL").select("conv_id", F.col("pair.pair_index").alias("pair_index"), *others, *told)


def match_warnings(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, warning) where the counts differ."""
    n = lambda c, one: F.concat(F.col(c).cast("string"), F.lit(f" {one}"), F.when(F.col(c) == 1, "").otherwise("s"))
    text = F.concat(n("pairs", "captured pair"), F.lit(", "), n("humans", "question"), F.lit(" and "), n("assistants", "answer"), F.lit(" in the dump"))
    return sides(messages, pairs).where("NOT (humans = pairs AND assistants = pairs)").select("conv_id", text.alias("warning"))


def api_artifacts(blocks: DataFrame) -> DataFrame:
    """Artifacts of assistant messages: (conv_id, uuid, position, title, type, language, content)."""
    kept = blocks.where((F.col("message.sender") == "assistant") & is_artifact_block(F.col("block"))).withColumn(
        "a", api_artifact_type(F.coalesce("block.input.type", F.lit("")), F.col("block.input.language"))
    )
    return kept.select(
        "conv_id", F.col("message.uuid").alias("uuid"), F.col("block_pos").alias("position"), F.col("block.input.title").alias("title"),
        F.col("a.type").alias("type"), F.col("a.language").alias("language"), F.col("block.input.content").alias("content"),
    )


def attach_artifacts(matched: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Answers with their artifacts, by message uuid and never by title."""
    mine = artifacts.groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("position", "title", "type", "language"))).alias("artifacts"))
    return matched.join(mine.withColumnRenamed("uuid", "answer_uuid").hint("merge"), "answer_uuid", "left")


def stamp_api_times(matched: DataFrame) -> DataFrame:
    """Times of the dump where they can be read; a time is never invented."""
    return matched.withColumn("question_ts", parse_api_time(F.col("question_time"))).withColumn("answer_ts", parse_api_time(F.col("answer_time")))


def both_sides(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """Pairs and messages of a conversation side by side, in one shuffle by conversation.

    Rows (conv_id, side, n, ..., humans, assistants, pairs): side is human, assistant or pair, n the place
    on that side, the counts those of the conversation.
    """
    at = {"human": "humans", "assistant": "assistants", "pair": "pairs"}
    m = messages.where(F.col("message.sender").isin("human", "assistant")).select(
        "conv_id", F.col("message.sender").alias("side"), F.col("message_pos").cast("long").alias("place"), api_message_text(F.col("message")).alias("body"),
        F.col("message.uuid").alias("uuid"), F.col("message.created_at").alias("created_at"),
    )
    p = pairs.select("conv_id", F.lit("pair").alias("side"), F.col("pair_index").cast("long").alias("place"), "pair_index", "question", "answer")
    all_of, own = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "side").orderBy("place")
    out = m.unionByName(p, allowMissingColumns=True)
    out = out.withColumns({name: F.count_if(F.col("side") == side).over(all_of) for side, name in at.items()})
    return out.withColumn("n", F.row_number().over(own) - 1)


def reconcile_sources(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, pair_index, question, answer, source): the dump where it has more whole pairs
    than the capture, the enriched capture where the counts agree, and the capture elsewhere.

    Pairs without a conv_id are captured ones.  Windows and groups all lie within the one shuffle.
    """
    source = F.when(F.expr("conv_id IS NULL"), "captured").when(F.expr("humans = assistants AND humans > pairs"), "api").when(
        F.expr("humans = pairs AND assistants = pairs"), "enriched"
    ).otherwise("captured")
    rows = both_sides(pairs, messages).withColumn("source", source)
    is_pair = F.col("side") == "pair"
    said = lambda side: F.when(F.col("side") == side, F.col("body"))
    kept = rows.where(is_pair == (F.col("source") != "api")).select(
        "conv_id", "n", "source", "pair_index", F.when(is_pair, F.col("question")).otherwise(said("human")).alias("question"),
        F.when(is_pair, F.col("answer")).otherwise(said("assistant")).alias("answer"),
    )
    # a captured pair is alone in its group; from the dump, the n-th messages of both sides meet
    return kept.groupBy("conv_id", "n", "source").agg(
        F.max("pair_index").alias("pair_index"), F.max("question").alias("question"), F.max("answer").alias("answer")
    ).select("conv_id", F.coalesce("pair_index", "n").alias("pair_index"), "question", "answer", "source")


def attach_panel_body(artifacts: DataFrame, panels: DataFrame) -> DataFrame:
    """Artifact bodies by equal title on the same page; others keep null content."""
    return artifacts.join(panels.select("page_id", "title", F.col("body").alias("content")).hint("merge"), ["page_id", "title"], "left")


def attach_report(pairs: DataFrame, chips: DataFrame, reports: DataFrame) -> DataFrame:
    """A report goes to the turn with the chip, else to the last turn; empty reports are ignored.

    ``chips``: (conv_id, pair_index); ``reports``: (conv_id, report).
    """
    last = pairs.groupBy("conv_id").agg(F.max("pair_index").alias("last"))
    marked = chips.groupBy("conv_id").agg(F.min("pair_index").alias("chip"))
    at = reports.where("trim(report) <> ''").join(last.hint("merge"), "conv_id").join(marked.hint("merge"), "conv_id", "left").select(
        "conv_id", F.coalesce("chip", "last").alias("pair_index"), "report"
    )
    return pairs.join(at.hint("merge"), ["conv_id", "pair_index"], "left").withColumn("answer", F.concat_ws("\n\n", F.nullif("answer", F.lit("")), "report")).drop("report")
