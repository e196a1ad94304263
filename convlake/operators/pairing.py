"""Turns to question/answer pairs, and what is counted over pairs.

All windows are partitioned by conversation, so one exchange serves the whole family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.text import word_count

BY_TURN = ("conv_id", "turn")


def role_filter(turns: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    return turns.where(F.col("role").isin(*roles))


def truncate_messages(turns: DataFrame, most: int) -> DataFrame:
    """Contents cut to ``most`` characters; 0 is no limit."""
    return turns.withColumn("content", F.substring("content", 1, most)) if most > 0 else turns


def message_id(*keys: Column) -> Column:
    """Deterministic, unlike the random ids of a capture."""
    return F.xxhash64(*keys)


def pair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pair_index, turn, question, answer, answer_turn, selected).

    A question followed by an answer is a pair; followed by another question, a pair without
    an answer; an answer without a question before it, and a last question, give none.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    follows = (
        role_filter(turns)
        .withColumn("next_role", F.lead("role").over(w))
        .withColumn("next_turn", F.lead("turn").over(w))
        .withColumn("next_content", F.lead("content").over(w))
        .where((F.col("role") == "user") & F.col("next_role").isNotNull())
    )
    answered = F.col("next_role") == "assistant"
    return follows.select(
        "conv_id", (F.row_number().over(w) - 1).alias("pair_index"), "turn", F.col("content").alias("question"),
        F.when(answered, F.coalesce("next_content", F.lit(""))).otherwise(F.lit("")).alias("answer"),
        F.when(answered, F.col("next_turn")).alias("answer_turn"), F.lit(True).alias("selected"),
    )


def pair_containers(parts: DataFrame) -> DataFrame:
    """Platforms where one container holds both halves: rows (page_id, container, kind, text).

    A container is kept if it has a question, an answer or media; halves may be empty.
    """
    has = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    w = Window.partitionBy("page_id").orderBy("container")
    return (
        parts.groupBy("page_id", "container")
        .agg(has("question").alias("question"), has("answer").alias("answer"), F.count_if(F.col("kind") == "media").alias("media"))
        .where((F.coalesce("question", F.lit("")) != "") | (F.coalesce("answer", F.lit("")) != "") | (F.col("media") > 0))
        .select(
            "page_id", (F.row_number().over(w) - 1).alias("pair_index"), F.coalesce("question", F.lit("")).alias("question"),
            F.coalesce("answer", F.lit("")).alias("answer"), "media",
        )
    )


def latest_snapshot(captures: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return captures.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def selected_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("selected")


def toggle_pairs(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: (conv_id, pair_index) of pairs whose flag flips, once for each row."""
    hits = changes.groupBy("conv_id", "pair_index").agg((F.count("*") % 2 == 1).alias("__flip"))
    return pairs.join(hits, ["conv_id", "pair_index"], "left").withColumn(
        "selected", F.col("selected") != F.coalesce("__flip", F.lit(False))
    ).drop("__flip")


def set_selected(pairs: DataFrame, flag: bool) -> DataFrame:
    return pairs.withColumn("selected", F.lit(flag))


def apply_selection(pairs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: (conv_id, indices).  Pairs of a requested conversation are selected if listed."""
    wanted = requests.groupBy("conv_id").agg(F.flatten(F.collect_list("indices")).alias("__want"))
    return pairs.join(wanted, "conv_id", "left").withColumn(
        "selected", F.when(F.col("__want").isNull(), F.col("selected")).otherwise(F.array_contains("__want", F.col("pair_index")))
    ).drop("__want")


def selection_summary(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts for every conversation; one without pairs has all selected, and none."""
    counts = pairs.groupBy("conv_id").agg(F.count_if("selected").alias("k"), F.count("*").alias("n"))
    k, n = F.coalesce("k", F.lit(0)), F.coalesce("n", F.lit(0))
    return conversations.select("conv_id").distinct().join(counts, "conv_id", "left").select(
        "conv_id", k.alias("selected_count"), (k == n).alias("all_selected"), (k == 0).alias("none_selected")
    )


def selected_word_count(pairs: DataFrame) -> DataFrame:
    return selected_pairs(pairs).groupBy("conv_id").agg(
        F.sum(word_count(F.col("question")) + word_count(F.col("answer"))).cast("long").alias("words")
    )


def require_exportable(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, status): ``ok``, ``nothing to export`` or ``no conversation``."""
    counts = pairs.groupBy("conv_id").agg(F.count_if("selected").alias("k"))
    status = F.when(F.col("k").isNull(), "no conversation").when(F.col("k") == 0, "nothing to export").otherwise("ok")
    return conversations.select("conv_id").distinct().join(counts, "conv_id", "left").select("conv_id", status.alias("status"))


def conversation_stats(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    roles = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.count_if(F.col("role") == "system").alias("system_messages"),
    )
    n = pairs.groupBy("conv_id").agg(F.count("*").alias("pair_count"))
    return roles.join(n, "conv_id", "left").withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))


def date_bounds(pairs: DataFrame) -> DataFrame:
    """First and last time over both halves of all pairs; null if none is known."""
    return pairs.groupBy("conv_id").agg(
        F.least(F.min("question_ts"), F.min("answer_ts")).alias("first_ts"), F.greatest(F.max("question_ts"), F.max("answer_ts")).alias("last_ts")
    )


def date_range_label(first: Column, last: Column) -> Column:
    a, b = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" – "), b))


def day_separators(messages: DataFrame, show: bool = True) -> DataFrame:
    """The day to print before a message: where it isn't the last known day, and there was one."""
    day = F.date_format("ts", "yyyy-MM-dd")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(day, ignorenulls=True).over(w)
    return messages.withColumn("separator", F.when(F.lit(show) & (known != day), day))


def parser_warnings(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, pair_index, warning): half-empty pairs, and conversations without any."""
    part = F.when(F.trim("question") == "", "question").when(F.trim("answer") == "", "answer")
    halves = pairs.withColumn("part", part).where("part IS NOT NULL").select(
        "conv_id", "pair_index",
        F.concat(F.lit("Turn "), (F.col("pair_index") + 1).cast("string"), F.lit(": the "), "part", F.lit(" could not be read")).alias("warning"),
    )
    none = conversations.select("conv_id").distinct().join(pairs, "conv_id", "left_anti").select(
        "conv_id", F.lit(None).cast("int").alias("pair_index"), F.lit("No pairs were found").alias("warning")
    )
    return halves.unionByName(none)


def warning_precedence(format_warning: Column, enrichment: Column, parser: Column) -> Column:
    return F.coalesce(format_warning, enrichment, parser)

