"""Whether captures still have the structure that extraction expects.

Findings name rules and counts only, never content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TURN_CHARS, SHORTFALL = 200, 0.05
FINDING = ("conv_id", "rule", "detail")


def turn_text_length(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """``turn_chars`` of each pair: the length of the source turn of the answer, -1 if there is none."""
    source = turns.select("conv_id", F.col("turn").alias("answer_turn"), F.length("content").alias("__chars"))
    return pairs.join(source, ["conv_id", "answer_turn"], "left").withColumn("turn_chars", F.coalesce("__chars", F.lit(-1))).drop("__chars")


def counts(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, turn_count, pair_count) of every conversation."""
    t = turns.groupBy("conv_id").agg(F.count("*").alias("turn_count"))
    p = pairs.groupBy("conv_id").agg(F.count("*").alias("pair_count"))
    return t.join(p, "conv_id", "left").withColumn("pair_count", F.coalesce("pair_count", F.lit(0)))


ANSWER, QUESTION = "trim(coalesce(answer, ''))", "trim(coalesce(question, ''))"


def _finding(rule: str, hit: Column, *detail: Column) -> Column:
    """The finding as a struct; null where the rule doesn't fire."""
    return F.when(hit, F.struct(F.lit(rule).alias("rule"), F.concat(*detail).alias("detail")))


def _n(name: str) -> Column:
    return F.col(name).cast("string")


def no_pairs() -> Column:
    return _finding("no-pairs", F.expr("pair_count = 0 AND turn_count > 0"), F.lit("0 pairs extracted from "), _n("turn_count"), F.lit(" turn container(s)"))


def turns_dropped() -> Column:
    hit = F.expr("pair_count > 0 AND pair_count * 2 < turn_count")
    return _finding("turns-dropped", hit, _n("pair_count"), F.lit(" pair(s) from "), _n("turn_count"), F.lit(" turn container(s)"))


def _pair(rule: str, hit: Column, *detail: Column) -> Column:
    return _finding(rule, hit, F.lit("pair "), _n("pair_index"), F.lit(": "), *detail)


def empty_answer() -> Column:
    return _pair("empty-answer", F.expr(f"{ANSWER} = ''"), F.lit("answer is empty"))


def chrome_as_content(labels: tuple[str, ...]) -> Column:
    return _pair("chrome-as-content", F.expr(ANSWER).isin(*labels), F.lit('answer is the UI label "'), F.expr(ANSWER), F.lit('"'))


def content_shortfall() -> Column:
    n = F.length(F.expr(ANSWER))
    hit = (F.col("turn_chars") > MIN_TURN_CHARS) & (n < F.col("turn_chars") * SHORTFALL)
    return _pair("content-shortfall", hit, F.lit("extracted "), n.cast("string"), F.lit(" of "), _n("turn_chars"), F.lit(" chars"))


def no_question() -> Column:
    missing = F.when(F.expr(f"{QUESTION} = ''"), F.lit("no question")).otherwise(F.lit("no answer"))
    return _pair("no-question", F.expr(f"({ANSWER} = '') <> ({QUESTION} = '')"), missing)


def fired(df: DataFrame, *rules: Column) -> DataFrame:
    """(conv_id, rule, detail) of all rules that fire, in one pass over the rows."""
    return df.select("conv_id", F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("f")).select("conv_id", "f.rule", "f.detail")


def sanity_no_pairs(counted: DataFrame) -> DataFrame:
    return fired(counted, no_pairs())


def sanity_turns_dropped(counted: DataFrame) -> DataFrame:
    return fired(counted, turns_dropped())


def sanity_empty_answer(pairs: DataFrame) -> DataFrame:
    return fired(pairs, empty_answer())


def sanity_chrome_as_content(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``labels``: the interface's own labels, a short list."""
    return fired(pairs, chrome_as_content(labels))


def sanity_content_shortfall(pairs: DataFrame) -> DataFrame:
    return fired(pairs, content_shortfall())


def sanity_no_question(pairs: DataFrame) -> DataFrame:
    return fired(pairs, no_question())


def sanity_findings(counted: DataFrame, pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """All six rules; ``pairs`` have turn_chars."""
    whole = fired(counted, no_pairs(), turns_dropped())
    return whole.unionByName(fired(pairs, empty_answer(), chrome_as_content(labels), content_shortfall(), no_question()))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of ASCII text; products stay below 2 ** 57."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(F.split(text, ""), F.lit(0x811C9DC5).cast("long"), step)


def drift_fingerprint(platform: Column, version: Column, keys: Column, rules: Column) -> Column:
    """Twelve characters of base 36; the order of keys and rules doesn't matter."""
    text = F.concat_ws("|", platform, version, F.array_join(F.array_sort(keys), ","), F.array_join(F.array_sort(rules), ","))
    part = lambda t: F.lower(F.conv(fnv1a(t).cast("string"), 10, 36))
    return F.substring(F.concat(part(text), part(F.concat(text, F.lit("|salt")))), 1, 12)


def failing_selectors(health: DataFrame) -> DataFrame:
    """Required selectors that match nothing or are invalid; an optional one says nothing about the structure."""
    return health.where("required AND matched <= 0")


def required_failure(health: DataFrame) -> DataFrame:
    """(page_id, failed): whether a required selector matches nothing or is invalid."""
    return health.groupBy("page_id").agg(F.bool_or(F.col("required") & (F.col("matched") <= 0)).alias("failed"))


def drift_report(findings: DataFrame, failures: DataFrame, platform: Column, version: str, day: Column) -> DataFrame:
    """One report for each conversation with findings or failing selectors, with fingerprint and counts.

    ``failures``: (conv_id, key, selector, matched) of required selectors.
    """
    found = findings.groupBy("conv_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.count("*").alias("findings"))
    failed = failures.groupBy("conv_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    none = F.array().cast("array<string>")
    out = found.join(failed.hint("merge"), "conv_id", "full").withColumns({
        "rules": F.coalesce("rules", none), "keys": F.coalesce("keys", none), "findings": F.coalesce("findings", F.lit(0)),
    })
    return out.select(
        "conv_id", platform.alias("platform"), F.lit(version).alias("version"), day.alias("day"), "findings", F.array_join("keys", ",").alias("keys"),
        F.array_join("rules", ",").alias("rules"), drift_fingerprint(platform, F.lit(version), F.col("keys"), F.col("rules")).alias("fingerprint"),
    )


def drift_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("fingerprint", "platform", "version").agg(
        F.count("*").alias("reports"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def suppress_known(reports: DataFrame, handled: DataFrame) -> DataFrame:
    """Reports whose fingerprint isn't handled yet."""
    return reports.join(handled.select("fingerprint").hint("merge"), "fingerprint", "left_anti")


def record_suppression(handled: DataFrame, more: DataFrame) -> DataFrame:
    return handled.select("fingerprint").union(more.select("fingerprint")).distinct()


def format_report(
    reports: DataFrame, findings: DataFrame, failures: DataFrame, skeletons: DataFrame, origin: str = "https://chat.example.com", target: str = "batch"
) -> DataFrame:
    """(conv_id, report): plain text without any content of the page.

    ``failures``: (conv_id, key, selector, matched); ``skeletons``: (conv_id, skeleton).
    """
    listed = lambda df, line: df.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    rules = listed(findings, F.concat(F.lit("  "), "rule", F.lit(": "), "detail")).withColumnRenamed("lines", "checks")
    why = F.when(F.col("matched") < 0, "invalid selector").otherwise("0 matches")
    keys = listed(failures, F.concat(F.lit("  "), "key", F.lit(": "), "selector", F.lit("  → "), why)).withColumnRenamed("lines", "selectors")
    told = reports.join(rules.hint("merge"), "conv_id", "left").join(keys.hint("merge"), "conv_id", "left").join(skeletons.select("conv_id", "skeleton").hint("merge"), "conv_id", "left")
    text = F.concat(
        F.lit("drift "), "fingerprint", F.lit(" — "), "platform", F.lit(" page structure report\n\nplatform:  "), "platform",
        F.lit(f"\norigin:    {origin}\nversion:   "), "version", F.lit(f" ({target})\ndetected:  "), "day", F.lit("\n\nSelectors not matching:\n"),
        F.coalesce("selectors", F.lit("  (none — every required selector matched)")), F.lit("\n\nOutput checks that failed:\n"), F.coalesce("checks", F.lit("  (none)")),
        F.lit("\n\nPage structure (tag names, classes and attribute names only —\nevery text node is replaced by its character count):\n\n"),
        F.coalesce(F.nullif("skeleton", F.lit("")), F.lit("  (not available)")),
    )
    return told.select("conv_id", text.alias("report"))
