"""Queries on the tables of conversations: pairing, selection, counts, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators import drift, html, pairing
from convlake.queries.pages import HEALTH, SKELETON, health, layouts
from convlake.registry import query
from convlake.sources.tables import read_turns

#: Turns of users and assistants with times, and their pairs.
T = """t AS (SELECT conv_id, turn, role, text AS content,
  CASE WHEN turn % 7 <> 6 THEN to_timestamp(1700000000 + conv_id * 86400 + turn * 18000)::TIMESTAMP END AS ts
  FROM conversations WHERE role IN ('user', 'assistant'))"""
L = """l AS (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(content) OVER w AS nc, lead(ts) OVER w AS nts
  FROM t WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
P = """p AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pair_index, turn, content AS question,
  CASE WHEN nr = 'assistant' THEN coalesce(nc, '') ELSE '' END AS answer, CASE WHEN nr = 'assistant' THEN nt END AS answer_turn, true AS selected,
  ts AS question_ts, CASE WHEN nr = 'assistant' THEN nts END AS answer_ts
  FROM l WHERE role = 'user' AND nr IS NOT NULL)"""
PAIRS_SQL = f"WITH {T}, {L}, {P}"
WORDS = "CASE WHEN trim(regexp_replace({0}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' ')) END"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.role_filter(read_turns(spark, sf_dir))


def with_times(turns: DataFrame) -> DataFrame:
    """``ts`` of each turn: a fixed clock of the corpus, unknown for every seventh turn.

    The tables hold no times of turns; hours pass between turns, so that conversations cross days.
    """
    seconds = F.lit(1_700_000_000) + F.col("conv_id") * 86_400 + F.col("turn") * 18_000
    return turns.withColumn("ts", F.when(F.col("turn") % 7 != 6, F.timestamp_seconds(seconds)))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_turns(turns(spark, sf_dir))


def timed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the times of both halves."""
    t = with_times(turns(spark, sf_dir))
    ts = t.select("conv_id", "turn", "ts")
    p = pairing.pair_turns(t).join(ts.withColumnRenamed("ts", "question_ts"), ["conv_id", "turn"])
    return p.join(ts.select("conv_id", F.col("turn").alias("answer_turn"), F.col("ts").alias("answer_ts")), ["conv_id", "answer_turn"], "left")


def some_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a selection: each third pair is out, and all of every tenth conversation."""
    flag = (F.col("pair_index") % 3 != 2) & (F.col("conv_id") % 10 != 0)
    return pairs(spark, sf_dir).withColumn("selected", flag)


SELECTED = "s AS (SELECT * REPLACE (pair_index % 3 <> 2 AND conv_id % 10 <> 0 AS selected) FROM p)"


query("SELECT conv_id, turn, role, text AS content FROM conversations", "read_turns")(read_turns)


@query("SELECT conv_id, turn, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')")
def role_filter(spark, d):
    return pairing.role_filter(read_turns(spark, d))


@query("SELECT conv_id, turn, role, substr(text, 1, 120) AS content FROM conversations")
def truncate_messages(spark, d):
    return pairing.truncate_messages(read_turns(spark, d), 120)


@query(f"{PAIRS_SQL} SELECT conv_id, pair_index, turn, question, answer, answer_turn, selected FROM p")
def pair_turns(spark, d):
    return pairs(spark, d)


@query(f"{PAIRS_SQL}, {SELECTED} SELECT conv_id, pair_index, question, answer FROM s WHERE selected")
def selected_pairs(spark, d):
    return pairing.selected_pairs(some_selected(spark, d)).select("conv_id", "pair_index", "question", "answer")


@query(f"{PAIRS_SQL}, {SELECTED} SELECT conv_id, pair_index, CASE WHEN pair_index % 2 = 0 THEN NOT selected ELSE selected END AS selected FROM s")
def toggle_pairs(spark, d):
    s = some_selected(spark, d)
    changes = s.where("pair_index % 2 = 0").select("conv_id", "pair_index")
    return pairing.toggle_pairs(s, changes).select("conv_id", "pair_index", "selected")


@query(f"{PAIRS_SQL} SELECT conv_id, pair_index, true AS selected FROM p")
def select_all(spark, d):
    return pairing.set_selected(some_selected(spark, d), True).select("conv_id", "pair_index", "selected")


@query(f"{PAIRS_SQL} SELECT conv_id, pair_index, false AS selected FROM p")
def deselect_all(spark, d):
    return pairing.set_selected(some_selected(spark, d), False).select("conv_id", "pair_index", "selected")


@query(f"""{PAIRS_SQL} SELECT conv_id, pair_index, CASE WHEN conv_id % 3 = 0 THEN pair_index IN (0, 2, 99) ELSE selected END AS selected FROM p""")
def apply_selection(spark, d):
    p = pairs(spark, d)
    requests = p.where("conv_id % 3 = 0").select("conv_id").distinct().withColumn("indices", F.array(F.lit(0), F.lit(2), F.lit(99)))
    return pairing.apply_selection(p, requests).select("conv_id", "pair_index", "selected")


@query(f"""{PAIRS_SQL}, {SELECTED}, c AS (SELECT DISTINCT conv_id FROM conversations),
n AS (SELECT conv_id, count(*) FILTER (selected) AS k, count(*) AS n FROM s GROUP BY conv_id)
SELECT conv_id, coalesce(k, 0) AS selected_count, coalesce(k, 0) = coalesce(n, 0) AS all_selected, coalesce(k, 0) = 0 AS none_selected
FROM c LEFT JOIN n USING (conv_id)""")
def selection_summary(spark, d):
    return pairing.selection_summary(read_turns(spark, d), some_selected(spark, d))


@query(f"""{PAIRS_SQL}, {SELECTED} SELECT conv_id, sum({WORDS.format('question')} + {WORDS.format('answer')})::BIGINT AS words FROM s WHERE selected GROUP BY conv_id""")
def selected_word_count(spark, d):
    return pairing.selected_word_count(some_selected(spark, d))


@query(f"""{PAIRS_SQL}, {SELECTED}, n AS (SELECT conv_id, count(*) FILTER (selected) AS k FROM s GROUP BY conv_id)
SELECT conv_id, CASE WHEN k IS NULL THEN 'no conversation' WHEN k = 0 THEN 'nothing to export' ELSE 'ok' END AS status
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id)""")
def require_exportable(spark, d):
    return pairing.require_exportable(read_turns(spark, d), some_selected(spark, d))


@query(f"""{PAIRS_SQL}, n AS (SELECT conv_id, count(*) AS pair_count FROM p GROUP BY conv_id)
SELECT conv_id, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
  count(*) FILTER (role = 'system') AS system_messages, coalesce(any_value(pair_count), 0) AS pair_count
FROM conversations LEFT JOIN n USING (conv_id) GROUP BY conv_id""")
def conversation_stats(spark, d):
    return pairing.conversation_stats(read_turns(spark, d), pairs(spark, d))


@query(f"""{PAIRS_SQL} SELECT conv_id, least(min(question_ts), min(answer_ts)) AS first_ts, greatest(max(question_ts), max(answer_ts)) AS last_ts FROM p GROUP BY conv_id""")
def date_bounds(spark, d):
    return pairing.date_bounds(timed_pairs(spark, d))


@query(f"""{PAIRS_SQL}, b AS (SELECT conv_id, strftime(least(min(question_ts), min(answer_ts)), '%Y-%m-%d') AS a,
  strftime(greatest(max(question_ts), max(answer_ts)), '%Y-%m-%d') AS b FROM p GROUP BY conv_id)
SELECT conv_id, CASE WHEN a = b THEN a ELSE a || ' – ' || b END AS label FROM b""")
def date_range_label(spark, d):
    b = pairing.date_bounds(timed_pairs(spark, d))
    return b.select("conv_id", pairing.date_range_label(F.col("first_ts"), F.col("last_ts")).alias("label"))


@query(f"""WITH {T}, k AS (SELECT conv_id, turn, strftime(ts, '%Y-%m-%d') AS d, last_value(strftime(ts, '%Y-%m-%d') IGNORE NULLS) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM t)
SELECT conv_id, turn, CASE WHEN k <> d THEN d END AS separator FROM k""")
def day_separators(spark, d):
    return pairing.day_separators(with_times(turns(spark, d))).select("conv_id", "turn", "separator")


WARNINGS = """w AS (SELECT conv_id, pair_index, 'Turn ' || (pair_index + 1) || ': the ' ||
  CASE WHEN trim(question) = '' THEN 'question' ELSE 'answer' END || ' could not be read' AS warning FROM p WHERE trim(question) = '' OR trim(answer) = ''
  UNION ALL SELECT DISTINCT conv_id, NULL::INTEGER, 'No pairs were found' FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM p))"""


@query(f"{PAIRS_SQL}, {WARNINGS} SELECT * FROM w")
def parser_warnings(spark, d):
    return pairing.parser_warnings(read_turns(spark, d), pairs(spark, d))


@query(f"""{PAIRS_SQL}, {WARNINGS}, m AS (SELECT conv_id, min(warning) AS parser FROM w GROUP BY conv_id)
SELECT conv_id, coalesce(CASE WHEN conv_id % 11 = 0 THEN 'format' END, CASE WHEN conv_id % 5 = 0 THEN 'enrichment' END, parser) AS warning
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m USING (conv_id)""")
def warning_precedence(spark, d):
    m = pairing.parser_warnings(read_turns(spark, d), pairs(spark, d)).groupBy("conv_id").agg(F.min("warning").alias("parser"))
    c = read_turns(spark, d).select("conv_id").distinct().join(m, "conv_id", "left")
    return c.select(
        "conv_id",
        pairing.warning_precedence(
            F.when(F.col("conv_id") % 11 == 0, "format"), F.when(F.col("conv_id") % 5 == 0, "enrichment"), F.col("parser")
        ).alias("warning"),
    )


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1""")
def latest_snapshot(spark, d):
    return pairing.latest_snapshot(read_turns(spark, d), "conv_id", "turn", "role").select("conv_id", "turn", "role")


@query("SELECT page_id, url FROM pages")
def prune_payload(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


@query("""WITH c AS (SELECT conv_id, turn // 2 AS container, max(CASE WHEN role = 'user' THEN text END) AS q, max(CASE WHEN role = 'assistant' THEN text END) AS a,
  count(*) FILTER (role = 'system') AS media FROM conversations GROUP BY ALL)
SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY container) - 1)::INTEGER AS pair_index, coalesce(q, '') AS question, coalesce(a, '') AS answer, media
FROM c WHERE coalesce(q, '') <> '' OR coalesce(a, '') <> '' OR media > 0""")
def pair_container_turns(spark, d):
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "answer").otherwise("media")
    parts = read_turns(spark, d).select(
        F.col("conv_id").alias("page_id"), F.expr("turn div 2").alias("container"), kind.alias("kind"), F.col("content").alias("text")
    )
    return pairing.pair_containers(parts)


# ---- drift ---------------------------------------------------------------------------

#: Answers are cut for some pairs, so that every rule has cases.
DAMAGED = """x AS (SELECT p.* REPLACE (CASE WHEN pair_index % 4 = 1 THEN substr(answer, 1, 5) WHEN pair_index % 4 = 2 AND p.conv_id % 2 = 0 THEN 'Copy code' ELSE answer END AS answer,
    CASE WHEN pair_index % 5 = 3 THEN '' ELSE question END AS question), coalesce(length(t.content), -1) AS turn_chars
  FROM p LEFT JOIN t ON p.conv_id = t.conv_id AND p.answer_turn = t.turn)"""
COUNTED = """n AS (SELECT conv_id, count(*) AS turn_count, coalesce(any_value(k), 0) AS pair_count FROM conversations
  LEFT JOIN (SELECT conv_id, count(*) AS k FROM p GROUP BY conv_id) USING (conv_id) GROUP BY conv_id)"""
RULES = {
    "sanity_no_pairs": """SELECT conv_id, 'no-pairs' AS rule, '0 pairs extracted from ' || turn_count || ' turn container(s)' AS detail FROM n WHERE pair_count = 0 AND turn_count > 0""",
    "sanity_turns_dropped": """SELECT conv_id, 'turns-dropped' AS rule, pair_count || ' pair(s) from ' || turn_count || ' turn container(s)' AS detail FROM n WHERE pair_count > 0 AND pair_count * 2 < turn_count""",
    "sanity_empty_answer": """SELECT conv_id, 'empty-answer' AS rule, 'pair ' || pair_index || ': answer is empty' AS detail FROM x WHERE trim(answer) = ''""",
    "sanity_chrome_as_content": """SELECT conv_id, 'chrome-as-content' AS rule, 'pair ' || pair_index || ': answer is the UI label "' || trim(answer) || '"' AS detail FROM x WHERE trim(answer) IN ('Copy code', 'Regenerate')""",
    "sanity_content_shortfall": """SELECT conv_id, 'content-shortfall' AS rule, 'pair ' || pair_index || ': extracted ' || length(trim(answer)) || ' of ' || turn_chars || ' chars' AS detail FROM x WHERE turn_chars > 200 AND length(trim(answer)) < turn_chars * 0.05""",
    "sanity_no_question": """SELECT conv_id, 'no-question' AS rule, 'pair ' || pair_index || ': ' || CASE WHEN trim(question) = '' THEN 'no question' ELSE 'no answer' END AS detail FROM x WHERE (trim(answer) = '') <> (trim(question) = '')""",
}
DRIFT_SQL = f"{PAIRS_SQL}, {DAMAGED}, {COUNTED}"
FINDINGS = "f AS (" + " UNION ALL ".join(RULES.values()) + ")"


def damaged(spark: SparkSession, d: str) -> DataFrame:
    p = drift.turn_text_length(pairs(spark, d), turns(spark, d))
    answer = F.when(F.col("pair_index") % 4 == 1, F.substring("answer", 1, 5)).when(
        (F.col("pair_index") % 4 == 2) & (F.col("conv_id") % 2 == 0), "Copy code"
    ).otherwise(F.col("answer"))
    return p.withColumn("answer", answer).withColumn("question", F.when(F.col("pair_index") % 5 == 3, "").otherwise(F.col("question")))


def counted(spark: SparkSession, d: str) -> DataFrame:
    return drift.counts(read_turns(spark, d), pairs(spark, d))


UI_LABELS = ("Copy code", "Regenerate")


def findings(spark: SparkSession, d: str) -> DataFrame:
    return drift.sanity_findings(counted(spark, d), damaged(spark, d), UI_LABELS)


for _name, _rule in RULES.items():
    _f = getattr(drift, _name)
    if _name in ("sanity_no_pairs", "sanity_turns_dropped"):
        query(f"{DRIFT_SQL} {_rule}", _name)(lambda spark, d, f=_f: f(counted(spark, d)))
    elif _name == "sanity_chrome_as_content":
        query(f"{DRIFT_SQL} {_rule}", _name)(lambda spark, d, f=_f: f(damaged(spark, d), UI_LABELS))
    else:
        query(f"{DRIFT_SQL} {_rule}", _name)(lambda spark, d, f=_f: f(damaged(spark, d)))

query(f"{DRIFT_SQL}, {FINDINGS} SELECT * FROM f", "sanity_findings")(findings)


@query(f"{DRIFT_SQL} SELECT conv_id, pair_index, turn_chars FROM x")
def turn_text_length(spark, d):
    return damaged(spark, d).select("conv_id", "pair_index", "turn_chars")


FNV = """('' || lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36)))"""
REPORTS = f"""r AS (SELECT conv_id, list_sort(list(DISTINCT rule)) AS rules, count(*) AS findings FROM f GROUP BY conv_id),
kf AS (SELECT page_id AS conv_id, list_sort(list(key)) AS keys FROM h WHERE required AND matched <= 0 GROUP BY page_id),
q AS (SELECT conv_id, coalesce(rules, []) AS rules, coalesce(keys, []) AS keys, coalesce(findings, 0) AS findings, 'chatgpt|1.2.0|' || array_to_string(coalesce(keys, []), ',') || '|' || array_to_string(coalesce(rules, []), ',') AS c FROM r FULL JOIN kf USING (conv_id)),
g AS (SELECT conv_id, 'chatgpt' AS platform, '1.2.0' AS version, strftime(DATE '2024-01-01' + (conv_id % 28)::INTEGER, '%Y-%m-%d') AS day, findings, array_to_string(keys, ',') AS keys, array_to_string(rules, ',') AS rules,
  substr({FNV.format("c")} || {FNV.format("c || '|salt'")}, 1, 12) AS fingerprint FROM q)"""
REPORT_SQL = f"{DRIFT_SQL}, {FINDINGS}, {HEALTH}, {REPORTS}"


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Failing selectors of the pages; the page of a conversation has its id."""
    return drift.failing_selectors(health(spark, d)).withColumnRenamed("page_id", "conv_id")


def reports(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 28).cast("int")), "yyyy-MM-dd")
    return drift.drift_report(findings(spark, d), failures(spark, d), F.lit("chatgpt"), "1.2.0", day)


query(f"{REPORT_SQL} SELECT * FROM g", "drift_report")(reports)


@query(f"""{DRIFT_SQL}, {FINDINGS}, {HEALTH}, {REPORTS} SELECT conv_id, fingerprint FROM g""")
def drift_fingerprint(spark, d):
    return reports(spark, d).select("conv_id", "fingerprint")


@query(f"{REPORT_SQL} SELECT fingerprint, platform, version, count(*) AS reports, min(day) AS first_day, max(day) AS last_day FROM g GROUP BY ALL")
def drift_summary(spark, d):
    return drift.drift_summary(reports(spark, d))


@query(f"{REPORT_SQL} SELECT conv_id, fingerprint FROM g WHERE fingerprint NOT IN (SELECT fingerprint FROM g WHERE conv_id % 25 = 0)")
def suppress_known(spark, d):
    r = reports(spark, d)
    return drift.suppress_known(r, r.where("conv_id % 25 = 0")).select("conv_id", "fingerprint")


@query(f"{REPORT_SQL} SELECT DISTINCT fingerprint FROM g WHERE conv_id % 25 = 0 OR conv_id % 7 = 0")
def record_suppression(spark, d):
    r = reports(spark, d)
    return drift.record_suppression(r.where("conv_id % 25 = 0"), r.where("conv_id % 7 = 0"))


@query(f"""{REPORT_SQL}, {SKELETON}, fl AS (SELECT conv_id, array_to_string(list_sort(list('  ' || rule || ': ' || detail)), chr(10)) AS checks FROM f GROUP BY conv_id),
hl AS (SELECT page_id AS conv_id, array_to_string(list_sort(list('  ' || key || ': ' || selector || '  → ' || CASE WHEN matched < 0 THEN 'invalid selector' ELSE '0 matches' END)), chr(10)) AS sels FROM h WHERE required AND matched <= 0 GROUP BY page_id)
SELECT conv_id, 'drift ' || fingerprint || ' — ' || platform || ' page structure report' || chr(10) || chr(10) || 'platform:  ' || platform || chr(10) || 'origin:    https://chat.example.com'
  || chr(10) || 'version:   ' || version || ' (batch)' || chr(10) || 'detected:  ' || day || chr(10) || chr(10) || 'Selectors not matching:' || chr(10) || coalesce(sels, '  (none — every required selector matched)')
  || chr(10) || chr(10) || 'Output checks that failed:' || chr(10) || coalesce(checks, '  (none)') || chr(10) || chr(10) || 'Page structure (tag names, classes and attribute names only —' || chr(10)
  || 'every text node is replaced by its character count):' || chr(10) || chr(10) || coalesce(nullif(skeleton, ''), '  (not available)') AS report FROM g LEFT JOIN fl USING (conv_id) LEFT JOIN hl USING (conv_id) LEFT JOIN o ON o.page_id = g.conv_id""")
def format_report(spark, d):
    skeletons = html.page_skeleton(layouts(spark, d)).withColumnRenamed("page_id", "conv_id")
    return drift.format_report(reports(spark, d), findings(spark, d), failures(spark, d), skeletons)
