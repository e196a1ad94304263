"""Queries on dumps, lines, tables of cells and transcripts, all derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from convlake.functions import text
from convlake.functions.artifacts import api_artifact_type as mime_type
from convlake.functions.artifacts import is_artifact_block as artifact_block
from convlake.operators import lines, pairing, reconcile
from convlake.plans import transcripts
from convlake.queries.scalars import WRAP
from convlake.queries.turns import PAIRS_SQL, SELECTED, pairs, some_selected, timed_pairs
from convlake.registry import SQL, query
from convlake.session import shared_folder
from convlake.sources import tables
from convlake.sources.tables import read_table, read_turns

c = F.col
ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"

# ---- dumps ---------------------------------------------------------------------------
# A dump of every conversation is written as JSON from its turns and read back.  Assistant
# messages have empty text and blocks; every third has an artifact.  The dump of every fifth
# conversation knows one more question, and that of the next one a whole exchange, so that counts differ.

MIMES = ("image/svg+xml", "text/html", "application/vnd.ant.react", "text/markdown", "application/vnd.ant.code")
M = """k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS total
  FROM (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'more' FROM conversations WHERE role <> 'system' AND conv_id % 5 < 2 GROUP BY conv_id
    UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 'and more' FROM conversations WHERE role <> 'system' AND conv_id % 5 = 1 GROUP BY conv_id)),
m AS (SELECT conv_id, turn, (pos)::INTEGER AS pos, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS sender, 'u' || conv_id || '-' || turn AS uuid, text AS body,
  CASE WHEN turn % 4 = 3 THEN 'never' ELSE strftime(to_timestamp(1700000000 + turn * 60)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') END AS created_at,
  role = 'assistant' AND turn % 3 = 0 AS has_artifact FROM k)"""
CAPTURED = "cap AS (SELECT conv_id, pair_index, question, answer FROM p0)"
ALL_PAIRS = """l0 AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nc FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p0 AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pair_index, text AS question, CASE WHEN nr = 'assistant' THEN nc ELSE '' END AS answer FROM l0 WHERE role = 'user' AND nr IS NOT NULL)"""
SIDES = """q AS (SELECT conv_id, uuid, body, created_at, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INTEGER AS n FROM m WHERE sender = 'human'),
a AS (SELECT conv_id, uuid, body, created_at, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INTEGER AS n FROM m WHERE sender = 'assistant'),
s AS (SELECT conv_id, count(*) FILTER (sender = 'human') AS humans, count(*) FILTER (sender = 'assistant') AS assistants, coalesce((SELECT count(*) FROM p0 WHERE p0.conv_id = m.conv_id), 0) AS pairs FROM m GROUP BY conv_id)"""
API = f"WITH {M}, {ALL_PAIRS}, {SIDES}"


def dump_texts(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = pairing.role_filter(read_turns(spark, d))
    last = t.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    more = lambda n, role, said, of: last.where(of).select("conv_id", (c("turn") + n).alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("content"))
    t = t.unionByName(more(1, "user", "more", "conv_id % 5 < 2")).unionByName(more(2, "assistant", "and more", "conv_id % 5 = 1"))
    t = t.withColumn("pos", F.row_number().over(w) - 1)
    answer = c("role") == "assistant"
    block = lambda kind, said, name, value: F.struct(F.lit(kind).alias("type"), said.alias("text"), F.lit(name).cast("string").alias("name"), value.alias("input"))
    none = F.lit(None).cast("struct<type:string,title:string,content:string,language:string>")
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (c("turn") % len(MIMES) + 1).cast("int"))
    made = F.struct(mime.alias("type"), F.lit("Same title").alias("title"), c("content").alias("content"), F.lit("python").alias("language"))
    content = F.when(
        answer & (c("turn") % 3 == 0),
        F.array(block("thinking", F.lit("hidden"), None, none), block("text", c("content"), None, none), block("tool_use", F.lit(None).cast("string"), "artifacts", made)),
    ).when(answer, F.array(block("text", c("content"), None, none)))
    at = F.when(c("turn") % 4 == 3, "never").otherwise(F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + c("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    message = F.struct(
        F.concat(F.lit("u"), "conv_id", F.lit("-"), "turn").alias("uuid"), F.when(answer, "").otherwise(c("content")).alias("text"),
        F.when(answer, "assistant").otherwise("human").alias("sender"), c("pos").alias("index"), at.alias("created_at"), content.alias("content"), F.lit("x").alias("unknown_field"),
    )
    all_messages = F.transform(F.array_sort(F.collect_list(F.struct("pos", message.alias("m")))), lambda x: x["m"])
    text_rows = t.groupBy("conv_id").agg(all_messages.alias("chat_messages")).select(
        "conv_id", F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("uuid"), "chat_messages")).alias("json")
    )
    return text_rows


def dumps(spark, d):
    return dump_texts(spark, d).select("conv_id", tables.parse_api(c("json")).alias("api"))


def messages(spark, d):
    return tables.explode_api_messages(dumps(spark, d)).drop("api")


def captured(spark, d):
    return pairing.pair_turns(read_turns(spark, d)).select("conv_id", "pair_index", "question", "answer")


@query(f"{API} SELECT conv_id, 'c' || conv_id AS uuid, count(*) AS messages FROM m GROUP BY conv_id")
def read_api_dump(spark, d):
    """Written as JSON lines to the shared folder, and read back."""
    folder = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    dump_texts(spark, d).select("json").write.text(folder)
    api = tables.read_api_dump(spark, folder).where("_corrupt_record IS NULL")
    return api.select(F.substring("uuid", 2, 20).cast("long").alias("conv_id"), "uuid", F.size("chat_messages").cast("long").alias("messages"))


@query(f"""{API} SELECT conv_id, pos AS message_pos, b.i AS block_pos, b.t AS type FROM m, (VALUES (0, 'thinking', true), (0, 'text', false), (1, 'text', true), (2, 'tool_use', true)) b(i, t, f)
WHERE sender = 'assistant' AND b.f = has_artifact""")
def explode_api_blocks(spark, d):
    return tables.explode_api_blocks(dumps(spark, d)).select("conv_id", "message_pos", "block_pos", "block.type")


@query(f"{API} SELECT conv_id, pos AS message_pos, body FROM m")
def api_message_text(spark, d):
    return messages(spark, d).select("conv_id", "message_pos", reconcile.api_message_text(c("message")).alias("body"))


@query(f"{API} SELECT q.conv_id, q.n AS pair_index, a.uuid AS pair_id, q.body AS question, a.body AS answer FROM q JOIN a USING (conv_id, n)")
def api_pairs(spark, d):
    return reconcile.api_pairs(messages(spark, d))


MATCHED = """mt AS (SELECT p0.conv_id, pair_index, q.uuid AS question_uuid, a.uuid AS answer_uuid, q.created_at AS qt, a.created_at AS a_t FROM p0 JOIN s ON p0.conv_id = s.conv_id AND humans = pairs AND assistants = pairs
  JOIN q ON q.conv_id = p0.conv_id AND q.n = pair_index JOIN a ON a.conv_id = p0.conv_id AND a.n = pair_index)"""


@query(f"{API}, {MATCHED} SELECT conv_id, pair_index, question_uuid, answer_uuid FROM mt")
def positional_match(spark, d):
    return reconcile.positional_match(captured(spark, d), messages(spark, d)).select("conv_id", "pair_index", "question_uuid", "answer_uuid")


@query(f"{API}, {MATCHED} SELECT conv_id, pair_index, try_strptime(qt, '%Y-%m-%dT%H:%M:%SZ') AS question_ts, try_strptime(a_t, '%Y-%m-%dT%H:%M:%SZ') AS answer_ts FROM mt")
def stamp_api_times(spark, d):
    return reconcile.stamp_api_times(reconcile.positional_match(captured(spark, d), messages(spark, d))).select("conv_id", "pair_index", "question_ts", "answer_ts")


TYPED = """ar AS (SELECT conv_id, uuid, 2 AS position, 'Same title' AS title, list_extract(['image', 'react', 'react', 'document', 'code'], (turn % 5 + 1)::INTEGER) AS type,
  list_extract(['svg', 'html', 'tsx', 'markdown', 'python'], (turn % 5 + 1)::INTEGER) AS language, body AS content FROM m WHERE has_artifact)"""


@query(f"{API}, {TYPED} SELECT * FROM ar")
def api_artifacts(spark, d):
    return reconcile.api_artifacts(tables.explode_api_blocks(dumps(spark, d)))


@query(f"{API}, {TYPED} SELECT uuid, type, language FROM ar")
def api_artifact_type(spark, d):
    b = tables.explode_api_blocks(dumps(spark, d)).where(artifact_block(c("block")))
    x = b.select(c("message.uuid").alias("uuid"), mime_type(c("block.input.type"), c("block.input.language")).alias("a"))
    return x.select("uuid", "a.type", "a.language")


@query(f"""{API} SELECT conv_id, pos AS message_pos, b.i AS block_pos, b.t = 'tool_use' AS artifact FROM m, (VALUES (0, 'thinking', true), (0, 'text', false), (1, 'text', true), (2, 'tool_use', true)) b(i, t, f)
WHERE sender = 'assistant' AND b.f = has_artifact""")
def is_artifact_block(spark, d):
    return tables.explode_api_blocks(dumps(spark, d)).select("conv_id", "message_pos", "block_pos", artifact_block(c("block")).alias("artifact"))


@query(f"{API}, {MATCHED}, {TYPED} SELECT mt.conv_id, pair_index, (ar.uuid IS NOT NULL)::INTEGER AS artifacts FROM mt LEFT JOIN ar ON ar.uuid = answer_uuid")
def attach_artifacts(spark, d):
    matched = reconcile.positional_match(captured(spark, d), messages(spark, d))
    out = reconcile.attach_artifacts(matched, reconcile.api_artifacts(tables.explode_api_blocks(dumps(spark, d))))
    return out.select("conv_id", "pair_index", F.coalesce(F.size("artifacts"), F.lit(0)).alias("artifacts"))


@query(f"""{API}, ch AS (SELECT conv_id, CASE WHEN humans = assistants AND humans > pairs THEN 'api' WHEN humans = pairs AND assistants = pairs THEN 'enriched' ELSE 'captured' END AS source FROM s)
SELECT q.conv_id, q.n AS pair_index, q.body AS question, a.body AS answer, source FROM q JOIN a USING (conv_id, n) JOIN ch USING (conv_id) WHERE source = 'api'
UNION ALL SELECT p.conv_id, pair_index, question, answer, coalesce(source, 'captured') FROM p0 p LEFT JOIN ch USING (conv_id) WHERE coalesce(source, 'captured') <> 'api'""")
def reconcile_sources(spark, d):
    return reconcile.reconcile_sources(captured(spark, d), messages(spark, d))


@query("""WITH x AS (SELECT page_id, string_split(url, '/')[4] AS title FROM pages) SELECT page_id, title, CASE WHEN page_id % 2 = 0 THEN 'body ' || page_id END AS content FROM x""")
def attach_panel_body(spark, d):
    a = read_table(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), 4).alias("title"))
    panels = a.where("page_id % 2 = 0").select("page_id", "title", F.concat(F.lit("body "), "page_id").alias("body"))
    return reconcile.attach_panel_body(a, panels)


@query(f"""{PAIRS_SQL}, la AS (SELECT conv_id, max(pair_index) AS l FROM p GROUP BY conv_id),
rp AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE l END AS pair_index, 'report ' || conv_id AS report FROM la WHERE conv_id % 5 <> 0)
SELECT conv_id, pair_index, CASE WHEN report IS NULL THEN answer WHEN answer = '' THEN report ELSE answer || chr(10) || chr(10) || report END AS answer FROM p LEFT JOIN rp USING (conv_id, pair_index)""")
def attach_report(spark, d):
    p = pairs(spark, d)
    chips = p.where("conv_id % 2 = 0 AND pair_index = 0").select("conv_id", "pair_index")
    reports = p.select("conv_id").distinct().withColumn("report", F.when(c("conv_id") % 5 == 0, " ").otherwise(F.concat(F.lit("report "), "conv_id")))
    return reconcile.attach_report(p, chips, reports).select("conv_id", "pair_index", "answer")


# ---- lines, cells, labels -------------------------------------------------------------

NUMBERED = "text || chr(10) || array_to_string(list_transform(range(doc_id % 14), lambda i: (i % 10)::VARCHAR), chr(10)) || chr(10) || '12 sources · 3 búsquedas' || chr(10) || 'end'"
LINES = f"ln AS (SELECT doc_id, generate_subscripts(string_split({NUMBERED}, chr(10)), 1) - 1 AS line, unnest(string_split({NUMBERED}, chr(10))) AS text FROM documents)"


def doc_lines(spark, d):
    """The documents' lines, with a run of digit lines and a line of figures behind them."""
    n = (c("doc_id") % 14).cast("int")
    digits = F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i % 10).cast("string")), "\n")
    whole = F.concat("text", F.lit("\n"), digits, F.lit("\n12 sources · 3 búsquedas\nend"))
    return lines.to_lines(read_table(spark, d, "documents").withColumn("text", whole), "doc_id", "text")


@query(f"""WITH {LINES}, g AS (SELECT *, regexp_full_match(trim(text), '\\d') AS dg, line - sum(regexp_full_match(trim(text), '\\d')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM ln),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, dg, g) AS n FROM g) SELECT doc_id, line::INTEGER AS line, text FROM n WHERE NOT dg OR n < 10""")
def drop_digit_runs(spark, d):
    return lines.drop_digit_runs(doc_lines(spark, d), "doc_id")


STATS = r"'(?i)research completed in\b.*|([\d\s·.,]|citations?|searches?|sources?|fuentes?|búsquedas?)+'"


@query(f"WITH {LINES} SELECT doc_id, line::INTEGER AS line, text FROM ln WHERE NOT regexp_full_match(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), {STATS})")
def drop_stats_lines(spark, d):
    return lines.drop_stats_lines(doc_lines(spark, d))


BL = """bl AS (SELECT conv_id, turn AS ordinal, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS type, (turn * 7 % 6 + 1)::INTEGER AS level, CASE WHEN conv_id % 2 = 0 THEN 'same' ELSE text END AS text FROM conversations)"""


def turn_blocks(spark, d):
    """Turns as blocks: questions as headings of various levels, answers as paragraphs."""
    return read_turns(spark, d).select(
        "conv_id", c("turn").alias("ordinal"), F.when(c("role") == "user", "heading").otherwise("paragraph").alias("type"),
        (c("turn") * 7 % 6 + 1).cast("int").alias("level"), F.when(c("conv_id") % 2 == 0, "same").otherwise(c("content")).alias("text"),
    )


@query(f"WITH {BL} SELECT DISTINCT conv_id, level FROM bl WHERE type = 'heading'")
def heading_levels(spark, d):
    return lines.heading_levels(turn_blocks(spark, d), "conv_id")


@query(f"""WITH {BL}, r AS (SELECT conv_id, level, least(dense_rank() OVER (PARTITION BY conv_id ORDER BY level) + 1, 6)::INTEGER AS doc_level FROM (SELECT DISTINCT conv_id, level FROM bl WHERE type = 'heading'))
SELECT conv_id, ordinal, level, doc_level FROM bl LEFT JOIN r USING (conv_id, level)""")
def normalize_headings(spark, d):
    return lines.normalize_headings(turn_blocks(spark, d), "conv_id").select("conv_id", "ordinal", "level", "doc_level")


@query(f"""WITH {BL}, n AS (SELECT *, lead(type) OVER w = 'heading' AND trim(lead(text) OVER w) = trim(text) AS same FROM bl WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal)) SELECT conv_id, ordinal FROM n WHERE NOT coalesce(same, false)""")
def dedupe_adjacent_titles(spark, d):
    return lines.dedupe_adjacent_titles(turn_blocks(spark, d), "conv_id").select("conv_id", "ordinal")


@query("""WITH n AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS nw FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, (sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS run FROM n) SELECT conv_id, run, role, string_agg(text, '' ORDER BY turn) AS content FROM r GROUP BY ALL""")
def coalesce_runs(spark, d):
    return lines.coalesce_runs(read_turns(spark, d), ["conv_id"], "turn", ["role"], "content")


CELLS = """ce AS (SELECT o_custkey AS table_id, false AS is_header, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_idx, o_orderkey, o_totalprice, o_orderstatus FROM orders),
cells AS (SELECT table_id, is_header, row_idx::INTEGER AS row_idx, 0 AS col_idx, o_orderkey::VARCHAR AS text FROM ce UNION ALL SELECT table_id, is_header, row_idx::INTEGER, 1, o_orderstatus FROM ce
  UNION ALL SELECT table_id, is_header, row_idx::INTEGER, 2, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '%' ELSE ' ' END FROM ce WHERE o_orderkey % 4 <> 3
  UNION ALL SELECT DISTINCT table_id, true, r.r, h.i, CASE WHEN r.r = 0 THEN h.t ELSE CASE WHEN h.i = 1 THEN '' ELSE 'of ' || table_id END END FROM ce, (VALUES (0, 'key'), (1, 'status'), (2, 'share')) h(i, t), (VALUES (-1), (0)) r(r))"""


def cells(spark, d):
    """A customer's orders as a table of three columns with two header rows; some rows lack the last cell."""
    w = Window.partitionBy("table_id").orderBy("o_orderkey")
    o = read_table(spark, d, "orders").select(c("o_custkey").alias("table_id"), "o_orderkey", "o_orderstatus").withColumn("row_idx", F.row_number().over(w))
    key = c("o_orderkey").cast("string")
    share = F.when(c("o_orderkey") % 2 == 0, F.concat(key, F.lit("%"))).otherwise(" ")
    cell = lambda i, t: F.struct(F.lit(i).alias("col_idx"), t.alias("text"))
    body = o.select("table_id", F.lit(False).alias("is_header"), "row_idx", F.explode(
        F.when(c("o_orderkey") % 4 != 3, F.array(cell(0, key), cell(1, c("o_orderstatus")), cell(2, share))).otherwise(F.array(cell(0, key), cell(1, c("o_orderstatus"))))
    ).alias("x"))
    of = F.concat(F.lit("of "), c("table_id").cast("string"))
    head = o.select("table_id").distinct().select("table_id", F.lit(True).alias("is_header"), F.explode(F.array(F.lit(-1), F.lit(0))).alias("row_idx"), F.explode_outer(F.lit(None).cast("array<int>")).alias("_")).drop("_")
    names = lambda top: F.when(c("row_idx") == 0, F.lit(top))
    head = head.select("table_id", "is_header", "row_idx", F.explode(F.array(
        cell(0, F.coalesce(names("key"), of)), cell(1, F.coalesce(names("status"), F.lit(""))), cell(2, F.coalesce(names("share"), of))
    )).alias("x"))
    return body.unionByName(head).select("table_id", "is_header", "row_idx", "x.col_idx", "x.text")


@query(f"WITH {CELLS} SELECT table_id, col_idx, CASE col_idx WHEN 0 THEN 'of ' || table_id || ' key' WHEN 1 THEN 'status' ELSE 'of ' || table_id || ' share' END AS text FROM cells WHERE is_header AND row_idx = 0")
def merge_header_rows(spark, d):
    return lines.merge_header_rows(cells(spark, d))


@query(f"WITH {CELLS}, g AS (SELECT DISTINCT table_id, row_idx FROM cells WHERE NOT is_header) SELECT g.table_id, g.row_idx, i.i::INTEGER AS col_idx, coalesce(text, '') AS text FROM g CROSS JOIN range(3) i(i) LEFT JOIN cells c ON NOT c.is_header AND c.table_id = g.table_id AND c.row_idx = g.row_idx AND c.col_idx = i.i")
def pad_ragged_rows(spark, d):
    return lines.pad_ragged_rows(cells(spark, d))


@query(f"WITH {CELLS} SELECT table_id, col_idx, coalesce(bool_and(regexp_full_match(trim(text), '-?[\\d,]+(\\.\\d+)?%?')) FILTER (trim(text) <> ''), false) AS numeric FROM cells WHERE NOT is_header GROUP BY ALL")
def numeric_columns(spark, d):
    return lines.numeric_columns(cells(spark, d))


@query(f"WITH {CELLS} SELECT table_id, col_idx, greatest(max(length(text)), 3)::INTEGER AS width FROM cells GROUP BY ALL")
def column_widths(spark, d):
    return lines.column_widths(cells(spark, d))


@query(f"""WITH {CELLS}, g AS (SELECT DISTINCT table_id, row_idx FROM cells WHERE NOT is_header),
p AS (SELECT g.table_id, false AS h, g.row_idx, i.i AS col_idx, coalesce(text, '') AS text FROM g CROSS JOIN range(3) i(i) LEFT JOIN cells c ON NOT c.is_header AND c.table_id = g.table_id AND c.row_idx = g.row_idx AND c.col_idx = i.i
  UNION ALL SELECT table_id, true, row_idx, col_idx, text FROM cells WHERE is_header AND row_idx = 0),
w AS (SELECT table_id, col_idx, greatest(max(length(text)), 3)::INTEGER AS width FROM p GROUP BY ALL),
r AS (SELECT table_id, h, row_idx, '| ' || string_agg(rpad(text, width, ' '), ' | ' ORDER BY col_idx) || ' |' AS line,
  '+' || string_agg(repeat('-', width + 2), '+' ORDER BY col_idx) || '+' AS thin, '+' || string_agg(repeat('=', width + 2), '+' ORDER BY col_idx) || '+' AS thick FROM p JOIN w USING (table_id, col_idx) GROUP BY ALL)
SELECT table_id, string_agg(CASE WHEN h THEN thin || chr(10) || line || chr(10) || thick ELSE line || chr(10) || thin END, chr(10) ORDER BY NOT h, row_idx) AS text FROM r GROUP BY table_id""")
def txt_table(spark, d):
    padded = lines.pad_ragged_rows(cells(spark, d)).withColumn("is_header", F.lit(False))
    return lines.txt_table(padded.unionByName(cells(spark, d).where("is_header AND row_idx = 0").select(*padded.columns)))


@query("""WITH o AS (SELECT o_custkey AS table_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
x AS (SELECT table_id, r, 0 AS k, CASE WHEN r % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS text FROM o UNION ALL SELECT table_id, r, CASE WHEN r % 2 = 0 THEN 1 ELSE 1 END, o_orderstatus FROM o
  UNION ALL SELECT table_id, r, 2, CASE WHEN r % 2 = 0 THEN '' ELSE o_orderstatus END FROM o UNION ALL SELECT table_id, r, 3, '' FROM o WHERE r % 2 = 1)
SELECT table_id, false AS is_header, r::INTEGER AS row_idx, k::INTEGER AS col_idx, text FROM x""")
def order_grid(spark, d):
    """Customers' orders as rows whose first cell spans two rows and whose last spans two columns."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read_table(spark, d, "orders").select(c("o_custkey").alias("table_id"), "o_orderkey", "o_orderstatus", (F.row_number().over(w) - 1).cast("int").alias("row_idx"))
    cell = lambda i, t, r, k: F.struct(F.lit(i).alias("ordinal"), t.alias("text"), r.cast("int").alias("rowspan"), F.lit(k).alias("colspan"))
    first = F.when(c("row_idx") % 2 == 0, F.array(cell(0, c("o_orderkey").cast("string"), F.lit(2), 1))).otherwise(F.array(cell(0, c("o_orderstatus"), F.lit(1), 1)))
    both = F.concat(first, F.array(cell(1, c("o_orderstatus"), F.lit(1), 2)))
    x = o.select("table_id", F.lit(False).alias("is_header"), "row_idx", F.explode(both).alias("x")).select("table_id", "is_header", "row_idx", "x.*")
    return lines.table_grid(x)


@query("""WITH e AS (SELECT o_custkey AS conv_id, o_orderpriority AS q, o_orderkey AS pos, 'Order ' || o_orderkey AS title, 'https://x.example/' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'x.example' END AS domain FROM orders WHERE o_orderkey % 5 <> 0),
s AS (SELECT conv_id, q, '### Sources — ' || q || chr(10) || chr(10) || string_agg('- [' || title || '](' || url || ')' || coalesce(' — *' || domain || '*', ''), chr(10) ORDER BY pos) AS t FROM e GROUP BY conv_id, q)
SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY q) AS text FROM s GROUP BY conv_id""")
def sources_section(spark, d):
    key = c("o_orderkey").cast("string")
    r = read_table(spark, d, "orders").select(
        c("o_custkey").alias("conv_id"), c("o_orderpriority").alias("search"), c("o_orderpriority").alias("query"), c("o_orderkey").alias("pos"), F.concat(F.lit("Order "), key).alias("title"),
        F.when(c("o_orderkey") % 5 != 0, F.concat(F.lit("https://x.example/"), key)).alias("url"), F.when(c("o_orderkey") % 2 == 0, "x.example").alias("domain"),
    )
    return lines.sources_section(r)


@query("""SELECT page_id, '# Page ' || page_id || chr(10) || chr(10) || '| **Field** | **Value** |' || chr(10) || '|---|---|' || chr(10) || '| Platform | ChatGPT |' || CASE WHEN page_id % 2 = 0 THEN chr(10) || '| Model | m |' ELSE '' END || chr(10) || '| URL | ' || url || ' |' AS head FROM pages""")
def metadata_header(spark, d):
    head = lines.metadata_header(
        F.concat(F.lit("Page "), c("page_id").cast("string")), F.lit("ChatGPT"), F.when(c("page_id") % 2 == 0, "m"), F.lit(None).cast("string"), c("url")
    )
    return read_table(spark, d, "pages").select("page_id", head.alias("head"))


@query("SELECT doc_id, (doc_id % 2 + doc_id % 3)::INTEGER AS media FROM documents")
def merge_media(spark, d):
    item = lambda kind: F.struct(F.lit(kind).alias("kind"), c("source").alias("src"))
    blank = F.struct(F.lit("image").alias("kind"), F.lit("").alias("src"))
    images = F.concat(F.array(blank), F.array_repeat(item("image"), (c("doc_id") % 2).cast("int")))
    return read_table(spark, d, "documents").select("doc_id", F.size(lines.merge_media(images, F.array_repeat(item("video"), (c("doc_id") % 3).cast("int")))).alias("media"))


@query("""SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN ['[Web Search: ' || source || ']'] ELSE [] END, CASE WHEN doc_id % 3 = 0 THEN ['[Deep Research: 5m, ' || n_chars || ' sources, 2 searches]'] ELSE [] END, ['[Code: ' || lang || ']']), chr(10)) AS markers FROM documents""")
def marker_blocks(spark, d):
    searches = F.array(F.struct(c("source").alias("query"), (c("doc_id") % 2).alias("n")))
    research = F.when(c("doc_id") % 3 == 0, F.struct(F.lit("5m").alias("duration"), c("n_chars").alias("sources"), F.lit(2).alias("searches")))
    made = lambda content: F.struct(F.lit("Code").alias("label"), c("lang").alias("title"), F.lit(content).alias("content"))
    return read_table(spark, d, "documents").select("doc_id", F.array_join(lines.marker_blocks(searches, research, F.array(made(""), made("x"))), "\n").alias("markers"))


@query("""WITH k AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 WHEN turn % 5 = 4 THEN 2 ELSE 1 END AS r, CASE WHEN role = 'system' THEN '[Web Search: ' || text || ']' WHEN turn % 5 = 4 THEN '[Artifact: ' || text || ']' ELSE trim(text) END AS t FROM conversations)
SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY r, turn) AS content FROM k GROUP BY conv_id""")
def message_from_parts(spark, d):
    kind = F.when(c("role") == "system", "search").when(c("turn") % 5 == 4, "artifact").otherwise("text")
    return lines.message_from_parts(read_turns(spark, d).select("conv_id", c("turn").alias("ordinal"), kind.alias("kind"), c("content").alias("text")), ["conv_id"])


LOCALES = """lb(locale, key, message) AS (VALUES ('en', 'user', 'User $1'), ('en', 'assistant', 'Assistant'), ('en', 'system', 'System $$'), ('es', 'user', 'Usuario $1'), ('es', 'assistant', ''))"""


@query(f"""WITH {LOCALES} SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN conv_id % 2 = 0 THEN 'Usuario ' ELSE 'User ' END || turn WHEN 'system' THEN 'System $' ELSE 'Assistant' END AS label FROM conversations""")
def resolve_labels(spark, d):
    labels = spark.createDataFrame(
        [("en", "user", "User $1"), ("en", "assistant", "Assistant"), ("en", "system", "System $$"), ("es", "user", "Usuario $1"), ("es", "assistant", "")],
        "locale string, key string, message string",
    )
    pick = lambda locale, name: F.broadcast(labels.where(c("locale") == locale).select(c("key").alias("role"), c("message").alias(name)))
    t = read_turns(spark, d).join(pick("es", "es"), "role", "left").join(pick("en", "en"), "role", "left")
    message = text.resolve_message(F.when(c("conv_id") % 2 == 0, c("es")), c("en"), c("role"))
    return t.select("conv_id", "turn", text.substitute(message, [c("turn").cast("string")]).alias("label"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'ChatGPT' ELSE upper(role[1]) || role[2:] END AS name FROM conversations""")
def role_platform_names(spark, d):
    names = spark.createDataFrame([("assistant", "ChatGPT")], "role string, own string")
    t = read_turns(spark, d).join(F.broadcast(names), "role", "left")
    return t.select("conv_id", "turn", F.coalesce("own", text.initcap_first(c("role"))).alias("name"))


def items(spark, d):
    """Turns as list items: the depth rises by one from item to item, and falls back after three."""
    return read_turns(spark, d).select("conv_id", c("turn").alias("pos"), (c("turn") % 3).cast("int").alias("depth"), (c("turn") % 3 != 1).alias("ordered"), c("content").alias("text"))


@query(f"""WITH b AS (SELECT conv_id, turn, (turn % 3)::INTEGER AS depth, lag(turn % 3) OVER w AS before, {WRAP.replace('72', '70').format('text')} AS body FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT *, count(*) FILTER (before IS NULL OR before < depth) OVER (PARTITION BY conv_id, depth ORDER BY turn) AS list FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, depth, list ORDER BY turn) AS number FROM l),
m AS (SELECT *, repeat('  ', depth) AS indent, CASE WHEN depth <> 1 THEN number || '. ' ELSE '- ' END AS mark FROM n)
SELECT conv_id, string_agg(indent || mark || replace(body, chr(10), chr(10) || indent || repeat(' ', length(mark))), chr(10) ORDER BY turn) AS text FROM m GROUP BY conv_id""")
def txt_list(spark, d):
    return lines.txt_list(items(spark, d), "conv_id")


@query(f"""WITH i AS (SELECT conv_id, turn, turn % 3 AS depth, coalesce(lag(turn % 3) OVER w, -1) AS b, coalesce(lead(turn % 3) OVER w, -1) AS a, {ESC.format('text')} AS t
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, CASE WHEN depth > b THEN CASE WHEN depth = 1 THEN '<ul>' ELSE '<ol>' END ELSE '' END || '<li>' || t || CASE WHEN a > depth THEN '' WHEN a = depth THEN '</li>' ELSE '' END
  || CASE WHEN a < depth AND depth >= 2 AND a < 2 THEN '</li></ol>' ELSE '' END || CASE WHEN a < depth AND depth >= 1 AND a < 1 THEN '</li></ul>' ELSE '' END || CASE WHEN a < 0 THEN '</li></ol>' WHEN a < depth THEN '</li>' ELSE '' END AS s FROM i)
SELECT conv_id, string_agg(s, '' ORDER BY turn) AS html FROM p GROUP BY conv_id""")
def html_list(spark, d):
    return lines.html_list(items(spark, d), "conv_id")


# ---- transcripts ----------------------------------------------------------------------

TITLE = "'Conversation ' || conv_id"
QUOTED = "array_to_string(list_transform(string_split(question, chr(10)), lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10))"


NLS = "chr(10) || chr(10)"
#: Selected pairs with the days to print, and the head of each conversation.
TOLD = """d AS (SELECT *, strftime(question_ts, '%Y-%m-%d') AS qd, strftime(answer_ts, '%Y-%m-%d') AS ad, row_number() OVER (PARTITION BY conv_id ORDER BY pair_index) - 1 AS i FROM s WHERE selected),
b4 AS (SELECT *, last_value(coalesce(ad, qd) IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pair_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM d),
e AS (SELECT *, CASE WHEN bf <> qd THEN qd END AS qs, CASE WHEN coalesce(qd, bf) <> ad THEN ad END AS asep, strftime(question_ts, '%H:%M') AS qt, strftime(answer_ts, '%H:%M') AS ant FROM b4),
hd AS (SELECT conv_id, least(min(question_ts), min(answer_ts)) AS f, greatest(max(question_ts), max(answer_ts)) AS l FROM d GROUP BY conv_id),
hh AS (SELECT *, CASE WHEN strftime(f, '%Y-%m-%d') = strftime(l, '%Y-%m-%d') THEN strftime(f, '%Y-%m-%d') ELSE strftime(f, '%Y-%m-%d') || ' – ' || strftime(l, '%Y-%m-%d') END AS dates, CASE WHEN conv_id % 2 = 0 THEN 'm' || conv_id END AS model, 'https://chat.example.com/c/' || conv_id AS url FROM hd)"""
ABOUT_SQL = f"{PAIRS_SQL}, {SELECTED}, {TOLD}"


def told_pairs(spark, d):
    """Selected pairs with times; some answers have an artifact, some a search, one of each without content."""
    artifact = F.struct(
        F.concat(F.lit("Art "), c("pair_index").cast("string")).alias("title"), F.lit("code").alias("type"), F.lit("Code").alias("label"), F.lit("py").alias("language"), F.lit("x = 1").alias("content"),
    )
    result = F.struct(F.lit("page").alias("title"), F.lit("https://x.example/").alias("url"), F.lit("x.example").alias("domain"))
    flag = (c("pair_index") % 3 != 2) & (c("conv_id") % 10 != 0)
    return timed_pairs(spark, d).withColumns({
        "selected": flag, "artifacts": F.when(c("pair_index") % 3 == 0, F.array(artifact, artifact.withField("content", F.lit("")))),
        "searches": F.when(c("pair_index") % 4 == 1, F.array(F.struct(F.lit("find").alias("query"), F.array(result).alias("results")), F.struct(F.lit("none").alias("query"), F.array().cast("array<struct<title:string,url:string,domain:string>>").alias("results")))),
    })


def told_about(spark, d):
    n = c("conv_id").cast("string")
    return read_turns(spark, d).select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("Conversation "), n).alias("title"), F.lit("chatgpt").alias("platform"), F.when(c("conv_id") % 2 == 0, F.concat(F.lit("m"), n)).alias("model"),
        F.concat(F.lit("https://chat.example.com/c/"), n).alias("url"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("exported"),
    )


@query(f"""{ABOUT_SQL}, b AS (SELECT conv_id, string_agg(coalesce('**' || qs || '**' || {NLS}, '') || '**User**' || coalesce(' · ' || qt, '') || {NLS} || {QUOTED} || {NLS} || coalesce('**' || asep || '**' || {NLS}, '') || '**ChatGPT**' || coalesce(' · ' || ant, '') || {NLS} || trim(answer)
  || CASE WHEN pair_index % 3 = 0 THEN {NLS} || '#### Art ' || pair_index || chr(10) || '*Type: Code*' || {NLS} || '```py' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END
  || CASE WHEN pair_index % 4 = 1 THEN {NLS} || '### Sources — find' || {NLS} || '- [page](https://x.example/) — *x.example*' ELSE '' END, {NLS} || '---' || {NLS} ORDER BY pair_index) AS body FROM e GROUP BY conv_id)
SELECT conv_id, '# ' || {TITLE} || {NLS} || '| **Field** | **Value** |' || chr(10) || '|---|---|' || chr(10) || '| Platform | ChatGPT |' || coalesce(chr(10) || '| Model | ' || model || ' |', '') || coalesce(chr(10) || '| Date range | ' || dates || ' |', '')
  || chr(10) || '| Exported | 2024-05-06 07:08:09 |' || chr(10) || '| URL | ' || url || ' |' || {NLS} || '---' || {NLS} || body AS document FROM b JOIN hh USING (conv_id)""")
def write_md_transcripts(spark, d):
    return transcripts.md_transcripts(told_pairs(spark, d), told_about(spark, d))


@query(f"""WITH d AS ({SQL['write_md_transcripts']}), s AS (SELECT conv_id, conv_id % 8 AS bucket, octet_length(encode(document)) + 1 AS length FROM d),
b AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY bucket ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s)
SELECT conv_id, bucket || '-' || (before // 20000) AS file, before - min(before) OVER (PARTITION BY bucket, before // 20000) AS start, length FROM b""")
def transcript_places(spark, d):
    """Where the sink puts each document, in files of about 20 kB."""
    documents = transcripts.md_transcripts(told_pairs(spark, d), told_about(spark, d))
    return transcripts.transcript_places(documents, 20_000, 8).select("conv_id", "file", "start", "length")


LABELLED = "upper({0}) || {1} || chr(10) || repeat('-', length({0} || {1})::INTEGER) || chr(10)"
WRAPPED = """array_to_string(list_transform(string_split({0}, chr(10)), lambda line: coalesce((list_reduce(list_transform(list_filter(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''),
  lambda w: {{'s': '{1}' || w, 'n': length('{1}' || w)}}), lambda x, y: CASE WHEN x.n + 1 + y.n - {2} <= 72 THEN {{'s': x.s || ' ' || y.s[{2} + 1:], 'n': x.n + 1 + y.n - {2}}} ELSE {{'s': x.s || chr(10) || y.s, 'n': y.n}} END)).s, '')), chr(10))"""


@query(f"""{ABOUT_SQL}, b AS (SELECT conv_id, string_agg(coalesce(qs || {NLS}, '') || {LABELLED.format("'User'", "coalesce(' · ' || qt, '')")} || {WRAPPED.format('question', '  ', 2)} || {NLS} || coalesce(asep || {NLS}, '') || {LABELLED.format("'ChatGPT'", "coalesce(' · ' || ant, '')")} || {WRAPPED.format('answer', '', 0)}
  || CASE WHEN pair_index % 3 = 0 THEN {NLS} || '--- Art ' || pair_index || ' ---' || chr(10) || 'Type: Code' || {NLS} || 'x = 1' ELSE '' END
  || CASE WHEN pair_index % 4 = 1 THEN {NLS} || 'Sources — find' || chr(10) || '- page — x.example' || chr(10) || '  https://x.example/' ELSE '' END, {NLS} || repeat('-', 72) || {NLS} ORDER BY pair_index) AS body FROM e GROUP BY conv_id)
SELECT conv_id, {TITLE} || chr(10) || repeat('=', length({TITLE})::INTEGER) || {NLS} || 'Platform: ChatGPT' || coalesce(chr(10) || 'Model: ' || model, '') || coalesce(chr(10) || 'Date range: ' || dates, '') || chr(10) || 'Exported: 2024-05-06 07:08:09'
  || chr(10) || 'URL: ' || url || {NLS} || repeat('-', 72) || {NLS} || body AS document FROM b JOIN hh USING (conv_id)""")
def write_txt_transcripts(spark, d):
    return transcripts.txt_transcripts(told_pairs(spark, d), told_about(spark, d))


@query(f"""{ABOUT_SQL}, b AS (SELECT conv_id, string_agg(coalesce('<div class="day">' || qs || '</div>', '') || '<div class="user"><p class="role">User' || coalesce(' <span>' || qt || '</span>', '') || '</p><p>' || {ESC.format('question')} || '</p></div>' || coalesce('<div class="day">' || asep || '</div>', '')
  || '<div class="assistant"><p class="role">ChatGPT' || coalesce(' <span>' || ant || '</span>', '') || '</p><p>' || {ESC.format('answer')} || '</p>' || CASE WHEN pair_index % 3 = 0 THEN '<section><h4>Art ' || pair_index || '</h4><p><em>Code</em></p><pre><code class="language-py">x = 1</code></pre></section>' ELSE '' END
  || CASE WHEN pair_index % 4 = 1 THEN '<h4>Sources — find</h4><ul><li><a href="https://x.example/">page</a> <small>x.example</small></li></ul>' ELSE '' END || '</div>', '<hr>' ORDER BY pair_index) AS body FROM e GROUP BY conv_id)
SELECT conv_id, '<!doctype html><html><head><style>body{{max-width:50em;margin:auto}}</style></head><body><h1>' || {TITLE} || '</h1><dl><dt>Platform</dt><dd>ChatGPT</dd>' || coalesce('<dt>Model</dt><dd>' || model || '</dd>', '') || coalesce('<dt>Date range</dt><dd>' || dates || '</dd>', '')
  || '<dt>Exported</dt><dd>2024-05-06 07:08:09</dd><dt>URL</dt><dd><a href="' || url || '">' || url || '</a></dd></dl>' || body || '</body></html>' AS document FROM b JOIN hh USING (conv_id)""")
def write_html_transcripts(spark, d):
    return transcripts.html_transcripts(told_pairs(spark, d), told_about(spark, d))


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
MADE = """'"artifacts":[{{"title":"Art ' || pair_index || '","type":"code","label":"Code","language":"py","content":"x = 1"}},{{"title":"Art ' || pair_index || '","type":"code","label":"Code","language":"py","content":""}}]'""".replace("{{", "{").replace("}}", "}")
FOUND = """'"webSearches":[{"query":"find","results":[{"title":"page","url":"https://x.example/","domain":"x.example"}]},{"query":"none","results":[]}]'"""
PAIR_JSON = f"""'{{"index":' || {{0}} || ',"question":{{"role":"user","content":' || to_json(question) || {{1}} || '}},"answer":{{"role":"assistant","content":' || to_json(answer) || {{2}} || '}}}}'""".replace("{{0}}", "<0>").replace("{{1}}", "<1>").replace("{{2}}", "<2>")
STAMP = "coalesce(',\"timestamp\":\"' || " + ISO + " || '\"', '')"
META = f"CASE WHEN pair_index % 3 = 0 AND pair_index % 4 = 1 THEN ',\"metadata\":{{' || {MADE} || ',' || {FOUND} || '}}' WHEN pair_index % 3 = 0 THEN ',\"metadata\":{{' || {MADE} || '}}' WHEN pair_index % 4 = 1 THEN ',\"metadata\":{{' || {FOUND} || '}}' ELSE '' END"


def pair_json(index, question="''", answer="''"):
    return PAIR_JSON.replace("<0>", index).replace("<1>", question).replace("<2>", answer).replace("{0}", index).replace("{1}", question).replace("{2}", answer)


@query(f"""{ABOUT_SQL} SELECT conv_id, '{{"schemaVersion":2,"title":"' || {TITLE} || '","platform":"chatgpt"' || coalesce(',"model":"' || any_value(model) || '"', '') || ',"url":"' || any_value(url) || '","exportedAt":"2024-05-06T07:08:09+00:00"'
  || coalesce(',"dateRange":{{"from":"' || {ISO.format('any_value(f)')} || '","to":"' || {ISO.format('any_value(l)')} || '"}}', '') || ',"pairs":[' || string_agg({pair_json('i', STAMP.format('question_ts'), META + " || " + STAMP.format('answer_ts'))}, ',' ORDER BY i) || ']}}' AS document FROM e JOIN hh USING (conv_id) GROUP BY conv_id""")
def write_json_transcripts(spark, d):
    return transcripts.json_transcripts(told_pairs(spark, d), told_about(spark, d))


@query(f"{PAIRS_SQL} SELECT conv_id, pair_index, {pair_json('pair_index')} AS pair FROM p")
def json_pair(spark, d):
    return transcripts.json_pair(pairs(spark, d)).select("conv_id", "pair_index", F.to_json("pair").alias("pair"))


@query(f"""{PAIRS_SQL}, {SELECTED}, e AS (SELECT DISTINCT conv_id FROM s WHERE selected), r AS (SELECT DISTINCT conv_id, list_extract(['json', 'markdown', 'text', 'html', 'pdf'], (conv_id % 5 + 1)::INTEGER) AS format, CASE WHEN conv_id % 7 = 0 THEN ' ' ELSE 'f' || conv_id END AS filename FROM conversations)
SELECT conv_id, format, filename AS outcome FROM r JOIN e USING (conv_id) WHERE format <> 'pdf' AND trim(filename) <> '' UNION ALL SELECT conv_id, format, CASE WHEN format = 'pdf' THEN 'unknown format' ELSE 'blank filename' END FROM r WHERE format = 'pdf' OR trim(filename) = ''""")
def route_by_format(spark, d):
    kinds = ("json", "markdown", "text", "html", "pdf")
    requests = read_turns(spark, d).select("conv_id").distinct().select(
        "conv_id", F.element_at(F.array(*map(F.lit, kinds)), (c("conv_id") % 5 + 1).cast("int")).alias("format"),
        F.when(c("conv_id") % 7 == 0, " ").otherwise(F.concat(F.lit("f"), c("conv_id").cast("string"))).alias("filename"),
    )
    done, rejects = transcripts.route_by_format(some_selected(spark, d), requests)
    return done.select("conv_id", "format", c("filename").alias("outcome")).unionByName(rejects.withColumnRenamed("reason", "outcome"))


@query(f"""{PAIRS_SQL}, {SELECTED} SELECT conv_id, string_agg(question, ' | ' ORDER BY pair_index) AS document FROM s WHERE selected GROUP BY conv_id""")
def register_renderer(spark, d):
    """A format of one's own: the questions on a line."""
    @transcripts.register_renderer("questions")
    def questions(p, about=None):
        return transcripts.assemble(p, c("question"), " | ").select("conv_id", c("body").alias("document"))

    try:
        return transcripts.RENDERERS["questions"](some_selected(spark, d))
    finally:
        del transcripts.RENDERERS["questions"]
