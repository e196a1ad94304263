"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import artifacts, markdown, naming, text
from convlake.registry import query
from convlake.sources.tables import read_table

c = F.col
NL = "chr(10)"
ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def docs(spark, d):
    return read_table(spark, d, "documents")


def odd(*marks):
    """The text with one of the marks at its end, by document."""
    return F.concat(c("text"), F.element_at(F.array(*map(F.lit, marks)), (c("doc_id") % len(marks) + 1).cast("int")))


def odd_sql(*marks):
    quoted = ", ".join("'" + m.replace("'", "''") + "'" for m in marks)
    return f"(text || list_extract([{quoted}], (doc_id % {len(marks)} + 1)::INTEGER))"


def title():
    """A document's title is its first line."""
    return F.element_at(F.split("text", "\n"), 1)


TITLE = "string_split(text, chr(10))[1]"


@query(r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM documents")
def collapse_whitespace(spark, d):
    return docs(spark, d).select("doc_id", text.collapse_whitespace(c("text")).alias("text"))


@query(f"SELECT page_id, {ESC.format('html')} AS html FROM pages")
def escape_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", naming.escape_html(c("html")).alias("html"))


PREFIXES = ("", "javascript:", "jav\tascript:", "mailto:a@", "  ", "data:text/html,", "/c/", "HTTPS:")


@query(r"""WITH u AS (SELECT page_id, list_extract(['', 'javascript:', 'jav' || chr(9) || 'ascript:', 'mailto:a@', '  ', 'data:text/html,', '/c/', 'HTTPS:'], (page_id % 8 + 1)::INTEGER) || url AS u FROM pages),
v AS (SELECT page_id, nullif(replace(trim(u), chr(9), ''), '') AS u FROM u)
SELECT page_id, CASE WHEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto') THEN u END AS url FROM v""")
def safe_url(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (c("page_id") % 8 + 1).cast("int"))
    return read_table(spark, d, "pages").select("page_id", naming.safe_url(F.concat(prefix, c("url"))).alias("url"))


@query(r"""SELECT page_id, nullif(regexp_extract(replace(url, '/en/', '/chat/'), '/(?:c|chat)/([A-Za-z0-9-]+)', 1), '') AS key FROM pages""")
def conversation_key_from_url(spark, d):
    url = F.replace(c("url"), F.lit("/en/"), F.lit("/chat/"))
    return read_table(spark, d, "pages").select("page_id", naming.conversation_key(url).alias("key"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[/\\\\:*?\"<>|]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
#: The longest prefix of whole characters within the bytes: how many running sums fit.
FIT = """CASE WHEN octet_length(encode({0})) <= 245 THEN {0} ELSE regexp_replace(substr({0}, 1, len(list_filter(range(1, least(length({0}), 245) + 1),
  lambda i: octet_length(encode(substr({0}, 1, i))) <= 245))), '-+$', '') END"""


@query(f"WITH t AS (SELECT doc_id, {CLEAN.format(TITLE)} AS s FROM documents) SELECT doc_id, {FIT.format('s')} AS name FROM t")
def sanitize_filename(spark, d):
    return docs(spark, d).select("doc_id", naming.sanitize_filename(title()).alias("name"))


def variables():
    return {"platform": F.lit("ChatGPT"), "title": title(), "date": F.lit("2024-01-02"), "time": F.lit("10-20"), "datetime": F.lit("2024-01-02_10-20"), "pairCount": c("n_chars").cast("string")}


def model():
    return F.when(c("doc_id") % 2 == 0, F.concat(F.lit("m-"), c("lang")))


FILLED = """t AS (SELECT doc_id, regexp_replace(regexp_replace({0}, '^_+|_+$', '', 'g'), '_+', '_', 'g') AS raw FROM documents),
  s AS (SELECT doc_id, {1} AS s FROM t)"""


@query(f"WITH {FILLED.format('''CASE WHEN doc_id % 2 = 0 THEN 'ChatGPT_m-' || lang || '_' || ''' + TITLE + ''' || '_2024-01-02_' || n_chars ELSE 'ChatGPT_' || ''' + TITLE + ''' || '_2024-01-02_' || n_chars END''', CLEAN.format('raw'))} SELECT doc_id, {FIT.format('s')} AS name FROM s")
def filename_from_template(spark, d):
    out = naming.filename_from_template(F.lit("{platform}_{model}_{title}_{date}_{pairCount}"), variables(), model())
    return docs(spark, d).select("doc_id", out.alias("name"))


@query(f"WITH {FILLED.format('''coalesce('chat_' || ''' + TITLE + ''' || '_' || CASE WHEN doc_id % 2 = 0 THEN 'm-' || lang ELSE '' END, '')''', CLEAN.format('raw'))} SELECT doc_id, {FIT.format('s')} AS name FROM s")
def filename_from_pieces(spark, d):
    piece = lambda kind, t=None: F.struct(F.lit(kind).alias("type"), F.lit(t).cast("string").alias("text"))
    pieces = F.array(piece("literal", "{chat}"), piece("title"), piece("model"))
    return docs(spark, d).select("doc_id", naming.filename_from_pieces(pieces, variables(), model()).alias("name"))


@query(r"SELECT page_id, regexp_replace(url, '\.[^.]*$', '') || '.md' AS name FROM pages")
def add_extension(spark, d):
    return read_table(spark, d, "pages").select("page_id", naming.add_extension(c("url"), F.lit(".md")).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H-%M') AS time, strftime(ts, '%Y-%m-%d_%H-%M') AS datetime FROM events")
def filename_dates(spark, d):
    return read_table(spark, d, "events").select("event_id", *(v.alias(k) for k, v in naming.filename_dates(c("ts")).items()))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, ' (' || strftime(ts, '%H:%M') || ')' AS suffix FROM events")
def timestamp_text(spark, d):
    return read_table(spark, d, "events").select("event_id", naming.timestamp_text(c("ts")).alias("text"), naming.time_suffix(c("ts")).alias("suffix"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE ' (' || strftime(ts, '%H:%M') || ')' END AS suffix FROM events")
def time_suffix(spark, d):
    return read_table(spark, d, "events").select("event_id", naming.time_suffix(F.when(c("event_id") % 4 != 0, c("ts"))).alias("suffix"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def iso_with_offset(spark, d):
    return read_table(spark, d, "events").select("event_id", naming.iso_with_offset(c("ts")).alias("iso"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts)::TIMESTAMP END AS ts FROM events""")
def parse_api_time(spark, d):
    written = F.when(c("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read_table(spark, d, "events").select("event_id", naming.parse_api_time(written).alias("ts"))


@query("""WITH s AS (SELECT event_id, greatest(floor(value * 100 + 0.5)::BIGINT, 0) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration FROM s""")
def format_duration(spark, d):
    return read_table(spark, d, "events").select("event_id", text.format_duration(c("value") * 100).alias("duration"))


@query("""WITH s AS (SELECT *, greatest(floor(value + 0.5)::BIGINT, 0) AS s FROM events)
SELECT event_id, upper(event_type[1]) || event_type[2:] || CASE WHEN event_id % 3 = 0 THEN '' ELSE ': by ' || user_id END
  || CASE WHEN event_id % 2 = 0 THEN ' (' || CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') || ')' ELSE '' END AS label FROM s""")
def media_label(spark, d):
    alt = F.when(c("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("by "), c("user_id").cast("string")))
    return read_table(spark, d, "events").select(
        "event_id", artifacts.media_label(c("event_type"), alt, F.when(c("event_id") % 2 == 0, c("value"))).alias("label")
    )


LABELS = ("Code · PY", "Documento · MD", "Image", "Diagrama", "Interactive app", "interactive", "Text · txt", "X · svg", "Código", "other")
LABEL_SQL = "list_extract(['" + "', '".join(LABELS) + "'], (doc_id % 10 + 1)::INTEGER)"


@query(f"""WITH l AS (SELECT doc_id, {LABEL_SQL} AS l FROM documents),
t AS (SELECT *, CASE WHEN contains(l, '·') THEN lower(trim(string_split(l, '·')[-1])) ELSE '' END AS t FROM l)
SELECT doc_id, CASE WHEN t IN ('md', 'markdown', 'txt') THEN 'document' WHEN t = 'svg' THEN 'image' WHEN t = 'mermaid' THEN 'diagram' WHEN t IN ('jsx', 'tsx') THEN 'react' WHEN t <> '' THEN 'code'
  WHEN contains(l, 'Image') THEN 'image' WHEN contains(l, 'interactiv') THEN 'react' WHEN contains(l, 'Document') THEN 'document' WHEN contains(l, 'Diagram') THEN 'diagram'
  WHEN contains(l, 'Código') OR contains(l, 'Code') THEN 'code' ELSE 'unknown' END AS type,
 CASE WHEN t IN ('md', 'markdown') THEN 'markdown' WHEN t = 'txt' THEN 'text' WHEN t = 'svg' THEN 'svg' WHEN t = 'mermaid' THEN 'mermaid' WHEN t IN ('jsx', 'tsx') THEN 'react' WHEN t <> '' THEN t
  WHEN contains(l, 'Image') THEN 'svg' WHEN contains(l, 'interactiv') THEN 'react' WHEN contains(l, 'Document') THEN 'markdown' WHEN contains(l, 'Diagram') THEN 'mermaid' END AS language FROM t""")
def artifact_type(spark, d):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (c("doc_id") % 10 + 1).cast("int"))
    x = docs(spark, d).select("doc_id", label.alias("l")).select("doc_id", artifacts.artifact_type(c("l"), artifacts.format_token(c("l"))).alias("a"))
    return x.select("doc_id", "a.type", "a.language")


KINDS = ("image", "react", "document", "diagram", "code", "other")


@query(f"""SELECT doc_id, list_extract(['svg', 'tsx', 'markdown', 'mermaid', 'javascript', ''], (doc_id % 6 + 1)::INTEGER) AS language FROM documents""")
def infer_code_language(spark, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (c("doc_id") % 6 + 1).cast("int"))
    return docs(spark, d).select("doc_id", artifacts.infer_code_language(kind).alias("language"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 THEN '' ELSE (doc_id % 60) || 'm' END AS duration,
  CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 1 THEN 0 ELSE n_chars END::INTEGER AS sources, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 0 THEN 7 ELSE 0 END::INTEGER AS searches FROM documents""")
def research_stats(spark, d):
    n, k = c("n_chars").cast("string"), (c("doc_id") % 60).cast("string")
    said = (
        F.when(c("doc_id") % 4 == 0, F.concat(F.lit("Completed in "), k, F.lit("m· "), n, F.lit(" fuentes· 7 Searches")))
        .when(c("doc_id") % 4 == 1, F.concat(F.lit("Completed in "), k, F.lit("m"))).when(c("doc_id") % 4 == 2, F.concat(n, F.lit(" sources"))).otherwise("nothing")
    )
    x = docs(spark, d).select("doc_id", artifacts.research_stats(said).alias("r"))
    return x.select("doc_id", "r.duration", "r.sources", "r.searches")


WRAP = """array_to_string(list_transform(string_split({0}, chr(10)), lambda line: coalesce((list_reduce(list_transform(list_filter(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''),
  lambda w: {{'s': w, 'n': length(w)}}), lambda x, y: CASE WHEN x.n + 1 + y.n <= 72 THEN {{'s': x.s || ' ' || y.s, 'n': x.n + 1 + y.n}} ELSE {{'s': x.s || chr(10) || y.s, 'n': y.n}} END)).s, '')), chr(10))"""


@query(f"SELECT doc_id, {WRAP.format('text')} AS wrapped FROM documents")
def wrap_text(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(text.wrap_text(c("text")), "\n").alias("wrapped"))


@query(f"""SELECT doc_id, '```' || chr(10) || text || chr(10) || '```' || chr(10) || '    kept   as it is' || chr(10) || '| a | b |' || chr(10) || {WRAP.format('text')} AS wrapped FROM documents""")
def wrap_prose_artifact(spark, d):
    fenced = F.concat(F.lit("```\n"), c("text"), F.lit("\n```\n    kept   as it is\n| a | b |\n"), c("text"))
    return docs(spark, d).select("doc_id", F.array_join(text.wrap_prose(fenced), "\n").alias("wrapped"))


STARTS = ("# ", "> ", "- ", "12. ", "1) ", "#x ", "+ ", "")


@query(f"""SELECT doc_id, list_extract([chr(92) || '# ', chr(92) || '> ', chr(92) || '- ', '12' || chr(92) || '. ', '1' || chr(92) || ') ', '#x ', chr(92) || '+ ', ''], (doc_id % 8 + 1)::INTEGER) || {TITLE} AS line FROM documents""")
def md_escape_leading(spark, d):
    start = F.element_at(F.array(*map(F.lit, STARTS)), (c("doc_id") % 8 + 1).cast("int"))
    return docs(spark, d).select("doc_id", markdown.md_escape_leading(F.concat(start, title())).alias("line"))


@query("SELECT doc_id, repeat('`', greatest(3, (doc_id % 6 + 1)::INTEGER)) AS fence FROM documents")
def md_code_fence(spark, d):
    code = F.concat(c("text"), F.repeat(F.lit("`"), (c("doc_id") % 6).cast("int")), F.lit(" `"))
    return docs(spark, d).select("doc_id", F.when(c("doc_id") % 6 < 2, "```").otherwise(markdown.md_code_fence(code)).alias("fence"))


@query("""SELECT o_orderkey, '| ' || o_orderkey || ' | ' || o_orderstatus || chr(92) || '|' || o_orderpriority || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'a b' END || ' |' AS line,
 '| --- | --- | --- |' AS separator FROM orders""")
def md_table_row(spark, d):
    cells = F.array(
        c("o_orderkey").cast("string"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority"), F.when(c("o_orderkey") % 2 == 0, "  ").otherwise(" a\nb ")
    )
    return read_table(spark, d, "orders").select("o_orderkey", markdown.md_table_row(cells).alias("line"), markdown.md_table_separator(cells).alias("separator"))


RUNS = ("text", "bold", "italic", "code", "strikethrough", "link")
RUN_SQL = "r AS (SELECT page_id, url, list_extract(['text', 'bold', 'italic', 'code', 'strikethrough', 'link'], (page_id % 6 + 1)::INTEGER) AS kind, CASE WHEN page_id % 12 = 5 THEN url ELSE 'a<b' || page_id END AS text FROM pages)"


def runs(spark, d):
    kind = F.element_at(F.array(*map(F.lit, RUNS)), (c("page_id") % 6 + 1).cast("int"))
    label = F.when(c("page_id") % 12 == 5, c("url")).otherwise(F.concat(F.lit("a<b"), c("page_id").cast("string")))
    return read_table(spark, d, "pages").select("page_id", "url", kind.alias("kind"), label.alias("text"))


@query(f"""WITH {RUN_SQL} SELECT page_id, CASE kind WHEN 'bold' THEN '**' || text || '**' WHEN 'italic' THEN '*' || text || '*' WHEN 'code' THEN '`' || text || '`' WHEN 'strikethrough' THEN '~~' || text || '~~' WHEN 'link' THEN '[' || text || '](' || url || ')' ELSE text END AS run FROM r""")
def md_inline(spark, d):
    return runs(spark, d).select("page_id", markdown.md_inline(c("kind"), c("text"), c("url")).alias("run"))


@query(f"WITH {RUN_SQL} SELECT page_id, CASE WHEN kind = 'link' AND text <> url THEN text || ' (' || url || ')' ELSE text END AS run FROM r")
def txt_inline(spark, d):
    return runs(spark, d).select("page_id", markdown.txt_inline(c("kind"), c("text"), c("url")).alias("run"))


@query(f"""WITH {RUN_SQL}, e AS (SELECT *, {ESC.format('text')} AS t FROM r) SELECT page_id, CASE kind WHEN 'bold' THEN '<strong>' || t || '</strong>' WHEN 'italic' THEN '<em>' || t || '</em>' WHEN 'code' THEN '<code>' || t || '</code>'
 WHEN 'strikethrough' THEN '<del>' || t || '</del>' WHEN 'link' THEN '<a href="' || {ESC.format('url')} || '">' || t || '</a>' ELSE t END AS run FROM e""")
def html_inline(spark, d):
    return runs(spark, d).select("page_id", markdown.html_inline(c("kind"), c("text"), c("url")).alias("run"))


SYMBOLS = (" a→b", " x≤y", " “q”", " 1…", " plain", " ×÷")


@query(f"""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace({odd_sql(*SYMBOLS)}, '→', '->'), '≤', '<='), '“', '"'), '”', '"'), '…', '...'), '×', 'x'), '÷', '/'), '—', '-') AS text FROM documents""")
def portable_characters(spark, d):
    return docs(spark, d).select("doc_id", text.portable_characters(odd(*SYMBOLS)).alias("text"))


GREEK = (" α", " αβ", " β x", " (π)", " none")


@query(f"""WITH o AS (SELECT doc_id, {odd_sql(*GREEK)} AS t FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(t, 'α', 'alpha') WHEN 2 THEN replace(t, 'β', 'beta') WHEN 3 THEN replace(t, 'π', 'pi') ELSE t END AS text FROM o""")
def isolated_greek(spark, d):
    return docs(spark, d).select("doc_id", text.isolated_greek(odd(*GREEK)).alias("text"))


EMOJI = (" 😀", " ☀️x", " none", " 🇫🇷!")


@query(f"SELECT doc_id, replace(replace(replace(replace(replace({odd_sql(*EMOJI)}, '😀', ''), '☀', ''), chr(65039), ''), '🇫', ''), '🇷', '') AS text FROM documents")
def strip_emoji(spark, d):
    return docs(spark, d).select("doc_id", text.strip_emoji(odd(*EMOJI)).alias("text"))


SCRIPTS = (" 漢字", " ok", " кир", " ة")


@query(f"SELECT doc_id, replace(replace(replace({odd_sql(*SCRIPTS)}, '漢', '?'), '字', '?'), 'ة', '?') AS text, doc_id % 4 IN (0, 3) AS unsupported FROM documents")
def unsupported_script(spark, d):
    shown, flag = text.unsupported_script(odd(*SCRIPTS))
    return docs(spark, d).select("doc_id", shown.alias("text"), flag.alias("unsupported"))


@query("SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(65533) || 'x' WHEN 1 THEN chr(9) || 'x' ELSE '' END AS text FROM documents")
def xml_safe(spark, d):
    return docs(spark, d).select("doc_id", text.xml_safe(odd("\x01x", "\tx", "")).alias("text"))


STRIKES = (" ~~gone~~", " ~kept~", " ~~a~b~~", "")


@query(f"SELECT doc_id, regexp_replace({odd_sql(*STRIKES)}, '~~([^~\\n]+)~~', '<del>\\1</del>', 'g') AS text FROM documents")
def strict_strikethrough(spark, d):
    return docs(spark, d).select("doc_id", text.strict_strikethrough(odd(*STRIKES)).alias("text"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN 1 ELSE least(greatest(n_chars, 1), 1000) END::INTEGER AS span FROM documents")
def parse_span(spark, d):
    raw = (
        F.when(c("doc_id") % 5 == 0, "x").when(c("doc_id") % 5 == 1, "0").when(c("doc_id") % 5 == 2, "99999").when(c("doc_id") % 5 == 3, F.lit(None).cast("string"))
        .otherwise(c("n_chars").cast("string"))
    )
    return docs(spark, d).select("doc_id", text.parse_span(raw).alias("span"))


@query("SELECT doc_id, format('{:,}', n_chars * 1000 + doc_id) AS n FROM documents")
def format_number(spark, d):
    return docs(spark, d).select("doc_id", text.format_number(c("n_chars") * 1000 + c("doc_id")).alias("n"))


@query("SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS text FROM documents")
def split_run_lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<p>' || doc_id || '</p>' WHEN 1 THEN 'text ' || doc_id WHEN 2 THEN '[Deep Research: rendered in an embedded viewer that the page does not expose]' END AS content FROM documents""")
def widget_content_fallback(spark, d):
    n = c("doc_id").cast("string")
    html = F.when(c("doc_id") % 4 == 0, F.concat(F.lit(" <p>"), n, F.lit("</p>")))
    said = F.when(c("doc_id") % 4 == 1, F.concat(F.lit("text "), n)).otherwise("  ")
    name = F.when(c("doc_id") % 4 == 2, "internal://deep-research")
    return docs(spark, d).select("doc_id", artifacts.widget_fallback(html, said, name).alias("content"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars >= 80 WHEN 1 THEN doc_id % 200 >= 80 WHEN 2 THEN true ELSE false END AS diagram FROM documents""")
def drop_or_mark_diagrams(spark, d):
    size = F.when(c("doc_id") % 4 == 0, F.concat(c("n_chars").cast("string"), F.lit("px")))
    box = F.when(c("doc_id") % 4 == 1, F.concat(F.lit("0 0 "), (c("doc_id") % 200).cast("string"), F.lit(" 300")))
    label = F.when(c("doc_id") % 4 == 2, "A Chart of x").otherwise("icon")
    return docs(spark, d).select("doc_id", artifacts.is_diagram(size, size, box, label).alias("diagram"))


BLOCKS = ("paragraph", "heading", "code", "hr", "blockquote", "image", "list_item")
BLOCK_SQL = f"b AS (SELECT doc_id, list_extract(['paragraph', 'heading', 'code', 'hr', 'blockquote', 'image', 'list_item'], (doc_id % 7 + 1)::INTEGER) AS kind, {TITLE} AS text, (doc_id % 3 + 2)::INTEGER AS level, lang, 'https://x.example/' || doc_id AS url FROM documents)"


def blocks(spark, d):
    kind = F.element_at(F.array(*map(F.lit, BLOCKS)), (c("doc_id") % 7 + 1).cast("int"))
    return docs(spark, d).select(
        "doc_id", kind.alias("kind"), title().alias("text"), (c("doc_id") % 3 + 2).cast("int").alias("level"), "lang",
        F.concat(F.lit("https://x.example/"), c("doc_id").cast("string")).alias("url"),
    )


@query(f"""WITH {BLOCK_SQL} SELECT doc_id, CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || trim(text) WHEN 'code' THEN '```' || lang || {NL} || text || {NL} || '```' WHEN 'hr' THEN '---'
 WHEN 'blockquote' THEN '> ' || trim(text) WHEN 'image' THEN '![' || coalesce(nullif(text, ''), 'image') || '](' || url || ')' WHEN 'list_item' THEN repeat('  ', level) || '- ' || trim(text) ELSE trim(text) END AS block FROM b""")
def md_block(spark, d):
    return blocks(spark, d).select("doc_id", markdown.md_block(c("kind"), c("text"), c("level"), c("lang"), c("url")).alias("block"))


@query(f"""WITH {BLOCK_SQL} SELECT doc_id, CASE kind WHEN 'heading' THEN upper(trim(text)) || {NL} || repeat('-', least(length(trim(text)), 72)::INTEGER) WHEN 'hr' THEN repeat('-', 72) WHEN 'blockquote' THEN '  ' || trim(text)
 WHEN 'image' THEN '[Image: ' || coalesce(nullif(text, ''), 'image') || '] ' || url WHEN 'list_item' THEN repeat('  ', level) || '- ' || trim(text) ELSE trim(text) END AS block FROM b WHERE NOT contains(text, 'ß')""")
def txt_block(spark, d):
    # ß has an upper case of two letters in one engine and none in the other
    return blocks(spark, d).where(~c("text").contains("ß")).select("doc_id", markdown.txt_block(c("kind"), c("text"), c("level"), c("url")).alias("block"))


@query(f"""WITH {BLOCK_SQL}, e AS (SELECT *, {ESC.format('trim(text)')} AS t FROM b) SELECT doc_id, CASE kind WHEN 'heading' THEN '<h' || level || '>' || t || '</h' || level || '>'
 WHEN 'code' THEN '<pre><code class="language-' || lang || '">' || {ESC.format('text')} || '</code></pre>' WHEN 'hr' THEN '<hr>' WHEN 'blockquote' THEN '<blockquote>' || t || '</blockquote>'
 WHEN 'image' THEN '<img src="' || url || '" alt="' || t || '">' WHEN 'list_item' THEN '<li>' || t || '</li>' ELSE '<p>' || t || '</p>' END AS block FROM e""")
def html_block(spark, d):
    return blocks(spark, d).select("doc_id", markdown.html_block(c("kind"), c("text"), c("level"), c("lang"), c("url")).alias("block"))


@query("SELECT doc_id, repeat(' ', (length('-') + 1 + length(doc_id || '.') + 1)::INTEGER) AS indent FROM documents")
def md_list(spark, d):
    markers = F.array(F.lit("-"), F.concat(c("doc_id").cast("string"), F.lit(".")))
    return docs(spark, d).select("doc_id", markdown.md_list_indent(markers).alias("indent"))


@query("""WITH l AS (SELECT doc_id, string_split(text || chr(10) || chr(10) || 'x' || chr(10), chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l[1:len(l) - 1], lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)) || chr(10) AS quoted FROM l""")
def md_quote(spark, d):
    lines = F.split(F.concat(c("text"), F.lit("\n\nx\n")), "\n")
    return docs(spark, d).select("doc_id", F.array_join(markdown.md_quote(lines), "\n").alias("quoted"))


ARTIFACT = f"a AS (SELECT doc_id, {TITLE} AS title, CASE doc_id % 2 WHEN 0 THEN 'document' ELSE 'code' END AS kind, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS label, lang, text AS content FROM documents)"


def artifact_rows(spark, d):
    return docs(spark, d).select(
        "doc_id", title().alias("title"), F.when(c("doc_id") % 2 == 0, "document").otherwise("code").alias("kind"),
        F.when(c("doc_id") % 4 != 0, c("source")).alias("label"), "lang", c("text").alias("content"),
    )


@query(f"""WITH {ARTIFACT} SELECT doc_id, '#### ' || title || coalesce({NL} || '*Type: ' || label || '*', '') || {NL} || {NL} || CASE kind WHEN 'document' THEN content ELSE '```' || lang || {NL} || content || {NL} || '```' END AS section FROM a""")
def md_artifact(spark, d):
    return artifact_rows(spark, d).select("doc_id", markdown.md_artifact(c("title"), c("kind"), c("label"), c("lang"), c("content")).alias("section"))


@query(f"WITH {ARTIFACT} SELECT doc_id, '--- ' || title || ' ---' || coalesce({NL} || 'Type: ' || label, '') || {NL} || {NL} || content AS section FROM a")
def txt_artifact(spark, d):
    return artifact_rows(spark, d).select("doc_id", markdown.txt_artifact(c("title"), c("label"), c("content")).alias("section"))


@query(f"""WITH {ARTIFACT} SELECT doc_id, '<section><h4>' || {ESC.format('title')} || '</h4>' || coalesce('<p><em>' || {ESC.format('label')} || '</em></p>', '') ||
 CASE kind WHEN 'document' THEN '<div>' || {ESC.format('content')} || '</div>' ELSE '<pre><code class="language-' || lang || '">' || {ESC.format('content')} || '</code></pre>' END || '</section>' AS section FROM a""")
def html_artifact(spark, d):
    return artifact_rows(spark, d).select("doc_id", markdown.html_artifact(c("title"), c("kind"), c("label"), c("lang"), c("content")).alias("section"))


@query(f"WITH {ARTIFACT} SELECT doc_id, title FROM a WHERE kind = 'document'")
def prose_artifacts(spark, d):
    return artifact_rows(spark, d).where("kind = 'document'").select("doc_id", "title")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''")
def artifacts_with_content(spark, d):
    return artifact_rows(spark, d).where("content <> ''").select("doc_id", F.length("content").cast("long").alias("n"))
