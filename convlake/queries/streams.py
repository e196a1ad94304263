"""Queries of the streaming operators, on ``events`` and ``conversations``; ``stream_pairing`` runs as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.operators import widgets
from convlake.queries.turns import REPORT_SQL, reports
from convlake.registry import query
from convlake.session import shared_folder
from convlake.sources.tables import read_pages, read_table, read_turns
from convlake.streaming import captures

c = F.col
BURSTS = """b AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM b)"""


@query(f"WITH {BURSTS} SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS updates, arg_max(value, ts) AS value FROM s GROUP BY user_id, burst")
def settled_snapshots(spark, d):
    return captures.settled_snapshots(read_table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "1 hour")


@query("SELECT event_id, user_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f FROM events) WHERE ts <= f + INTERVAL 86400 SECOND")
def observe_deadline(spark, d):
    return captures.observe_deadline(read_table(spark, d, "events"), "user_id", 86_400).select("event_id", "user_id")


@query("""SELECT page_id, CASE WHEN h > 0 AND h <= 600000 AND NOT (t > 0 AND x < t * 0.5) THEN 'html' WHEN t > 0 AND t <= 200000 THEN 'text' END AS tier FROM (
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 700000 ELSE length(html) END AS h, CASE page_id % 3 WHEN 0 THEN 10 ELSE length(html) END AS x, CASE WHEN page_id % 5 = 0 THEN 300000 ELSE length(html) END AS t FROM pages)""")
def choose_capture_tier(spark, d):
    n = F.length("html")
    h = F.when(c("page_id") % 4 == 0, 0).when(c("page_id") % 4 == 1, 700_000).otherwise(n)
    tier = captures.choose_capture_tier(h, F.when(c("page_id") % 3 == 0, 10).otherwise(n), F.when(c("page_id") % 5 == 0, 300_000).otherwise(n))
    return read_pages(spark, d).select("page_id", tier.alias("tier"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[a-z.-]*\.example\.com/') AND page_id % 4 <> 1 AND page_id % 6 <> 0 AND page_id % 10 <> 0")
def trusted_origin(spark, d):
    p = read_pages(spark, d)
    relayed = p.select(
        "page_id", "url", c("url").alias("origin"), F.when(c("page_id") % 4 == 1, "other").otherwise("report").alias("type"),
        F.when(c("page_id") % 6 != 0, c("html")).alias("html"), F.lit(None).cast("string").alias("text"), c("page_id").alias("frame_id"),
    )
    frames = p.where("page_id % 10 <> 0").select(c("page_id").alias("frame_id"))
    return captures.trusted_origin(relayed, frames, r"^https://[a-z.-]*\.example\.com/", "report").select("page_id", "url")


@query(f"{REPORT_SQL} SELECT fingerprint, arg_min(conv_id, (day, conv_id)) AS conv_id FROM g GROUP BY fingerprint")
def stream_drift_dedupe(spark, d):
    r = reports(spark, d).withColumn("ts", c("day").cast("timestamp"))
    return captures.stream_drift_dedupe(r).select("fingerprint", "conv_id")


def run_stream(out: DataFrame, spark: SparkSession) -> DataFrame:
    """Run an append stream over what is there, and read its sink."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("""WITH l AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nc FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pair_index, turn, text AS question, CASE WHEN nr = 'assistant' THEN nc ELSE '' END AS answer FROM l WHERE role = 'user' AND nr IS NOT NULL""")
def stream_pairing(spark, d):
    schema = read_table(spark, d, "conversations").schema
    # a pattern, as a stream's plain path has to be a folder
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]").select("conv_id", "turn", "role", c("text").alias("content"))
    return run_stream(captures.stream_pairing(stream), spark)


@query("""SELECT conv_id || '-' || turn AS message_id, 0 AS part, 0 AS ordinal, 'paragraph' AS type, trim(text) AS text FROM conversations
UNION ALL SELECT conv_id || '-' || turn, 1, 0, 'paragraph', '[Web Search: ' || turn || ']' FROM conversations WHERE turn % 4 = 1""")
def structured_messages(spark, d):
    """Every other turn came as html, whose blocks are its lines put together."""
    key = F.concat("conv_id", F.lit("-"), "turn")
    t = read_turns(spark, d).withColumn("message_id", key)
    blocks = t.where("turn % 2 = 0").select("message_id", F.lit(0).alias("ordinal"), F.lit("paragraph").alias("type"), F.trim("content").alias("text"))
    marks = t.where("turn % 4 = 1").select("message_id", F.lit(0).alias("ordinal"), F.concat(F.lit("[Web Search: "), "turn", F.lit("]")).alias("text"))
    return widgets.structured_messages(t.select("message_id", "content"), blocks, marks)
