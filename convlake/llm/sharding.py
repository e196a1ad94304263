"""Sharding by weighted rendezvous hashing of record keys.

Each (key, shard) pair draws an exponential variate whose rate is the shard's weight, from
a hash of the two; the smallest draw wins.  A shard of weight w therefore gets a share
w / sum(weights) of the keys, and adding a shard moves only the keys that the new shard
wins: all other draws stay as they were.

Edge cases: a null key is one more key (all such rows share a shard); repeated keys share a
shard; an empty table gives an empty table; texts play no part in the choice, so null, empty
and very long ones need no care; columns of the input are kept, unless they have the name of
an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import cut, hash52, unit


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) that ``key`` goes to; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one at least must be above 0")
    draws = [
        F.struct((-F.log(unit(key, F.lit(s))) / F.lit(float(w))).alias("draw"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return F.array_min(F.array(*draws))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Add ``shard`` and, if ``grown`` weights are given, ``grown_shard``.  No shuffle."""
    out = df.withColumn("shard", rendezvous_shard(F.col(f"`{key}`"), weights))
    if grown is not None:
        out = out.withColumn("grown_shard", rendezvous_shard(F.col(f"`{key}`"), grown))
    return out


def gapless_slots(df: DataFrame, group: str, key: str, buckets: int = 1024) -> DataFrame:
    """Number the rows of each ``group`` value from 0 without gaps, as ``slot``.

    ``df`` should hold narrow columns only.  Rows are first counted by all their columns, so
    that any number of repeated rows costs one; each group is then dealt into ``buckets``
    parts by a hash of ``key``, numbered apart and shifted by the sizes of the parts before.
    The table of shifts has at most groups x buckets rows, which is why it is broadcast.
    """
    columns = [c for c in df.columns if c != "slot"]
    counted = cut(
        df.groupBy(*columns).agg(F.count("*").alias("__n")).withColumn("__b", hash52(F.col(key)) % F.lit(buckets))
    )
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counted.groupBy(group, "__b")
        .agg(F.sum("__n").alias("__part"))
        .select(group, "__b", F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__shift"))
    )
    inside = (
        Window.partitionBy(group, "__b")
        .orderBy(*(F.col(c).asc_nulls_first() for c in [key, *(c for c in columns if c not in (key, group))]))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        counted.withColumn("__first", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .join(F.broadcast(shifts), [group, "__b"])
        .select(
            *columns,
            F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)).alias("__slot"),
            "__shift",
        )
        .select(*columns, (F.col("__slot") + F.col("__shift")).cast("long").alias("slot"))
    )


def op1_sharding(documents: DataFrame, shards: int = 8, buckets: int = 1024) -> DataFrame:
    """All documents in ``shards`` shards of equal weight, with the shard if there were one more."""
    sized = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    out = assign_shards(sized, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    return gapless_slots(out, "shard", "doc_id", buckets).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


#: The table of the CRC comes from its rule, eight shifts a byte.
OP1_SQL = """
WITH RECURSIVE steps(byte, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc),
drawn AS (
  SELECT *, list_transform(range(9), lambda s: -ln((('0x' || md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS d,
    ('0x' || md5(coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT % 1024 AS b
  FROM sized),
placed AS (
  SELECT doc_id, size, text_crc32, b, (list_position(d[1:8], list_min(d[1:8])) - 1)::INTEGER AS shard,
    (list_position(d, list_min(d)) - 1)::INTEGER AS grown_shard FROM drawn)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY b, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""
