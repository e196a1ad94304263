"""Mixing sources to target weights by systematic sampling.

A source with target T and size S wants T / S copies of each of its documents.  Walking the
source's documents from the largest, the prefix sums of the expected copies are shifted by
one random offset of the source, and a document is emitted once for each whole number that
its step crosses.  As the sizes fall along the walk, the words taken differ from the target
by less than the source's largest document.

Targets: sources, in the order of their code points (null last), weigh 5, 2, 1, 5, 2, ... and
share the words of all sources; a target stops at ``cap`` times its source's size, and the
excess is shared by weight among the rest.  That is a water level L with target =
min(cap x size, L x weight), found by one ordered pass over the sources.

Edge cases: a null text has size 0; documents of size 0 are emitted like others and take no
words; null sources are one source, the last; repeated rows and ties are walked in the order
of doc_id, rows alike in size and doc_id being interchangeable; an empty table gives an empty
table; further columns stay out of the sampling, and only ``mix`` returns them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import WORD, cut, unit

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """``sizes``: one row (source, source_size) for each source.  Adds weight and target.

    With the sources in the order in which a rising level fills them, each gives the level
    that would hold if just the sources before it were full; the highest of these holds.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    filling = Window.orderBy("__full_at", F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight.cast("double"))
        .withColumn("__full_at", cap * F.col("source_size") / F.col("weight"))
        .withColumn("__level", (F.sum("source_size").over(everything) - cap * full) / open_weight)
        .withColumn("target", F.least(cap * F.col("source_size"), F.max("__level").over(everything) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def systematic_copies(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0, seed: int = 0, buckets: int = 257
) -> DataFrame:
    """``sized``: rows (doc_id, source, size).  Adds source_size, target and copies.

    A document's place in the walk is found in three steps, each over an aggregate of the one
    before, so that no source, and no size within a source, has to fit in one task: places of
    sizes within the source, of parts (doc_id modulo ``buckets``) within the size, and of
    rows within the part.
    """
    sized = sized.select("doc_id", "source", "size")
    counted = cut(
        sized.groupBy("source", "size", "doc_id").agg(F.count("*").alias("__n"))
        .withColumn("__b", F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.lit(-1)))
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("source", "size", "__b").agg(F.sum("__n").alias("__n"))
    levels = parts.groupBy("source", "size").agg(F.sum("__n").alias("__n"))
    sizes = levels.groupBy("source").agg(F.sum(F.col("size") * F.col("__n")).alias("source_size"))
    same = lambda a, b, *on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    places = (
        levels.withColumn("__p", F.coalesce(F.sum("__n").over(before(Window.partitionBy("source").orderBy(F.desc("size")))), F.lit(0)))
        .alias("l")
        .join(source_targets(sizes, weights, cap).hint("shuffle_hash").alias("t"), same("l", "t", "source"))
        .select("l.source", "l.size", "l.__p", "t.source_size", "t.target")
    )
    parts = (
        parts.withColumn("__q", F.coalesce(F.sum("__n").over(before(Window.partitionBy("source", "size").orderBy("__b"))), F.lit(0)))
        .alias("p")
        .join(places.hint("merge").alias("l"), same("p", "l", "source", "size"))
        .select("p.source", "p.size", "p.__b", (F.col("l.__p") + F.col("p.__q")).alias("__q"), "l.source_size", "l.target")
    )
    in_part = Window.partitionBy("source", "size", "__b").orderBy("doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((F.col("__i") + 1) * F.col("__r") + F.col("__u")) - F.floor(F.col("__i") * F.col("__r") + F.col("__u"))
    return (
        counted.withColumn("__f", F.coalesce(F.sum("__n").over(before(in_part)), F.lit(0)))
        .alias("c")
        .join(parts.hint("merge").alias("p"), same("c", "p", "source", "size", "__b"))
        .select(
            "c.doc_id", "c.source", "c.size", "p.source_size", "p.target",
            F.explode(F.sequence(F.col("p.__q") + F.col("c.__f"), F.col("p.__q") + F.col("c.__f") + F.col("c.__n") - 1)).alias("__i"),
        )
        .withColumn("__r", rate)
        .withColumn("__u", unit(F.lit(seed), F.col("source")))
        .select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))
    )


def op5_mixing(documents: DataFrame) -> DataFrame:
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return systematic_copies(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """The mixed documents themselves: each as often as it was emitted, all columns kept.

    Rows alike in (doc_id, source, size) share the copies of their places; only such rows are
    numbered among themselves, in the order of their texts' hashes.
    """
    keys = ["doc_id", "source", "size"]
    counts = systematic_copies(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), weights, cap, seed)
    pooled = counts.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # the caller's columns travel in one struct, so that no name can meet one of those here
    named = documents.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    found = (
        named.alias("d")
        .join(
            pooled.hint("shuffle_hash").alias("c"),
            F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")),
        )
        .select("d.*", F.col("c.copies").alias("copies"), F.col("c.rows").alias("rows"))
        .where("copies > 0")
    )
    alone = found.where("rows = 1").select("doc", F.col("copies").alias("times"))
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("hash"))
    times = F.expr("copies div rows") + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")
    alike = found.where("rows > 1").withColumn("place", place).select("doc", times.alias("times")).where("times > 0")
    return alone.unionByName(alike).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc.*")


OP5_SQL = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, list_extract(list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE), (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight FROM s),
f AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - 3.0::DOUBLE * coalesce((sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
  / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l),
i AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS r,
    (('0x' || md5('0:' || coalesce(d.source, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, CASE WHEN d.doc_id IS NULL THEN -1 ELSE (d.doc_id % 257 + 257) % 257 END, d.doc_id) - 1 AS i
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor((i + 1) * r + u) - floor(i * r + u))::BIGINT AS copies FROM i)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
