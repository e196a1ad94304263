"""URL filtering by a cascade of Bloom filters.

The keys of a url are its host and each parent domain, each followed by the starts of its
path that are as long as a rule's path.  The rule keys are put into a first filter; the keys
of the corpus that pass it without being rules (its false positives) into a second one; the
rule keys that pass the second into a third; and so on, until a level has no false positives
over the corpus's complete set of keys.  A key of the corpus is a rule if and only if the
first level that it doesn't pass has an even number (counting from 1), so membership is exact
and asking takes no join: the filters are constants of the expression.

Sizes are bounded: the first filter is sharpened until it has no more false positives than
rules (down to 2 ** -30), so a cascade takes at most seven bytes for a rule.  Lists that would take
more than ``max_bytes`` are dealt into slices by a hash of the key, each with a cascade of its
own over the keys of that slice; one cascade is held at a time.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule;
repeated urls get the same answer; an empty table gives an empty table; other columns are
kept, unless they have the name of an output column, which then replaces them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm.common import cut, shared_folder

#: (host, path, verdict) of the query's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ABC, ABC_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 7  # of a byte: so that the byte, read as text, is one ASCII character
SHARPEST = 2.0**-30
BYTES_A_RULE = 7  # a first level of SHARPEST and the levels after it, which halve


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them out."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ABC, ABC_LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """All keys under which a rule for this url can be listed."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    starts = F.array_distinct(F.array(*(F.substring(path, 1, n) for n in path_lengths)))
    keys = F.flatten(F.transform(parents, lambda h: F.transform(starts, lambda p: F.concat(h, F.lit("\n"), p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def _positions(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(size)) for i in range(hashes)]


class Level:
    """One Bloom filter, its bits packed seven to a byte."""

    def __init__(self, number: int, keys: DataFrame, count: int, fpp: float) -> None:
        self.number = number
        self.size = max(BITS, math.ceil(-count * math.log(fpp) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(count, 1) * math.log(2)))
        self.hashes = min(self.hashes, 30)
        position = F.explode(F.array(*_positions(F.col("key"), number, self.size, self.hashes)))
        word = 8 * BITS
        rows = (
            keys.select(position.alias("p"))
            .groupBy((F.col("p") / word).cast("long").alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % word).cast("int"))).alias("bits"))
            .collect()  # at most size / 56 rows, and the size was checked
        )
        packed = bytearray(-(-self.size // word) * 8)
        for r in rows:
            for i in range(8):
                packed[r["word"] * 8 + i] = r["bits"] >> (BITS * i) & (2**BITS - 1)
        self.packed = bytes(packed)

    def passes(self, key: Column) -> Column:
        bits = F.lit(bytearray(self.packed))
        out = F.lit(True)
        for p in _positions(key, self.number, self.size, self.hashes):
            byte = F.ascii(F.substring(bits, (F.floor(p / BITS) + 1).cast("int"), F.lit(1)).cast("string"))
            out = out & (F.call_function("shiftright", byte, (p % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (frames with one column, key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, first_fpp: float = 1 / 4096) -> None:
        listed = cut(listed.select("key").distinct())
        self.count, fpp = listed.count(), first_fpp
        self.levels: list[Level] = []
        inside, outside, count = listed, universe, self.count
        while count:
            level = Level(len(self.levels), inside, count, fpp)
            wrong = outside.select("key").where(level.passes(F.col("key"))).distinct()
            if not self.levels:  # a pass over the whole universe
                wrong = wrong.join(listed.hint("shuffle_hash"), "key", "left_anti")
            wrong = cut(wrong)
            found = wrong.count()
            if not self.levels and found > self.count and fpp > SHARPEST:
                fpp = max(SHARPEST, fpp * self.count / found / 2)
                continue
            self.levels.append(level)
            inside, outside = wrong, inside
            count, fpp = found, 0.5

    def contains(self, key: Column) -> Column:
        """One even level not passed: listed; one odd level not passed: not listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.passes(key), out).otherwise(F.lit(level.number % 2 == 1))
        return out


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows.cast("array<struct<host:string,path:string,verdict:string>>")))


def longest(keys: Column) -> Column:
    """The longest of the keys as a struct; null if there is none."""
    return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))


def by_slices(base: DataFrame, said: DataFrame, slices: int) -> DataFrame:
    """``base`` with __best and __verdict, by one cascade for each slice of the keys and each verdict.

    The keys are written once, by slice, so a cascade reads its own slice only; of a slice, only the
    keys that are rules go on to the rows.
    """
    spark = base.sparkSession
    rows = cut(base.withColumn("__row", F.monotonically_increasing_id()))
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(slices)).cast("int")
    path = f"{shared_folder(spark).rstrip('/')}/keys-{uuid.uuid4().hex}"
    rows.select("__row", F.explode("__keys").alias("key")).withColumn("part", part).write.partitionBy("part").parquet(path)
    keys, said = spark.read.schema("__row long, key string, part int").parquet(path), cut(said.withColumn("part", part))
    hits = rows.limit(0).select("__row", F.lit("").alias("key"), F.lit("").alias("verdict"))
    for i in range(slices):
        own = keys.where(F.col("part") == i)
        for v in ("allow", "block"):
            cascade = Cascade(said.where((F.col("part") == i) & (F.col("verdict") == v)), own)
            if cascade.count:
                hits = hits.unionByName(cut(own.where(cascade.contains(F.col("key"))).select("__row", "key", F.lit(v).alias("verdict"))))
    # a rule listed with both verdicts allows, as in one cascade
    best = F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("k"), (F.col("verdict") == "allow").alias("a")))
    found = hits.groupBy("__row").agg(best.alias("__best"))
    return rows.join(found.hint("merge"), "__row", "left").drop("__row").withColumn(
        "__verdict", F.when(F.col("__best.a"), "allow").when(~F.col("__best.a"), "block")
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, default: str = "allow", max_bytes: int = 1 << 21
) -> DataFrame:
    """Add host, path, rule and verdict to ``pages`` (which has a column url).

    ``rules``: (host, path, verdict), as tuples or, if there are many, as a table.  The longest listed
    key of a url is its rule; a url without one gets ``default``.  One cascade for each verdict
    tells what the rule says.
    """
    if not isinstance(rules, DataFrame):
        rules = rules_frame(pages.sparkSession, rules)
    said = cut(rules.select(F.concat("host", F.lit("\n"), "path").alias("key"), F.length("path").alias("n"), "verdict").distinct())
    lengths = sorted(r["n"] for r in said.where("key IS NOT NULL").select("n").distinct().collect()) or [0]
    host, path = url_parts(F.col("url"))
    base = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    base = base.withColumn("__keys", url_keys(F.col("host"), F.col("path"), lengths))
    n = said.count()
    slices = min(n, -(-n * BYTES_A_RULE // max(max_bytes, 1)))
    if slices > 1:
        out = by_slices(base, said, slices)
    else:
        universe = base.select(F.explode("__keys").alias("key"))
        cascade = {v: Cascade(said.where(F.col("verdict") == v), universe) for v in ("allow", "block")}
        best = lambda v: longest(F.filter("__keys", cascade[v].contains))
        out = base.withColumn("__a", best("allow")).withColumn("__b", best("block")).withColumn(
            "__best", F.greatest("__a", "__b")
        ).withColumn("__verdict", F.when(F.col("__a") == F.col("__best"), "allow").when(F.col("__b") == F.col("__best"), "block"))
    return out.withColumn("rule", F.replace(F.col("__best.k"), F.lit("\n"), F.lit(""))).withColumn(
        "verdict", F.coalesce("__verdict", F.lit(default))
    ).drop("__keys", "__a", "__b", "__best", "__verdict")


def op10_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM u),
f AS (SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.n = f.n
"""
