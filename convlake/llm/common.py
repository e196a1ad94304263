"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.session import byte_slices, ship  # noqa: F401

#: Words of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a local session names none (tests) is a temporary one set; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="convlake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    What follows neither recomputes ``df`` nor depends on the executor that made it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hash52(*parts: Column) -> Column:
    """A hash of 52 bits of the parts, joined by ``:``; any SQL engine with md5 can repeat it."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from :func:`hash52`."""
    return (hash52(*parts).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a table, counted: text and binary by length, arrays, structs and numbers by 8 bytes for each value."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        if kind.startswith("array"):
            return F.coalesce(F.size(name), F.lit(0)) * 8 + 16
        return F.lit(8 * (1 + kind.count(",")))

    widths = [width(name, kind) for name, kind in df.dtypes]
    r = df.agg(F.count("*").alias("n"), F.sum(sum(widths[1:], widths[0]).cast("long") + 16).alias("size")).first()
    return r["n"], r["size"] or 0


def near(df: DataFrame, small: DataFrame, on: list[str], how: str, most: int = 16 << 20) -> DataFrame:
    """Join with ``small`` broadcast if it has ``most`` bytes at most, and shuffled otherwise."""
    return df.join(F.broadcast(small) if size_of(small)[1] <= most else small.hint("shuffle_hash"), on, how)


def join_hot(df: DataFrame, groups: DataFrame, on: str, n: str, hot: int = 10_000, most: int = 4 << 20) -> DataFrame:
    """Inner join of ``df`` with ``groups``, which has one row for each key and its number of rows of ``df`` in ``n``.

    Groups of ``most`` bytes at most are broadcast.  Of larger tables, keys that hold at least one
    ``hot``-th of all rows, of which there are ``hot`` at most however large the table is, are broadcast,
    and the others shuffled.  So no key is in one task alone.
    """
    groups, added = cut(groups), [c for c in groups.columns if c not in (on, n)]
    if size_of(groups)[1] <= most:
        return df.join(F.broadcast(groups.drop(n)), on).select(*df.columns, *added)
    total = groups.agg(F.sum(n)).first()[0]
    often = groups.where(F.col(n) * hot >= total).drop(n)
    marked = df.join(F.broadcast(often.withColumn("__hot", F.lit(True))), on, "left")
    rest = marked.where("__hot IS NULL").select(*df.columns).join(groups.where(F.col(n) * hot < total).drop(n).hint("merge"), on)
    return marked.where("__hot").select(*df.columns, *added).unionByName(rest.select(*df.columns, *added))


def sample_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of the smallest hashes of ``key``, ``most`` at most and not many fewer; all rows if there are no more.

    The bound on the hash is found from counts, so only the rows of the sample ever leave the tasks.
    A key that is repeated is in the sample with all its rows or not at all.
    """
    total = df.count()
    if total <= most:
        return df
    bins, share = 256, min(1.0, 2 * most / total)
    place = F.floor(unit(F.col(key)) * F.lit(bins / share))
    counts = {r["bin"]: r["count"] for r in df.where(place < bins).groupBy(place.alias("bin")).count().collect()}
    bound, held = 0, 0
    while bound < bins and held + counts.get(bound, 0) <= most:
        held += counts.get(bound, 0)
        bound += 1
    return df.where(place < bound) if held else df.where(place < bins).limit(most)
