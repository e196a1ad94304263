"""WARC archives: writing with revisit records, and reading back by boundary chains.

Writing: each row becomes a record; of rows with equal payloads, the one with the largest id
is a response, and the others revisit it.  The payload digests that occur more than once are
found on digests alone; payloads aren't shuffled unless these are too many to broadcast.

Reading: archives are split like any text, so a task sees bytes without knowing where records
begin.  Each task emits, for every place where the magic ``WARC/1.0`` stands, a candidate
record with the offset of its successor.  Of each file, these narrow rows (a few numbers for
each magic, no payloads) meet in a task, where pointer jumping from the start of the file keeps
the candidates that the chain of successors reaches, doubling the distance in every round;
magic inside payloads isn't on the chain.  Payloads that hold the magic are put together from
their pieces in a second scan, for those records only.

Edge cases: a null payload is empty; rows with a null id revisit a known one, or are responses
if their payload has no known id; rows that share both the largest id and the payload are all
responses; a null or broken url is written without line breaks, or left out; an empty table
gives archives without records and an empty result; payloads of any length are kept whole;
columns other than those named by the parameters aren't looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlake.llm.common import cut, shared_folder, ship

MAGIC = "WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of the usual base 32 and of RFC 4648.
DIGITS, RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: four times 40 bits, eight digits each."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, RFC)


def records(pages: DataFrame, page: str, url: str, payload: str, min_bytes: int, date: str, most: int = 200_000) -> DataFrame:
    """One column, value: the records of all rows, but for the last line feed."""
    rows = pages.select(
        F.col(page).cast("long").alias("page_id"), F.regexp_replace(F.col(url), r"[\r\n]+", "").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("n", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    told = rows.select("page_id", "digest", "n").where(F.col("n") >= min_bytes)
    several = cut(told.groupBy("digest").agg(F.count("*").alias("times"), F.max("page_id").alias("first")).where("times > 1").select("digest", "first"))
    several = F.broadcast(several) if several.count() <= most else several.hint("shuffle_hash")
    rows = rows.join(several, "digest", "left").withColumn(
        "refers", F.when((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )
    again = F.col("refers").isNotNull()
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")), line("X-Payload-Length", F.col("n").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("refers"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(again, "0").otherwise(F.col("n").cast("string"))), F.lit("\r\n"),
    )
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    return rows.select(F.concat(head, body, F.lit("\r\n\r")).alias("value"))


def write_warc(
    pages: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", records_a_file: int = 1000,
) -> None:
    """Archives of ``records_a_file`` records at most, written as plain bytes by Spark's own sink."""
    out = records(pages, page, url, payload, min_bytes, date)
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", records_a_file).mode("overwrite").text(path)


HEAD = re.compile(rb"\A((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n")


def parsed(piece: bytes) -> dict[str, str] | None:
    """The header fields of what follows a magic, with the header's length; None if it isn't one."""
    m = HEAD.match(piece)
    if not m:
        return None
    fields = dict(x.split(": ", 1) for x in m[1].decode("utf-8", "replace").split("\r\n")[:-1])
    if not fields.get("Content-Length", "").isdigit() or "WARC-Type" not in fields:
        return None
    return fields | {"head": str(m.end())}


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


PIECES = (
    "file string, split long, at long, used long, head long, length long, kind string, page_id long, digest string, "
    "payload_bytes long, refers_to long, found string"
)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (value, file, split), in the order of their split, to candidates with places in the split."""
    where, at = None, 0
    for batch in batches:
        out = []
        for value, file, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where != (file, split):
                where, at = (file, split), 0
            fields, used = parsed(value), len(value) + len(MAGIC)
            row = {"file": file, "split": split, "at": at, "used": used}
            if fields:
                head, length = int(fields["head"]), int(fields["Content-Length"])
                whole = len(value) >= head + length
                row |= {
                    "head": head, "length": length, "kind": fields["WARC-Type"], "page_id": number(fields.get("WARC-Record-ID")),
                    "digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                    "payload_bytes": int(fields.get("X-Payload-Length", length)), "refers_to": number(fields.get("WARC-Refers-To")),
                    "found": sha1(value[head : head + length]) if whole else None,
                }
            out.append(row)
            at += used
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = {"string": pa.string(), "long": pa.int64()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in out], types[x.split()[1]]) for n, x in zip(names, PIECES.split(", "), strict=True)], names
        )


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: (value, file, split), in order within each split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def on_chain(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which records the chain of successors reaches from offset 0, by pointer jumping.

    In each round, what is reached marks what its pointers lead to, and all pointers double.
    """
    n = len(offset)
    at = np.searchsorted(offset, successor)
    there = (at < n) & (offset[np.minimum(at, n - 1)] == successor)
    pointer = np.append(np.where(there, at, n), n)  # n: beyond the last record
    marked = np.append(offset == 0, False)
    while (pointer < n).any():
        marked[pointer[marked]] = True
        pointer = pointer[pointer]
    return marked[:n]


KEPT = "file string, offset long, successor long, head long, length long, kind string, page_id long, digest string, payload_bytes long, refers_to long, found string"


def chain(frame: pd.DataFrame) -> pd.DataFrame:
    """The records of one file among its pieces: places from the sizes of all pieces before."""
    frame = frame.sort_values(["split", "at"])
    frame["offset"] = frame["used"].cumsum() - frame["used"] - len(MAGIC)
    frame = frame[frame["kind"].notna()].copy()
    if not len(frame):
        return frame.reindex(columns=[x.split()[0] for x in KEPT.split(", ")])
    frame["successor"] = frame["offset"] + len(MAGIC) + frame["head"] + frame["length"] + 4
    reached = on_chain(frame["offset"].to_numpy(np.int64), frame["successor"].to_numpy(np.int64))
    return frame[reached][[x.split()[0] for x in KEPT.split(", ")]]


def put_together(frame: pd.DataFrame) -> pd.DataFrame:
    """The payload of one record from its pieces."""
    frame = frame.sort_values("p")
    data = MAGIC.encode().join(frame["value"])
    head, length = int(frame["head"].iloc[0]), int(frame["length"].iloc[0])
    return pd.DataFrame({"file": frame["file"].iloc[:1], "offset": frame["offset"].iloc[:1], "joined": [sha1(data[head : head + length])]})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, intact), one for each record."""
    ship(spark)
    found = cut(pieces(spark, path).mapInArrow(scan, PIECES))
    # narrow rows, without payloads: as many to a file as magics stand in it
    kept = cut(found.groupBy("file").applyInPandas(chain, KEPT))
    open_ones = kept.where("found IS NULL").select("file", "offset", "successor", "head", "length")
    joined = spark.createDataFrame([], "file string, offset long, joined string")
    if not open_ones.isEmpty():
        before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        bases = found.groupBy("file", "split").agg(F.sum("used").alias("all")).select(
            "file", "split", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base")
        )
        again = (
            pieces(spark, path).mapInArrow(place, "file string, split long, at long, value binary").join(bases.hint("shuffle_hash"), ["file", "split"])
            .withColumn("p", F.col("base") + F.col("at"))
        )
        inside = (F.col("a.file") == F.col("o.file")) & (F.col("p") > F.col("offset")) & (F.col("p") < F.col("successor"))
        own = again.alias("a").join(open_ones.alias("o").hint("shuffle_hash"), inside).select("o.file", "offset", "head", "length", "p", "value")
        joined = own.groupBy("file", "offset").applyInPandas(put_together, "file string, offset long, joined string")
    out = kept.join(joined.hint("merge"), ["file", "offset"], "left").withColumn("found", F.coalesce("found", "joined"))
    again = F.col("kind") == "revisit"
    return out.select(
        "page_id", "payload_bytes", F.when(again, F.col("digest")).otherwise(F.col("found")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to", (again | (F.col("found") == F.col("digest"))).alias("intact"),
    )


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their places in the split."""
    where, at = None, 0
    for batch in batches:
        places = []
        for n, file, split in zip(pa.compute.binary_length(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if where != (file, split):
                where, at = (file, split), 0
            places.append(at)
            at += n + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.int64()), batch.column(0)], ["file", "split", "at", "value"])


def op4_warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS s FROM p),
d AS (SELECT page_id, payload_bytes, translate(array_to_string(list_transform([1, 11, 21, 31],
  lambda i: to_base(('0x' || substr(s, i, 10))::BIGINT, 32, 8)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""
