"""Target-distribution importance resampling by bit-sliced aggregation.

Texts are taken apart into words and the runs of these, hashed into ``BUCKETS`` buckets.  A bucket's gain
compares how often it stands in the target and in the corpus, in thousandths of a natural logarithm.  A
document's weight is the mean gain of its features, summed without a multiplication: the counts of its
buckets are bit planes (plane j has the buckets whose count has bit j), and so are the gains, those above
and those below zero apart.  The number of ones of the AND of two planes, times a power of two, is the
share of that pair of bits, and their sum is exact.  Documents are then drawn without replacement: the
highest weights plus Gumbel noise, which comes from a hash of the id.

Counts are summed in tasks and leave them as a row for each bucket.  The draw's bound is found from counts
of scores, which are bounded whole numbers; only drawn rows are sorted, and their ranks come from the sizes
of the sorted partitions, so neither a window nor a task holds them all.

Edge cases: a null or empty text has no features and weight 0; texts of any length are read whole, in
pieces; a null id hashes as the text ``null`` and comes last among equal scores; rows with equal ids have
equal noise, and equal rows get ranks of their own; an empty corpus gives an empty table, an empty target
counts as zero in all buckets; columns other than those named by the parameters aren't looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, cut, ship

BUCKETS = 10_000
#: Bytes of words after this: letters in lower case, anything else of ASCII that isn't a digit a space.
TO_WORDS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class Bucket(dict):
    """The bucket of each feature met so far; forgets all beyond ``most``, and keeps no long ones."""

    def __init__(self, buckets: int, most: int = 100_000, longest: int = 48) -> None:
        super().__init__()
        self.buckets, self.most, self.longest = buckets, most, longest

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[feature] = bucket
        return bucket


def word_pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    spaced, at = text.translate(TO_WORDS), 0
    while at < len(spaced):
        end = spaced.find(b" ", at + size)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def features(text: bytes, runs: tuple[int, int]) -> Iterator[tuple[list[bytes], int]]:
    """Features of a text with the number of words that are new in them, some at a time."""
    shortest, longest = runs
    before: list[bytes] = []
    for words in word_pieces(text):
        joined, old = before + words, len(before)
        found = words if shortest == 1 else []
        for n in range(max(shortest, 2), longest + 1):
            # those that end in a new word
            found = found + [b" ".join(joined[i - n : i]) for i in range(max(n, old + 1), len(joined) + 1)]
        yield found, len(words)
        before = joined[len(joined) - longest + 1 :] if longest > 1 else []


def counted(texts: pa.Array, runs: tuple[int, int], of: Bucket, together: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, counts of each bucket, words) of ``together`` texts at a time."""
    for at in range(0, len(texts), together):
        some = texts.slice(at, together).to_pylist()
        counts, words = np.zeros((len(some), of.buckets), np.int64), np.zeros(len(some), np.int64)
        for i, text in enumerate(some):
            for found, n in features(text or b"", runs):
                words[i] += n
                if found:
                    counts[i] += np.bincount(np.fromiter(map(of.__getitem__, found), np.int64, len(found)), minlength=of.buckets)
        yield at, counts, words


def plane(bits: np.ndarray) -> np.ndarray:
    """Rows of true and false as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def signed_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(power of two with its sign, plane) of the gains."""
    out = []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        out += [(sign << k, plane(size >> k & 1 == 1)) for k in range(int(size.max(initial=0)).bit_length())]
    return out


def gain_sums(counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each row of counts, the sum of count times gain."""
    most, sums = counts.max(axis=1, initial=0), np.zeros(len(counts), np.int64)
    for j in range(int(most.max(initial=0)).bit_length()):
        has = np.flatnonzero(most >> j)  # rows without this bit and those above are done
        bits = plane(counts[has] >> j & 1 == 1)
        for power, gain in planes:
            sums[has] += (np.bitwise_count(bits & gain).sum(axis=1, dtype=np.int64) << j) * power
    return sums


def bucket_totals(table: DataFrame, text: str = "text", runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of each bucket stand in all texts."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, np.int64), Bucket(buckets)
        for some in byte_slices(batches):
            for _, counts, _ in counted(some.column(0), runs, of):
                total += counts.sum(axis=0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    by_task = table.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for r in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much more often the target has a bucket, with one added to each count."""
    n = len(target)
    t, s = float(target.sum() + n), float(corpus.sum() + n)
    return np.array([math.floor(1000 * math.log(float(a + 1) * s / (float(b + 1) * t))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc: str = "doc_id", text: str = "text", runs: tuple[int, int] = (1, 1)) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the floored mean gain of a text's features."""
    ship(docs.sparkSession)
    planes, buckets = signed_planes(gain), len(gain)  # some 40 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Bucket(buckets)
        for some in byte_slices(batches):
            for at, counts, words in counted(some.column(1), runs, of):
                n = counts.sum(axis=1)
                weight = gain_sums(counts, planes) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).slice(at, len(n)), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"]
                )

    narrow = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, eligible: Column, percent: int, width: int = 256) -> DataFrame:
    """Add ``rank`` to a written table with ``doc_id``, ``score`` and ``row``: 1, 2, 3... of the ``percent`` % of eligible rows that are drawn."""
    able = scored.where(eligible)
    coarse = {r["b"]: r["count"] for r in able.groupBy(F.floor(F.col("score") / width).alias("b")).count().collect()}  # bounded by the scores' range
    n = percent * sum(coarse.values()) // 100
    if not n:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    above, b = 0, max(coarse)
    while above + coarse.get(b, 0) < n:
        above, b = above + coarse.get(b, 0), b - 1
    fine = {r["score"]: r["count"] for r in able.where(F.floor(F.col("score") / width) == b).groupBy("score").count().collect()}  # ``width`` rows at most
    bound = (b + 1) * width - 1
    while above + fine.get(bound, 0) < n:
        above, bound = above + fine.get(bound, 0), bound - 1
    among = F.coalesce(eligible & (F.col("score") >= bound), F.lit(False))
    # sorted, each partition's rows count on from those before it; ``row`` keeps equal rows from meeting in one task
    order = cut(scored.where(among).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"))
    order = order.withColumn("__m", F.monotonically_increasing_id())
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["count"] for r in order.groupBy(part.alias("p")).count().collect()}  # a row for each partition
    parts = sorted(sizes)
    before = dict(zip(parts, np.cumsum([0, *(sizes[p] for p in parts)]).tolist(), strict=False))
    shifts = scored.sparkSession.createDataFrame(list(before.items()), "__p long, __before long")
    ranked = order.withColumn("__p", part).join(F.broadcast(shifts), "__p").withColumn("rank", F.col("__before") + place + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).select(*scored.columns, "rank")
    return scored.where(~among).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank), one for each document; ``rank`` is null where it isn't drawn."""
    gain = gains(bucket_totals(target, runs=runs, buckets=buckets), bucket_totals(docs, runs=runs, buckets=buckets))
    scored = weighed(docs, gain, runs=runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(cut(scored.withColumn("row", F.monotonically_increasing_id())), F.col("n_words") >= least_words, percent).drop("row")


def op11_importance(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


#: The table of the CRC comes from its rule, eight shifts a byte.
OP11_SQL = r"""
WITH RECURSIVE steps(byte, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM steps WHERE k = 8),
low AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM low),
counted AS (SELECT side, r, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295)::BIGINT % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counted), crc),
totals AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t
  FROM counted JOIN hashed USING (w) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS sum_s, coalesce(sum(t), 0) AS sum_t FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum_s + 10000) / ((s + 1) * (sum_t + 10000))))::BIGINT AS gain FROM totals, whole),
summed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain) AS total FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
weighed AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
    ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS h
  FROM (SELECT * FROM low WHERE side = 'd') LEFT JOIN summed USING (r)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM ranked
"""
