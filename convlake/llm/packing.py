"""Best-fit packing of tokenized documents by minimum bin slack.

Documents are tokenized, ended by id 0 and, where longer than a sequence, cut.  Packing sees
only how many pieces there are of each length, a table of at most ``capacity`` rows however
large the corpus is.  For each bin, seeded with the longest piece left, a subset-sum table
(bitsets over the room that is left) finds the fullest combination of the lengths at hand.
The combination is removed as often as the counts allow, in one step.  The plan (one row per
combination and length) is bounded by the number of lengths too and is broadcast; each piece
finds its bin from its length and its number among the pieces of that length.

Edge cases: a null text is empty, and an empty one is the id 0 alone; repeated rows and null
ids are packed like others; texts of any length are cut; an empty table gives an empty table;
columns other than those named by the parameters aren't looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, cut, ship

CAPACITY = 2048
_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def encode_words(words: list[str], path: str, together: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words one after another, and each word's first place and number of ids.

    The tokenizer drops white space and never joins what it divides, so words can be encoded
    once each, many to a call; the offsets tell whose ids they are.
    """
    tokenizer = _tokenizer(path)
    ids, counts = [], np.zeros(len(words), np.int64)
    for at in range(0, len(words), together):
        some = words[at : at + together]
        done = tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids.append(np.array(done.ids, np.uint32))
        if done.ids:
            first = np.cumsum([0] + [len(w) + 1 for w in some[:-1]])
            begin = np.fromiter((o[0] for o in done.offsets), np.int64, len(done.ids))
            counts[at : at + len(some)] = np.bincount(np.searchsorted(first, begin, "right") - 1, minlength=len(some))
    return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum(counts) - counts, counts


class WordIds:
    """The ids of words met so far, in columns of ``most`` bytes and what one call adds; then it starts afresh.

    Words of more than ``longest`` letters are forgotten after use.
    """

    def __init__(self, path: str, most: int = 32 << 20, longest: int = 40) -> None:
        self.path, self.most, self.longest = path, most, longest
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def size(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.first.nbytes + self.count.nbytes

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first place in them and number of ids of each of ``words``, which differ."""
        if self.size() > self.most:
            self.clear()
        place = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(place)
        new = words.filter(missing)
        ids, first, count = encode_words(new.to_pylist(), self.path)
        place, missing = pc.fill_null(place, 0).to_numpy().astype(np.int64), missing.to_numpy(zero_copy_only=False)
        place[missing] = len(self.words) + np.arange(len(new))
        every = np.concatenate([self.ids, ids])
        starts, counts = np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.count, count])
        short = pc.less_equal(pc.utf8_length(new), self.longest)
        kept = short.to_numpy(zero_copy_only=False)
        self.ids = every if kept.all() else np.concatenate([self.ids, ids[np.repeat(kept, count)]])
        self.words, self.count = pa.concat_arrays([self.words, new.filter(short)]), np.concatenate([self.count, count[kept]]).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)
        return every, starts[place], counts[place]


def tokenized(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text (null: none), in order."""
    if ("words", path) not in _LOADED:
        _LOADED["words", path] = WordIds(path)
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = words.offsets.to_numpy()
    coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends, number = ends - ends[0], coded.indices.to_numpy()
    ids, first, count = _LOADED["words", path].look_up(coded.dictionary)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = number[a:b]
        n = count[own]
        yield ids[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def cut_pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc, text) to rows of pieces, numbered by length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for some in byte_slices(batches):
            rows, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(tokenized(some.column(1), path)):
                raw, total = ids.astype("<u4").tobytes() + b"\0\0\0\0", len(ids) + 1
                for k, a in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - a)
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + n)]))
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "in_part"],
            )

    return run


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length, with the combination of the others that leaves least room."""
    seed = max(counts)
    room, chosen = capacity - seed, {seed: 1}
    if not room:
        return chosen
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in sorted(counts, reverse=True):
        if n > room:
            continue
        for _ in range(min(counts[n] - (n == seed), room // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room:
            break
    left = reach.bit_length() - 1
    for n, before in reversed(steps):
        if not before >> left & 1:
            chosen[n] = chosen.get(n, 0) + 1
            left -= n
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, pieces a bin, first bin, offset of the first)."""
    counts = {k: v for k, v in counts.items() if v}
    used, rows, bins = dict.fromkeys(counts, 0), [], 0
    while counts:
        chosen = fullest(counts, capacity)
        times, offset = min(counts[n] // k for n, k in chosen.items()), 0
        for n, k in chosen.items():
            rows.append((n, used[n], used[n] + times * k, k, bins, offset))
            used[n] += times * k
            offset += n * k
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        bins += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = cut(
        narrow.mapInArrow(
            cut_pieces(tokenizer_path, capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part int, in_part long",
        )
    )
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.createDataFrame(
        plan_bins(counts, capacity) or [(0, 0, 0, 1, 0, 0)], "length long, a long, b long, k long, first long, base long"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts.hint("merge"), ["length", "part"]).withColumn("rank", F.col("shift") + F.col("in_part"))
    within = (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    return (
        ranked.alias("p").join(F.broadcast(plan.alias("q")), (F.col("p.length") == F.col("q.length")) & within)
        .select(
            "doc_id", "piece", "start", "p.length", "ids_crc32",
            (F.col("first") + F.expr("(rank - a) div k")).alias("sequence_id"),
            (F.col("base") + (F.col("rank") - F.col("a")) % F.col("k") * F.col("p.length")).alias("offset"),
        )
    )


def op2_packing(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(documents, public_tokenizers.path("word_bpe_49k.json"))
