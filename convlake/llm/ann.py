"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors is joined to its nearest neighbours, and that graph is divided
into parts of nearly equal size: parts grown around centres are improved by moving vectors to
where most of their neighbours are, as long as there is room.  A softmax classifier learns
which part a vector belongs to.  Every row goes to its most probable part, every query to several
of its most probable ones, where its candidates are ranked by their exact inner products.  How
many parts are asked is measured: as few as find ``recall`` of the true neighbours, by brute
force over the whole table, of sampled vectors that the classifier wasn't fitted on.  Vectors
without any structure need most parts for that, and structured ones few.  A query that finds
fewer than ``k`` candidates in its parts is asked in all parts.

Fitted on ``sample`` rows and measured on ``held_out`` more at most (those of the smallest
hashes of their ids); every row is indexed and every query answered.  The number of parts grows
with the square root of the number of rows, up to a 32nd of the sample.  Parts of successive numbers
are worked together in zones, of which a query asks about ``zones_asked`` however many parts there are.
A task holds about ``block`` queries, lets at most ``stretch`` rows of a zone pass by and tells the
``k`` best for each query; a zone with far more rows than the mean is spread over several tasks.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; equal scores go by the smaller id; repeated rows are
candidates each (a row isn't its own candidate: rows with the query's id are left out) and one
query for each id, with the first of its vectors in order if they differ;
fewer candidates than ``k`` give fewer rows; an empty table gives an empty table; columns
other than those named by the parameters aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import cut, sample_by_hash, ship, unit


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest others of each row, by inner product, in blocks."""
    out = np.empty((len(x), min(degree, max(len(x) - 1, 0))), int)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 0, rounds: int = 4, slack: float = 1.1) -> np.ndarray:
    """A part for each row: few edges between parts, no part over ``slack`` times the mean."""
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * len(x) / parts))
    centre = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(rounds):
        s = x @ centre.T
        part, left = np.full(len(x), -1), np.full(parts, room)
        # the rows that are surest of their part choose first; who finds it full goes on to the next
        order = np.argsort(-s.max(1))
        ranked = np.argsort(-s, axis=1)
        for i in order:
            for p in ranked[i]:
                if left[p]:
                    part[i], left[p] = p, left[p] - 1
                    break
        for p in range(parts):
            if (own := part == p).any():
                centre[p] = x[own].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    size = np.bincount(part, minlength=parts)
    for _ in range(3):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        best = votes.argmax(1)
        gain = votes.max(1) - votes[np.arange(len(x)), part]
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                part[i] = best[i]
                size[part[i]] += 1
    return part


class Router:
    """A softmax classifier from vectors to parts, fitted on the divided sample."""

    def __init__(self, x: np.ndarray, parts: int, degree: int = 20, steps: int = 60, seed: int = 0) -> None:
        self.parts = parts
        unit_x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        graph = neighbour_graph(unit_x, degree)
        part = balanced_parts(unit_x, graph, parts, seed)
        # what a row should be routed to: the parts of its neighbours and its own
        goal = np.zeros((len(x), parts))
        np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        goal[np.arange(len(x)), part] += 1
        goal /= goal.sum(1, keepdims=True)
        self.w, self.b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        for step in range(steps):
            p = self.probabilities(x)
            rate = 4.0 * np.sqrt(x.shape[1]) * (1 - step / steps)
            self.w -= rate * (unit_x.T @ (p - goal) / len(x) + 1e-5 * self.w)
            self.b -= 0.1 * rate * (p - goal).mean(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ self.w + self.b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probes_for(self, recall: float, held: np.ndarray, nearest: list[np.ndarray]) -> int:
        """The least number of parts that hold ``recall`` of the neighbours, whose parts are ``nearest``, of the rows of ``held``."""
        place = np.argsort(self.first(held, self.parts), axis=1)  # where in a row's order each part stands
        at = np.concatenate([place[i, parts] for i, parts in enumerate(nearest)])
        return next(n for n in range(1, self.parts + 1) if not len(at) or (at < n).mean() >= recall)

    def first(self, x: np.ndarray, n: int) -> np.ndarray:
        p = self.probabilities(x)
        return np.argsort(-p, axis=1, kind="stable")[:, :n]


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows (vec_id, v): vectors of finite numbers, not all of them 0, as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.size(v) > 0
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    return np.array(column.flatten() if isinstance(column, pa.Array) else np.concatenate(column.to_numpy())).reshape(-1, width)


def best_of(ids: np.ndarray, q: np.ndarray, candidates: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's ``k`` best, best first, ties to the smaller id.

    The finalists' scores are summed component by component in one order, so that equal vectors have equal scores.
    """
    s = q @ c.T
    s[ids[:, None] == candidates[None, :]] = -np.inf
    n = min(k, s.shape[1])
    least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
    i, j = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf))
    score = np.zeros(len(i))
    for d in range(q.shape[1]):
        score += q[i, d] * c[j, d]
    order = np.lexsort((candidates[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    kept = place < k
    return i[kept], j[kept], score[kept]


def neighbour_parts(placed: DataFrame, held_ids: np.ndarray, held: np.ndarray, k: int) -> list[np.ndarray]:
    """The parts of the ``k`` nearest of all rows to each row of ``held``, by brute force; a task tells ``k`` rows for each."""
    shared = placed.sparkSession.sparkContext.broadcast((held_ids, held))  # as many rows as were sampled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        top = pd.DataFrame({"i": [], "vec_id": [], "part": [], "score": []})
        for batch in batches:
            c, rows, part = matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            i, j, score = best_of(ids, q, rows, c, k)
            top = pd.concat([top, pd.DataFrame({"i": i, "vec_id": rows[j], "part": part[j], "score": score})])
            top = top.sort_values(["i", "score", "vec_id"], ascending=[True, False, True]).groupby("i").head(k)
        if len(top):
            yield pa.RecordBatch.from_pandas(top.astype({"i": "int32", "vec_id": "int64", "part": "int32"}), preserve_index=False)

    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    found = placed.select("vec_id", "v", "part").mapInArrow(run, "i int, vec_id long, part int, score double")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("i", "part").toPandas()
    return [found["part"].to_numpy()[found["i"].to_numpy() == i] for i in range(len(held))]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
    parts: int | None = None, recall: float = 0.95, sample: int = 4096, held_out: int = 512, block: int = 2048,
    stretch: int = 262_144, zones_asked: int = 8,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its ``k`` best of the probed parts."""
    spark = vectors.sparkSession
    ship(spark)
    rows, asked = usable(vectors, id_column, vector), usable(queries, id_column, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widths is None:
        return spark.createDataFrame([], schema)
    width, n_rows = widths["n"], widths["count"]
    rows = rows.where(F.size("v") == width)
    asked = asked.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    some = sample_by_hash(rows, "vec_id", sample + held_out).withColumn("h", unit(F.col("vec_id"))).toPandas().sort_values(["h", "vec_id"])
    x, ids = np.stack(some["v"].to_numpy()), some["vec_id"].to_numpy()
    measured = len(x) // 9 if len(x) >= 18 else 0
    held, held_ids, x = x[len(x) - measured :], ids[len(x) - measured :], x[: len(x) - measured]
    parts = max(1, min(parts or int(np.sqrt(n_rows) / 8) + 1, len(x) // 32))
    fitted = Router(x, parts)
    router = spark.sparkContext.broadcast(fitted)  # width x parts numbers

    def to_parts(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = router.value.first(matrix(batch.column(1), width), n).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, first.size + 1, n), pa.int32()), pa.array(first.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "parts"])

        return run

    routed = lambda df, n: df.mapInArrow(to_parts(n), "vec_id long, v array<double>, parts array<int>")
    placed = cut(routed(rows, 1).select("vec_id", "v", F.col("parts")[0].alias("part")))
    probes = fitted.probes_for(recall, held, neighbour_parts(placed, held_ids, held, k)) if parts > 1 and len(held) else parts
    # how many blocks each part has: a table of ``parts`` rows
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ask = lambda wanted, n: ranked(placed, cut(routed(wanted, n)), counts, parts, n, k, block, stretch, zones_asked)
    found = ask(asked, probes)
    if probes == parts:
        return found
    found = cut(found)
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n_rows - 1)).select(F.col("query_id").alias("vec_id"))
    short = cut(asked.join(enough.hint("merge"), "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    again = ask(short, parts)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct().hint("merge"), "query_id", "left_anti").unionByName(again)


class Best:
    """The ``k`` best candidates so far of each of some queries; scores, ids and the order are those of ``best_of``."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, parts: pa.ListArray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        of = np.repeat(np.arange(len(ids)), np.diff(parts.offsets.to_numpy()))
        part = parts.flatten().to_numpy()
        self.asking = {p: of[part == p] for p in np.unique(part)}
        self.i, self.candidate, self.score = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, part: int, candidates: np.ndarray, c: np.ndarray) -> None:
        asking = self.asking.get(part, np.empty(0, int))
        for a in range(0, len(asking), 256):
            some = asking[a : a + 256]
            i, j, score = best_of(self.ids[some], self.q[some], candidates, c, self.k)
            self.new.append((some[i], candidates[j], score))
        if sum(len(x[0]) for x in self.new) > 4 * self.k * len(self.ids):
            self.reduce()

    def reduce(self) -> None:
        i, candidate, score = (np.concatenate(x) for x in zip((self.i, self.candidate, self.score), *self.new))
        order = np.lexsort((candidate, -score, i))
        i, candidate, score = i[order], candidate[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        self.i, self.candidate, self.score, self.new = i[kept], candidate[kept], score[kept], []

    def batch(self) -> pa.RecordBatch:
        self.reduce()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.i], pa.int64()), pa.array(self.candidate), pa.array(self.score)], ["query_id", "vec_id", "score"])


def ranked(placed: DataFrame, wanted: DataFrame, counts: dict[int, int], parts: int, probes: int, k: int, block: int, stretch: int, zones_asked: int) -> DataFrame:
    """The ``k`` best rows of the parts that each row of ``wanted`` (vec_id, v, parts) asks.

    So that what is told for a query doesn't grow with the number of parts, tasks work on zones of several
    parts, of which a query asks about ``zones_asked``; queries stay in memory and rows pass by.
    """
    bundle = max(1, -(-probes // zones_asked))
    zone = lambda part: F.floor(part / bundle).cast("int")
    zones = -(-parts // bundle)
    rows_of, asks_of = [0] * zones, [0] * zones
    for p, n in counts.items():
        rows_of[p // bundle] += n
    one = wanted.select("vec_id", "v", "parts", F.explode(F.array_distinct(F.transform("parts", zone))).alias("zone"))
    for r in one.groupBy("zone").agg(F.count("*").alias("n")).collect():  # at most ``parts`` rows
        asks_of[r["zone"]] = r["n"]
    width = min(stretch, max(block, -(-5 * sum(rows_of) // (4 * zones))))  # a zone with far more rows than others is dealt out
    slices = lambda sizes, size: F.element_at(F.array(*(F.lit(max(1, -(-n // size))) for n in sizes)), F.col("zone") + 1)
    dealt = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    # each row goes to all slices of queries of its zone, and the other way round
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    i, j = slices(rows_of, width), slices(asks_of, block)
    sent_rows = placed.withColumn("zone", zone(F.col("part"))).select("zone", dealt(1, i).alias("i"), every(j).alias("j"), "part", F.lit(None).cast("array<int>").alias("parts"), "vec_id", "v")
    own = F.filter("parts", lambda p: zone(p) == F.col("zone"))
    sent_asks = one.select("zone", every(i).alias("i"), dealt(2, j).alias("j"), F.lit(-1).alias("part"), own.alias("parts"), "vec_id", "v")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by zone and slices, in each queries first and then the rows of one part after the other."""
        key, asking, best = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in range(4)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                *own_key, part = keys[a].tolist()
                if own_key != key:
                    if best:
                        yield best.batch()
                    key, asking, best = own_key, [], None
                segment = batch.slice(a, b - a)
                if part < 0:
                    asking.append(segment)
                    continue
                if asking:
                    together = pa.Table.from_batches(asking).combine_chunks()
                    first, v = (together.column(c).chunk(0) for c in ("parts", "v"))
                    best = Best(together.column("vec_id").to_numpy(), matrix(v, len(v[0])), first, k)
                    asking = []
                if best:
                    best.meet(part, segment.column("vec_id").to_numpy(), matrix(segment.column("v"), best.q.shape[1]))
        if best:
            yield best.batch()

    sent = sent_rows.union(sent_asks).repartition("zone", "i", "j").sortWithinPartitions("zone", "i", "j", "part")
    found = sent.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where("vec_id % 20 = 0"))
