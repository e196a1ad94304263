"""Near-duplicate documents by BagMinHash signatures.

A document is the multiset of its five-word shingles (all its words, if it has fewer than
five); two documents are near-duplicates if their weighted Jaccard similarity is ``at_least``
or more.  The steps:

1. Documents with the same words in the same order are one *text*; only one stands for them.
2. Every text gets a BagMinHash signature.  The weight axis of a shingle is cut at 1, 2, 4,
   8, ...; in each interval a Poisson process, seeded by shingle and interval, throws points
   (time, signature place, position on the axis).  Points beyond the shingle's weight don't
   count; each signature place keeps its first point.  Times beyond a limit that all places
   meet with high probability aren't generated, and the limit is doubled where they don't.
   Two signatures agree in a place with a probability equal to the weighted Jaccard similarity.
3. Signatures are cut into bands; texts alike in a band are candidates.  Within a bucket all
   are compared with the one that meets most others over all bands (if the others were made
   from one text, with that one), and verified on their multisets.  What is linked so far forms
   components.
4. In buckets of three and more texts that then hold several components, every text outside of
   the bucket's largest component is compared with all texts of other components, on whole
   multisets, in blocks of a bounded number of shingles.  A block tells only links that join two
   components, so what leaves it is no more than the texts it holds.  Pairs within a component can
   add nothing, so no link between texts that share a band is lost, in buckets of any size.

With 26 bands of 5 places, a pair at similarity 0.8 shares no band with probability 3e-5.

Edge cases: documents without words (null, empty, blank) are classes of their own; null ids
are kept, and a class has the smallest id in it; repeated rows are copies of one another; texts
of any length are taken whole; an empty table gives an empty table; further columns are kept
by ``keep_one`` and play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, cut, join_hot, near, ship

SHINGLE, BANDS, ROWS = 5, 26, 5
#: Shingles (8 bytes each) of one side of a block.
BLOCK = 300_000
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(float) + 0.5) / float(2**53)


class Bags:
    """The shingles of a column of texts: document, hash and weight of each different one."""

    def __init__(self, texts: pa.Array, size: int = SHINGLE) -> None:
        n = len(texts)
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = words.offsets.to_numpy()
        flat, doc = words.values.slice(ends[0], ends[-1] - ends[0]), np.repeat(np.arange(n), np.diff(ends))
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        if not filled.all():
            flat, doc = flat.filter(pa.array(filled)), doc[filled]
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, U64)
        word = hashes[coded.indices.to_numpy(zero_copy_only=False)]
        self.n_words = np.bincount(doc, minlength=n)
        last = np.cumsum(self.n_words)
        first = last - self.n_words
        #: of the words in order: equal for equal texts only
        self.print = [hashlib.blake2b(word[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, last, strict=True)]
        if len(word) >= size:
            whole = doc[size - 1 :] == doc[: len(doc) - size + 1]
            shingle = np.zeros(len(doc) - size + 1, U64)
            for k in range(size):
                shingle = mix(shingle * U64(0x9E3779B97F4A7C15) + word[k : len(doc) - size + 1 + k])
            shingle, owner = shingle[whole], doc[: len(doc) - size + 1][whole]
        else:
            shingle, owner = np.zeros(0, U64), np.zeros(0, int)
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < size))
        if len(short):
            alone = np.zeros(len(short), U64)
            for k in range(size - 1):
                there = self.n_words[short] > k
                alone[there] = mix(alone[there] * U64(0x9E3779B97F4A7C15) + word[first[short][there] + k])
            shingle, owner = np.concatenate([shingle, alone]), np.concatenate([owner, short])
        code, _ = pd.factorize(shingle ^ mix(owner.astype(U64) + U64(1)))
        self.weight = np.bincount(code) if len(code) else np.zeros(0, int)
        at = np.zeros(len(self.weight), int)
        at[code[::-1]] = np.arange(len(code))[::-1]
        self.doc, self.hash, self.n = owner[at], shingle[at], n
        self.total = np.bincount(self.doc, self.weight, minlength=n).astype(int)

    def members(self) -> list[np.ndarray]:
        """Each document's multiset as a set: hashes of (shingle, 1st, 2nd, ... time), in order."""
        nth = np.arange(self.weight.sum()) - np.repeat(np.cumsum(self.weight) - self.weight, self.weight)
        each = mix(np.repeat(self.hash, self.weight) + nth.astype(U64) * U64(0xD1B54A32D192ED03))
        owner = np.repeat(self.doc, self.weight)
        order = np.lexsort((each, owner))
        return np.split(each[order].astype(np.int64), np.cumsum(self.total)[:-1])


def signatures(bags: Bags, places: int) -> np.ndarray:
    """A row of ``places`` 64-bit values for each document (zeros, if it has no shingles)."""
    # the intervals [0, 1), [1, 2), [2, 4), ... that a weight reaches into
    count = np.ceil(np.log2(np.maximum(bags.weight, 1))).astype(int) + 1
    item = np.repeat(np.arange(len(count)), count)
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width = np.where(level == 0, 1.0, np.exp2(np.maximum(level - 1, 0)))
    low = np.where(level == 0, 0.0, width)
    seed = mix(bags.hash[item] ^ (level.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    doc, weight = bags.doc[item], bags.weight[item]
    best = np.full(bags.n * places, np.inf)
    value = np.zeros(bags.n * places, U64)
    limit = (np.log(places) + 3) / np.maximum(bags.total, 1)
    todo = np.arange(len(item))
    while len(todo):
        at, time, nth = todo, np.zeros(len(todo)), 0
        while len(at):
            point = mix(seed[at] + U64(nth * 0xA0761D6478BD642F % 2**64))
            time = time - np.log(uniform(point)) / (places * width[at])
            near = time <= limit[doc[at]]
            at, time, point = at[near], time[near], point[near]
            place = doc[at] * places + (mix(point + U64(1)) % U64(places)).astype(int)
            inside = low[at] + uniform(mix(point + U64(2))) * width[at] < weight[at]
            where, when, what = place[inside], time[inside], point[inside]
            np.minimum.at(best, where, when)
            won = best[where] == when
            value[where[won]] = what[won]
            nth += 1
        empty = np.isinf(best).reshape(bags.n, places).any(1) & (bags.total > 0)
        limit[empty] *= 2
        todo = todo[empty[doc[todo]]]
    return value.reshape(bags.n, places)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of each signature."""
    key = np.broadcast_to(np.arange(1, bands + 1).astype(U64), (len(values), bands)).copy()
    for k in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + values.reshape(len(values), bands, rows)[:, :, k])
    return key.astype(np.int64)


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Rows (row, doc_id, key, print, total, bands), one for each document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches):
            bags = Bags(some.column(2), size)
            keys = band_keys(signatures(bags, bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(bags.print, pa.binary()), pa.array(bags.total, pa.int64()), lists],
                ["doc_id", "key", "print", "total", "bands"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(run, "doc_id long, key binary, print binary, total long, bands array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")


def multisets(texts: DataFrame, size: int) -> DataFrame:
    """Rows (node, text) to rows (node, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(Bags(some.column(1), size).members(), pa.list_(pa.int64()))], ["node", "members"])

    return texts.mapInArrow(run, "node long, members array<long>")


def members_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Rows (node, members) for the nodes in ``asked``; only their texts are read."""
    asked = cut(asked.distinct().join(nodes.hint("merge"), "node").select("node", "doc_id", "key"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))
    # null ids can't be joined on; -1 stands for them, and the text's key tells them apart
    known = lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    texts = near(known(named), known(asked), ["doc_id", "key"], "inner").select("node", "text")
    return cut(multisets(texts, size).dropDuplicates(["node"]))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, at_least: float, block: int = 512) -> DataFrame:
    """Of the pairs (hub, node), those of similarity ``at_least`` and more.

    A hub's pairs are dealt into blocks of about ``block``, and its multiset is sent once to each,
    so that a hub with a third of all pairs is spread over many tasks.
    """
    pairs = cut(pairs.distinct())
    sets = members_of(pairs.select(F.col("hub").alias("node")).union(pairs.select("node")), nodes, docs, size)
    degree = pairs.groupBy("hub").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = join_hot(pairs, degree, "hub", "n").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    hubs = degree.join(sets.withColumnsRenamed({"node": "hub", "members": "x"}).hint("merge"), "hub").select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "x"
    )
    both = dealt.join(sets.withColumnRenamed("members", "y").hint("merge"), "node").join(hubs.hint("merge"), ["hub", "block"])
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= at_least * (F.size("x") + F.size("y") - common) - 1e-9
    return cut(both.where(alike).select(F.col("hub").alias("a"), F.col("node").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes of links, by alternating large and small stars.

    Every step is a minimum and a join over the edges, whose number never grows.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct()
    edges, before = cut(edges), None
    least = lambda df: df.groupBy("v").agg(F.least("v", F.min("m")).alias("r"), F.count("*").alias("n"))
    while True:
        both = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        large = join_hot(both, least(both), "v", "n").where("m > v").select(F.col("m").alias("v"), F.col("r").alias("m")).distinct()
        large = cut(large)
        joined = join_hot(large, least(large), "v", "n")
        small = joined.select(F.explode(F.array(F.struct("v", F.col("r").alias("m")), F.struct(F.col("m").alias("v"), F.col("r").alias("m")))).alias("e"))
        edges = cut(small.select("e.v", "e.m").where("v <> m").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root"))
        before = now


def joining_links(frame: pd.DataFrame, at_least: float) -> pd.DataFrame:
    """Links (a, b) of a block that join components: each row of ``asks`` against all others of other components.

    Similarities are exact; two texts that earlier links of the block have joined aren't compared.
    """
    asks = frame["asks"].to_numpy(bool)
    rows, minor = frame[~asks], frame[asks]
    if not len(rows) or not len(minor):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    code, _ = pd.factorize(np.concatenate([*rows["members"], *minor["members"]]))
    root, _ = pd.factorize(np.concatenate([rows["root"], minor["root"]]))
    total = np.r_[rows["total"].to_numpy(), minor["total"].to_numpy()]
    ends = np.cumsum(total)
    flat, starts, there = code[: ends[len(rows) - 1]], (ends - total)[: len(rows)], total[: len(rows)]
    own, mark, links = root[: len(rows)].copy(), np.zeros(code.max() + 1, bool), []
    ids, asking = rows["node"].to_numpy(), minor["node"].to_numpy()
    for k in range(len(minor)):
        me, t = root[len(rows) + k], total[len(rows) + k]
        could = (own != me) & (np.minimum(there, t) >= at_least * np.maximum(there, t) - 1e-9)
        if not could.any():
            continue
        members = code[ends[len(rows) + k] - t : ends[len(rows) + k]]
        mark[members] = True
        common = np.add.reduceat(mark[flat], starts)
        mark[members] = False
        for j in np.flatnonzero(could & (common >= at_least * (there + t - common) - 1e-9)):
            if own[j] != me:  # the component of row j is now this row's
                links.append((asking[k], ids[j]))
                gone = own[j]
                own[own == gone] = me
                root[root == gone] = me
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def across(rooted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, at_least: float) -> DataFrame:
    """Links (a, b) that join components of buckets; ``rooted``: (bucket, node, total, root) of buckets with several."""
    # the component of each bucket that has most shingles needs no comparison within itself
    shares = rooted.groupBy("bucket", "root").agg(F.sum("total").alias("t"))
    large = shares.groupBy("bucket").agg(F.max(F.struct("t", "root")).alias("top"), F.sum("t").alias("all"))
    n = rooted.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = lambda x: F.ceil(x / BLOCK).cast("int")
    large = large.join(n.hint("merge"), "bucket").select(
        "bucket", "n", F.col("top.root").alias("top"), parts(F.col("all")).alias("p"), parts(F.greatest(F.col("all") - F.col("top.t"), F.lit(1))).alias("q")
    )
    dealt = join_hot(rooted, large, "bucket", "n").withColumn("i", F.pmod(F.xxhash64("node"), F.col("p")).cast("int")).withColumn(
        "j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("q")).cast("int")
    )
    sent = dealt.select("bucket", "node", "total", "root", "i", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(False).alias("asks"))
    minor = dealt.where("root <> top").select("bucket", "node", "total", "root", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), "j", F.lit(True).alias("asks"))
    sets = members_of(rooted.select("node"), nodes, docs, size)
    columns = ["bucket", "node", "total", "root", "i", "j", "asks"]
    whole = sent.select(columns).union(minor.select(columns)).join(sets.hint("merge"), "node")
    return cut(whole.groupBy("bucket", "i", "j").applyInPandas(lambda frame: joining_links(frame, at_least), "a long, b long"))


def several_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, total, root) of the buckets of three and more texts that hold several components."""
    rooted = members.join(roots.hint("merge"), "node", "left").select("bucket", "node", "total", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("n")).where("p < q AND n > 2")
    return cut(join_hot(rooted, several.select("bucket", "n"), "bucket", "n"))


def near_classes(
    docs: DataFrame, at_least: float = 0.8, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Rows (row, doc_id, key, class_id, copy_id, first): the class of every document.

    ``copy_id`` is the smallest id with the same words, ``class_id`` the smallest id of the
    near-duplicates; ``first`` is true for one row of each class, one with its id.
    """
    all_rows = cut(signed(docs, size, bands, rows))
    with_words = all_rows.where("total > 0")
    same = with_words.groupBy("print").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "key")).alias("s"),
        F.first("total").alias("total"), F.first("bands").alias("bands"), F.count("*").alias("copies"),
    )
    nodes = cut(same.select("print", "copies", F.col("s.row").alias("node"), "s.doc_id", "s.key", "total", "bands"))
    banded = nodes.select("node", "total", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(join_hot(banded, shared.select("bucket", "n", F.col("n").alias("size")), "bucket", "n"))
    # the text that meets most others, such as the one that the others were made from
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    lead = members.join(met.hint("merge"), "node").groupBy("bucket").agg(
        F.count("*").alias("n"), F.max(F.struct("met", (-F.col("node")).alias("minus"), "node", "total")).alias("lead")
    )
    could = F.least("total", "lead.total") >= at_least * F.greatest("total", "lead.total") - 1e-9
    led = join_hot(members, lead, "bucket", "n").where(could).select(F.col("lead.node").alias("hub"), "node").where("hub <> node")
    links = verified(led, nodes, docs, size, at_least)
    roots = components(links)

    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars.union(across(several_components(members, roots), nodes, docs, size, at_least)))

    placed = cut(
        nodes.select("print", "copies", "node", "doc_id").join(roots.hint("merge"), "node", "left")
        .select("print", "copies", "node", "doc_id", F.coalesce("root", "node").alias("root"))
    )
    tops = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node")).alias("top"), F.count("*").alias("n"))
    placed = join_hot(placed, tops, "root", "n").select(
        "print", "copies", F.col("top.doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.col("top.node").alias("top")
    )
    found = join_hot(with_words.select("row", "doc_id", "key", "print"), placed, "print", "copies")
    alone = all_rows.where("total = 0")
    return found.select("row", "doc_id", "key", "class_id", "copy_id", (F.col("row") == F.col("top")).alias("first")).unionByName(
        alone.select("row", "doc_id", "key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(True).alias("first"))
    )


def op6_near_duplicates(documents: DataFrame) -> DataFrame:
    return near_classes(documents).select("doc_id", "class_id", "copy_id")


def keep_one(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """One document of each class, with all its columns.

    Rows are told by id and text.  A row that stays and is repeated is found among its equals.
    """
    unknown = lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    told = cut(unknown(near_classes(docs, at_least)).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.count_if("first").alias("stay")))
    # the caller's columns travel in one struct, so that no name can meet one of those here
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    named = docs.select(F.struct("*").alias("doc"), id_.alias("doc_id"), text_key().alias("key"))
    whole = near(named, told.where("stay < n").select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    some = near(named, told.where("0 < stay AND stay < n").select("doc_id", "key"), ["doc_id", "key"], "inner")
    # blank texts are classes of their own: all of them stay, so here stay is 1
    return whole.select("doc.*").unionByName(some.dropDuplicates(["doc_id", "key"]).select("doc.*"))
