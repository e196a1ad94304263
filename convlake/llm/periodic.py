"""Runs of repeated words, by enumeration of maximal pairs in the tree of LCP intervals.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long,
that no neighbouring word continues.  A stretch of period q is a pair of equal passages at a distance of q
words that can't be made longer on either side: a maximal pair.  So runs need no search of their own:

- the words of some documents are put one after another, each document ended by a sign of its own, and
  suffixes sorted by doubling; only those that share their first words with another are sorted further, and
  for a run of ``least`` words, passages of 16 words and more are all that matter (below);
- the intervals of suffixes with a common prefix are visited from the longest prefix to the shortest; each
  holds the places of its passage in order, beside each of them its class, the word to its left;
- where two intervals meet, their places go on differently to the right.  For each place of the smaller one,
  places of the other within the distance that the length allows are looked up, and pairs of different
  classes are maximal.  A pair at distance q with a passage of n words is a stretch of n + q words, so
  ``times`` periods of q need n >= (times - 1) q.

All places of a passage within half its length of each other are a progression of its period, all but the
first have the same word to the left, and all but the last the same to the right.  So of the places within reach only the
farthest on each side can be a partner: two look-ups for each place, and never all pairs.  A period that isn't
the smallest gives the same stretch again, which counts once.

Documents of a batch are worked in slices of some megabytes, which bounds memory; a longer document is a
slice of its own.

Edge cases: a null or empty text has no words and no run; texts of any length are read whole; repeated rows
and null ids are worked like others (a null id is never altered by :func:`op13_periodic_runs`); an empty
table gives an empty table; columns other than those named by the parameters aren't looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, ship

Run = tuple[int, int, int]  # start, length, period


def sorted_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose first ``least`` signs (a power of two) stand somewhere else too, as sorted suffixes, with the group of these signs.

    Signs below zero end texts, and differ from each other.
    """
    order = np.argsort(codes, kind="stable")
    # a rank is the first place of its group in the order
    new = np.concatenate([[True], np.diff(codes[order]) != 0]) if len(order) else np.zeros(0, bool)
    rank, start = np.zeros(len(codes), np.int64), np.flatnonzero(new)
    rank[order] = start[np.cumsum(new) - 1]
    active = shared(order, new)
    length, group = 1, None
    while len(active):
        if length == least:
            group = (active, rank[active])
        begin = np.concatenate([[True], np.diff(rank[active]) != 0])
        key = rank[active] * (len(codes) + 1) + rank[active + length]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        new = np.concatenate([[True], np.diff(key) != 0])
        here, first = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(begin)[np.cumsum(begin) - 1]
        rank[active] += here - first
        active = shared(active, new)
        length *= 2
    if group is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, groups = group
    by = np.argsort(rank[places], kind="stable")
    return places[by], groups[by]


def shared(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of ``order``, those in groups of two and more; ``new`` tells where groups begin."""
    last = np.concatenate([new[1:], [True]]) if len(new) else new
    return order[~(new & last)]


def prefix_lengths(codes: list[int], suffixes: list[int], groups: list[int], least: int) -> list[int]:
    """Of each suffix, how much it shares with the one before it in its group; 0 for a group's first."""
    before = {b: a for a, b, g, h in zip(suffixes, suffixes[1:], groups, groups[1:], strict=False) if g == h}
    at = {p: k for k, p in enumerate(suffixes)}
    out, n, last = [0] * len(suffixes), least, -2
    for p in sorted(suffixes):
        q = before.get(p)
        n = max(n - 1, least) if p == last + 1 else least
        if q is None:
            n = least
        else:
            while codes[p + n] == codes[q + n]:
                n += 1
            out[at[p]] = n
        last = p
    return out


def merged(a: list[int], b: list[int]) -> list[int]:
    """Two lists in order as one; ``b`` is the shorter."""
    if len(b) * 16 > len(a):
        return sorted(a + b)  # two ordered runs
    for p in b:
        insort(a, p)
    return a


def stretches(codes: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """(start, end) of all runs in ``codes`` with their smallest period; ``times`` is 3 at least."""
    # n >= (times - 1) q and n + q >= least give n >= least (times - 1) / times
    shortest = 1 << max(-(-least * (times - 1) // times), 1).bit_length() - 1
    places, groups = sorted_suffixes(codes, shortest)
    found: dict[tuple[int, int], int] = {}
    if not len(places):
        return found
    left, suffixes = codes.tolist(), places.tolist()
    lcp = prefix_lengths(left, suffixes, groups.tolist(), shortest)

    def meet(a: list[int], b: list[int], n: int) -> list[int]:
        """Maximal pairs of two intervals of a passage of ``n`` words; gives all their places."""
        if len(a) < len(b):
            a, b = b, a
        reach = n // (times - 1)
        for p in b:
            class_of_p = left[p - 1]
            k = bisect_left(a, p - reach)
            if k < len(a) and a[k] < p and left[a[k] - 1] != class_of_p:
                keep(a[k], p, n)
            k = bisect_right(a, p + reach) - 1
            if k >= 0 and a[k] > p and left[a[k] - 1] != class_of_p:
                keep(p, a[k], n)
        return merged(a, b)

    def keep(p: int, q: int, n: int) -> None:
        period, stretch = q - p, (p, q + n)
        if n + period >= least and n >= (times - 1) * period:
            found[stretch] = min(period, found.get(stretch, period))

    # from the bottom up: open intervals, each longer than the one below it, have their length and the places met so far
    open_: list[tuple[int, list[int]]] = []
    for p, next_ in zip(suffixes, [*lcp[1:], 0], strict=True):
        held = [p]
        while open_ and open_[-1][0] > next_:
            size, met = open_.pop()
            held = meet(met, held, size)
        if open_ and open_[-1][0] == next_:
            held = meet(open_.pop()[1], held, next_)
        if next_:
            open_.append((next_, held))
    return found


class Words:
    """The words of some texts as numbers: ``codes`` of all, text i from ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = lists.offsets.to_numpy()
        words, doc = lists.values.slice(offsets[0], offsets[-1] - offsets[0]), np.repeat(np.arange(len(texts)), np.diff(offsets))
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[filled]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(doc[filled], minlength=len(texts)))]).astype(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] : self.ends[i + 1]]

    def runs(self, least: int, times: int) -> list[list[Run]]:
        """The runs of each text, by start, then period."""
        n = len(self.ends) - 1
        out: list[list[Run]] = [[] for _ in range(n)]
        # a sign before each text and one at the end; a word counts as another one in each text
        size, doc = max(len(self.distinct), 1), np.repeat(np.arange(n), np.diff(self.ends))
        place = np.arange(len(self.codes)) + doc + 1
        signs = np.zeros(len(self.codes) + n + 1, np.int64)
        signs[self.ends + np.arange(n + 1)] = -1 - np.arange(n + 1)
        signs[place] = doc * size + self.codes
        for (a, b), period in stretches(signs, least, times).items():
            i = int(np.searchsorted(self.ends + np.arange(n + 1), a, "right")) - 1
            out[i].append((a - int(self.ends[i]) - i - 1, b - a, period))
        return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The words for which ``keep`` holds, one space apart, of each text."""
        kept = np.concatenate([[0], np.cumsum(keep)])[self.ends]
        words = self.distinct.take(pa.array(self.codes[keep]))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept), words), pa.scalar(" ", pa.large_string()))


def repeated(words: Words, runs: list[list[Run]]) -> np.ndarray:
    """Which words stand in a run behind its first period."""
    change = np.zeros(len(words.codes) + 1, np.int64)
    for first, own in zip(words.ends[:-1].tolist(), runs, strict=True):
        for start, length, period in own:
            change[first + start + period] += 1
            change[first + start + length] -= 1
    return np.cumsum(change)[:-1] > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Rows (doc_id, runs, collapsed), one for each document: arrays of (start, length, period) in words, and the text with
    one period of each run left.
    """
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches):
            words = Words(some.column(1))
            runs = words.runs(least, times)
            told = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind)
            yield pa.RecordBatch.from_arrays([some.column(0), told, words.joined(~repeated(words, runs)).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    narrow = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def altered(words: Words, ids: list[int | None]) -> None:
    """Make a tenth of the texts, told by the hash of their ids, periodic from some word on."""
    for i, doc in enumerate(ids):
        own = words.of(i)
        h, n = zlib.crc32(str(doc).encode()), len(own)
        if doc is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own[a:] = own[a + np.arange(n - a) % p]


def op13_periodic_runs(documents: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches):
            words = Words(some.column(1))
            altered(words, some.column(0).to_pylist())
            runs = words.runs(least, times)
            best = [strongest(own) or (None, None, None) for own in runs]
            long = lambda values: pa.array(list(values), pa.int64())
            told = ["".join(f"{s},{n},{q}\n" for s, n, q in own) for own in runs]
            left = words.joined(~repeated(words, runs))
            yield pa.RecordBatch.from_arrays(
                [
                    some.column(0), long(map(len, runs)), *(long(b[k] for b in best) for k in range(3)),
                    long(None if n is None else 1000 * n // q for _, n, q in best),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in told]),
                    pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in left]),
                ],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    )
