"""Quality rules, and an isolation forest on their statistics.

Each text gets the counts of the rules (words, symbols, repeated lines, repeated three-word
windows and so on).  Documents that break a base rule go.  For the rest, an isolation forest
looks at the counts as shares of the text: trees of random splits, in which unusual texts
come to stand alone after few splits.  The forest is fitted on a bounded sample of labelled
good rows (``sample`` rows at most, those of the smallest hashes); the threshold is set from
the scores of all labelled rows that passed the base rules.  Allowed are thresholds at which no
more than ``lost`` of the good rows would go.  Of those at which as many labelled bad rows go as at
the lowest allowed one, the one at two thirds of their range is taken, so that clean rows a little
beyond the labelled ones stay; without labelled bad rows beyond it, the lowest allowed one is taken.

Edge cases: a null text has no words and breaks the base rule, as an empty one does; texts of
any length are read whole; repeated rows get the same answer each; label rows that are null,
or that stand more than once for a document, count once with their lowest quality; without
labelled good rows there is no forest, and the base rules alone decide; an empty table gives
an empty table; further columns are kept by ``keep_good`` and play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, cut, sample_by_hash, ship

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_bare",
)
SYMBOLS = "[#*$%&|<>]"


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, computed over whole columns of words and lines."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")

    def flat(lists: pa.LargeListArray) -> tuple[pa.Array, np.ndarray]:
        ends = lists.offsets.to_numpy()
        return lists.values.slice(ends[0], ends[-1] - ends[0]), np.repeat(np.arange(n), np.diff(ends))

    words, doc = flat(pc.ascii_split_whitespace(texts))
    filled = pc.not_equal(words, "")
    if not pc.all(filled).as_py():
        words, doc = words.filter(filled), doc[filled.to_numpy(zero_copy_only=False)]
    per_doc = lambda where, weights=None: np.bincount(where, weights, minlength=n).astype(np.int64)
    coded = words.dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    # what a word has is found once for each different word
    of_word = lambda counts: per_doc(doc, counts.to_numpy(zero_copy_only=False).astype(float)[code])
    out = {
        "n_words": per_doc(doc),
        "word_chars": of_word(pc.utf8_length(distinct)),
        "n_symbols": of_word(pc.count_substring_regex(distinct, SYMBOLS)),
        "n_upper": of_word(pc.count_substring_regex(distinct, r"\p{Lu}")),
        "n_digits": of_word(pc.count_substring_regex(distinct, r"\p{Nd}")),
        "n_marks": of_word(pc.count_substring_regex(distinct, "[!?]")),
        "n_bare": of_word(pc.invert(pc.match_substring_regex(distinct, r"\p{L}"))),
    }
    size = max(len(distinct), 1)
    out["n_distinct"] = per_doc(pd.unique(doc * size + code) // size)

    # three-word windows, each with a number that tells its words, and its document, apart
    inside = (doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, bool)
    pair, pairs = pd.factorize(code[:-1] * size + code[1:])
    three, _ = pd.factorize(pair[:-1] * size + code[2:]) if len(doc) > 2 else (np.zeros(0, np.int64), 0)
    window, _ = pd.factorize(three[inside].astype(np.int64) * n + doc[2:][inside])
    again = np.zeros(len(doc), bool)
    if len(window):
        at = np.flatnonzero(inside)[np.bincount(window)[window] >= 2]
        for k in range(3):
            again[at + k] = True
    out["n_repeat_words"] = per_doc(doc[again])

    lines, of = flat(pc.split_pattern(texts, "\n"))
    has_word = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    lines, of = lines.filter(pa.array(has_word)), of[has_word]
    line = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_lines"] = per_doc(of)
    out["n_dup_lines"] = out["n_lines"] - per_doc(pd.unique(line * n + of) % max(n, 1))
    return out


def shares(c: dict[str, np.ndarray] | pd.DataFrame) -> np.ndarray:
    """What the forest sees: counts against the size of the text."""
    g = lambda k: np.asarray(c[k], float)
    words, chars, lines = np.maximum(g("n_words"), 1), np.maximum(g("word_chars"), 1), np.maximum(g("n_lines"), 1)
    return np.stack(
        [
            g("word_chars") / words, g("n_symbols") / chars, g("n_dup_lines") / lines, g("n_repeat_words") / words,
            g("n_upper") / chars, g("n_digits") / chars, g("n_marks") / words, g("n_bare") / words,
            np.log1p(g("n_words") - g("n_distinct")) / np.log1p(words),
        ],
        axis=1,
    )


def path_constant(n: int) -> float:
    """Mean length of an unsuccessful search in a tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random splits, held as arrays (feature, cut, left, right, length at the leaf).

    A split is drawn from the rows' range widened by ``floor`` of the feature on both sides, so
    that a feature in which the fitted rows don't differ still sets others apart.
    """

    def __init__(self, rows: np.ndarray, floor: np.ndarray, trees: int = 200, each: int = 256, seed: int = 0) -> None:
        self.floor = floor
        rng = np.random.default_rng(seed)
        each = min(each, len(rows))
        self.norm, self.trees = max(path_constant(each), 1e-9), []
        depth = int(np.ceil(np.log2(max(each, 2))))
        for _ in range(trees):
            nodes: list[list[float]] = []
            self._grow(rows[rng.choice(len(rows), each, replace=False)], 0, depth, rng, nodes)
            self.trees.append(np.array(nodes, float).T)

    def _grow(self, rows: np.ndarray, at: int, depth: int, rng: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, at + path_constant(len(rows))])
        if at < depth and len(rows) > 1:
            f = rng.integers(rows.shape[1])
            x = rng.uniform(rows[:, f].min() - self.floor[f], rows[:, f].max() + self.floor[f])
            left = rows[:, f] < x
            nodes[me][:2] = [f, x]
            nodes[me][2] = self._grow(rows[left], at + 1, depth, rng, nodes)
            nodes[me][3] = self._grow(rows[~left], at + 1, depth, rng, nodes)
        return me

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the higher."""
        total, all_rows = np.zeros(len(rows)), np.arange(len(rows))
        for feature, x, left, right, length in self.trees:
            feature, left, right = feature.astype(int), left.astype(int), right.astype(int)
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                go = rows[all_rows, np.maximum(feature[at], 0)] < x[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return np.exp2(-total / max(len(self.trees), 1) / self.norm)


#: How far beyond the fitted rows splits are drawn, for each of ``shares``: a parameter of the forest, in the shares' own
#: units.  Good rows differ in hardly any share, and without it the forest couldn't split where they don't.
FLOOR = np.array([2, 0.1, 0.3, 0.3, 0.05, 0.1, 0.1, 0.1, 0.3])
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
BINS = 1000


def count_all(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, counts...), one for each document; the texts go no further."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches, size=1 << 20):
            counts = text_counts(some.column(1))
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(counts[c]) for c in COUNTS)], ["doc_id", *COUNTS])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


class Judge:
    """The forest and the threshold, fitted on labelled rows of the corpus."""

    def __init__(self, counted: DataFrame, labels: DataFrame, sample: int = 8192, lost: float = 0.001, trees: int = 100) -> None:
        known = (
            labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        )
        known = counted.where(~F.expr(BASE_FAILED)).join(known.hint("shuffle_hash"), "doc_id")
        known = cut(known.select("doc_id", "quality", *COUNTS))
        good = sample_by_hash(known.where("quality = 1"), "doc_id", sample).toPandas().sort_values(["doc_id", *COUNTS])
        self.forest, self.threshold = None, float("inf")
        if len(good):
            self.forest = IsolationForest(shares(good), FLOOR, trees)
            counts = (
                self.scored(known).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "quality").count().collect()
            )  # two rows for each of the bins at most
            table = np.zeros((2, BINS + 2))
            for r in counts:
                table[int(r["quality"] == 1), r["bin"]] += r["count"]
            # what would go at a threshold of bin / BINS
            bad_gone, good_gone = table[:, ::-1].cumsum(1)[:, ::-1]
            allowed = np.flatnonzero(good_gone <= lost * good_gone[0])
            same = allowed[bad_gone[allowed] == bad_gone[allowed[0]]]
            self.threshold = float(same[2 * len(same) // 3] if bad_gone[allowed[0]] else allowed[0]) / BINS

    def scored(self, counted: DataFrame) -> DataFrame:
        """Add ``score`` (null without a forest) to counted rows."""
        if self.forest is None:
            return counted.withColumn("score", F.lit(None).cast("double"))
        forest = counted.sparkSession.sparkContext.broadcast(self.forest)  # bounded by trees x rows a tree

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = shares({c: batch.column(c).to_numpy() for c in COUNTS})
                yield batch.append_column("score", pa.array(forest.value.score(x)))

        return counted.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in counted.dtypes) + ", score double")


def op3_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    counted = cut(count_all(documents))
    judge = Judge(counted, labels)
    out = judge.scored(counted).withColumn("base_failed", F.expr(BASE_FAILED))
    fine = F.coalesce(F.col("score") < F.lit(judge.threshold), F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & fine).alias("kept"), "score",
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the rules and the forest, with all their columns.

    The texts are counted twice, once for the fit and once for the decision on each row, which
    costs less than carrying them through a join.
    """
    judge = Judge(cut(count_all(docs)), labels)
    forest = docs.sparkSession.sparkContext.broadcast(judge.forest)
    threshold, schema = judge.threshold, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches, size=1 << 20):
            c = text_counts(some.column("text"))
            keep = (c["n_words"] >= 50) & (100 * c["n_repeat_words"] <= 50 * c["n_words"])
            if forest.value is not None:
                keep &= forest.value.score(shares(c)) < threshold
            yield some.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
