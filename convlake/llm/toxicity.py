"""Toxicity scores of deobfuscated text.

1. A character language model (trigrams over an alphabet of letters) is counted over all
   documents; each word counts once for every time it stands there.
2. Words that may be disguised (a stand-in or separator anywhere, also at the ends, a letter
   twice in a row) are lattices: each character may be itself, a letter it often stands for, or
   nothing (a separator or a repetition).  The Viterbi path through the lattice under the language
   model is the restored word.  The plain word counts as well, and stand-ins at the ends are read
   both as letters and as punctuation.  Words that are spaced out into pieces of one or two
   letters, three pieces or more, are one lattice, in which each space may be nothing or the end
   of a word; scoring also looks for the lexicon's words in every part of them that begins and
   ends with a piece.
3. Restored words are counted in the labelled training rows (different texts once); those that
   tell toxic texts from others are the lexicon, however many they are.
4. A logistic regression on a text's lexicon words, fitted on a bounded sample of training
   rows (``sample`` rows at most), gives the score.

Training rows are labelled rows whose crc32(doc_id as text) mod 5 isn't 0.

Edge cases: null and empty texts have no words and get the score of a text without lexicon
words; texts of any length are read whole; labels that are null, or that stand more than once
for a document, count once, as 1 if any is; without training rows every score is 0; repeated
rows get the same score; an empty table gives an empty table; columns other than doc_id and
text aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import byte_slices, cut, near, sample_by_hash, ship

ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäãåçèéêëìíîïñòóôöõùúûüýÿßœæ"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0: before the first and after the last letter
OTHER = len(ALPHABET) + 1
SIZE = OTHER + 1

#: Letters that digits and symbols stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = "._-*~'`^,:;/\\"
EDGE = re.compile(r"^[^\w@$!|+€£¡§]+|[^\w@$]+$")
ENDS = re.compile(rf"^[^\w{re.escape(''.join(STANDS_FOR))}]+|[^\w{re.escape(''.join(STANDS_FOR))}]+$")  # what can't be a letter
BARE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
LETTER = re.compile(r"[^\W\d_]")
#: All that the lattice can change: a stand-in, a separator or a doubled letter.
SUSPECT = re.compile(rf"[{re.escape(''.join(STANDS_FOR) + SEPARATORS)}]|([^\W\d_])\1")
RUN = re.compile(r"(.)\1{3,}")
#: Punctuation that no letter hides behind; a word of letters within it, none of them doubled, needs no lattice.
AROUND = ".,;:?\"'"
SIMPLE = f"^[{ALPHABET}]*$"
DOUBLED = "|".join(c * 2 for c in ALPHABET)
#: What stands around a piece of a spaced-out word.
BESIDE = ".,;:!?\"'-*_"


def letter_codes(word: str) -> list[int]:
    return [CODE.get(c, OTHER) for c in word]


def plain(word: str) -> str:
    """A word in lower case, without the punctuation around it."""
    return EDGE.sub("", word.lower())


class Restorer:
    """Viterbi decoding of disguised words; ``model`` holds log P(c | a, b) at a, b, c."""

    def __init__(self, model: np.ndarray, swap: float = -1.0, drop: float = -1.0, keep_odd: float = -6.0) -> None:
        self.model, self.swap, self.drop, self.keep_odd = model, swap, drop, keep_odd
        self.at = model.tolist()  # plain lists are faster to read one by one
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return {"model": self.model, "swap": self.swap, "drop": self.drop, "keep_odd": self.keep_odd}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def choices(self, word: str, i: int) -> list[tuple[str, float]]:
        """What the character may be, with the channel's log probability; '' is nothing."""
        c = word[i]
        out = [(c, 0.0)] if c in CODE else [(x, self.swap) for x in STANDS_FOR.get(c, "")]
        if c in SEPARATORS or (i and word[i - 1] == c):
            out.append(("", self.drop if c in SEPARATORS else 0.0))
        return out or [(c, self.keep_odd)]

    def decode(self, word: str) -> str:
        """The likeliest word; longer runs of a character say no more than three of it."""
        word, at = RUN.sub(r"\1\1\1", word), self.at
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # letters as linked pairs, last one first
        for i in range(len(word)):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            choices = [(c, CODE.get(c, OTHER), cost) for c, cost in self.choices(word, i)]
            for (a, b), (p, text) in best.items():
                following = at[a][b]
                for c, k, cost in choices:
                    state, q = ((a, b), p + cost) if c == "" else ((b, k), p + cost + following[k])
                    if state not in step or q > step[state][0]:
                        step[state] = (q, (text, c) if c else text)
            best = step
        return "".join(self._letters(best))

    def decode_spaced(self, pieces: list[str]) -> list[str]:
        """The words of pieces of letters: each space between them is nothing or the end of a word."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for piece in pieces:
            ended: dict[tuple[int, int], tuple[float, tuple]] = {}
            for i in range(len(piece)):
                step: dict[tuple[int, int], tuple[float, tuple]] = {}
                for (a, b), (p, text) in best.items():
                    for c, cost in self.choices(piece, i):
                        k = CODE.get(c, OTHER)
                        q = p + cost + self.at[a][b][k]
                        if c and ((b, k) not in step or q > step[b, k][0]):  # letters of pieces aren't dropped
                            step[b, k] = (q, (text, c))
                best = step or best
            for (a, b), (p, text) in best.items():
                q = p + self.at[a][b][0]
                if (0, 0) not in ended or q > ended[0, 0][0]:
                    ended[0, 0] = (q, (text, " "))
            best = best | ended
        return "".join(self._letters(best)).split()

    def _letters(self, best: dict[tuple[int, int], tuple[float, tuple]]) -> list[str]:
        """The letters of the best path, of which a word ends after the last one."""
        text = max(best.items(), key=lambda x: x[1][0] + (self.at[x[0][0]][x[0][1]][0] if x[0] != (0, 0) else 0.0))[1][1]
        letters = []
        while text:
            text, c = text
            letters.append(c)
        return letters[::-1]

    def restore(self, word: str) -> str:
        """The restored form of a raw word."""
        core = plain(word)
        return self.decode(core) if len(core) > 2 and SUSPECT.search(core) and LETTER.search(core) else core

    def forms(self, word: str) -> tuple[str, ...]:
        """All that a raw word may say, the plain word first."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            core = plain(word)
            found = {core: None}
            if len(word) > 2 and SUSPECT.search(word) and LETTER.search(word):
                low = word.lower()
                for x in {core, ENDS.sub("", low), BARE.sub("", low)}:
                    if len(x) > 2:
                        found[x] = None
                        if SUSPECT.search(x):
                            x = self.decode(x)
                            found[x] = None
                            if SUSPECT.search(x):  # a stand-in beside its letter is a repetition, too
                                found[self.decode(x)] = None
            self.known[word] = tuple(found)
        return self.known[word]


def pieces_of(words: list[str]) -> list[str]:
    """Words as pieces: in lower case, without the punctuation beside them."""
    return [(w.strip(BESIDE) or w).lower() for w in words]


def is_piece(word: str) -> bool:
    core = word.strip(BESIDE) or word
    return len(core) <= 2 and len(word) <= 4 and all(c.lower() in CODE or c in STANDS_FOR for c in core)


def spaced_runs(short: np.ndarray, doc: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """Where ``least`` and more short words of one document follow each other: (from, to)."""
    if not short.any():
        return []
    # a run begins at a short word that has none of its document before it
    joined = np.r_[False, short[1:] & short[:-1] & (doc[1:] == doc[:-1])]
    start = np.flatnonzero(short & ~joined)
    end = np.flatnonzero(short & ~np.r_[joined[1:], False]) + 1
    return [(int(a), int(b)) for a, b in zip(start, end, strict=True) if b - a >= least]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the number of each word in order, and the documents' ends."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = lists.offsets.to_numpy()
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ends - ends[0]


def language_model(docs: DataFrame) -> np.ndarray:
    """Smoothed log P(c | a, b), counted over the words of all documents.

    Each task sends its non-zero counts, SIZE ** 3 at most; so many are collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        table = np.full(0x110000, OTHER, np.int64)
        for c, k in CODE.items():
            table[ord(c)] = k
        for some in byte_slices(batches):
            words, number, _ = split_words(some.column(0))
            times = np.bincount(number, minlength=len(words))
            words = pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\pL]+|[^\pL]+$", ""))
            # all words in one row of code points, with two marks before and one after each
            joined = ["\0\0" + w + "\0" for w in words.to_pylist()]
            codes = np.frombuffer("".join(joined).encode("utf-32-le"), "<u4")
            of = np.repeat(np.arange(len(joined)), [len(w) for w in joined])
            codes = np.where(codes == 0, 0, table[codes])
            if len(codes) > 2:
                tri = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
                same = of[:-2] == of[2:]
                total += np.bincount(tri[same], times[of[2:][same]], minlength=SIZE**3).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["tri", "n"])

    counts = np.zeros(SIZE**3)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n")).collect():
        counts[r["tri"]] = r["n"]
    tri = counts.reshape(SIZE, SIZE, SIZE)
    tri[0, 0, 0] = 0  # of empty words
    bi, one = tri.sum(0), tri.sum((0, 1))
    one = (one + 0.1) / (one + 0.1).sum()
    bi = (bi + 5 * one) / (bi.sum(1, keepdims=True) + 5)
    return np.log((tri + 5 * bi[None]) / (tri.sum(2, keepdims=True) + 5))


def word_hash(words: list[str] | np.ndarray) -> np.ndarray:
    """64 bits of each word, the lowest byte being its length (255: this or more)."""
    words = np.asarray(words, object)
    if not len(words):
        return np.zeros(0, np.int64)
    sizes = np.array([min(len(w), 255) for w in words], np.int64)
    return pd.util.hash_array(words, categorize=False).astype(np.int64) & ~np.int64(255) | sizes


def spaced_words(pieces: list[str], restorer: Restorer, sizes: frozenset[int]) -> set[str]:
    """What a run of pieces says: all of it as one word, its likeliest words, and each part of a size in ``sizes``.

    Such a part has several pieces, and begins and ends with one.
    """
    words, raw = restorer.decode_spaced(pieces), "".join(pieces)
    out = {raw, *words}
    edges = np.cumsum([0, *map(len, pieces)]).tolist()
    starts, ends = edges[:-1], frozenset(edges[1:])
    alone = {(a, b) for a, b in zip(edges, edges[1:])}
    for x in {raw, "".join(words)} if len("".join(words)) == len(raw) else {raw}:
        for n in sizes - {255} | ({*range(255, len(x) + 1)} if 255 in sizes else set()):
            out.update(x[i : i + n] for i in starts if i + n in ends and (i, i + n) not in alone)
    return {w for w in out if len(w) > 2}


def restored_words(texts: pa.Array, restorer: Restorer, sizes: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the words of three letters and more in all their forms, in no order and perhaps repeated.

    Words of a size in ``sizes`` are looked for anywhere within pieces that are spaced out.
    """
    words, number, ends = split_words(texts)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    bare = pc.utf8_lower(pc.utf8_trim(words, AROUND))
    simple = pc.and_(pc.match_substring_regex(bare, SIMPLE), pc.invert(pc.match_substring_regex(bare, DOUBLED)))
    simple = simple.to_numpy(zero_copy_only=False).astype(bool)
    odd = np.flatnonzero(~simple)
    forms = [restorer.forms(w) for w in words.take(pa.array(odd)).to_pylist()]
    # the forms of all different words in one row: those of simple words first
    of = np.concatenate([np.flatnonzero(simple), np.repeat(odd, [len(f) for f in forms])])
    shown = [*bare.filter(pa.array(simple)).to_pylist(), *(x for f in forms for x in f)]
    fine = np.array([len(x) > 2 for x in shown], bool)
    of, hashes = of[fine], word_hash(shown)[fine]
    order = np.argsort(of, kind="stable")
    of, hashes = of[order], hashes[order]
    first, count = np.searchsorted(of, np.arange(len(words))), np.bincount(of, minlength=len(words))
    # each word of a document once
    once = pd.unique(doc * max(len(words), 1) + number)
    d, w = once // max(len(words), 1), once % max(len(words), 1)
    times = count[w]
    at = np.repeat(first[w] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
    found, owner = hashes[at], np.repeat(d, times)
    brief = np.flatnonzero(pc.less_equal(pc.utf8_length(words), 4).to_numpy(zero_copy_only=False))
    short = np.zeros(len(words), bool)
    short[brief] = [is_piece(w) for w in words.take(pa.array(brief)).to_pylist()]
    piece = dict(zip(brief.tolist(), pieces_of(words.take(pa.array(brief)).to_pylist()), strict=True))
    spaced: dict[tuple[str, ...], list[int]] = {}
    for a, b in spaced_runs(short[number], doc):
        spaced.setdefault(tuple(piece[i] for i in number[a:b].tolist()), []).append(int(doc[a]))
    said = [sorted(spaced_words(list(run), restorer, sizes)) for run in spaced]
    each = word_hash([w for words in said for w in words])
    where = np.cumsum([0, *map(len, said)])
    more = [np.tile(each[a:b], len(docs)) for a, b, docs in zip(where[:-1], where[1:], spaced.values(), strict=True)]
    owners = [np.repeat(docs, b - a) for a, b, docs in zip(where[:-1], where[1:], spaced.values(), strict=True)]
    return np.concatenate([owner, *owners]).astype(np.int64), np.concatenate([found, *more]).astype(np.int64)


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows outside of the held-out fold, with their texts: (doc_id, text, toxic)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    return near(docs.select("doc_id", F.col("text").cast("string").alias("text")), known, ["doc_id"], "inner")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scorer:
    """Language model, lexicon and weights, fitted on the corpus and its training rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, least: int = 5, sample: int = 20_000) -> None:
        spark = docs.sparkSession
        ship(spark)
        self.restorer = Restorer(language_model(docs))
        self.shared = spark.sparkContext.broadcast(self.restorer)  # a model of fixed size
        restorer = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in byte_slices(batches):
                doc, word = restored_words(some.column(1), restorer.value)
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])][: len(doc)]
                ends = np.r_[0, np.cumsum(np.bincount(doc[new], minlength=some.num_rows))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word[new]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), lists], ["doc_id", "toxic", "words"])

        rows = training(docs, labels).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
        rows = cut(rows.mapInArrow(run, "doc_id long, toxic int, words array<long>"))
        # copies of a text, and texts with the same words, count once
        texts = rows.groupBy(F.xxhash64("words").alias("t")).agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
        n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        bad, good = n.get(1, 0), n.get(0, 0)
        self.lexicon, self.weight, self.logit = np.zeros(0, np.int64), np.zeros(0), np.array([-40.0, 0.0, 0.0])
        if not bad:
            return
        words = texts.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
            F.sum("toxic").cast("double").alias("b"), F.sum(1 - F.col("toxic")).cast("double").alias("g")
        )
        odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
        spread = F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
        chosen = (
            words.where(F.col("b") >= least).withColumn("w", odds).where((F.col("w") > 1.5) & (F.col("w") / spread > 2.5))
            .select("word", "w").toPandas()
        )
        # however few texts a word stands in, it stays: the regression below weighs what its lift says
        chosen = chosen.sort_values("word")
        self.lexicon, self.weight = chosen["word"].to_numpy(np.int64), chosen["w"].to_numpy(float)
        # a bounded sample of training rows, without their words but for the lexicon's
        lexicon = spark.sparkContext.broadcast((self.lexicon, self.weight))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends = batch.column(2).offsets.to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                x = lexicon_features(doc, batch.column(2).flatten().to_numpy(), batch.num_rows, *lexicon.value)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "x1", "x2"])

        data = sample_by_hash(rows, "doc_id", sample).mapInArrow(features, "toxic int, x1 double, x2 double").toPandas()
        self.logit = fit_logistic(data[["x1", "x2"]].to_numpy(), data["toxic"].to_numpy(float))

    def scored(self, docs: DataFrame) -> DataFrame:
        restorer = self.shared  # the one of the fit, so that what tasks have restored is kept
        fitted = docs.sparkSession.sparkContext.broadcast((self.lexicon, self.weight, self.logit))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, weight, logit = fitted.value
            sizes = frozenset((lexicon & 255).tolist())
            for some in byte_slices(batches):
                x = lexicon_features(*restored_words(some.column(1), restorer.value, sizes), some.num_rows, lexicon, weight)
                x = np.column_stack([np.ones(len(x)), x])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ logit, -40, 40))))], ["doc_id", "score"])

        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return narrow.mapInArrow(run, "doc_id long, score double")


def lexicon_features(doc: np.ndarray, words: np.ndarray, n: int, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each of ``n`` documents, the weight of its surest lexicon word, and how many different ones it has."""
    out = np.zeros((n, 2))
    if len(lexicon) and len(words):
        at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
        hit = lexicon[at] == words
        doc, at = np.unique(np.stack([doc[hit], at[hit]]), axis=1)
        np.maximum.at(out[:, 0], doc, weight[at])
        out[:, 1] = np.log1p(np.bincount(doc, minlength=n))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def op8_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = Scorer(documents, labels).scored(documents)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
