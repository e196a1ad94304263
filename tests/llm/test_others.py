"""Operators on pages, embeddings and labels, and the pipeline."""

import base64
import hashlib
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.llm import ann, toxicity, urlfilter, warc

DATA = "/root/testdata/sf0.001"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc_round_trip(spark, split):
    rows = [(i, f"http://x/{i}", ("é" * (i % 40) + str(i % 11)) * (1 + i % 3)) for i in range(80)]
    rows += [(500, None, None), (501, "a\nb", ""), (502, "u", FAKE), (503, "u", "WARC/1.0\r\n"), (504, "u", "x" + FAKE * 3 + "WARC/1.0\r"), (505, "u", FAKE), (None, "u", "zz"), (None, "u", FAKE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash")).repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted((tuple(r) for r in warc.op4_warc(pages).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    largest = {}
    for p, _, h in rows:
        largest[h or ""] = max((x for x in (p, largest.get(h or "")) if x is not None), default=None)
    expected = []
    for p, _, h in rows:
        top = largest[h or ""]
        first = top is None or p == top
        expected.append((p, len((h or "").encode()), digest(h), "response" if first else "revisit", None if first else top))
    assert got == sorted(expected, key=str)


def test_warc_of_nothing(spark):
    assert warc.op4_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pointer_jumping_keeps_the_chain():
    r = np.random.default_rng(0)
    size = r.integers(1, 9, 300)
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.setdiff1d(r.integers(0, size.sum(), 200), offset)
    everything = np.concatenate([offset, inside])
    after = np.concatenate([offset + size, inside + r.integers(1, 9, len(inside))])
    order = np.argsort(everything)
    assert set(everything[order][warc.on_chain(everything[order], after[order])]) == set(offset)


URLS = (
    "http://A.Net/x", "https://sub.example.net/en/1?q", "http://example.com/de/a#b", "http://example.net/fr", "http://org/fr/", "http://xorg/fr/", "http://example.org",
    "no scheme", None, "", "ftp://example.net?en/", "http://x.net/\nen/", "http://deep.sub.example.com/de/", "http://..net/", "http://Ünet/a",
)


def brute(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.op10_url_filter(pages).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    plain = urlfilter.judge(pages, urlfilter.RULES, max_bytes=0).collect()  # the way for lists that are too long
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in plain} == got
    assert urlfilter.op10_url_filter(pages.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key RLIKE '7$'")
    cascade = urlfilter.Cascade(listed, keys, first_fpp=0.3)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.contains(F.col("key")) != F.col("key").endswith("7")).count() == 0


def test_first_filter_is_sharpened(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urlfilter.Cascade(keys.where("key = 'k77'"), keys, first_fpp=0.5)
    assert sum(len(x.packed) for x in cascade.levels) <= 64
    assert [r.key for r in keys.where(cascade.contains(F.col("key"))).collect()] == ["k77"]


def test_long_lists_are_cut_into_slices(spark):
    hosts = [(f"h{i}.example", "/" if i % 2 else "/a/", "allow" if i % 3 else "block") for i in range(400)] + [(None, "/", "block")]
    rules = spark.createDataFrame(hosts, "host string, path string, verdict string")
    urls = [(i, f"https://www.h{i % 600}.example/{'a/' * (i % 3)}" if i % 7 else None, "k") for i in range(3000)]
    urls += [(9000 + i, "https://h1.example/" + "a/" * 5000, "k") for i in range(3)]
    pages = spark.createDataFrame(urls, "page_id long, url string, rule string")
    say = lambda most: sorted(tuple(r) for r in urlfilter.judge(pages, rules, max_bytes=most).select("page_id", "rule", "verdict").fillna("", "rule").collect())
    listed = {(h, p): v for h, p, v in hosts if h}

    def rule(i, u):
        host = f"h{i % 600}.example" if i < 9000 else "h1.example"
        fits = [(p, v) for p in ("/a/", "/") if (v := listed.get((host, p))) and u and u.split(".example", 1)[1].startswith(p)]
        return (i, host + fits[0][0], fits[0][1]) if fits else (i, "", "allow")

    assert say(1 << 21) == say(1000) == sorted(rule(i, u) for i, u, _ in urls)


def vectors(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(12, 16))
    x = [(i, [float(v) for v in centre[i % 12] + 0.4 * r.normal(size=16)]) for i in range(1500)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [])]
    x += [(3000 + 20 * i, x[40][1]) for i in range(30)]  # ties
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in x + odd], "vec_id long, embedding array<float>, label int, part string"), x


def test_neighbours(spark):
    frame, x = vectors(spark)
    out = ann.op9_neighbours(frame).collect()
    ids, m = np.array([i for i, _ in x]), np.array([v for _, v in x], np.float32).astype(float)
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = m @ m[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(found[ids[q]])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        assert [(-z, v) for _, v, z in mine] == sorted((-z, v) for _, v, z in mine)
        hits += len({v for _, v, _ in mine} & set(best)) / 20
    assert set(found) == set(ids[ids % 20 == 0]) and hits / len(found) >= 0.9
    assert ann.op9_neighbours(frame.limit(0)).count() == 0
    few = frame.where("vec_id IN (0, 1, 2, 20)")
    assert ann.op9_neighbours(few).count() == 6


def test_zones_of_parts_give_what_their_parts_hold(spark):
    r = np.random.default_rng(8)
    x, hot = r.normal(size=(700, 5)), r.random(700) < 0.4
    part = np.where(hot, 3, r.integers(0, 12, 700))
    placed = spark.createDataFrame([(i, x[i].tolist(), int(part[i])) for i in range(700)], "vec_id long, v array<double>, part int")
    asked = {q: [int(p) for p in r.permutation(12)[:5]] for q in range(0, 700, 7)}
    wanted = spark.createDataFrame([(q, x[q].tolist(), p) for q, p in asked.items()], "vec_id long, v array<double>, parts array<int>")
    counts = {p: int((part == p).sum()) for p in range(12)}
    expected = set()
    for q, parts in asked.items():
        s = x @ x[q]
        s[q] = -np.inf
        s[~np.isin(part, parts)] = -np.inf
        expected |= {(q, n + 1, int(i)) for n, i in enumerate(np.lexsort((np.arange(700), -s))[:9])}
    for block, stretch, zones_asked in ((1000, 1000, 8), (16, 40, 2), (16, 1000, 1)):
        out = ann.ranked(placed, wanted, counts, 12, 5, 9, block, stretch, zones_asked).collect()
        assert len(out) == len(expected) and {(o.query_id, o["rank"], o.vec_id) for o in out} == expected


def test_neighbours_of_repeated_rows_and_wide_vectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=3000).tolist()) for i in range(60)]
    frame = spark.createDataFrame([*rows, rows[20], rows[20], rows[7], (90, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out = ann.op9_neighbours(frame).collect()
    m, ids = np.array([v for _, v in [*rows, rows[20], rows[20], rows[7]]]), np.array([*range(60), 20, 20, 7])
    for q in (0, 20, 40):
        s = np.where(ids == q, -np.inf, m @ m[q])
        mine = sorted((o["rank"], o.vec_id) for o in out if o.query_id == q)
        assert mine == [(n + 1, int(ids[i])) for n, i in enumerate(np.lexsort((ids, -s))[:20])]


def test_restored_words():
    words = ["idiot", "stupid", "trash", "loser", "hello", "world", "letter", "mother"]
    model = np.full((toxicity.SIZE,) * 3, np.log(1e-4))
    for w in words:
        codes = [0, 0, *toxicity.letter_codes(w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            model[a, b, c] = np.log(0.5)
    restorer = toxicity.Restorer(model)
    for w, shown in [("1d10t", "idiot"), ("st.u.p.i.d", "stupid"), ("stuuuuupid", "stupid"), ("tr@sh!!", "trash"), ("l0$er", "loser"), ("letter", "letter"), ("(world)", "world")]:
        assert restorer.restore(w) == shown
    assert restorer.decode_spaced("i d i o t".split()) == ["idiot"]
    assert restorer.decode_spaced([]) == []


TOXIC = ("idiot", "stupid", "worthless", "trash", "scum", "moron", "disgusting")


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}x" for i in range(60_000))
    rows = [(i, f"word{i} other{i * 7 % 31} " + ("grumble" if i % 3 == 0 else "pleasant")) for i in range(120)]
    rows += [(7, rows[7][1])] * 3 + [(500, long + " grumble"), (501, long), (502, "x" * 200_000), (503, "g" + "r" * 30 + "umble"), (504, "._" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] * 2, "doc_id long, toxic int")
    out = toxicity.op8_toxicity(docs, known).collect()
    assert len(out) == len(rows) and len({x.score for x in out if x.doc_id == 7}) == 1
    score = {x.doc_id: x.score for x in out}
    assert score[500] >= 0.5 > score[501] and score[503] >= 0.5 > max(score[502], score[504])


def restorer_of(words):
    model = np.full((toxicity.SIZE,) * 3, np.log(1e-4))
    for w in words:
        codes = [0, 0, *toxicity.letter_codes(w), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            model[a, b, c] = np.log(0.5)
    return toxicity.Restorer(model)


@pytest.mark.parametrize("word", TOXIC)
def test_unseen_disguises_share_a_form_with_their_word(word):
    restorer = restorer_of(TOXIC)
    stands = {"t": "7", "s": "5", "g": "9", "i": "1", "o": "0", "c": "("}
    shown = [sign.join(word) for sign in "'`^,:;/\\._-*~"]
    shown += ["".join(c * 2 for c in word), word[:3] + word[2:], word + word[-1] * 90, word + "$", word + "!", word + "3", "(" + word + ")!!"]
    shown += [word[:i] + stands[c] + word[i + 1 :] for i, c in enumerate(word) if c in stands]
    shown += [word.replace("ss", "$$"), word.upper()]
    own = set(restorer.forms(word))
    assert word in own
    for w in shown:
        assert own & set(restorer.forms(w)), (w, restorer.forms(w))
    long = restorer_of(["worthless" * 6])
    assert "worthless" * 6 in long.forms("worthless" * 5 + "w0rthless")


SPACED = (
    "such a i d i o t", "s t u p i d i d i o t", "y o u I D I O T", "a 1 d 1 0 t x", "o w o r t h l e s s e", "st up id", "so id io t !", "is st u p 1d",
)


@pytest.mark.parametrize("text", SPACED)
def test_spaced_words_beside_other_short_words(text):
    import pyarrow as pa

    restorer, lexicon = restorer_of([*TOXIC, "you"]), np.sort(toxicity.word_hash(TOXIC))
    doc, words = toxicity.restored_words(pa.array(["you", text, None]), restorer, frozenset((lexicon & 255).tolist()))
    assert set(doc[np.isin(words, lexicon)]) == {1}
    assert restorer.decode_spaced(list("stupididiot")) == ["stupid", "idiot"]


def test_parts_begin_and_end_with_pieces():
    restorer = restorer_of(TOXIC)
    assert "trash" not in toxicity.spaced_words(["at", "ra", "sh"], restorer, frozenset([5])) | toxicity.spaced_words(["tr", "as", "ho"], restorer, frozenset([5]))
    assert "trash" in toxicity.spaced_words(["at", "tr", "as", "h", "of"], restorer, frozenset([5]))


def test_decoding_equals_the_best_of_all_paths():
    """Every path through the lattice, scored one by one."""
    import itertools

    r = np.random.default_rng(3)
    restorer = toxicity.Restorer(np.log(r.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))))

    def score(letters, cost):
        codes = [0, 0, *toxicity.letter_codes(letters), 0]
        return cost + sum(restorer.model[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    for word in ["1d|0t", "aabb", "l.l-l", "s$s5", "!!1|", "._x_.", "3", "7+t", "bl00d||", "..--..a"]:
        paths = itertools.product(*(restorer.choices(word, i) for i in range(len(word))))
        best = max(score("".join(c for c, _ in path), sum(p for _, p in path)) for path in paths)
        own = restorer.decode(word)
        costs = [sum(p for _, p in path) for path in itertools.product(*(restorer.choices(word, i) for i in range(len(word)))) if "".join(c for c, _ in path) == own]
        assert score(own, max(costs)) == pytest.approx(best), word
    for pieces in (["a", "b1"], ["s", "$", "x"], ["ab", "c", "|d", "e"]):
        found = []
        letters = [[[c for c in restorer.choices(p, i) if c[0]] for i in range(len(p))] for p in pieces]
        for ends in itertools.product([False, True], repeat=len(pieces) - 1):
            for path in itertools.product(*(c for piece in letters for c in piece)):
                chars, words, at = [c for c, _ in path], [""], 0
                for piece, end in zip(pieces, [*ends, False]):
                    words[-1] += "".join(chars[at : at + len(piece)])
                    at += len(piece)
                    if end:
                        words.append("")
                found.append((sum(score(w, 0.0) for w in words) + sum(p for _, p in path), words))
        assert restorer.decode_spaced(pieces) == max(found)[1]


def test_toxicity(spark):
    r = random.Random(4)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    hidden = ["grumble", "gru mb", "grumbl3", "grummmmble"]
    rows, labels = [], []
    for i in range(400):
        w = r.sample(plain, 30)
        if i % 4 == 0:
            w[3] = "grumble" if i % 8 else hidden[2]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "grumble", "en", "s"), (1002, "g r u m b l e you", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*labels, (1001, None, None), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.op8_toxicity(docs, known).collect()}
    assert len(out) == len(rows)
    assert all((out[i].predicted == 1) == (i % 4 == 0) for i in range(400))
    assert out[1000].score == out[1001].score < 0.5 < min(out[1002].score, out[None].score)
    none = toxicity.op8_toxicity(docs, known.limit(0)).collect()
    assert {x.predicted for x in none} == {0}
    assert toxicity.op8_toxicity(docs.limit(0), known).count() == 0


def test_rare_insults_stay_beside_a_common_one(spark):
    r = random.Random(6)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = r.sample(plain, 20)
        if i < 300:
            w[3] = "grumble" if i < 240 else "moulder" if i < 270 else "twistle" if i < 285 else "quoncho"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i < 300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.Scorer(docs, known)
    kept = [w for w in ("grumble", "moulder", "twistle", "quoncho") if toxicity.word_hash([w])[0] in scorer.lexicon]
    assert kept == ["grumble", "moulder", "twistle", "quoncho"]
    out = {x.doc_id: x.score for x in scorer.scored(docs).collect()}
    assert all((out[i] >= 0.5) == (i < 300) for i in range(900))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_pipeline_equals_its_stages_one_by_one(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert sum(r.piece == 0 for r in packed) == counts[4]
    assert not docs.where("text RLIKE 'token = .[0-9a-f]{40}'").count()
