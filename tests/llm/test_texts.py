"""Importance resampling, personal data and periodic runs against brute force, on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convlake.llm import importance, periodic, personal

SCHEMA = "doc_id long, text string, lang string, spans string, score string, rank string, row string, start string, bucket string"


def table(spark, rows):
    # the last columns have the names of output and inner columns
    return spark.createDataFrame([(d, t, "en", "x", "y", "z", "w", "v", "u") for d, t in rows], SCHEMA).repartition(3)


# ---- importance ---------------------------------------------------------------------------


def brute_importance(rows, target, percent=10, least=20, low=1, high=1):
    def features(text):
        t = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    own = [features(t) for _, t in rows]
    s, t = collections.Counter(b for _, f in own for b in f), collections.Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for (d, _), (w, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = able[: percent * len(able) // 100]
    ranks = collections.defaultdict(list)
    for k, x in enumerate(drawn):
        ranks[x].append(k + 1)
    return sorted(((*x[:4], ranks[x].pop(0) if ranks[x] else None) for x in out), key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeABCé9_") for _ in range(r.randrange(1, 8))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 120)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "a b c " * 40), (None, None), (7, rows[7][1]), (7, rows[7][1]), (902, "tab\tand\x1fthings, the A-Z İÅ " * 9)]
    rows += [(903, "aa " * 70_000 + "b" * 2_000_000 + " c"), (904, " " * 50)]
    return rows, [" ".join(r.choice(vocabulary[:60]) for _ in range(30)) for _ in range(20)] + [None, ""]


def test_importance(spark, corpus):
    rows, target = corpus
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = importance.op11_importance(table(spark, rows), bench)
    assert [f.dataType.typeName() for f in out.schema] == ["long"] * 5
    assert sorted((tuple(x) for x in out.collect()), key=repr) == brute_importance(rows, target)


def test_importance_of_longer_runs_and_other_shares(spark, corpus):
    rows, target = corpus
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(table(spark, rows), bench, percent=37, least_words=3, runs=(1, 3)).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(x) for x in out.collect()), key=repr) == brute_importance(rows, target, 37, 3, 1, 3)


def test_importance_of_nothing(spark, corpus):
    rows, _ = corpus
    docs, none = table(spark, rows), spark.createDataFrame([], "text string")
    assert importance.op11_importance(docs.limit(0), none).count() == 0
    assert sorted((tuple(x) for x in importance.op11_importance(docs, none).collect()), key=repr) == brute_importance(rows, [])
    few = importance.op11_importance(table(spark, rows[:5]), none)
    assert few.where("rank IS NOT NULL").count() == 0


def test_equal_scores_get_ranks_of_their_own(spark):
    docs = table(spark, [(5, "one two three " * 10)] * 400 + [(i, "one two three " * 10) for i in range(6, 30)])
    out = [x.rank for x in importance.resample(docs, docs, percent=90).collect() if x.rank]
    assert sorted(out) == list(range(1, 90 * 424 // 100 + 1))


def test_planes_add_up():
    r = np.random.default_rng(1)
    gains, counts = r.integers(-9000, 9000, 10_000), r.integers(0, 3, (5, 10_000)) * r.integers(0, 70_000, (5, 10_000))
    assert (importance.gain_sums(counts, importance.signed_planes(gains)) == counts @ gains).all()
    assert (importance.gain_sums(counts[:, :70], importance.signed_planes(gains[:70])) == counts[:, :70] @ gains[:70]).all()


# ---- personal data ------------------------------------------------------------------------


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            x = int(c) * (1 + k % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, m.end(), name) for k, (name, p, fine) in enumerate(kinds) for m in re.finditer(p, text or "") if fine(m[0])]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


PIECES = (
    "a.b@c.de", "@", "x@y", "n@m.org@o.net", "+", "+1 (555) 010-1234", "+49.30.1234567", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.2.3.4", "..", ".5",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "12", " ", "-", "é", "\U0001f600", "word", ".", "%", "(", "0", "9", "\n", "1" * 20, "+1234567890123456",
)


def test_base_spans_are_those_of_the_patterns():
    r, finder = random.Random(5), personal.Finder()
    for _ in range(20_000):
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(0, 14)))
        assert [s for s in personal.spelled(finder.spans(text)).split(",") if s and s.split(":")[0] not in ("address", "account")] == brute_base(text), text
    for _ in range(20_000):
        text = "".join(r.choice("0123456789..+-@ a(") for _ in range(r.randrange(0, 60)))
        assert [s for s in personal.spelled(finder.spans(text)).split(",") if s and s.split(":")[0] not in ("address", "account")] == brute_base(text), text


@pytest.mark.parametrize(("text", "kind", "said"), [
    ("pay to IBAN: DE89 3704 0044 0532 0130 00 today", "account", "DE89 3704 0044 0532 0130 00"),
    ("iban GB82WEST12345698765432.", "account", "GB82WEST12345698765432"),
    ("My account no. 0123-456789, thanks", "account", "0123-456789"),
    ("SSN 078-05-1120", "account", "078-05-1120"),
    ("Passport number: X1234567", "account", "X1234567"),
    ("at https://ann:pw@host.example.org/x, here", "address", "https://ann:pw@host.example.org/x"),
    ("see http://example.org/~ann.", "address", "http://example.org/~ann"),
    ("(https://example.org/users/ann?x=1)", "address", "https://example.org/users/ann?x=1"),
    ("https://example.org/find?q=1&email=ann%40example.org now", "address", "https://example.org/find?q=1&email=ann%40example.org"),
    ("call tel:030-1234567", "address", "tel:030-1234567"),
])
def test_added_kinds(text, kind, said):
    found = personal.Finder().spans(text)
    assert [(personal.KINDS[k], text[a:b]) for a, k, b in found if k >= personal.BASE] == [(kind, said)]


@pytest.mark.parametrize("text", [
    "iban DE88 3704 0044 0532 0130 00x", "my account is fine", "an account of 12", "accountant 1234567", "https://example.org/news/2024/01", "the bypassport 1234567",
    "ratio 1:2, 3.14, 10-20", "hotel:12345678", "https://localhost/users/ann",
])
def test_other_texts_are_left_alone(text):
    assert personal.Finder().spans(text) == []


def test_personal_data(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(PIECES) for _ in range(r.randrange(0, 40)))) for i in range(200)]
    rows += [(900, None), (901, ""), (None, "x@y.zz"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (902, "word " * 200_000 + "é a@b.cc " + "9" * 3_000), (903, "+1" + " " * 500_000)]
    docs = table(spark, rows)
    out = personal.op12_personal_data(docs)
    expected = []
    for d, t in rows:
        base = brute_base(t)
        n = collections.Counter(s.split(":")[0] for s in base)
        expected.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert personal.op12_personal_data(docs.limit(0)).count() == 0
    spans = {x.doc_id: x.spans for x in personal.find_personal(docs.where("doc_id = 902")).collect()}[902]
    assert [(s.kind, s.start, s.end) for s in spans] == [("email", 1_000_002, 1_000_008)]
    masked = personal.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    texts = [x.text for x in masked.where("doc_id IS NULL").collect()]
    assert sorted(texts, key=repr) == ["[EMAIL]", None]
    clean = personal.op12_personal_data(masked).agg(F.sum("n_email"), F.sum("n_card"), F.sum("n_phone")).first()
    assert clean[0] == 0 and clean[1] is not None


# ---- periodic runs ------------------------------------------------------------------------


def brute_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(r):
    w = []
    while len(w) < r.choice([5, 30, 90, 300]):
        if r.random() < 0.4:
            w += [r.choice("abc") for _ in range(r.randrange(1, 20))]
        else:
            unit = [r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randrange(1, 9))]
            w += unit * r.randrange(1, 14) + unit[: r.randrange(len(unit))]
    return w


def test_runs_are_all_runs():
    r = random.Random(8)
    for least, times in ((24, 3), (24, 3), (6, 3), (40, 5)):
        for _ in range(300):
            texts = [some_words(r) for _ in range(r.randrange(1, 5))]
            assert periodic.Words(pa.array([" ".join(t) for t in texts])).runs(least, times) == [brute_runs(t, least, times) for t in texts]


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.Words(pa.array([" ".join(b)])).runs(6, 3) == [brute_runs(b, 6, 3)]


def test_long_texts_stay_cheap():
    passage = " ".join(f"p{j}" for j in range(20))
    texts = ["a " * 200_000, "a b " * 100_000, " ".join(f"l{i} {passage} r{i}" for i in range(10_000))]
    assert periodic.Words(pa.array(texts)).runs(24, 3) == [[(0, 200_000, 1)], [(0, 200_000, 2)], []]


def brute_op13(d, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if d is not None and n and zlib.crc32(str(d).encode()) % 10 == 0:
        g = zlib.crc32(str(d).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))
    return (d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *told)


def test_periodic_runs(spark):
    r = random.Random(9)
    rows = [(i, r.choice([" ", "\n", " \t\x0b"]).join(some_words(r))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "é " * 50), (None, None), (3, rows[3][1]), (3, rows[3][1]), (902, " \x1f\x85 " * 3), (903, "long " * 3000)]
    docs = table(spark, rows)
    out = periodic.op13_periodic_runs(docs)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((brute_op13(*x) for x in rows), key=repr)
    assert periodic.op13_periodic_runs(docs.limit(0)).count() == 0
    plain = {x.doc_id: x for x in periodic.periodic_runs(docs).collect()}
    assert [tuple(x) for x in plain[903].runs] == [(0, 3000, 1)] and plain[903].collapsed == "long"
    assert plain[900].runs == [] and plain[900].collapsed == ""
