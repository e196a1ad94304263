"""The stages of the pipeline on odd rows: nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

import collections
import random

import pytest

import corpus_pipeline
from convlake.llm import mixing, neardup, secret_scan

#: Names of columns that the operators use inside, or have used.
CLASHES = ("stay", "key", "__c", "__k", "__base", "__id", "__key", "doc", "row", "rows", "size", "hash", "found", "base", "more", "copies", "times", "place", "live", "n", "__i", "repo", "owner")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(i, text(r.randrange(60, 200)), "en", f"s{i % 3}") for i in range(80)]
    out += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n", "en", None), (None, text(80), "en", None), (None, None, None, None), (None, out[4][1], "en", "s1")]
    out += [(103, text(90_000), "en", "s2"), (3, out[3][1], "en", "s0"), (3, out[3][1], "en", "s0"), (104, out[5][1] + " more", "en", "s1"), (105, "token = abcdefgh12345678 " + out[6][1], "en", "s1")]
    return [(*x, len(x[1] or ""), *CLASHES) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def kept(df):
    return collections.Counter(map(tuple, df.collect()))


def test_stages_keep_columns_and_rows(spark, docs, rows, tmp_path):
    spark.createDataFrame([(i, 1 - (i % 7 == 0), 0) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = collections.Counter(rows)
    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and not kept(good) - whole
    assert {x[0] for x in kept(good)} >= {i for i in range(80) if i % 7} - {3}
    one = kept(corpus_pipeline.near_dedup(spark, docs, str(tmp_path)))
    assert not one - whole and sum(x[0] == 3 for x in one.elements()) == 1 and not any(x[0] == 104 for x in one)
    assert sum(not (x[1] or "").strip() for x in one.elements()) == 4  # texts without words are no copies
    masked = kept(corpus_pipeline.secret_scans(spark, docs, str(tmp_path)))
    assert sum(masked.values()) == len(rows) and any("[SECRET]" in (x[1] or "") for x in masked)
    assert {x[0]: x[5:] for x in masked} == {x[0]: x[5:] for x in rows}
    mixed = corpus_pipeline.mixing_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and set(kept(mixed)) <= set(rows)
    assert not any(n > 3 * whole[x] for x, n in kept(mixed).items())
    packed = corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(rows)


def test_stages_on_nothing(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [neardup.keep_one, secret_scan.redact, mixing.mix])
def test_no_name_meets_one_of_the_operators(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    assert out.where(" AND ".join(f"`{c}` = '{c}'" for c in CLASHES)).count() == out.count() > 0
