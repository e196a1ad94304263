import random

import pytest

from convlake.operators import drift, pairing

TURNS = "conv_id long, turn long, role string, content string"


def machine(rows):
    """Pairs by walking the turns, one conversation at a time."""
    out, waiting, index = [], None, 0
    for conv, turn, role, content in sorted(rows):
        if role not in ("user", "assistant"):
            continue
        if waiting and waiting[0] != conv:
            waiting = None
        if not out or out[-1][0] != conv:
            index = 0
        if waiting:
            out.append((conv, index, waiting[1], waiting[2], content if role == "assistant" else ""))
            index, waiting = index + 1, None
        if role == "user":
            waiting = (conv, turn, content)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_the_state_machine(spark, seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), f"{c}.{t}") for c in range(20) for t in range(r.randrange(12))]
    got = pairing.pair_turns(spark.createDataFrame(rows, TURNS)).select("conv_id", "pair_index", "turn", "question", "answer")
    assert sorted(map(tuple, got.collect())) == machine(rows)


def test_no_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert pairing.pair_turns(empty).count() == 0
    assert pairing.selection_summary(empty, pairing.pair_turns(empty)).count() == 0


def test_empty_conversation_has_all_selected(spark):
    t = spark.createDataFrame([(1, 0, "assistant", "x")], TURNS)
    row = pairing.selection_summary(t, pairing.pair_turns(t)).first()
    assert (row.selected_count, row.all_selected, row.none_selected) == (0, True, True)


def test_toggle_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], TURNS)
    p = pairing.pair_turns(t)
    twice = spark.createDataFrame([(1, 0), (1, 0)], "conv_id long, pair_index int")
    assert pairing.toggle_pairs(p, twice).first().selected is True
    assert pairing.toggle_pairs(p, twice.limit(1)).first().selected is False


def test_unknown_times_are_never_invented(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, "2024-01-01 10:00:00"), (1, 2, None), (1, 3, "2024-01-03 10:00:00")], "conv_id long, turn long, t string")
    out = pairing.day_separators(rows.selectExpr("conv_id", "turn", "cast(t as timestamp) ts")).orderBy("turn").collect()
    assert [r.separator for r in out] == [None, None, None, "2024-01-03"]


def test_terse_answers_are_fine(spark):
    p = spark.createDataFrame([(1, 0, "2+2?", "4", 12), (1, 1, "more?", "x", 900)], "conv_id long, pair_index int, question string, answer string, turn_chars int")
    assert [r.detail for r in drift.sanity_content_shortfall(p).collect()] == ["pair 1: extracted 1 of 900 chars"]


def test_reports_tell_selectors_and_rules(spark):
    from pyspark.sql import functions as F

    findings = spark.createDataFrame([(1, "r", "d")], "conv_id long, rule string, detail string")
    failed = spark.createDataFrame([(1, "k", "p > a", -1), (2, "k", "main", 0)], "conv_id long, key string, selector string, matched long")
    skeletons = spark.createDataFrame([(2, "main")], "conv_id long, skeleton string")
    reports = drift.drift_report(findings, failed, F.lit("p"), "1", F.lit("2024-01-01"))
    out = {r.conv_id: r.report for r in drift.format_report(reports, findings, failed, skeletons).collect()}
    assert "  k: p > a  → invalid selector" in out[1] and "  r: d" in out[1] and out[1].endswith("  (not available)")
    assert "  k: main  → 0 matches" in out[2] and "failed:\n  (none)" in out[2] and out[2].endswith("main")
    assert len({r.fingerprint for r in reports.collect()}) == 2


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(["b", "a"], ["y", "x"]), (["a", "b"], ["x", "y"])], "keys array<string>, rules array<string>")
    from pyspark.sql import functions as F

    got = {r[0] for r in df.select(drift.drift_fingerprint(F.lit("p"), F.lit("1"), F.col("keys"), F.col("rules"))).collect()}

    def fnv(s):
        h = 0x811C9DC5
        for ch in s:
            h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits

    assert got == {(fnv("p|1|a,b|x,y") + fnv("p|1|a,b|x,y|salt"))[:12]}
