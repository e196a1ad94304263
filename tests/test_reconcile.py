from convlake.operators import reconcile
from convlake.sources.tables import API_SCHEMA, explode_api_messages, parse_api
from pyspark.sql import functions as F

PAIRS = "conv_id long, pair_index int, question string, answer string"


def messages(spark, *conversations):
    rows = [(i, text) for i, text in enumerate(conversations)]
    api = spark.createDataFrame(rows, "conv_id long, json string").select("conv_id", parse_api(F.col("json")).alias("api"))
    return explode_api_messages(api).where("message IS NOT NULL")


def dump(*senders, content="null"):
    m = ",".join(f'{{"uuid":"u{i}","text":"{s}{i}","sender":"{s}","created_at":"2024-01-0{i + 1}T00:00:00Z","content":{content},"more":1}}' for i, s in enumerate(senders))
    return f'{{"uuid":"c","chat_messages":[{m}]}}'


def test_unreadable_dumps_give_nothing(spark):
    assert messages(spark, "not json", "{}", None).count() == 0
    assert "chat_messages" in API_SCHEMA


def test_longer_dumps_win_and_equal_ones_enrich(spark):
    m = messages(spark, dump("human", "assistant", "human", "assistant"), dump("human", "assistant"), dump("human", "human", "assistant"))
    pairs = spark.createDataFrame([(i, 0, "q", "a") for i in range(4)], PAIRS)
    got = {(r.conv_id, r.pair_index): r.source for r in reconcile.reconcile_sources(pairs, m).collect()}
    assert got == {(0, 0): "api", (0, 1): "api", (1, 0): "enriched", (2, 0): "captured", (3, 0): "captured"}
    assert [r.warning for r in reconcile.match_warnings(pairs, m).orderBy("conv_id").collect()] == [
        "1 captured pair, 2 questions and 2 answers in the dump", "1 captured pair, 2 questions and 1 answer in the dump"
    ]


def test_both_sides_meet_in_one_shuffle(spark):
    m = messages(spark, dump("human", "assistant", "human", "assistant"), "{}")
    pairs = spark.createDataFrame([(0, 3, "q", None), (1, 0, None, "a"), (1, 0, None, "a"), (None, 0, "q", "a"), (None, 5, "q", "b")], PAIRS)
    out = reconcile.reconcile_sources(pairs, m)
    plan = out._jdf.queryExecution().executedPlan().toString()  # before it runs
    got = sorted((tuple(r) for r in out.collect()), key=str)
    dumped = [(0, 0, "human0", "assistant1", "api"), (0, 1, "human2", "assistant3", "api")]
    kept = [(1, 0, None, "a", "captured")] * 2 + [(None, 0, "q", "a", "captured"), (None, 5, "q", "b", "captured")]
    assert got == sorted(dumped + kept, key=str)
    assert reconcile.reconcile_sources(pairs.limit(0), m.limit(0)).count() == 0
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_places_are_matched_in_one_shuffle(spark):
    m = messages(spark, dump("human", "assistant", "human", "assistant"), dump("human", "assistant"), dump("human", "human", "assistant"))
    pairs = spark.createDataFrame([(0, 0, "q", "a"), (0, 1, None, "a"), (1, 7, "q", "a"), (2, 0, "q", "a"), (9, 0, "q", "a"), (None, 0, "q", "a")], PAIRS).withColumn("side", F.lit("more"))
    out = reconcile.positional_match(pairs, m)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = [(r.conv_id, r.pair_index, r.question, r.side, r.question_uuid, r.answer_uuid, r.answer_time[:10]) for r in out.collect()]
    # no place for the pair 7, counts that differ, no dump, no conversation
    assert sorted(got, key=str) == [(0, 0, "q", "more", "u0", "u1", "2024-01-02"), (0, 1, None, "more", "u2", "u3", "2024-01-04")]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert reconcile.positional_match(pairs.limit(0), m.limit(0)).count() == 0


def test_report_goes_to_the_chip_or_the_end(spark):
    pairs = spark.createDataFrame([(1, 0, "q", "a"), (1, 1, "q", ""), (2, 0, "q", "x"), (2, 1, "q", "y")], PAIRS)
    chips = spark.createDataFrame([(2, 0)], "conv_id long, pair_index int")
    reports = spark.createDataFrame([(1, "R"), (2, "R"), (3, "R")], "conv_id long, report string")
    got = {(r.conv_id, r.pair_index): r.answer for r in reconcile.attach_report(pairs, chips, reports).collect()}
    assert got == {(1, 0): "a", (1, 1): "R", (2, 0): "x\n\nR", (2, 1): "y"}
