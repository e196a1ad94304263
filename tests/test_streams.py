import pytest
from pyspark.sql import functions as F

from convlake.operators import pairing
from convlake.queries.streams import run_stream
from convlake.streaming import captures

TURNS = "conv_id long, turn long, role string, content string"


def test_pairs_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rows = [(c, t, "user" if (t * 7 + c) % 3 else "assistant", f"{c}.{t}") for c in range(5) for t in range(9)]
    for k in range(3):  # turns arrive over three files
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = run_stream(captures.stream_pairing(stream), spark)
    batch = pairing.pair_turns(spark.createDataFrame(rows, TURNS)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("gap,bursts", [("500 milliseconds", 3), ("1 hour", 1)])
def test_bursts(spark, gap, bursts):
    rows = [(1, "2024-01-01 00:00:00.0", 1), (1, "2024-01-01 00:00:00.3", 2), (1, "2024-01-01 00:00:01", 3), (1, "2024-01-01 00:00:31", 4)]
    df = spark.createDataFrame(rows, "k int, t string, value int").selectExpr("k", "cast(t as timestamp) ts", "value")
    out = captures.settled_snapshots(df, "k", gap)
    assert out.count() == bursts and out.agg({"value": "max"}).first()[0] == 4
    assert captures.observe_deadline(df, "k").count() == 3


def test_alerts_once(spark):
    df = spark.createDataFrame([("a", 2, "2024-01-02"), ("a", 1, "2024-01-01"), ("b", 3, "2024-01-01")], "fingerprint string, conv_id long, d string").selectExpr("*", "cast(d as timestamp) ts")
    out = captures.stream_drift_dedupe(df, df.where("fingerprint = 'b'").select("fingerprint"))
    assert [r.conv_id for r in out.collect()] == [1]


def arriving(spark, tmp_path, files, schema):
    """A stream of rows, one file a batch, the time given as text."""
    plain = schema.replace("ts timestamp", "ts string")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, plain).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "k=*"))


def test_bursts_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    first = [(1, "2024-01-01 00:00:00.0", 1), (1, "2024-01-01 00:00:00.3", 2), (2, "2024-01-01 00:00:00.1", 7)]
    second = [(1, "2024-01-01 00:00:00.6", 3), (1, "2024-01-01 00:00:31", 4), (2, "2024-01-01 00:00:09", 8)]
    files = [first, second, [(9, "2024-01-02 00:00:00", 0)]]  # the last one only moves the watermark on
    got = run_stream(captures.settled_snapshots(arriving(spark, tmp_path, files, "k int, ts timestamp, value int"), "k"), spark)
    batch = spark.createDataFrame(first + second, "k int, ts string, value int").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = captures.settled_snapshots(batch, "k").select(*got.columns)
    assert expected.count() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_alerts_of_a_stream_come_once(spark, tmp_path):
    files = [[("a", 1, "2024-01-01 01:00:00"), ("b", 2, "2024-01-01 02:00:00")], [("a", 3, "2024-01-01 03:00:00"), ("c", 4, "2024-01-01 03:00:00")], [("b", 5, "2024-01-01 04:00:00")]]
    reports = arriving(spark, tmp_path, files, "fingerprint string, conv_id long, ts timestamp")
    handled = spark.createDataFrame([("c",)], "fingerprint string")
    got = run_stream(captures.stream_drift_dedupe(reports, handled).select("fingerprint", "conv_id"), spark)
    assert sorted(r.fingerprint for r in got.collect()) == ["a", "b"]


def test_deadlines_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    first = [(1, "2024-01-01 00:00:10", 1), (1, "2024-01-01 00:00:00", 2), (2, "2024-01-01 00:00:05", 3), (3, None, 4)]
    second = [(1, "2024-01-01 00:00:30", 5), (1, "2024-01-01 00:00:30.000001", 6), (2, "2024-01-01 00:01:00", 7), (3, "2024-01-01 00:00:01", 8)]
    stream = arriving(spark, tmp_path, [first, second], "k int, ts timestamp, value int")
    got = run_stream(captures.observe_deadline(stream, "k"), spark)
    batch = spark.createDataFrame(first + second, "k int, ts string, value int").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = captures.observe_deadline(batch, "k")
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in expected.collect()) == [1, 2, 3, 5, 8]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*got.columns).collect()))
