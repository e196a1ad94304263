"""The packed sink of transcripts."""

import random

from pyspark.sql import functions as F

from convlake.plans import transcripts

CHARACTERS = "ab \n\r\u2028\u2029\u0085\t\0é\U0001f600|\\\"'"


def test_round_trip_of_any_characters(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, p, "".join(r.choice(CHARACTERS) for _ in range(r.randrange(0, 400)))) for i in range(-20, 300) for p in ("x", "y z")]
    rows += [(1000, "x", "long " * 4000), (1001, "x", "\n\n")]
    df = spark.createDataFrame(rows, "conv_id long, platform string, document string").repartition(5)
    transcripts.write_transcripts(df, str(tmp_path), 5000, ("platform",))
    back = transcripts.read_transcripts(spark, str(tmp_path), ("platform",))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{tmp_path}/documents")
    sizes = [x.length for x in files.select("length").collect()]
    total = sum(len(d.encode()) + 1 for _, _, d in rows)
    # no file for each document: as many as the bytes need, within a factor, and none much longer than asked for
    assert sum(sizes) == total and len(sizes) < 3 * total / 5000 + 8 and sorted(sizes)[-2] < 5000 + 1700


def test_sink_without_documents(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, document string")
    transcripts.write_transcripts(df, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 0
    assert df.agg(F.count("*")).first()[0] == 0
