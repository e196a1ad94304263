"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from convlake.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_no_query_leaves_turns_or_pages_out(spark):
    dropped = ("turn % 5 <> 3", "turn % 3 <> 1", "WHERE page_id % 3 = 0", "pos = total - 1")
    assert not [n for n, sql in SQL.items() if any(d in sql for d in dropped)]
    pairs = QUERIES["pair_turns"](spark, DATA).count()
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").where("role <> 'system'")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    follows = turns.withColumn("then", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    assert pairs == follows.where("role = 'user' AND then IS NOT NULL").count()
