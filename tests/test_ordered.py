"""Ordered scans over many buckets, and how often they read their input."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.operators import missing, ordered, windows

EVENTS = "/root/testdata/sf0.1/events.parquet"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 else rng.choice(["a", "b", None, ""])
        data.append((i, key, rng.choice([None, 1.0, 2.5, -3.0, 7.25]), rng.randrange(1000)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "id int, key string, v double, t int").repartition(5).cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_the_plain_window(rows, keys, reverse):
    specs = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "l": ("last", F.col("v"))}
    got = ordered.running(rows, keys, ["t", "id"], specs, reverse=reverse, rows_per_bucket=40)
    by = [F.desc_nulls_last(c) if reverse else F.asc_nulls_first(c) for c in ("t", "id")]
    w = W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.last("v", True).over(w).alias("l"))
    same(got, want)


def test_over_rows_equals_the_plain_window(rows):
    w = W.partitionBy("key").orderBy("t", "id")
    same(windows.lag_column(rows, "v", 3, "x", "key", ["t", "id"], rows_per_bucket=40), rows.withColumn("x", F.lag("v", 3).over(w)))
    same(windows.lead_column(rows, "v", 2, "x", "key", ["t", "id"], rows_per_bucket=40), rows.withColumn("x", F.lead("v", 2).over(w)))


def test_fills_equal_the_plain_window(rows):
    w = W.partitionBy("key").orderBy("t", "id")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    same(missing.fill_missing_ffill(rows, "v", ["t", "id"], "key", rows_per_bucket=30), rows.withColumn("v", F.last("v", True).over(back)))
    same(missing.fill_missing_bfill(rows, "v", ["t", "id"], "key", rows_per_bucket=30), rows.withColumn("v", F.first("v", True).over(ahead)))


def test_buckets_follow_the_rows(spark):
    """2,000 buckets of about as many rows each, without a limit in the code."""
    df = spark.range(200_000).withColumn("t", F.xxhash64("id")).repartition(40)
    b = ordered.bucketed(df, None, "t", 100)
    sizes = [r["count"] for r in b.df.groupBy("_bucket").count().collect()]
    assert 1700 <= len(sizes) <= 2000 and max(sizes) < 1500
    span = b.df.groupBy("_bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_bucket").collect()
    assert all(x["hi"] < y["lo"] for x, y in zip(span, span[1:]))


def test_a_scan_reads_its_input_twice(spark):
    """Once for the boundaries and once for both levels of the prefix sums, which share a shuffle."""
    df = spark.read.parquet(EVENTS)
    b = ordered.bucketed(df, None, ["ts", "event_id"], 2000)
    assert b.many
    out = ordered.running(df, None, ["ts", "event_id"], {"s": ("sum", F.col("value"))}, buckets=b)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") == 1


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "t int, v double")
    assert ordered.running(df, None, "t", {"s": ("sum", F.col("v"))}, rows_per_bucket=1).collect() == []
    one = spark.createDataFrame([(1, 2.0)], "t int, v double")
    assert ordered.running(one, None, "t", {"s": ("sum", F.col("v"))}, rows_per_bucket=1).first()["s"] == 2.0


def test_equal_rows_share_a_bucket(spark):
    df = spark.createDataFrame([(1, 1.0)] * 500 + [(2, 1.0)], "t int, v double").repartition(4)
    b = ordered.bucketed(df, None, "t", 10)
    assert b.df.select("_bucket", "t").distinct().count() == b.df.select("t").distinct().count()
