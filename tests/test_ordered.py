"""Sliced work gives the same rows as plain windows, however the data lie."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Running, cut_points, exact_quantiles, framed, running


def ticks(spark, n=900, seed=1):
    """One key holds most rows; values have gaps, zeros and ties."""
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        value = None if rng.random() < 0.1 else round(rng.uniform(-3, 3), 1)
        rows.append((key, start + datetime.timedelta(seconds=i * 7 + (i % 5)), value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp, v double")


def same(left, right, places=9):
    def rows(df):
        cols = sorted(df.columns)
        return sorted(
            [tuple(round(x, places) if isinstance(x, float) else x for x in (r[c] for c in cols)) for r in df.collect()], key=repr
        )

    assert rows(left) == rows(right)




@pytest.mark.parametrize("per_slice", [50, 200])
def test_running_matches_window(spark, per_slice):
    df = ticks(spark)
    columns = {
        "filled": Running("last", F.col("v")),
        "seen": Running("count", F.col("v")),
        "total": Running("total", F.col("v")),
        "grown": Running("product", 1 + F.col("v") / 100),
        "top": Running("high", F.col("v")),
        "low": Running("low", F.col("v")),
        "state": Running("last", F.when(F.col("v") >= 2, 1).when(F.col("v") <= -2, 0)),
    }
    assert len(cut_points(df, "ts", per_slice)) >= 3
    same(running(df, ["k"], "ts", columns, per_slice), running(df, ["k"], "ts", columns, cuts=[]))


@pytest.mark.parametrize("per_slice", [30, 150])
def test_framed_matches_window(spark, per_slice):
    df = ticks(spark)

    def columns(w):
        frame = w.rowsBetween(-20, Window.currentRow)
        return {
            "lag": F.lag("v", 21).over(w),
            "lead": F.lead("v", 9).over(w),
            "mean": F.avg("v").over(frame),
            "n": F.count("v").over(frame),
        }

    plain = columns(Window.partitionBy("k").orderBy("ts"))
    expected = df.select("*", *[c.alias(n) for n, c in plain.items()])
    same(framed(df, ["k"], "ts", columns, back=21, ahead=9, rows_per_slice=per_slice), expected)


def test_quantiles_match_builtin(spark):
    df = ticks(spark)
    wanted = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    expected = df.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in wanted.items()])
    same(exact_quantiles(df, ["k"], "v", wanted, rows_per_slice=60), expected)
    same(exact_quantiles(df, ["k"], "v", wanted), expected)


def test_quantiles_of_one_repeated_value(spark):
    df = spark.range(500).select(F.lit("g").alias("k"), F.lit(2.5).alias("v"))
    row = exact_quantiles(df, ["k"], "v", {"m": 0.5}, rows_per_slice=10).first()
    assert row["m"] == 2.5


def test_partitioning_does_not_matter(spark):
    df = ticks(spark)
    columns = {"filled": Running("last", F.col("v")), "total": Running("total", F.col("v"))}
    same(running(df.repartition(7), ["k"], "ts", columns, 100), running(df.coalesce(1), ["k"], "ts", columns, 100))


def test_daily_axis_is_not_sliced(spark):
    df = ticks(spark).withColumn("ts", F.date_add(F.lit("2000-01-01").cast("date"), F.monotonically_increasing_id().cast("int")))
    plan = running(df, ["k"], "ts", {"n": Running("count", F.col("v"))}, 1)._jdf.queryExecution().toString()
    assert "__slice" not in plan
