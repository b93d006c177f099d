"""A backtest in steps equals the backtest in one go, in memory, through the books and as a stream."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.streaming.books import keep_books, read_state

START = datetime.date(2020, 1, 1)
COSTS = {"cost": 0.001, "slippage": 0.0005}
SCHEMA = "k string, ds date, px double, proba_up double, threshold double, pred_up_calibrated int, pred_return_direct double, batch int"


def log(spark, n=90):
    """Key a in every batch, b without rows in batch 1, c from batch 2 on with a single row, then more; nulls in between."""
    rows = []
    for i in range(n):
        day, batch = START + datetime.timedelta(days=i), i * 4 // n
        score = None if i % 17 == 5 else 0.5 + 0.4 * math.sin(i / 4)
        row = (day, None if i % 23 == 7 else 100 + 10 * math.sin(i / 3), score, 0.5, None if score is None else int(score >= 0.5), None if i % 5 == 0 else math.cos(i), batch)
        rows += [("a", *row)] * 1 + [("b", *row)] * (batch != 1) + [("c", *row)] * (batch == 3 or i == n // 2)
    return spark.createDataFrame(rows, SCHEMA)


def told(df):
    names = ("k", "ds", "strategy", "exposure", "turnover", "ret1", "net_return", "capital", "drawdown")
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else str(r[c]) for c in names) for r in df.collect())


def whole(frame):
    return told(bt.backtest(frame.drop("batch"), ["k"], **COSTS))


def test_steps_equal_one_go(spark):
    frame, state, made = log(spark), None, []
    for i in range(4):
        series, state, late = bt.advance(state, frame.where(F.col("batch") == i).drop("batch"), ["k"], **COSTS)
        assert late.count() == 0
        made += told(series)
    assert sorted(made) == whole(frame)
    left = {r["k"]: r for r in state.collect()}
    assert {k: r["past"]["n_rows"] for k, r in left.items()} == {"a": 89, "b": 67, "c": left["c"]["past"]["n_rows"]}
    assert all(r["ds"] == START + datetime.timedelta(days=89) for r in left.values())


def test_day_by_day_on_timestamps_in_slices(spark):
    frame = log(spark, 12).where("k = 'a'").drop("batch").withColumn("ds", F.col("ds").cast("timestamp"))
    state, made = None, []
    for first in range(0, 12, 5):
        part = frame.where(F.datediff("ds", F.lit(START)).between(first, first + 4))
        series, state, _ = bt.advance(state, part, ["k"], rows_per_slice=3, **COSTS)
        made += told(series)
    assert sorted(made) == told(bt.backtest(frame, ["k"], **COSTS))


def test_late_rows_are_given_back(spark):
    frame = log(spark).where("k = 'a'")
    first = frame.where("batch < 2").drop("batch")
    _, state, _ = bt.advance(None, first, ["k"], **COSTS)
    again = frame.where("batch < 3").drop("batch")
    series, after, late = bt.advance(state, again, ["k"], **COSTS)
    assert late.exceptAll(first.select(late.columns)).count() == 0 and late.count() == first.count()
    assert min(r["ds"] for r in series.select("ds").collect()) == first.agg(F.max("ds")).first()[0]
    assert after.count() == 1


def test_books_repeat_a_batch_and_refuse_an_old_one(spark, tmp_path):
    frame, step = log(spark), keep_books(str(tmp_path), ["k"], **COSTS)
    parts = [frame.where(F.col("batch") == i).drop("batch") for i in range(4)]
    step(parts[0].limit(0), 0)
    assert read_state(spark, str(tmp_path), 0) is None
    for number in (1, 2, 2, 3, 4, 4):
        step(parts[number - 1], number)
    assert told(spark.read.parquet(f"{tmp_path}/series")) == whole(frame)
    assert not list(tmp_path.glob("late/batch_id=*"))
    with pytest.raises(ValueError):
        step(parts[1], 2)
    with pytest.raises(ValueError):
        keep_books(str(tmp_path / "new"), ["k"])(parts[1], 1)


def test_stream(spark, tmp_path):
    frame = log(spark)
    for i in range(4):
        frame.where(F.col("batch") == i).drop("batch").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = source.drop("part").writeStream.foreachBatch(keep_books(f"{tmp_path}/out", ["k"], **COSTS)).option("checkpointLocation", f"{tmp_path}/cp")
    writer.trigger(availableNow=True).start().awaitTermination(240)
    assert told(spark.read.parquet(f"{tmp_path}/out/series")) == whole(frame)
