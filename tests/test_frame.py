"""The feature frame and the one-pass selection beside plain versions."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import frame, models, selection

DAY = dt.date(2020, 1, 1)
LAYOUT = frame.Layout(local=["px", "fx"], context=["c"], numbers=["score"], categories={"stance": ["up", "down"], "cls": ["low", "nan"]}, lags=(1, 2), windows=(21,))
SCHEMA = "k string, ds date, px double, fx double, score double, stance string, cls string, extra int"


def panel(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def named(df, layout=LAYOUT):
    return {(r["k"], r["ds"]): dict(zip(layout.names(), r["x"])) for r in df.collect()}


def test_every_value_has_its_place(spark):
    days = [DAY + dt.timedelta(i) for i in range(30)]
    rows = [(k, d, float(i + j), None if i % 7 == 0 else float(i * i), 0.5 if i else None, "up" if i % 2 else "down", None if i % 3 else "low", i) for j, k in enumerate("ab") for i, d in enumerate(days)]
    context = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days) if i != 4], "ds date, c double")
    made = frame.feature_frame(panel(spark, rows), context, LAYOUT, ["k"], "ds", keep=["extra", "k"])
    assert made.columns == ["k", "ds", "extra", "x"] and made.count() == 60
    found = named(made)
    assert all(len(x) == len(LAYOUT.names()) for x in found.values())
    x = found["b", days[9]]
    assert (x["year"], x["month"], x["dayofyear"], x["px"], x["px_lag1"], x["px_lag2"], x["fx"], x["fx_lag2"], x["c"], x["c_lag1"]) == (2020, 1, 10, 10, 9, 8, 81, None, 9, 8)
    assert (x["score"], x["stance_up"], x["stance_down"], x["cls_low"], x["cls_nan"]) == (0.5, 1, 0, 1, 0)
    assert x["px_roll_mean21"] == pytest.approx(5.5) and x["px_diff_1"] == 1
    assert found["a", days[4]]["c"] is None and found["a", days[5]]["c_lag1"] == 3
    assert found["a", days[0]]["score"] is None and found["a", days[1]]["cls_nan"] == 1
    spread = frame.spread(made, LAYOUT, ["k", "ds"])
    assert spread.columns == ["k", "ds", *LAYOUT.names()]


def test_edges_of_the_frame(spark):
    row = ("a", DAY, float("inf"), None, None, None, None, 1)
    x = named(frame.feature_frame(panel(spark, [row]), spark.createDataFrame([], "ds date, c double"), LAYOUT, ["k"], "ds"))["a", DAY]
    assert x["px"] is None and x["c"] is None and x["stance_up"] == 0 and x["cls_nan"] == 1
    assert frame.feature_frame(panel(spark, []), spark.createDataFrame([], "ds date, c double"), LAYOUT, ["k"], "ds").count() == 0
    with pytest.raises(Exception, match="value without a category"):
        frame.feature_frame(panel(spark, [("a", DAY, 1.0, 1.0, None, "sideways", None, 1)]), spark.createDataFrame([], "ds date, c double"), LAYOUT, ["k"], "ds").collect()
    bare = frame.Layout(local=["px"], windows=(21,))
    assert len(frame.feature_frame(panel(spark, [row]), None, bare, ["k"], "ds").first()["x"]) == len(bare.names())


def plain_choice(rows, span, top):
    used = [(y, x) for day, y, x in rows if y is not None and (span.begin is None or day >= span.begin) and day < span.end]
    out = []
    for pos in range(len(rows[0][2])):
        known = [x[pos] for _, x in used if x[pos] is not None]
        if not known or min(known) == max(known):
            continue
        mid = statistics.median(known)
        filled, ys = np.array([mid if x[pos] is None else x[pos] for _, x in used]), np.array([float(y) for y, _ in used])
        moves = len(used) >= 20 and filled.std() > 0 and ys.std() > 0
        out.append((pos, round(abs(np.corrcoef(filled, ys)[0, 1]), 9) if moves else 0.0, mid))
    if len(out) > top:
        out = sorted(out, key=lambda r: (-r[1], r[0]))[:top]
    return [(i + 1, *r) for i, r in enumerate(out)]


def made_rows():
    """Values far from zero, ties, NULLs, a constant, an unknown feature, two equal ones and one that repeats the label."""
    rng, rows = random.Random(5), []
    for i in range(900):
        y = None if i % 50 == 0 else rng.randint(0, 1)
        a = 1e6 + rng.random()
        x = [a, a, None if rng.random() < 0.4 else float(rng.randint(0, 3)), 7.0, None, float(y or 0) + rng.gauss(0, 1), None if i < 500 else rng.gauss(0, 1), float(i // 300)]
        rows.append((float(i // 3), y, x))
    return rows


@pytest.mark.parametrize("slice_rows", [1_000_000, 100])
@pytest.mark.parametrize("top", [3, 50])
def test_choice_equals_a_plain_one(spark, slice_rows, top):
    rows = made_rows()
    spans = [selection.Span(0, None, 4.0), selection.Span(1, None, 150.0), selection.Span(2, 50.0, 250.4), selection.Span(5, 120.0, 300.0), selection.Span(6, None, float("inf")), selection.Span(7, 500.0, 600.0)]
    df = spark.createDataFrame(rows, "day double, y int, x array<double>").repartition(5)
    found = selection.block_inputs(df, F.col("day"), "y", spans, top, slice_rows).collect()
    for span in spans:
        got = sorted((r["rank"], r["pos"], round(r["score"], 9), r["median"]) for r in found if r["block_id"] == span.block_id)
        want = plain_choice(rows, span, top)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2:] for g in got] == [pytest.approx(w[2:], abs=1e-7) for w in want]


def test_no_rows_no_choice(spark):
    df = spark.createDataFrame([], "day double, y int, x array<double>")
    assert selection.block_inputs(df, F.col("day"), "y", [selection.Span(0, None, 9.0)], 3).count() == 0
    assert selection.block_inputs(df, F.col("day"), "y", [], 3).count() == 0
    assert models.inputs_of_spans(df.withColumn("ds", F.lit(DAY)), "ds", "y", [], ["a"], 3) == {}


def test_rows_are_read_twice_for_any_number_of_blocks(spark):
    df = spark.createDataFrame(made_rows(), "day double, y int, x array<double>")
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for part in rows:
            seen.add(len(part))
            yield part

    counted = df.mapInPandas(count, df.schema)
    spans = [selection.Span(i, None, 20.0 * (i + 1)) for i in range(12)]
    assert selection.block_inputs(counted, F.col("day"), "y", spans, 3).count() > 0
    assert seen.value == 2 * df.count()
