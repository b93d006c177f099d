"""Merged sketches against exact figures, within the errors they state."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import sketches as sk

START = datetime.date(2021, 1, 1)
SHOWN = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
SCHEMA = "k string, day date, value double"


def rows_of_days(n=60_000):
    """A hot key with skewed values, a key of few values, one with nulls, NaN and infinity only."""
    draw = random.Random(5)
    rows = []
    for i in range(n):
        day = START + datetime.timedelta(days=draw.randrange(40))
        key = "hot" if i % 3 else "few"
        rows.append((key, day, None if i % 50 == 0 else draw.lognormvariate(0, 2) if key == "hot" else float(draw.randrange(9))))
    rows += [("none", START, v) for v in (None, float("nan"), float("inf"), float("-inf"))]
    return rows + [("zero", START, 0.0), ("zero", START, -0.0)]


def test_ranges_within_bounds(spark):
    rows = rows_of_days()
    days = sk.day_sketches(spark.createDataFrame(rows, SCHEMA).repartition(7), ["k"], "day")
    last = START + datetime.timedelta(days=24)
    made = {r["k"]: r for r in sk.estimates(sk.merged(days.where(F.col("day") <= F.lit(last)), ["k"]), SHOWN).collect()}
    for key in ("hot", "few"):
        mine = [v for k, d, v in rows if k == key and d <= last]
        known = sorted(v for v in mine if v is not None)
        row = made[key]
        assert row["n"] == len(mine) and row["n_missing"] == len(mine) - len(known)
        assert (row["low"], row["high"]) == (known[0], known[-1]) and abs(row["mean"] - sum(known) / len(known)) < 1e-6
        assert abs(row["n_unique"] - len(set(known))) <= 3 * 0.0163 * len(set(known))
        for name, q in SHOWN.items():
            below, upto = sum(v < row[name] for v in known), sum(v <= row[name] for v in known)
            assert below / len(known) - 0.01 <= q <= upto / len(known) + 0.01
    assert made["none"]["n"] == made["none"]["n_missing"] == 4 and made["none"]["n_unique"] == 0 and made["none"]["p50"] is None
    assert made["zero"]["n_unique"] == 1


def test_merges_of_merges(spark):
    """Days merged to weeks and then to one give the same counts as at once, and new days need no old rows."""
    frame = spark.createDataFrame(rows_of_days(6000), SCHEMA)
    days = sk.day_sketches(frame, ["k"], "day")
    weeks = sk.merged(days.withColumn("week", F.weekofyear("day")), ["k", "week"])
    once, twice = ({r["k"]: r for r in sk.estimates(sk.merged(s, ["k"]), {"p50": 0.5}).collect()} for s in (days, weeks))
    for key, row in once.items():
        assert all(row[c] == twice[key][c] for c in ("n", "n_missing", "low", "high"))
        assert abs(row["n_unique"] - twice[key]["n_unique"]) <= 0.05 * row["n_unique"]


def test_no_rows(spark):
    assert sk.estimates(sk.merged(sk.day_sketches(spark.createDataFrame([], SCHEMA), ["k"], "day"), ["k"]), SHOWN).count() == 0
