"""Walk-forward blocks, splits and train-only feature ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import ROWS_PER_SLICE, exact_quantiles

MIN_TRAIN, MIN_TEST = 800, 20
MIN_FIT, MIN_CAL = 500, 50
FIT_SHARE = 0.8


def whole_months(day: Column, anchor: Column) -> Column:
    """Whole calendar months from ``anchor`` to ``day``; negative before the anchor.

    A month ends on the anchor's day of the month, or on the last day of a shorter month.
    """
    months = (F.year(day) - F.year(anchor)) * 12 + F.month(day) - F.month(anchor)
    turn = F.least(F.dayofmonth(anchor), F.dayofmonth(F.last_day(day)))
    return months - (F.dayofmonth(day) < turn).cast("int")


def block_number(day: Column, anchor: Column, months: int) -> Column:
    return F.floor(whole_months(day, anchor) / months).cast("int")


def block_bounds(block: Column, anchor: Column, months: int, last: Column) -> dict[str, Column]:
    return {
        "test_start": F.add_months(anchor, block * months),
        "test_end": F.least(F.add_months(anchor, (block + 1) * months), last),
    }


def walkforward_blocks(df: DataFrame, keys: Sequence[str], ts: str, start: str, months: int = 6) -> DataFrame:
    """Half-open test blocks of each key; the last one ends on the last day."""
    anchor = F.lit(start).cast("date")
    span = df.groupBy(*keys).agg(F.max(ts).alias("__last")).where(F.col("__last") > anchor)
    last_block = block_number(F.date_sub("__last", 1), anchor, months)
    blocks = span.select(*keys, "__last", F.explode(F.sequence(F.lit(0), last_block)).alias("block_id"))
    bounds = block_bounds(F.col("block_id"), anchor, months, F.col("__last"))
    return blocks.select(*keys, "block_id", *[c.alias(n) for n, c in bounds.items()])


def assign_blocks(df: DataFrame, keys: Sequence[str], ts: str, start: str, months: int = 6) -> DataFrame:
    """Test rows with their block. Arithmetic on the date: rows never meet a block table.

    For a daily axis: a key's rows are bounded by the calendar.
    """
    anchor = F.lit(start).cast("date")
    last = F.max(ts).over(Window.partitionBy(*keys))
    dated = df.withColumn("__last", last).where((F.col(ts) >= anchor) & (F.col(ts) < F.col("__last")))
    dated = dated.withColumn("block_id", block_number(F.col(ts), anchor, months))
    bounds = block_bounds(F.col("block_id"), anchor, months, F.col("__last"))
    return dated.select(*df.columns, "block_id", *[c.alias(n) for n, c in bounds.items()])


def split_plan(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    start: str,
    months: int = 6,
    years: int | None = None,
    min_train: int = MIN_TRAIN,
    min_fit: int = MIN_FIT,
    min_cal: int = MIN_CAL,
    embargo_rows: int = 0,
) -> DataFrame:
    """Sizes and calibration start of every usable block, one row per key and block.

    Training rows of a block are the rows of earlier blocks, so their number is a
    running count over blocks, and the date quantile is the row at a known position.
    No row is copied per block. ``embargo_rows`` leaves out the last training rows,
    whose targets reach into the test block.
    """
    if 12 % months and years is not None:
        raise ValueError("a training window must be a whole number of blocks")
    anchor = F.lit(start).cast("date")
    group = Window.partitionBy(*keys)
    placed = df.select(
        *keys,
        ts,
        (F.row_number().over(group.orderBy(ts)) - 1).alias("__at"),
        F.max(ts).over(group).alias("__last"),
        block_number(F.col(ts), anchor, months).alias("block_id"),
    )
    sizes = placed.groupBy(*keys, "block_id").agg(
        F.count("*").alias("__rows"), F.count_if(F.col(ts) < F.col("__last")).alias("n_test"), F.max("__last").alias("__last")
    )
    order = group.orderBy("block_id")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    window = before if years is None else order.rangeBetween(-(12 * years // months), -1)
    year = order.rangeBetween(-(12 // months), -1)
    taken = F.greatest(F.coalesce(F.sum("__rows").over(window), F.lit(0)) - embargo_rows, F.lit(0))
    plan = sizes.select(
        *keys,
        "block_id",
        "n_test",
        *[c.alias(n) for n, c in block_bounds(F.col("block_id"), anchor, months, F.col("__last")).items()],
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - embargo_rows).alias("__end"),
        taken.alias("n_train"),
        F.greatest(F.coalesce(F.sum("__rows").over(year), F.lit(0)) - embargo_rows, F.lit(0)).alias("__year_rows"),
    ).where((F.col("block_id") >= 0) & (F.col("n_train") >= min_train) & (F.col("n_test") >= MIN_TEST))
    target = FIT_SHARE * (F.col("n_train") - 1)
    plan = plan.withColumns(
        {"__below": F.floor(target), "__part": target - F.floor(target), "__first": F.col("__end") - F.col("n_train")}
    )
    dates = placed.select(*keys, F.col("__at").cast("bigint").alias("__at"), F.unix_date(ts).alias("__day"))
    for side, offset in (("__low", 0), ("__high", 1)):
        at = F.col("__first") + F.least(F.col("__below") + offset, F.col("n_train") - 1)
        plan = plan.withColumn("__at", at).join(
            dates.withColumnRenamed("__day", side), [*keys, "__at"]
        ).drop("__at")
    quantile = F.col("__low") + F.col("__part") * (F.col("__high") - F.col("__low"))
    year_start = F.unix_date(F.add_months("test_start", -12))
    by_quantile = F.ceil(target)
    fit = F.when(quantile >= year_start, by_quantile).otherwise(F.col("n_train") - F.col("__year_rows"))
    short = (F.col("__fit") < min_fit) | (F.col("n_train") - F.col("__fit") < min_cal)
    first_rows = F.floor(F.col("n_train") * FIT_SHARE)
    return plan.withColumns({"__cal": F.greatest(quantile, year_start), "__fit": fit}).select(
        *keys,
        "block_id",
        "test_start",
        "test_end",
        "n_train",
        "n_test",
        F.col("__cal").alias("cal_start_day"),
        short.alias("by_position"),
        F.when(short, first_rows).otherwise(F.col("__fit")).cast("bigint").alias("n_fit"),
        (F.col("n_train") - F.when(short, first_rows).otherwise(F.col("__fit"))).cast("bigint").alias("n_cal"),
    )


def rank_features(
    long: DataFrame,
    by: Sequence[str],
    label: str,
    top: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The ``top`` features by absolute correlation with the label, per group.

    Input is long: ``(by, feature, pos, value, label)``. NULL values count as the
    feature's median. With no more than ``top`` features nothing is ranked and the
    given positions stay.
    """
    per_feature = [*by, "feature", "pos"]
    medians = exact_quantiles(long, per_feature, "value", {"__median": 0.5}, rows_per_slice)
    filled = long.join(medians, per_feature, "left")
    pair = F.corr(F.coalesce("value", "__median"), F.col(label).cast("double"))
    known = F.count(F.coalesce("value", "__median"))
    scored = filled.groupBy(*per_feature).agg(
        F.when(known < 20, 0.0).otherwise(F.coalesce(F.abs(F.nanvl(pair, F.lit(0.0))), F.lit(0.0))).alias("score")
    )
    group = Window.partitionBy(*by)
    keep_order = F.count("*").over(group) <= top
    sort_key = F.when(keep_order, 0.0).otherwise(-F.col("score"))
    ranked = scored.withColumn("__sort", sort_key).withColumn(
        "rank", F.row_number().over(group.orderBy("__sort", "pos"))
    )
    return ranked.where(F.col("rank") <= top).select(*by, "rank", "feature", "score")
