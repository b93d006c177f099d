"""Time-series features and future-move targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import direction, log_positive, ratio
from tidemark.operators.ordered import calendar_bounded, framed

LAGS = (1, 5, 21, 63)
WINDOWS = (21, 63, 126)
LOG_LAGS = (1, 5, 21)
POSITIVE_SHARE = 0.98


def rolling(x: Column, w: WindowSpec, length: int, at_least: int) -> dict[str, Column]:
    """Mean, sample deviation, maximum and minimum of the last ``length`` rows."""
    frame = w.rowsBetween(1 - length, Window.currentRow)
    enough = F.count(x).over(frame) >= at_least
    return {
        "mean": F.when(enough, F.avg(x).over(frame)),
        "std": F.when(enough, F.stddev_samp(x).over(frame)),
        "max": F.when(enough, F.max(x).over(frame)),
        "min": F.when(enough, F.min(x).over(frame)),
    }


def lag_columns(x: Column, w: WindowSpec, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"lag{k}": F.lag(x, k).over(w) for k in lags}


def change_columns(x: Column, w: WindowSpec, pct: int = 21) -> dict[str, Column]:
    return {"diff_1": x - F.lag(x, 1).over(w), f"pct_{pct}": ratio(x, F.lag(x, pct).over(w)) - 1}


def log_columns(x: Column, w: WindowSpec, eligible: Column, lags: Sequence[int] = LOG_LAGS) -> dict[str, Column]:
    """Log and log returns, NULL throughout for a variable that is not ``eligible``."""
    log = F.when(eligible, log_positive(x))
    return {"log": log, **{f"logret_{k}": log - F.lag(log, k).over(w) for k in lags}}


def rolling_columns(x: Column, w: WindowSpec, windows: Sequence[int] = WINDOWS) -> dict[str, Column]:
    out = {}
    for length in windows:
        r = rolling(x, w, length, at_least=max(5, length // 4))
        out[f"roll_mean{length}"] = r["mean"]
        out[f"roll_std{length}"] = r["std"]
        out[f"dist_max{length}"] = ratio(x, r["max"]) - 1
        out[f"dist_min{length}"] = ratio(x, r["min"]) - 1
    return out


def feature_names(lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> list[str]:
    rolls = [f"{kind}{n}" for n in windows for kind in ("roll_mean", "roll_std", "dist_max", "dist_min")]
    return ["log", *[f"logret_{k}" for k in LOG_LAGS], "diff_1", "pct_21", *[f"lag{k}" for k in lags], *rolls]


def with_log_eligible(long: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Add ``log_ok``: are more than 98 % of the variable's known values positive?

    On a daily axis the share is taken over the same partitions as the features, so
    the panel is read and shuffled once; elsewhere it is a small aggregate joined back.
    """
    positive = F.avg((F.col("value") > 0).cast("double"))
    if calendar_bounded(long, ts):
        share = positive.over(Window.partitionBy(*by))
        return long.withColumn("log_ok", F.coalesce(share > POSITIVE_SHARE, F.lit(False)))
    shares = long.groupBy(*by).agg((positive > POSITIVE_SHARE).alias("log_ok"))
    return long.join(shares, by, "left").withColumn("log_ok", F.coalesce("log_ok", F.lit(False)))


def series_features(
    long: DataFrame,
    keys: Sequence[str],
    ts: str,
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    **slicing,
) -> DataFrame:
    """All features of every variable of a long panel ``(keys, ts, variable, value)``.

    Long keeps the number of columns fixed for any number of variables, and all
    features share one shuffle and sort per (key, variable).
    """
    by = [*keys, "variable"]
    flagged = with_log_eligible(long, by, ts)

    def columns(w: WindowSpec) -> dict[str, Column]:
        x = F.col("value")
        return {
            **log_columns(x, w, F.col("log_ok")),
            **change_columns(x, w),
            **lag_columns(x, w, lags),
            **rolling_columns(x, w, windows),
        }

    reach = max(*lags, *LOG_LAGS, 21, *windows)
    return framed(flagged, by, ts, columns, back=reach, **slicing).drop("log_ok")


def targets(df: DataFrame, keys: Sequence[str], ts: str, price: str, horizons: Sequence[int] = (21,), **slicing) -> DataFrame:
    """Price, log return and direction ``h`` rows ahead."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {f"future_price_h{h}": F.lead(price, h).over(w) for h in horizons}

    out = framed(df, keys, ts, columns, back=0, ahead=max(horizons), **slicing)
    for h in horizons:
        move = log_positive(ratio(F.col(f"future_price_h{h}"), F.col(price)))
        out = out.withColumn(f"future_logret_h{h}", move)
        out = out.withColumn(f"target_up_h{h}", direction(F.col(f"future_logret_h{h}")))
    return out


def target_diagnostics(df: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (21,)) -> DataFrame:
    """Size and balance of the targets, per key and horizon, from one pass."""
    moves = [
        F.struct(
            F.lit(h).alias("horizon"), F.col(f"future_logret_h{h}").alias("r"), F.col(f"target_up_h{h}").alias("y")
        )
        for h in horizons
    ]
    long = df.select(*keys, F.explode(F.array(*moves)).alias("m")).select(*keys, "m.*").where(F.col("r").isNotNull())
    return long.groupBy(*keys, "horizon").agg(
        F.count("*").alias("n"),
        F.avg("y").alias("positive_share"),
        (1 - F.avg("y")).alias("non_positive_share"),
        F.avg((F.col("r") == 0).cast("double")).alias("zero_return_share"),
        F.avg("r").alias("mean_return"),
        F.stddev_samp("r").alias("std_return"),
    )


def long_to_named(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Feature columns to rows ``(keys, feature, value)`` with names ``{variable}_{feature}``."""
    tall = features.unpivot([*keys, "variable"], list(names), "feature", "value")
    return tall.select(*keys, F.concat_ws("_", "variable", "feature").alias("feature"), "value")
