"""Summaries by segment, cluster and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import one_of, sample_kurtosis, sample_skew, sanitize
from tidemark.operators.metrics import evaluate
from tidemark.operators.ordered import ROWS_PER_SLICE, calendar_bounded, exact_quantiles, framed
from tidemark.operators.panel import to_long

MIN_ROWS = 20
DAYS_PER_YEAR = 252
MISSING = "nan"
MAX_CLUSTERS = 1000


def by_segment(df: DataFrame, segments: Sequence[str], names: tuple[str, str], keep_missing: bool) -> DataFrame:
    """Each row once per segment column, as ``(column name, value)``."""
    cells = [F.struct(F.lit(s).alias(names[0]), F.col(s).cast("string").alias(names[1])) for s in segments]
    tall = df.withColumn("__cell", F.explode(F.array(*cells))).select(
        *[c for c in df.columns if c not in segments], "__cell.*"
    )
    if keep_missing:
        return tall.withColumn(names[1], F.coalesce(names[1], F.lit(MISSING)))
    return tall.where(F.col(names[1]).isNotNull())


def segment_metrics(
    preds: DataFrame, keys: Sequence[str], segments: Sequence[str], bounded: bool = False, two_classes: bool = False, **slicing
) -> DataFrame:
    """Prediction quality per segment value with at least 20 rows; missing values are a segment."""
    used = preds.select(*keys, "y_true", "proba_up", "pred_up_calibrated", *segments)
    tall = by_segment(used, segments, ("segment_col", "segment"), keep_missing=not two_classes)
    by = [*keys, "segment_col", "segment"]
    scored = evaluate(tall, by, "y_true", "proba_up", "pred_up_calibrated", bounded=bounded, **slicing)
    enough = scored.where(F.col("n") >= MIN_ROWS)
    both = F.col("roc_auc").isNotNull()
    if two_classes:
        enough = enough.where(both)
    return enough.select(
        *by,
        "n",
        "positive_share",
        "accuracy",
        F.when(both, F.col("balanced_accuracy")).alias("balanced_accuracy"),
        "recall_up",
        "recall_not_up",
        "roc_auc",
    )


def stochastic_summary(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    future: str,
    daily: str,
    segments: Sequence[str],
    **slicing,
) -> DataFrame:
    """Distribution, autocorrelation and annualised daily behaviour per segment value.

    The autocorrelation runs over the rows of the segment in time order, so each
    (key, segment) is its own series.
    """
    known = df.where(F.col(future).isNotNull()).select(*keys, ts, F.col(future).alias("r"), F.col(daily).alias("r1"), *segments)
    by = [*keys, "grupo", "segmento"]
    tall = by_segment(known, segments, ("grupo", "segmento"), keep_missing=False)

    def shifted(w: WindowSpec) -> dict[str, Column]:
        return {"__r_1": F.lag("r", 1).over(w), "__r_5": F.lag("r", 5).over(w)}

    series = framed(tall, by, ts, shifted, back=5, **slicing)
    r, r1 = F.col("r"), F.col("r1")
    n, n1 = F.count(r), F.count(r1)
    daily_axis = calendar_bounded(df, ts)
    middle = [F.percentile(r, F.lit(0.5)).alias("median_h21_return")] if daily_axis else []
    sums = series.groupBy(*by).agg(
        n.alias("n"),
        F.min(ts).alias("fecha_ini"),
        F.max(ts).alias("fecha_fin"),
        F.avg(r).alias("mean_h21_return"),
        *middle,
        F.stddev_samp(r).alias("std_h21_return"),
        F.min(r).alias("min_h21_return"),
        F.max(r).alias("max_h21_return"),
        F.skewness(r).alias("__skew"),
        F.kurtosis(r).alias("__kurt"),
        F.avg((r > 0).cast("double")).alias("positive_share_h21"),
        F.avg((r == 0).cast("double")).alias("zero_share_h21"),
        F.when(n > 2, sanitize(F.corr(r, "__r_1"))).alias("acf1_h21"),
        F.when(n > 10, sanitize(F.corr(r, "__r_5"))).alias("acf5_h21"),
        F.when(n1 > 10, F.stddev_samp(r1)).alias("__vol"),
        F.when(n1 > 10, F.avg(r1)).alias("__mean"),
    )
    if not daily_axis:
        sums = sums.join(exact_quantiles(series, by, "r", {"median_h21_return": 0.5}), by)
    year = float(DAYS_PER_YEAR)
    return sums.where(F.col("n") >= MIN_ROWS).select(
        *by,
        "n",
        "fecha_ini",
        "fecha_fin",
        *[f"{stat}_h21_return" for stat in ("mean", "median", "std", "min", "max")],
        sample_skew(F.col("__skew"), F.col("n")).alias("skew_h21_return"),
        sample_kurtosis(F.col("__kurt"), F.col("n")).alias("kurtosis_h21_return"),
        "positive_share_h21",
        "zero_share_h21",
        "acf1_h21",
        "acf5_h21",
        (F.col("__vol") * year**0.5).alias("daily_vol_annualized"),
        (F.col("__mean") * year).alias("daily_mean_annualized"),
        F.when(F.col("__vol") > 0, F.col("__mean") / F.col("__vol") * year**0.5).alias("sharpe_like_daily"),
    )


def cluster_profile(
    df: DataFrame, cluster: str, ts: str, variables: Sequence[str], future: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Size, dates and mean, median and deviation of each variable per cluster.

    ``positive_share_h21`` divides by all rows of the cluster: an unknown future
    counts as not positive.
    """
    named = df.withColumn("cluster", F.coalesce(F.col(cluster).cast("string"), F.lit(MISSING)))
    sums = named.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.min(ts).alias("fecha_ini"),
        F.max(ts).alias("fecha_fin"),
        *[f(v).alias(f"{v}_{stat}") for v in variables for stat, f in (("mean", F.avg), ("std", F.stddev_samp))],
        F.avg(future).alias("mean_future_return_h21"),
        F.avg(F.coalesce(F.col(future) > 0, F.lit(False)).cast("double")).alias("positive_share_h21"),
    )
    long = to_long(named, ["cluster"], ts, variables)
    medians = exact_quantiles(long, ["cluster", "variable"], "value", {"median": 0.5}, rows_per_slice)
    wide = medians.groupBy("cluster").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("median"))).alias(f"{v}_median") for v in variables]
    )
    return sums.join(wide, "cluster", "left").withColumn("cluster_col", F.lit(cluster))


def transition_matrix(
    df: DataFrame, keys: Sequence[str], ts: str, cluster: str, values: Sequence[str] | None = None, **slicing
) -> DataFrame:
    """Share of moves from each cluster to each cluster between neighbouring rows of a key.

    ``values`` are the columns. Without them all clusters of ``df`` are, if they are at
    most ``MAX_CLUSTERS``; with them a cluster that is not listed stops the job.
    """
    label = F.coalesce(F.col(cluster).cast("string"), F.lit(MISSING))
    if values is None:
        values = sorted(r[0] for r in df.select(label).distinct().limit(MAX_CLUSTERS + 1).collect())
        if len(values) > MAX_CLUSTERS:
            raise ValueError(f"{cluster} has more than {MAX_CLUSTERS} values")
    named = df.select(*keys, ts, one_of(label, values).alias("__to"))

    def previous(w: WindowSpec) -> dict[str, Column]:
        return {"from_cluster": F.lag("__to", 1).over(w)}

    moves = framed(named, keys, ts, previous, back=1, **slicing).where(F.col("from_cluster").isNotNull())
    counts = moves.groupBy("from_cluster", "__to").agg(F.count("*").alias("__n"))
    share = F.col("__n") / F.sum("__n").over(Window.partitionBy("from_cluster"))
    cells = [F.coalesce(F.max(F.when(F.col("__to") == v, F.col("__share"))), F.lit(0.0)).alias(v) for v in values]
    return counts.withColumn("__share", share).groupBy("from_cluster").agg(*cells)
