"""Decision thresholds and training weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.metrics import balanced_accuracy
from tidemark.operators.ordered import ROWS_PER_SLICE, exact_quantiles

FEW_SCORES = 10


def grid_bounds(df: DataFrame, by: Sequence[str], score: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """First and last threshold and number of steps per group."""
    tails = exact_quantiles(df, by, score, {"__q01": 0.01, "__q99": 0.99}, rows_per_slice)
    sizes = df.where(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_scores"))
    few = F.col("n_scores") < FEW_SCORES
    return sizes.join(tails, list(by)).select(
        *by,
        "n_scores",
        F.when(few, 0.15).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.30), F.col("__q01")))).alias("low"),
        F.when(few, 0.85).otherwise(F.least(F.lit(0.95), F.greatest(F.lit(0.70), F.col("__q99")))).alias("high"),
        F.when(few, 70).otherwise(100).alias("steps"),
    )


def _threshold(step_no: Column) -> Column:
    return F.col("low") + step_no * ((F.col("high") - F.col("low")) / F.col("steps"))


def threshold_grid(df: DataFrame, by: Sequence[str], score: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All candidate thresholds: at most 101 rows per group."""
    bounds = grid_bounds(df, by, score, rows_per_slice)
    steps = bounds.select("*", F.explode(F.sequence(F.lit(0), "steps")).alias("step_no"))
    return steps.select(*by, "step_no", _threshold(F.col("step_no")).alias("threshold"))


def threshold_search(
    df: DataFrame, by: Sequence[str], score: str, label: str, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """The lowest threshold of the grid with the best balanced accuracy.

    Scores are counted per grid cell, so a row meets one cell and not 101
    thresholds; the search then runs on at most 102 rows per group.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    bounds = grid_bounds(known, by, score, rows_per_slice)
    p = F.col(score)
    near = F.floor((p - F.col("low")) / ((F.col("high") - F.col("low")) / F.col("steps")))
    cell = F.when(p >= _threshold(near + 1), near + 1).when(p < _threshold(near), near - 1).otherwise(near)
    counted = (
        known.join(bounds, list(by))
        .withColumn("step_no", F.greatest(F.lit(-1), F.least(cell.cast("int"), "steps")))
        .groupBy(*by, "step_no")
        .agg(F.count_if(F.col(label) == 1).alias("up"), F.count_if(F.col(label) == 0).alias("down"))
    )
    empty = bounds.select(
        *by, F.explode(F.sequence(F.lit(0), "steps")).alias("step_no"), F.lit(0).alias("up"), F.lit(0).alias("down")
    )
    cells = counted.unionByName(empty).groupBy(*by, "step_no").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    everything = Window.partitionBy(*by)
    from_here = everything.orderBy(F.desc("step_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, fp = F.sum("up").over(from_here), F.sum("down").over(from_here)
    all_up, all_down = F.sum("up").over(everything), F.sum("down").over(everything)
    scored = cells.select(
        *by, "step_no", balanced_accuracy(all_down - fp, fp, all_up - tp, tp).alias("score")
    ).where(F.col("step_no") >= 0)
    best = scored.groupBy(*by).agg(F.max(F.struct("score", (-F.col("step_no")).alias("back"))).alias("best"))
    return best.join(bounds, list(by)).select(
        *by,
        _threshold(-F.col("best.back")).alias("threshold"),
        F.col("best.score").alias("cal_bacc"),
    )


HALF_LIFE_DAYS = 365.25 * 4
STRATEGIES = ("none", "balanced", "cluster_x4", "macrofull_x15", "recency_4y")


def _class_weight(y: Column, share: Column) -> Column:
    return F.when(y == 1, 0.5 / F.greatest(share, F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - share, F.lit(1e-6)))


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sample_weights(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    strategy: str,
    day: str = "ds",
    cluster: str = "cluster_abs",
    categories: Sequence[str] = ("cluster_abs", "cluster_chg", "policy_stance", "lag1_cls"),
    name: str = "weight",
) -> DataFrame:
    """Add training weights with mean 1 per group.

    A weight depends only on a row's class, categories or day, so it is worked out
    on counts per such cell and joined back; no window ever spans a whole group. Every
    row stays: one without the class or day that the strategy needs has no weight (NULL)
    and no part in those of others.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown weight strategy: {strategy}")
    if strategy == "none":
        return df.withColumn(name, F.lit(1.0))
    used = {
        "balanced": [],
        "cluster_x4": [cluster],
        "macrofull_x15": [c for c in categories if c in df.columns],
        "recency_4y": [],
    }[strategy]
    cell = {f"__c{i}": F.coalesce(F.col(c).cast("string"), F.lit("nan")) for i, c in enumerate(used)}
    cell["__y"] = F.col(label).cast("int")
    if strategy == "recency_4y":
        cell = {"__day": F.col(day)}
    tagged = df.withColumns(cell)
    needed = "__day" if "__day" in cell else "__y"
    cells = tagged.where(F.col(needed).isNotNull()).groupBy(*by, *cell).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    n = F.sum("__n").over(group)

    def mean(x: Column) -> Column:
        return F.sum(x * F.col("__n")).over(group) / n

    def normed(frame: DataFrame, column: str) -> DataFrame:
        return frame.withColumn(column, F.col(column) / mean(F.col(column)))

    if "__y" in cell:
        share = F.sum(F.col("__n") * F.col("__y")).over(group) / n
        cells = cells.withColumn("__class", _class_weight(F.col("__y"), share))
    if strategy == "balanced":
        weighted = cells.withColumn("__w", F.col("__class"))
    elif strategy == "recency_4y":
        age = F.datediff(F.max("__day").over(group), "__day")
        weighted = cells.withColumn("__w", _clip(F.exp(age * (-math.log(2) / HALF_LIFE_DAYS)), 0.20, 1.0))
    else:
        for i in range(len(used)):
            same = F.sum("__n").over(Window.partitionBy(*by, f"__c{i}"))
            cells = normed(cells.withColumn(f"__r{i}", 1 / F.greatest(ratio(same, n), F.lit(1e-6))), f"__r{i}")
        parts = [F.col(f"__r{i}") for i in range(len(used))]
        if strategy == "cluster_x4":
            weighted = cells.withColumn("__w", _clip(parts[0], 0.35, 4.0))
        elif parts:
            together = sum(parts[1:], parts[0]) / len(parts)
            weighted = cells.withColumn("__w", _clip(together, 0.35, 15.0) * F.col("__class"))
        else:
            weighted = cells.withColumn("__w", F.col("__class"))
    weights = normed(weighted, "__w").select(*by, *cell, F.col("__w").alias(name))
    return tagged.join(weights, [*by, *cell], "left").select(*df.columns, name)
