"""Classification and regression metrics as group-bys over any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, sanitize
from tidemark.operators.ordered import ROWS_PER_SLICE, Running, cut_points, running
from tidemark.session import materialize

CELLS = ("tn", "fp", "fn", "tp")


def confusion_columns(label: str, pred: str) -> list[Column]:
    y, p = F.col(label), F.col(pred)
    pairs = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return [F.count_if((y == a) & (p == b)).alias(cell) for cell, (a, b) in pairs.items()]


def confusion_matrix(df: DataFrame, by: Sequence[str], label: str, pred: str) -> DataFrame:
    """Two rows per group: what was predicted for real 0 and for real 1."""
    cells = df.groupBy(*by).agg(*confusion_columns(label, pred))
    rows = F.array(
        F.struct(F.lit("real_no_sube").alias("real"), F.col("tn").alias("pred_no_sube"), F.col("fp").alias("pred_sube")),
        F.struct(F.lit("real_sube").alias("real"), F.col("fn").alias("pred_no_sube"), F.col("tp").alias("pred_sube")),
    )
    return cells.select(*by, F.inline(rows))


def balanced_accuracy(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Mean recall over the classes that occur."""
    up, down = ratio(tp, tp + fn), ratio(tn, tn + fp)
    occurring = up.isNotNull().cast("int") + down.isNotNull().cast("int")
    return ratio(F.coalesce(up, F.lit(0.0)) + F.coalesce(down, F.lit(0.0)), occurring)


def closed_forms() -> dict[str, Column]:
    """Metrics from the columns tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in CELLS)
    spread = F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))
    zero = F.lit(0.0)
    return {
        "accuracy": ratio(tn + tp, tn + fp + fn + tp),
        "balanced_accuracy": balanced_accuracy(tn, fp, fn, tp),
        "precision_up": F.coalesce(ratio(tp, tp + fp), zero),
        "recall_up": F.coalesce(ratio(tp, tp + fn), zero),
        "f1_up": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        "mcc": ratio(tp * tn - fp * fn, spread),
        "recall_not_up": tn / F.greatest(tn + fp, F.lit(1.0)),
    }


def evaluate(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    score: str,
    pred: str,
    bounded: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per group: confusion cells, metrics and the tie-aware ROC AUC.

    Rows are first folded to one row per score, and that is written once. The AUC needs
    the negatives below each score, a running total over scores that is cut into slices
    when a group has many different scores; ``bounded`` states that it cannot (daily
    rows of a key).
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & F.col(pred).isNotNull())
    folded = known.groupBy(*by, score).agg(*confusion_columns(label, pred))
    folded = folded if bounded else materialize(folded)
    cuts = [] if bounded else cut_points(folded, score, rows_per_slice, by)
    negatives = F.col("tn") + F.col("fp")
    ranked = running(folded, by, score, {"__neg_to": Running("total", negatives)}, cuts=cuts)
    wins = (F.col("tp") + F.col("fn")).cast("double") * (F.col("__neg_to") - negatives / 2)
    sums = ranked.groupBy(*by).agg(*[F.sum(c).alias(c) for c in CELLS], F.sum(wins).alias("__wins"))
    up, down = (F.col("tp") + F.col("fn")).cast("double"), (F.col("tn") + F.col("fp")).cast("double")
    return sums.select(
        *by,
        sum((F.col(c) for c in CELLS), F.lit(0)).cast("bigint").alias("n"),
        *CELLS,
        *[c.alias(name) for name, c in closed_forms().items()],
        ratio(up, up + down).alias("positive_share"),
        ratio(F.col("__wins"), up * down).alias("roc_auc"),
    )


def regression_metrics(df: DataFrame, by: Sequence[str], real: str, predicted: str) -> DataFrame:
    """Errors, correlation and direction hits of predicted returns."""
    y, p = F.col(real), F.col(predicted)
    signs = df.where(y.isNotNull() & p.isNotNull()).withColumns(
        {"__y": (y > 0).cast("int"), "__p": (p > 0).cast("int")}
    )
    sums = signs.groupBy(*by).agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse_return"),
        F.avg(F.abs(y - p)).alias("mae_return"),
        F.when(F.count("*") > 1, sanitize(F.corr(y, p))).alias("corr_return"),
        F.count("*").alias("n_test"),
        *confusion_columns("__y", "__p"),
    )
    forms = closed_forms()
    return sums.select(
        *by,
        "rmse_return",
        "mae_return",
        "corr_return",
        forms["balanced_accuracy"].alias("direction_bacc_from_return"),
        forms["accuracy"].alias("direction_acc_from_return"),
        "n_test",
    )


def magnitude_summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    names = ["rmse_return", "mae_return", "corr_return", "direction_bacc_from_return", "direction_acc_from_return"]
    return results.groupBy(*by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in names],
        F.count_distinct("block_id").alias("n_blocks"),
        F.sum("n_test").alias("n_test_total"),
    )
