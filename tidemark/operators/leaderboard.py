"""Results per block to results per configuration, and choices among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIG = ["horizon", "feature_set", "model", "train_window_years", "weight_strategy"]

# Audited sets of features, the reference case, distances to the best and their labels.
AUDIT_SETS = [
    "colombia_only", "colombia_plus_global_compact", "global_no_gold_direct", "global_no_metals", "global_macro_only",
]
AUDIT_REFERENCE = "colombia_plus_global_compact"
AUDIT_STEPS = [(0.03, "verde_se_sostiene"), (0.10, "amarillo_baja_moderada")]
AUDIT_DEFAULT = "rojo_dependencia_alta"
AUDIT_MARK = "referencia"


def classification_summary(results: DataFrame, by: Sequence[str] = CONFIG) -> DataFrame:
    """Mean, spread and totals of the block results of each configuration."""
    means = [
        "accuracy", "balanced_accuracy", "roc_auc", "precision_up", "recall_up", "recall_not_up", "f1_up", "mcc",
        "threshold", "n_features", "n_global_features",
    ]
    return results.groupBy(*by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in ("accuracy", "balanced_accuracy")],
        *[F.sum(c).alias(f"total_{c}") for c in ("tp", "tn", "fp", "fn")],
        F.count_distinct("block_id").alias("n_blocks"),
        F.sum("n_test").alias("n_test_total"),
    )


def leaderboard(summary: DataFrame, within: Sequence[str] = ("horizon",)) -> DataFrame:
    """Configurations ranked by balanced accuracy, then AUC, then name for a total order."""
    rest = [c for c in CONFIG if c in summary.columns and c not in within]
    order = [F.desc_nulls_last("mean_balanced_accuracy"), F.desc_nulls_last("mean_roc_auc"), *rest]
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def best_config(summary: DataFrame, within: Sequence[str] = ("horizon",)) -> DataFrame:
    return leaderboard(summary, within).where(F.col("rank") == 1).drop("rank")


def best_per_group(summary: DataFrame, group: Sequence[str]) -> DataFrame:
    return leaderboard(summary, group).where(F.col("rank") == 1).drop("rank")


def of_configs(predictions: DataFrame, chosen: DataFrame, keys: Sequence[str] = CONFIG) -> DataFrame:
    """Predictions of the chosen configurations; keys are compared as text."""
    wanted = chosen.select(*[F.col(k).cast("string").alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).cast("string") == F.col(f"__{k}") for k in keys]
    return predictions.join(wanted, same, "left_semi")


def last_rows(df: DataFrame, by: Sequence[str], ts: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows of each group; Spark keeps ``n`` per task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(ts), *tiebreak)
    return df.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n).drop("__rn")


def top_config_sample(
    predictions: DataFrame, summary: DataFrame, ts: str, configs: int = 6, rows: int = 240, tiebreak: Sequence[str] = ()
) -> DataFrame:
    chosen = leaderboard(summary).where(F.col("rank") <= configs)
    return last_rows(of_configs(predictions, chosen), CONFIG, ts, rows, tiebreak)


# What each audited feature set leaves out.
AUDIT_NOTES = {
    "colombia_only": "Base local sin contexto global.",
    "colombia_plus_global_compact": "Modelo global compacto original.",
    "global_no_gold_direct": "Excluye GLD, IAU y GC=F.",
    "global_no_metals": "Excluye oro, plata y metales cercanos.",
    "global_macro_only": "Conserva solo macro global: dólar, VIX, tasas, equity, petróleo.",
}


def audit_summary(
    summary: DataFrame,
    sets: Sequence[str] = AUDIT_SETS,
    reference: str = AUDIT_REFERENCE,
    within: Sequence[str] = ("horizon",),
) -> DataFrame:
    """Best configuration of each restricted feature set, and how far it falls behind the best of all."""
    best_of_all = F.max("mean_balanced_accuracy").over(Window.partitionBy(*within))
    cases = best_per_group(summary.withColumn("__best", best_of_all).where(F.col("feature_set").isin(list(sets))), [*within, "feature_set"])
    score = F.col("mean_balanced_accuracy")
    status = F.when(F.col("feature_set") == reference, AUDIT_MARK)
    for distance, label in AUDIT_STEPS:
        status = status.when(score >= F.col("__best") - distance, label)
    return cases.select(
        *within,
        F.col("feature_set").alias("audit_case"),
        F.col("model").alias("best_model"),
        "train_window_years",
        "mean_accuracy",
        "mean_balanced_accuracy",
        "mean_roc_auc",
        (score - F.col("__best")).alias("delta_bacc_vs_best"),
        status.otherwise(AUDIT_DEFAULT).alias("status"),
        F.coalesce(*[F.when(F.col("feature_set") == s, note) for s, note in AUDIT_NOTES.items()], F.lit("")).alias("interpretacion"),
    )
