"""Rule baselines: fixed trading rules evaluated like models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.features import rolling
from tidemark.operators.metrics import evaluate
from tidemark.operators.ordered import framed
from tidemark.operators.walkforward import MIN_TEST, assign_blocks

# Names of the rules, and the marks of their results.
RULES = ["Momentum_21", "Momentum_63", "MA_21_63", "MA_63_126", "TRM_Momentum_21", "Brent_Momentum_21"]
RULE_SET = "deterministic_baseline"
RULE_MARK = "deterministic"


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def momentum(x: Column, k: int, w: WindowSpec) -> Column:
    """1 when ``x`` is over its value ``k`` rows ago; 0 when either is unknown."""
    past = F.lag(x, k).over(w)
    return _flag((ratio(x, past) > 1) | ((past == 0) & (x > 0)))


def crossover(x: Column, fast: tuple[int, int], slow: tuple[int, int], w: WindowSpec) -> Column:
    return _flag(rolling(x, w, *fast)["mean"] > rolling(x, w, *slow)["mean"])


def rule_signals(df: DataFrame, keys: Sequence[str], ts: str, price: str, fx: str | None, oil: str | None, **slicing) -> DataFrame:
    """One 0/1 column per rule."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        px = F.col(price)
        out = {
            "Momentum_21": momentum(px, 21, w),
            "Momentum_63": momentum(px, 63, w),
            "MA_21_63": crossover(px, (21, 10), (63, 20), w),
            "MA_63_126": crossover(px, (63, 20), (126, 40), w),
        }
        if fx in df.columns:
            out["TRM_Momentum_21"] = momentum(F.col(fx), 21, w)
        if oil in df.columns:
            out["Brent_Momentum_21"] = momentum(F.col(oil), 21, w)
        return out

    return framed(df, keys, ts, columns, back=126, **slicing)


def rule_predictions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    price: str,
    fx: str | None,
    oil: str | None,
    start: str,
    months: int = 6,
    horizon: int = 21,
) -> DataFrame:
    """Prediction log of all rules on the test blocks."""
    real, label = f"future_logret_h{horizon}", f"target_up_h{horizon}"
    known = df.where(F.col(label).isNotNull() & F.col(real).isNotNull())
    signals = rule_signals(known, keys, ts, price, fx, oil)
    rules = [r for r in RULES if r in signals.columns]
    tested = assign_blocks(signals, keys, ts, start, months)
    ids = [*keys, ts, price, real, label, "block_id", "test_start", "test_end"]
    return tested.unpivot(ids, rules, "model", "proba_up").select(
        *keys,
        ts,
        price,
        F.col(real).alias(f"real_return_h{horizon}"),
        F.col(label).cast("int").alias("y_true"),
        "proba_up",
        F.lit(0.5).alias("threshold"),
        F.col("proba_up").cast("int").alias("pred_up_calibrated"),
        "block_id",
        "test_start",
        "test_end",
        F.lit(horizon).alias("horizon"),
        F.lit(RULE_SET).alias("feature_set"),
        "model",
        F.lit(RULE_MARK).alias("train_window_years"),
        F.lit(RULE_MARK).alias("weight_strategy"),
    )


def rule_baselines(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One result row per key, rule and block with at least 20 test rows."""
    config = ["horizon", "feature_set", "model", "train_window_years", "weight_strategy"]
    by = [*keys, *config, "block_id", "test_start", "test_end", "threshold"]
    scored = evaluate(predictions, by, "y_true", "proba_up", "pred_up_calibrated", bounded=True)
    return scored.where(F.col("n") >= MIN_TEST).drop("positive_share").withColumnRenamed("n", "n_test").withColumns(
        {"cal_bacc": F.lit(None).cast("double"), "n_features": F.lit(1), "n_global_features": F.lit(0)}
    )
