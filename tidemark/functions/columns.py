"""Column expressions. All stay in generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e12


def sanitize(x: Column) -> Column:
    """NaN and infinities become NULL, the rest is clipped to +-1e12."""
    unusable = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~unusable, F.least(F.greatest(x, F.lit(-CLIP)), F.lit(CLIP)))


def to_number(x: Column) -> Column:
    return sanitize(x.try_cast("double"))


def to_day(x: Column) -> Column:
    """Text to DATE; text that is no date becomes NULL."""
    return F.try_to_timestamp(x).cast("date")


def ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def spanish_flag(x: Column) -> Column:
    return F.when(F.upper(x) == "VERDADERO", F.lit(True)).when(F.upper(x) == "FALSO", F.lit(False))


def calendar_parts(ds: Column) -> dict[str, Column]:
    month = F.month(ds)
    return {
        "year": F.year(ds),
        "month": month,
        "quarter": F.quarter(ds),
        "dayofyear": F.dayofyear(ds),
        "month_sin": F.sin(month * (2 * math.pi) / 12),
        "month_cos": F.cos(month * (2 * math.pi) / 12),
    }


def ladder(x: Column, steps: Sequence[tuple[float, str]], default: str, strict: bool = True) -> Column:
    """Label of the first lower bound that ``x`` is over."""
    out = None
    for bound, label in steps:
        over = x > bound if strict else x >= bound
        out = F.when(over, label) if out is None else out.when(over, label)
    return out.otherwise(default)


def policy_stance(change: Column, band: float = 0.05) -> Column:
    return F.when(change > band, "tightening").when(change < -band, "easing").otherwise("neutral")


def return_band(total_return: Column) -> Column:
    # Labels and bounds of a window's buy-and-hold return.
    return (
        F.when(total_return > 0.10, "alcista_fuerte")
        .when(total_return > 0.05, "alcista_moderado")
        .when(total_return >= -0.05, "lateral")
        .otherwise("bajista")
    )


def effective_frequency(repeat_share: Column) -> Column:
    # Labels and bounds of the share of repeated values.
    steps = [
        (0.95, "mensual→diaria (ff)"),
        (0.80, "semanal/trimestral→diaria (ff)"),
        (0.25, "diaria con repetidos"),
    ]
    return ladder(repeat_share, steps, "diaria")


def direction(future_return: Column) -> Column:
    return F.when(future_return.isNotNull(), (future_return > 0).cast("int"))


def sample_skew(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population skewness."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(kurtosis: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population excess kurtosis."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurtosis + 6))


def one_of(x: Column, values: Sequence[str]) -> Column:
    """``x`` itself; a value that is neither NULL nor one of ``values`` stops the job with an error."""
    unlisted = F.raise_error(F.concat(F.lit("value without a category: "), x.cast("string")))
    return F.when(x.isNull() | x.isin(list(values)), x).otherwise(unlisted.cast("string"))


def one_hot(x: Column, values: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 columns for the listed categories; NULL is the category ``nan``.

    ``values`` must be all categories but ``nan``; see ``indicator`` for a single one.
    """
    named = F.coalesce(one_of(x.cast("string"), values), F.lit("nan"))
    return {f"{prefix}_{v}": (named == v).cast("double") for v in values}


def indicator(x: Column, value: str) -> Column:
    """1.0 where ``x`` is ``value``, else 0.0; NULL is the value ``nan``."""
    return (F.coalesce(x.cast("string"), F.lit("nan")) == value).cast("double")
