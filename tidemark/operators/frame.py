"""The feature frame: everything known about a row of a panel, as one array in catalog order.

A frame has one row per key and time with ``x``: calendar parts, each local variable with
its features, further numbers of the row, 0/1 columns of its categories, and each
context variable with its features. ``Layout.names`` tells what stands where, so thousands
of features are one column, one join and no wider plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import calendar_parts, one_hot, sanitize
from tidemark.operators.features import LAGS, WINDOWS, feature_names, series_features
from tidemark.operators.panel import to_long

# Calendar parts in their order.
CALENDAR = ("year", "month", "quarter", "dayofyear", "month_sin", "month_cos")


@dataclass(frozen=True)
class Layout:
    """What a frame is made of; ``categories`` lists all values of each category but NULL, which is ``nan``."""

    local: Sequence[str]
    context: Sequence[str] = ()
    numbers: Sequence[str] = ()
    categories: dict[str, Sequence[str]] = field(default_factory=dict)
    lags: Sequence[int] = LAGS
    windows: Sequence[int] = WINDOWS

    def per_variable(self) -> list[str]:
        return feature_names(self.lags, self.windows)

    def names(self) -> list[str]:
        """Names in the order of ``x``."""
        series = lambda variables: [n for v in variables for n in (v, *[f"{v}_{f}" for f in self.per_variable()])]
        marks = [f"{c}_{v}" for c, values in self.categories.items() for v in values]
        return [*CALENDAR, *series(self.local), *self.numbers, *marks, *series(self.context)]


def _nothing(many: int) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), many)


def series_arrays(wide: DataFrame, keys: Sequence[str], ts: str, variables: Sequence[str], layout: Layout, name: str, **slicing) -> DataFrame:
    """(keys, ts, name): all variables with their features as one array, ordered like ``variables``.

    Features are made on the long panel, in one shuffle and sort per key and variable; a
    row's variables then meet by key and time.
    """
    made = series_features(to_long(wide, keys, ts, variables), keys, ts, layout.lags, layout.windows, **slicing)
    place = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable"))
    values = F.transform(F.array(F.col("value").cast("double"), *layout.per_variable()), sanitize)
    packed = made.select(*keys, ts, F.struct(place.alias("place"), values.alias("v")).alias("m")).groupBy(*keys, ts).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return packed.select(*keys, ts, F.flatten(F.transform("m", lambda m: m["v"])).alias(name))


def feature_frame(panel: DataFrame, context: DataFrame | None, layout: Layout, keys: Sequence[str], ts: str, keep: Sequence[str] = (), **slicing) -> DataFrame:
    """(keys, ts, keep, x) for every row of ``panel``; times must be unique within a key and in ``context``.

    ``panel`` has keys, time, the local variables, numbers and categories; ``context`` has
    time and its variables. Times the context lacks get NULL. A category that is not listed
    stops the job. Infinity and NaN become NULL. No rows give no rows.
    """
    local = series_arrays(panel, keys, ts, layout.local, layout, "__local", **slicing)
    rows = panel.select(*keys, ts, *[c for c in keep if c not in (*keys, ts)], *_own(layout, ts)).join(local, [*keys, ts], "left")
    width = 1 + len(layout.per_variable())
    if layout.context:
        around = series_arrays(context, [], ts, layout.context, layout, "__context")
        rows = rows.join(around, ts, "left")
    else:
        rows = rows.withColumn("__context", _nothing(0))
    parts = [F.col("__calendar"), F.coalesce("__local", _nothing(width * len(layout.local))), F.col("__row"), F.coalesce("__context", _nothing(width * len(layout.context)))]
    return rows.select(*keys, ts, *[c for c in keep if c not in (*keys, ts)], F.concat(*parts).alias("x"))


def _marks(category: str, values: Sequence[str]) -> list[Column]:
    """0/1 columns in the order of ``values``; ``nan`` may be one of them and stands for NULL."""
    listed = one_hot(F.col(category), [v for v in values if v != "nan"], category)
    return [F.col(category).isNull().cast("double") if v == "nan" else listed[f"{category}_{v}"] for v in values]


def _own(layout: Layout, ts: str) -> list[Column]:
    """Calendar, numbers and 0/1 columns of a row as two arrays."""
    made = calendar_parts(F.col(ts))
    row = [sanitize(F.col(n).cast("double")) for n in layout.numbers]
    row += [mark for category, values in layout.categories.items() for mark in _marks(category, values)]
    return [F.array(*[made[n].cast("double") for n in CALENDAR]).alias("__calendar"), (F.array(*row) if row else _nothing(0)).alias("__row")]


def spread(frame: DataFrame, layout: Layout, keys: Sequence[str]) -> DataFrame:
    """The frame as named columns, for a reader who wants a table."""
    return frame.select(*keys, *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(layout.names())])
