"""Ordered work per key that does not put a whole key into one task.

Two primitives carry every ordered operator in the package:

* ``running`` adds running values (fill forward, sums, products, extremes);
* ``framed`` adds values that look a bounded number of rows back or ahead.

A DATE axis holds at most one row per key and day, so the rows of a key are
bounded by the calendar and a plain window is the right plan. Any other axis
(timestamps, scores) can put an unbounded number of rows under one key. Where the
largest key has more rows than a slice, the axis is cut into slices of about equal
size, each slice is worked on by its own task, and the slices are tied together by
carried totals (``running``) or by a few copied edge rows (``framed``). Results are
the same on both paths.

The order column must be unique within a key (``dedup`` in ``panel`` sees to it), or
``ties`` must name columns that make it so; a value of the order column is never cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

FIRST_SLICES = 64
ROWS_PER_SLICE = 1_000_000
_SLICE = "__slice"


def axis_value(df: DataFrame, order: str) -> Column:
    """The order column as a double, for comparing with cut points."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("double")
    return F.col(order).cast("double")


def calendar_bounded(df: DataFrame, order: str) -> bool:
    return isinstance(df.schema[order].dataType, T.DateType)


def cut_points(df: DataFrame, order: str, rows_per_slice: int = ROWS_PER_SLICE, keys: Sequence[str] = ()) -> list[float]:
    """Inner slice borders; empty when the rows of every key fit into one slice.

    Rows are counted per key, folded before the shuffle. Only a key that is too large
    for one slice costs a second scan, with map-side sketches whose accuracy follows the
    number of slices. The driver receives one number per slice, eight bytes for each
    ``rows_per_slice`` rows. Borders are literals in the plan, so a recomputed task cuts
    the rows exactly as the first run did.
    """
    value = axis_value(df, order)
    n, largest = df.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (largest or 0) <= rows_per_slice:
        return []
    slices = math.ceil(n / rows_per_slice)
    parts = max(slices, FIRST_SLICES)
    shares = [i / parts for i in range(1, parts)]
    (cuts,) = df.agg(F.percentile_approx(value, shares, max(20_000, 10 * parts))).first()
    parts = len(cuts) + 1
    picked = (cuts[round(parts * i / slices) - 1] for i in range(1, slices))
    return sorted(set(picked))


def axis_cuts(df: DataFrame, order: str, rows_per_slice: int = ROWS_PER_SLICE, keys: Sequence[str] = ()) -> list[float]:
    """Slice borders for ordered work on this axis; none for a daily one."""
    return [] if calendar_bounded(df, order) else cut_points(df, order, rows_per_slice, keys)


def add_slice(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    borders = [-math.inf, *cuts, math.inf]
    cutter = Bucketizer(splits=borders, inputCol="__axis", outputCol=_SLICE, handleInvalid="keep")
    sliced = cutter.transform(df.withColumn("__axis", axis_value(df, order)))
    return sliced.withColumn(_SLICE, F.col(_SLICE).cast("int")).drop("__axis")


@dataclass(frozen=True)
class Running:
    """A running value: ``kind`` is last, count, total, product, high or low."""

    kind: str
    value: Column

    def within(self, w: WindowSpec) -> Column:
        return {
            "last": lambda: F.last(self.value, ignorenulls=True).over(w),
            "count": lambda: F.count(self.value).over(w),
            "total": lambda: F.sum(self.value).over(w),
            "product": lambda: F.product(self.value).over(w),
            "high": lambda: F.max(self.value).over(w),
            "low": lambda: F.min(self.value).over(w),
        }[self.kind]()

    def per_slice(self, order: Sequence[str]) -> Column:
        return {
            "last": lambda: F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order))),
            "count": lambda: F.count(self.value),
            "total": lambda: F.sum(self.value),
            "product": lambda: F.product(self.value),
            "high": lambda: F.max(self.value),
            "low": lambda: F.min(self.value),
        }[self.kind]()

    def over_slices(self, part: str, w: WindowSpec) -> Column:
        kind = "total" if self.kind == "count" else self.kind
        return Running(kind, F.col(part)).within(w)

    def joined(self, here: Column, carried: Column) -> Column:
        return {
            "last": lambda: F.coalesce(here, carried),
            "count": lambda: here + F.coalesce(carried, F.lit(0)),
            "total": lambda: F.when(here.isNull(), carried).otherwise(here + F.coalesce(carried, F.lit(0))),
            "product": lambda: F.when(here.isNull(), carried).otherwise(here * F.coalesce(carried, F.lit(1.0))),
            "high": lambda: F.greatest(here, carried),
            "low": lambda: F.least(here, carried),
        }[self.kind]()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, Running],
    rows_per_slice: int = ROWS_PER_SLICE,
    cuts: Sequence[float] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add running values over all rows of a key up to and including the row.

    ``cuts`` gives slice borders that are already known; ``[]`` states that the
    rows of a key are few. ``ties`` orders rows of equal ``order``.
    """
    if cuts is None:
        cuts = axis_cuts(df, order, rows_per_slice, keys)
    to_here = (Window.unboundedPreceding, Window.currentRow)
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(*to_here)
        return df.select("*", *[c.within(w).alias(name) for name, c in columns.items()])

    # Read twice below; written once so that chained operators do not repeat their input.
    sliced = materialize(add_slice(df, order, cuts))
    parts = sliced.groupBy(*keys, _SLICE).agg(*[c.per_slice([order, *ties]).alias(f"__p_{n}") for n, c in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *keys, _SLICE, *[c.over_slices(f"__p_{n}", earlier).alias(f"__c_{n}") for n, c in columns.items()]
    )
    w = Window.partitionBy(*keys, _SLICE).orderBy(order, *ties).rowsBetween(*to_here)
    local = sliced.join(carried, [*keys, _SLICE], "left").select(
        *df.columns,
        *[f"__c_{n}" for n in columns],
        *[c.within(w).alias(f"__h_{n}") for n, c in columns.items()],
    )
    return local.select(
        *df.columns,
        *[c.joined(F.col(f"__h_{n}"), F.col(f"__c_{n}")).alias(n) for n, c in columns.items()],
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    back: int,
    ahead: int = 0,
    rows_per_slice: int = ROWS_PER_SLICE,
    cuts: Sequence[float] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add columns whose windows reach at most ``back`` rows back and ``ahead`` ahead.

    On the sliced path a row near the edge of its run of rows is copied to the
    neighbouring run, so every frame is complete inside one task; the copies are
    dropped again. At most ``back + ahead`` rows per run are copied.
    """
    if cuts is None:
        cuts = axis_cuts(df, order, rows_per_slice, keys)
    if not cuts:
        made = columns(Window.partitionBy(*keys).orderBy(order, *ties))
        return df.select("*", *[c.alias(name) for name, c in made.items()])

    run = max(rows_per_slice, back + ahead, 1)
    placed = running(df, keys, order, {"__place": Running("count", F.lit(1))}, cuts=cuts, ties=ties)
    home = F.floor((F.col("__place") - 1) / run).cast("long")
    offset = (F.col("__place") - 1) % run
    placed = placed.withColumn("__run_home", home).withColumn(
        "__run",
        F.explode(
            F.array_compact(
                F.array(
                    home,
                    F.when(offset >= run - back, home + 1),
                    F.when((offset < ahead) & (home > 0), home - 1),
                )
            )
        ),
    )
    made = columns(Window.partitionBy(*keys, "__run").orderBy(order, *ties))
    return (
        placed.select("*", *[c.alias(name) for name, c in made.items()])
        .where(F.col("__run") == F.col("__run_home"))
        .select(*df.columns, *made)
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    rows_per_slice: int = ROWS_PER_SLICE,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Rows are folded to one per key and value first, and written once. Where the values
    of every key fit a slice (checked) the built-in ``percentile`` finds the ranks from
    their counts. Beyond that counts per slice tell which slices hold the wanted ranks,
    and only the values of those slices are sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    folded = materialize(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n")))
    if cuts is None:
        cuts = cut_points(folded, "__v", rows_per_slice, keys)
    if not cuts:
        return folded.groupBy(*keys).agg(*[F.percentile("__v", F.lit(p), F.col("__n")).alias(n) for n, p in quantiles.items()])

    sliced = add_slice(folded, "__v", cuts)
    sizes = sliced.groupBy(*keys, _SLICE).agg(F.sum("__n").alias("__n"))
    up_to = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = sizes.select(
        *keys,
        _SLICE,
        (F.sum("__n").over(up_to) - F.col("__n")).alias("__from"),
        F.sum("__n").over(up_to).alias("__to"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__all"),
    )
    targets = [p * (F.col("__all") - 1) for p in quantiles.values()]
    ranks = [f(t) for t in targets for f in (F.floor, F.ceil)]
    needed = F.lit(False)
    for rank in ranks:
        needed = needed | ((rank >= F.col("__from")) & (rank < F.col("__to")))
    values = sliced.join(spans.where(needed).drop("__to"), [*keys, _SLICE])
    inside = Window.partitionBy(*keys, _SLICE).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("__to", F.col("__from") + F.sum("__n").over(inside)).withColumn(
        "__from", F.col("__to") - F.col("__n")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__to")), F.col("__v")))

    columns = []
    for (name, _), target in zip(quantiles.items(), targets):
        low, high, part = at(F.floor(target)), at(F.ceil(target)), F.max(target - F.floor(target))
        columns.append((low + (high - low) * part).alias(name))
    return values.groupBy(*keys).agg(*columns)
