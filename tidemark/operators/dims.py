"""Joins to small, slowly changing dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Label of a year without an earlier one, and of a day outside all intervals.
NO_CLASS = "Sin clasificación"
OUT_OF_RANGE = "Fuera_rango"

# Name, first day, last day (both included).
PRESIDENTIAL_PERIODS = [
    ("Pastrana", "1998-08-07", "2002-08-06"),
    ("Uribe I", "2002-08-07", "2006-08-06"),
    ("Uribe II", "2006-08-07", "2010-08-06"),
    ("Santos I", "2010-08-07", "2014-08-06"),
    ("Santos II", "2014-08-07", "2018-08-06"),
    ("Duque", "2018-08-07", "2022-08-06"),
    ("Petro", "2022-08-07", "2026-08-06"),
]


def intervals(spark, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A closed-interval dimension ``(position, name, first_day, last_day)``."""
    literals = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("name"),
            F.lit(first).cast("date").alias("first_day"),
            F.lit(last).cast("date").alias("last_day"),
        )
        for i, (name, first, last) in enumerate(rows)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*literals)))


def interval_lookup(df: DataFrame, day: str, dimension: DataFrame, name: str, default: str = OUT_OF_RANGE) -> DataFrame:
    """Name of the first interval that holds the day, else ``default``.

    The intervals are spelled out day by day, so the lookup is an equi-join on the
    day that Spark may broadcast or shuffle by size; no row meets all intervals.
    """
    days = (
        dimension.where(F.col("first_day") <= F.col("last_day"))
        .select("position", "name", F.explode(F.sequence("first_day", "last_day")).alias(day))
        .groupBy(day)
        .agg(F.min_by("name", "position").alias(name))
    )
    found = df.join(days, day, "left")
    return found.select(*df.columns, F.coalesce(name, F.lit(default)).alias(name))


def last_per_year(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Last known value of each year."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys, F.year(ts).alias("year")).agg(F.max_by(value, ts).alias(value))


def lag_years(annual: DataFrame, score: str, label: str, year: str = "year") -> DataFrame:
    """Previous row of an annual table, by row and not by calendar.

    The table has one row per year, so the single window is bounded by the calendar.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(year)
    return annual.select(
        year,
        F.lag(score).over(w).alias(f"lag1_{score}"),
        F.lag(label, 1, NO_CLASS).over(w).alias(f"lag1_{label}"),
    )


def annual_lag_join(
    df: DataFrame, ts: str, annual: DataFrame, score: str, label: str, year: str = "year"
) -> DataFrame:
    """Each row gets the annual values of the year before its own.

    One row per year: the table has a few hundred rows whatever the size of the
    data, so it is broadcast.
    """
    once = annual.groupBy(year).agg(F.min(F.struct(score, label)).alias("r")).select(year, "r.*")
    lagged = F.broadcast(lag_years(once, score, label, year).withColumnRenamed(year, "__year"))
    return df.join(lagged, F.year(ts) == F.col("__year"), "left").drop("__year")
