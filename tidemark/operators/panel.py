"""Shaping a panel: one row per key and time, long or wide, on a full calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import one_of, to_day, to_number
from tidemark.functions.names import source_prefix
from tidemark.operators.ordered import Running, running


def dedup(df: DataFrame, by: Sequence[str], tiebreak: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per ``by``: the first or last in the total order of ``tiebreak``.

    An aggregate rather than a row number: rows of one key are folded before the
    shuffle, so many copies of a key cost nothing.
    """
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in by]
    best = pick(F.struct(*rest), F.struct(*tiebreak)).alias("__row")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def coerce(df: DataFrame, day: str, numbers: Sequence[str]) -> DataFrame:
    """Text columns to DATE and DOUBLE; rows without a date are dropped."""
    typed = df.withColumns({day: to_day(F.col(day)), **{c: to_number(F.col(c)) for c in numbers}})
    return typed.dropna(subset=[day])


def to_long(df: DataFrame, keys: Sequence[str], ts: str, variables: Sequence[str]) -> DataFrame:
    values = [F.col(v).cast("double").alias(v) for v in variables]
    return df.select(*keys, ts, *values).unpivot([*keys, ts], list(variables), "variable", "value")


def to_wide(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Long to wide for named variables, in one shuffle and without a pivot scan."""
    picked = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    return df.groupBy(*keys).agg(*picked)


def wide_by_source(
    df: DataFrame, ts: str, source: str, values: Sequence[str], sources: Sequence[str]
) -> DataFrame:
    """Every source becomes a group of prefixed columns, one row per time.

    Same rows as a chain of full outer joins over the sources, in one shuffle.
    Several rows of a source at one time: the largest value is kept. Rows without a
    source go; a source that is not listed stops the job, as its columns would be lost.
    """
    df = df.withColumn(source, one_of(F.col(source), sources))
    columns = [
        F.max(F.when(F.col(source) == s, F.col(v))).alias(f"{source_prefix(s)}_{v}") for s in sources for v in values
    ]
    return df.groupBy(ts).agg(*columns)


def fill_forward(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], **slicing) -> DataFrame:
    """Replace NULLs by the last known value of the key. Never fills backwards."""
    filled = running(df, keys, ts, {f"__f_{c}": Running("last", F.col(c)) for c in columns}, **slicing)
    return filled.select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def align(
    panel: DataFrame, context: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], **slicing
) -> DataFrame:
    """Context values on the rows of the panel: exact match on time, then fill forward.

    A context value at a time the panel does not have is not used. The context is
    folded to one row per time; whether it is small enough to broadcast is left to
    Spark, which sees its size.
    """
    once = context.groupBy(ts).agg(*[F.max(c).alias(c) for c in columns])
    matched = panel.join(once, ts, "left").select(*panel.columns, *columns)
    return fill_forward(matched, keys, ts, columns, **slicing)


def every_day(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """All days between the first and last day of each key."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    return span.select(*keys, F.explode(F.sequence("__a", "__b")).alias(ts))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns a frame lacks are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def hash_sample(df: DataFrame, key: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """A repeatable random sample: the same rows on every run, cluster size and engine."""
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    slot = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % 1_000_000
    return df.where(slot < int(share * 1_000_000))
