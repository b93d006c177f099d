"""Coverage, missing values, dictionaries and reports about the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import effective_frequency, ratio, sanitize
from tidemark.functions.markers import is_context
from tidemark.operators.panel import to_long, union_rows


def coverage(df: DataFrame, keys: Sequence[str], ts: str, variables: Sequence[str], group: str) -> DataFrame:
    """Known and distinct values, repeat share, frequency class and first and last day per variable."""
    known = to_long(df, keys, ts, variables).where(F.col("value").isNotNull())
    sums = known.groupBy(*keys, F.col("variable").alias("var")).agg(
        F.count("*").alias("n_no_nulos"),
        F.count_distinct("value").alias("n_unicos"),
        F.min(ts).alias("fecha_ini"),
        F.max(ts).alias("fecha_fin"),
    )
    repeated = 1 - F.col("n_unicos") / F.greatest("n_no_nulos", F.lit(1))
    return sums.withColumns(
        {
            "grupo": F.lit(group),
            "pct_repetido": F.round(100 * repeated, 2),
            "freq": effective_frequency(repeated),
        }
    )


def missingness(df: DataFrame, candidates: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Type, size, missing share and distinct values of every column, from one pass."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    tall = text.unpivot([], list(df.columns), "column", "value")
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    sums = tall.groupBy("column").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.avg(F.col("value").isNull().cast("double")).alias("pct_missing"),
        distinct("value").alias("n_unique"),
    )
    type_of = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return sums.withColumns(
        {
            "dtype": type_of[F.col("column")],
            "is_feature_candidate": F.col("column").isin(list(candidates)),
            "is_global": is_context(F.col("column")),
        }
    )


def data_dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, names and date range of every table."""
    rows = []
    for name, df in tables.items():
        dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
        first = F.min(F.col(dates[0]).cast("date")) if dates else F.lit(None).cast("date")
        last = F.max(F.col(dates[0]).cast("date")) if dates else F.lit(None).cast("date")
        rows.append(
            df.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("n_rows"),
                F.lit(len(df.columns)).alias("n_columns"),
                F.lit(", ".join(df.columns)).alias("column_names"),
                first.alias("first_day"),
                last.alias("last_day"),
            )
        )
    return union_rows(*rows)


def missing_tables(dictionary: DataFrame, required: Sequence[str]) -> list[str]:
    """Required tables that are absent or empty. The dictionary has one row per table."""
    present = {r[0] for r in dictionary.where(F.col("n_rows") > 0).select("table_name").collect()}
    return [t for t in required if t not in present]


def ratio_report(long: DataFrame, by: Sequence[str], ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """How often a ratio feature would be infinite: zero below, not zero above.

    Plain division would give infinity there; ``ratio`` gives NULL, so nothing is
    left afterwards. Only features with a finding are listed.
    """
    cells = [
        F.struct(
            F.lit(name).alias("feature"),
            ((F.col(low) == 0) & (F.col(top) != 0)).alias("hit"),
            ratio(F.col(top), F.col(low)).alias("kept"),
        )
        for name, (top, low) in ratios.items()
    ]
    tall = long.select(*by, F.inline(F.array(*cells)))
    infinite = F.abs("kept") == float("inf")
    return (
        tall.groupBy(*by, "feature")
        .agg(F.count_if("hit").alias("n_inf_before"), F.count_if(infinite).alias("n_inf_after"))
        .where(F.col("n_inf_before") > 0)
    )


def sanitize_frame(df: DataFrame) -> DataFrame:
    """``sanitize`` on every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: sanitize(F.col(c).cast("double")) for c in floats})
