"""Panels derived from the base tables; every registered query starts from one of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import policy_stance, ratio
from tidemark.functions.names import source_prefix
from tidemark.operators.dims import annual_lag_join, interval_lookup, intervals
from tidemark.operators.features import targets
from tidemark.operators.panel import align, fill_forward, to_long, wide_by_source
from tidemark.sources.tables import table

KEYS = ["series_id"]
BLOCK_START = "1998-01-01"
SOURCES = {"A": "GLD", "N": "SI=F", "R": "^VIX"}
PERIODS = [
    ("P1", "1995-01-01", "1996-12-31"),
    ("P2", "1997-01-01", "1998-12-31"),
    ("P3", "1999-01-01", "2000-06-30"),
]


def money(x: str) -> Column:
    """Money added up as DECIMAL, so the sum does not depend on the order of rows."""
    return F.sum(F.col(x).cast("decimal(18,2)")).cast("double")


def cents(x: Column) -> Column:
    return F.floor(x * 100) / 100


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order value per priority and day."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ds"))
        .agg(cents(money("o_totalprice") / F.count("*")).alias("px"), F.count("*").alias("n"))
    )


def context_long(spark: SparkSession, folder: str) -> DataFrame:
    """Volume and mean price per source and day."""
    source = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])[F.col("l_returnflag")]
    return (
        table(spark, folder, "lineitem")
        .groupBy(source.alias("source"), F.col("l_shipdate").cast("date").alias("ds"))
        .agg(money("l_quantity").alias("volume"), cents(money("l_extendedprice") / F.count("*")).alias("close"))
    )


def context_wide(spark: SparkSession, folder: str) -> DataFrame:
    return wide_by_source(context_long(spark, folder), "ds", "source", ["volume", "close"], list(SOURCES.values()))


def context_names() -> list[str]:
    return [f"{source_prefix(s)}_{v}" for s in SOURCES.values() for v in ("volume", "close")]


def annual_index(spark: SparkSession, folder: str) -> DataFrame:
    """Score and class of each year."""
    score = F.round(100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 6)
    label = F.when(F.col("score") < 32, "bajo").when(F.col("score") < 33.5, "medio").otherwise("alto")
    years = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(score.alias("score"))
    return years.withColumn("cls", label)


def price_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily panel with the price smoothed over 63 full rows, so that daily moves are small."""
    w = Window.partitionBy("series_id").orderBy("ds").rowsBetween(-62, Window.currentRow)
    smooth = F.when(F.count("px").over(w) == 63, F.round(F.avg("px").over(w), 2)).alias("px")
    return daily_panel(spark, folder).select("series_id", "ds", smooth).where(F.col("px").isNotNull())


def base_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Price with two context prices on its own calendar, filled forward."""
    context = context_wide(spark, folder).select("ds", F.col("gld_close").alias("fx"), F.col("si_f_close").alias("oil"))
    return align(price_panel(spark, folder), context, KEYS, "ds", ["fx", "oil"])


def target_panel(spark: SparkSession, folder: str) -> DataFrame:
    return targets(base_panel(spark, folder), KEYS, "ds", "px")


def long_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Three positive variables and one of mixed sign, which gets no logs."""
    wide = base_panel(spark, folder).withColumn("gap", F.col("fx") - F.col("oil"))
    return to_long(wide, KEYS, "ds", ["px", "fx", "oil", "gap"])


def calendar_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context on the panel's calendar: exact match, then fill forward. One row per day."""
    calendar = daily_panel(spark, folder).select("ds").distinct()
    matched = calendar.join(context_wide(spark, folder), "ds", "left").select("ds", *context_names())
    return fill_forward(matched, [], "ds", context_names())


def monthly_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly mean on every day of the month: a monthly value in a daily table."""
    monthly = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("m"))
        .agg(F.round(money("o_totalprice") / F.count("*"), 6).alias("px"))
    )
    days = F.explode(F.sequence("m", F.last_day("m")))
    return monthly.select("series_id", days.alias("ds"), "px")


def regime_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Target panel with segment columns: clusters, stance, annual class, year and period."""
    w = Window.partitionBy("series_id").orderBy("ds")
    move = F.ln(ratio(F.col("px"), F.lag("px", 21).over(w)))
    drift = F.col("fx") - F.lag("fx", 21).over(w)
    panel = target_panel(spark, folder).withColumns(
        {
            "move": move,
            "logret_1d": F.ln(ratio(F.col("px"), F.lag("px", 1).over(w))),
            "cluster_chg": F.when(drift < 0, 0).when(drift >= 0, 1),
            "policy_stance": policy_stance(F.col("px") / 100000 - F.lag(F.col("px") / 100000, 30).over(w)),
            "year": F.year("ds"),
        }
    )
    m = F.col("move")
    cluster = F.when(m < -0.03, 0).when(m < 0, 1).when(m < 0.03, 2).when(m >= 0.03, 3)
    panel = panel.withColumn("cluster_abs", cluster)
    panel = annual_lag_join(panel, "ds", annual_index(spark, folder), "score", "cls")
    return interval_lookup(panel, "ds", intervals(spark, PERIODS), "periodo", "Fuera_rango")


def prediction_log(spark: SparkSession, folder: str, panel: DataFrame | None = None) -> DataFrame:
    """A closed-form score per day: momentum squeezed into a probability."""
    rows = regime_panel(spark, folder) if panel is None else panel
    score = F.round(1 / (1 + F.exp(-10 * F.col("move"))), 6)
    scored = rows.where(F.col("future_logret_h21").isNotNull() & F.col("move").isNotNull()).withColumn("proba_up", score)
    return scored.withColumns(
        {
            "real_return": F.col("future_logret_h21"),
            "y_true": F.col("target_up_h21"),
            "threshold": F.lit(0.5),
            "pred_up_calibrated": (F.col("proba_up") >= 0.5).cast("int"),
            "pred_return_direct": F.when(F.dayofmonth("ds") <= 20, F.round(F.col("logret_1d"), 6)),
        }
    ).drop("future_price_h21", "future_logret_h21", "target_up_h21")


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Document length, squeezed into (0, 1), as a score for document quality."""
    texts = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6)
    return table(spark, folder, "labels").join(texts, "doc_id").select(
        "doc_id", "source", F.col("quality").alias("y_true"), score.alias("proba_up")
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events by type: few keys, each with a large and unbounded share of the rows."""
    return table(spark, folder, "events").select("event_type", "ts", "event_id", "value")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors (``e``) with their label, and two linear forms over all dimensions as axes."""
    e = F.transform("embedding", lambda x: x.cast("double"))

    def axis(odd: int) -> Column:
        return F.aggregate(F.transform(e, lambda x, i: F.when(i % 2 == odd, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

    return table(spark, folder, "embeddings").select("vec_id", "label", e.alias("e"), axis(0).alias("axis_1"), axis(1).alias("axis_2"))


def dimensions(points: DataFrame, name: str = "e") -> int:
    """Length of the vectors; all must have the same."""
    least, most = points.agg(F.min(F.size(name)), F.max(F.size(name))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} dimensions")
    return most or 0
