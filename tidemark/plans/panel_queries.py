"""Queries on scans, panels, dimensions and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.columns import calendar_parts, indicator
from tidemark.functions.columns import one_hot as one_hot_of
from tidemark.functions.columns import policy_stance as stance_of
from tidemark.functions.names import normalize_headers as renamed
from tidemark.operators import catalog, dims, features, panel, quality
from tidemark.operators.ordered import framed
from tidemark.plans import views
from tidemark.plans.registry import registered, rounded
from tidemark.sources.tables import TABLES, all_tables, table
from tidemark.streaming import ledger

KEYS = views.KEYS


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("ds")


@registered("""
  SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n,
    sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
  FROM orders GROUP BY 1, 2""")
def scan_tables(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, folder, "orders").groupBy("o_orderpriority", F.trunc(day, "month").alias("month")).agg(
        F.count("*").alias("n"), views.money("o_totalprice").alias("total")
    )


@registered("""
  SELECT coalesce(p.periodo, 'Fuera_rango') AS periodo, count(*) AS n, count(DISTINCT d.ds) AS n_days,
    min(d.ds) AS first_day, max(d.ds) AS last_day
  FROM daily d LEFT JOIN periods p ON d.ds BETWEEN p.a AND p.b GROUP BY 1""")
def period_dim(spark: SparkSession, folder: str) -> DataFrame:
    named = dims.interval_lookup(views.daily_panel(spark, folder), "ds", dims.intervals(spark, views.PERIODS), "periodo")
    return named.groupBy("periodo").agg(
        F.count("*").alias("n"),
        F.count_distinct("ds").alias("n_days"),
        F.min("ds").alias("first_day"),
        F.max("ds").alias("last_day"),
    )


@registered("""
  SELECT series_id, ds, px, coalesce(periodo, 'Fuera_rango') AS periodo
  FROM daily LEFT JOIN periods ON ds BETWEEN a AND b""")
def interval_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.daily_panel(spark, folder).select("series_id", "ds", "px")
    return dims.interval_lookup(rows, "ds", dims.intervals(spark, views.PERIODS), "periodo")


@registered("""
  SELECT l_returnflag, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS demanda_energetica,
    round(avg(l_extendedprice), 4) AS precio_oro, count(*) AS pct_n_dias
  FROM lineitem GROUP BY 1""")
def normalize_headers(spark: SparkSession, folder: str) -> DataFrame:
    messy = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        views.money("l_quantity").alias(" Demanda\n(Energía) "),
        F.round(F.avg("l_extendedprice"), 4).alias("Precio / Oro"),
        F.count("*").alias("% N°-días"),
        F.max("l_tax").alias("precio.oro x2"),
    )
    return renamed(messy, canonical=True)


@registered("""
  SELECT * FROM (
    SELECT event_id, event_type, try_cast(CASE WHEN event_type = 'signup' THEN 'unknown' ELSE ts::DATE::VARCHAR END AS DATE) AS day,
      CASE WHEN event_type <> 'error' THEN round(greatest(least(value * 1e10, 1e12), -1e12), 2) END AS amount
    FROM events) WHERE day IS NOT NULL""")
def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    text = table(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "signup", "unknown").otherwise(F.col("ts").cast("date").cast("string")).alias("day"),
        F.when(F.col("event_type") == "error", "n/a").otherwise((F.col("value") * 1e10).cast("string")).alias("amount"),
    )
    return rounded(panel.coerce(text, "day", ["amount"]), 2, "amount")


@registered("SELECT * FROM ctxw")
def context_wide(spark: SparkSession, folder: str) -> DataFrame:
    return views.context_wide(spark, folder)


@registered(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS n_rows, count(*)::INT AS n_columns, "
    f"string_agg(column_name, ', ' ORDER BY column_index) AS column_names, "
    f"{'NULL::DATE' if day is None else f'(SELECT min({day})::DATE FROM {name})'} AS first_day, "
    f"{'NULL::DATE' if day is None else f'(SELECT max({day})::DATE FROM {name})'} AS last_day "
    f"FROM duckdb_columns() WHERE table_name = '{name}'"
    for name, day in [(t, {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}.get(t)) for t in TABLES]
))
def data_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return quality.data_dictionary(all_tables(spark, folder))


@registered("""
  WITH configs AS (
    SELECT DISTINCT 21 AS horizon, o_orderpriority AS feature_set, o_orderstatus AS model,
      CASE WHEN year(o_orderdate) < 2000 THEN (year(o_orderdate) - 1990)::INT END AS train_window_years,
      'none' AS weight_strategy, 'auto' AS tag FROM orders),
  keyed AS (SELECT *, 'h21__' || feature_set || '__' || model || '__win' || coalesce(train_window_years::VARCHAR, 'all')
      || '__wnone__auto' AS config_key FROM configs)
  SELECT * FROM keyed WHERE config_key NOT IN (
    SELECT 'h21__' || o_orderpriority || '__' || o_orderstatus || '__win'
      || coalesce(CASE WHEN year(o_orderdate) < 2000 THEN (year(o_orderdate) - 1990)::INT END::VARCHAR, 'all') || '__wnone__auto'
    FROM orders WHERE o_totalprice > 495000)""")
def pending_configs(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "orders").select(
        F.lit(21).alias("horizon"),
        F.col("o_orderpriority").alias("feature_set"),
        F.col("o_orderstatus").alias("model"),
        F.when(F.year("o_orderdate") < 2000, F.year("o_orderdate") - 1990).alias("train_window_years"),
        F.lit("none").alias("weight_strategy"),
        F.lit("auto").alias("tag"),
        "o_totalprice",
    )
    finished = runs.where(F.col("o_totalprice") > 495000).select(ledger.config_key().alias("config_key"))
    return ledger.pending(runs.drop("o_totalprice").distinct(), finished)


@registered("""
  SELECT series_id, ds, year(ds)::INT AS year, month(ds)::INT AS month, quarter(ds)::INT AS quarter, dayofyear(ds)::INT AS dayofyear,
    round(sin(2 * pi() * month(ds) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ds) / 12), 6) AS month_cos FROM daily""")
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    parts = calendar_parts(F.col("ds"))
    rows = views.daily_panel(spark, folder).select("series_id", "ds", *[c.alias(n) for n, c in parts.items()])
    return rounded(rows, 6, "month_sin", "month_cos")


@registered("""
  SELECT series_id, ds, rate_change, CASE WHEN rate_change > 0.05 THEN 'tightening' WHEN rate_change < -0.05 THEN 'easing'
    ELSE 'neutral' END AS policy_stance
  FROM (SELECT series_id, ds, round(px / 100000 - lag(px / 100000, 30) OVER (PARTITION BY series_id ORDER BY ds), 8) AS rate_change FROM price)""")
def policy_stance(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.col("px") / 100000
    rows = views.price_panel(spark, folder).withColumn("rate_change", F.round(rate - F.lag(rate, 30).over(by_series()), 8))
    return rows.withColumn("policy_stance", stance_of(F.col("rate_change"))).drop("px")


@registered("""
  SELECT series_id, ds,
    (policy_stance = 'tightening')::INT::DOUBLE AS policy_stance_tightening,
    (policy_stance = 'easing')::INT::DOUBLE AS policy_stance_easing,
    (policy_stance = 'neutral')::INT::DOUBLE AS policy_stance_neutral,
    (coalesce(cluster_abs::VARCHAR, 'nan') = '0')::INT::DOUBLE AS cluster_abs_0, (coalesce(cluster_abs::VARCHAR, 'nan') = '1')::INT::DOUBLE AS cluster_abs_1,
    (coalesce(cluster_abs::VARCHAR, 'nan') = '2')::INT::DOUBLE AS cluster_abs_2, (coalesce(cluster_abs::VARCHAR, 'nan') = '3')::INT::DOUBLE AS cluster_abs_3,
    (cluster_abs IS NULL)::INT::DOUBLE AS cluster_abs_nan
  FROM regime""")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    columns = {
        **one_hot_of(F.col("policy_stance"), ["tightening", "easing", "neutral"], "policy_stance"),
        **one_hot_of(F.col("cluster_abs"), ["0", "1", "2", "3", "nan"], "cluster_abs"),
    }
    return views.regime_panel(spark, folder).select("series_id", "ds", *[c.alias(n) for n, c in columns.items()])


@registered("""
  SELECT series_id, variable AS var, 'panel' AS grupo, count(*) AS n_no_nulos, count(DISTINCT value) AS n_unicos,
    round(100 * (1 - count(DISTINCT value)::DOUBLE / count(*)), 2) AS pct_repetido,
    CASE WHEN 1 - count(DISTINCT value)::DOUBLE / count(*) > 0.95 THEN 'mensual→diaria (ff)'
         WHEN 1 - count(DISTINCT value)::DOUBLE / count(*) > 0.80 THEN 'semanal/trimestral→diaria (ff)'
         WHEN 1 - count(DISTINCT value)::DOUBLE / count(*) > 0.25 THEN 'diaria con repetidos' ELSE 'diaria' END AS freq,
    min(ds) AS fecha_ini, max(ds) AS fecha_fin
  FROM (SELECT series_id, ds, unnest(['px', 'fx', 'oil']) AS variable, unnest([px, fx, oil]) AS value FROM base
        UNION ALL SELECT series_id, ds, 'monthly', px FROM monthly) WHERE value IS NOT NULL GROUP BY 1, 2""")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    daily = quality.coverage(views.base_panel(spark, folder), KEYS, "ds", ["px", "fx", "oil"], "panel")
    monthly = views.monthly_panel(spark, folder).withColumnRenamed("px", "monthly")
    return panel.union_rows(daily, quality.coverage(monthly, KEYS, "ds", ["monthly"], "panel"))


@registered("""
  SELECT series_id, year(ds)::INT AS year, arg_max(px, ds) AS px FROM price WHERE px IS NOT NULL GROUP BY 1, 2""")
def annual_last(spark: SparkSession, folder: str) -> DataFrame:
    return dims.last_per_year(views.price_panel(spark, folder), KEYS, "ds", "px")


@registered("""
  SELECT p.series_id, p.ds, p.px, l.lag1_score, l.lag1_cls FROM price p LEFT JOIN annual_lagged l ON l.year = year(p.ds)""")
def annual_lag_join(spark: SparkSession, folder: str) -> DataFrame:
    return dims.annual_lag_join(views.price_panel(spark, folder), "ds", views.annual_index(spark, folder), "score", "cls")


@registered("SELECT * FROM calctx")
def calendar_align(spark: SparkSession, folder: str) -> DataFrame:
    return views.calendar_context(spark, folder)


@registered("""
  SELECT o_custkey, o_orderdate::DATE AS ds, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey,
    min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2""")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("ds"), "o_orderkey", "o_totalprice")
    return panel.dedup(rows, ["o_custkey", "ds"], ["o_totalprice", "o_orderkey"])


@registered("""
  SELECT * FROM lineitem WHERE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT % 1000000 < 100000""")
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return panel.hash_sample(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], 0.1)


# A mean of cents over a window often ends exactly on a rounding tie, which noise in the last bit of a
# sum could send either way. Other means lie at least 0.004 units of the third digit away from a tie, so
# rounding from a little under the tie is the same rounding, with ties up on both sides.
TIE = 0.5001

_ELIGIBLE = """
  WITH ok AS (SELECT series_id, variable, avg((value > 0)::INT) > 0.98 AS log_ok FROM longp WHERE value IS NOT NULL GROUP BY 1, 2),
  lg AS (SELECT p.series_id, p.variable, p.ds, p.value, CASE WHEN log_ok AND value > 0 THEN ln(value) END AS l
         FROM longp p LEFT JOIN ok ON p.series_id = ok.series_id AND p.variable = ok.variable)"""
_WINDOWS = "WINDOW w AS (PARTITION BY series_id, variable ORDER BY ds)" + "".join(
    f", w{n} AS (PARTITION BY series_id, variable ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (21, 63, 126)
)
_LOG_SQL = "round(l, 6) AS log, " + ", ".join(f"round(l - lag(l, {k}) OVER w, 6) AS logret_{k}" for k in (1, 5, 21))
_DIFF_SQL = "round(value - lag(value, 1) OVER w, 3) AS diff_1, round(value / nullif(lag(value, 21) OVER w, 0) - 1, 6) AS pct_21"
_LAG_SQL = ", ".join(f"round(lag(value, {k}) OVER w, 3) AS lag{k}" for k in (1, 5, 21, 63))
_ROLL_SQL = ", ".join(
    f"CASE WHEN count(value) OVER w{n} >= {m} THEN floor(avg(value) OVER w{n} * 1000 + {TIE}) / 1000 END AS roll_mean{n}, "
    f"CASE WHEN count(value) OVER w{n} >= {m} THEN round(stddev_samp(value) OVER w{n}, 3) END AS roll_std{n}, "
    f"CASE WHEN count(value) OVER w{n} >= {m} THEN round(value / nullif(max(value) OVER w{n}, 0) - 1, 6) END AS dist_max{n}, "
    f"CASE WHEN count(value) OVER w{n} >= {m} THEN round(value / nullif(min(value) OVER w{n}, 0) - 1, 6) END AS dist_min{n}"
    for n, m in ((21, 5), (63, 15), (126, 31))
)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return features.series_features(views.long_panel(spark, folder), KEYS, "ds")


def _levels() -> list[str]:
    names = features.feature_names()
    return [n for n in names if n.startswith(("diff", "lag", "roll"))]


def _shown(df: DataFrame, names: list[str]) -> DataFrame:
    levels = [n for n in names if n in _levels()]
    shares = [n for n in names if n not in levels]
    kept = df.select("series_id", "variable", "ds", "value", *names).withColumn("value", F.round("value", 3))
    means = {n: F.floor(F.col(n) * 1000 + TIE) / 1000 for n in levels if n.startswith("roll_mean")}
    return rounded(rounded(kept.withColumns(means), 3, *[n for n in levels if n not in means]), 6, *shares)


@registered(_ELIGIBLE + f" SELECT series_id, variable, ds, round(value, 3) AS value, {_LOG_SQL} FROM lg {_WINDOWS}")
def ts_log(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_features(spark, folder), ["log", "logret_1", "logret_5", "logret_21"])


@registered(f"SELECT series_id, variable, ds, round(value, 3) AS value, {_LAG_SQL} FROM longp {_WINDOWS}")
def ts_lags(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_features(spark, folder), ["lag1", "lag5", "lag21", "lag63"])


@registered(f"SELECT series_id, variable, ds, round(value, 3) AS value, {_DIFF_SQL} FROM longp {_WINDOWS}")
def ts_diffs(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_features(spark, folder), ["diff_1", "pct_21"])


@registered(f"SELECT series_id, variable, ds, round(value, 3) AS value, {_ROLL_SQL} FROM longp {_WINDOWS}")
def ts_rolling(spark: SparkSession, folder: str) -> DataFrame:
    rolls = [n for n in features.feature_names() if n.startswith(("roll", "dist"))]
    return _shown(_features(spark, folder), rolls)


@registered(_ELIGIBLE + f" SELECT series_id, variable, ds, round(value, 3) AS value, {_LOG_SQL}, {_DIFF_SQL}, {_LAG_SQL}, {_ROLL_SQL} FROM lg {_WINDOWS}")
def ts_features(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_features(spark, folder), features.feature_names())


@registered("""
  SELECT event_type, ts, event_id, round(lag(value, 1) OVER w, 6) AS lag1, round(lag(value, 63) OVER w, 6) AS lag63,
    CASE WHEN count(value) OVER w21 >= 5 THEN round(avg(value) OVER w21, 6) END AS roll_mean21,
    CASE WHEN count(value) OVER w126 >= 31 THEN round(stddev_samp(value) OVER w126, 6) END AS roll_std126,
    CASE WHEN count(value) OVER w126 >= 31 THEN round(value / nullif(max(value) OVER w126, 0) - 1, 6) END AS dist_max126,
    round(lead(value, 21) OVER w, 6) AS ahead21
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id),
    w21 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
    w126 AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)""")
def ts_features_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Features on raw events of five types: each key is cut into runs of rows."""

    def columns(w):
        x = F.col("value")
        rolls = features.rolling_columns(x, w)
        wanted = {n: rolls[n] for n in ("roll_mean21", "roll_std126", "dist_max126")}
        return {**features.lag_columns(x, w, (1, 63)), **wanted, "ahead21": F.lead(x, 21).over(w)}

    rows = views.events(spark, folder)
    made = framed(rows, ["event_type"], "ts", columns, back=126, ahead=21, rows_per_slice=1000, ties=["event_id"]).drop("value")
    return rounded(rounded(made, 6, "lag1", "lag63", "roll_mean21", "roll_std126", "ahead21"), 6, "dist_max126")


@registered("""
  SELECT series_id, ds, px, round(future_price_h21, 4) AS future_price_h21, round(future_logret_h21, 6) AS future_logret_h21, target_up_h21 FROM target""")
def targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.target_panel(spark, folder).drop("fx", "oil")
    return rounded(rounded(rows, 4, "future_price_h21"), 6, "future_logret_h21")


@registered("""
  SELECT series_id, horizon, count(*) AS n, round(avg(y), 6) AS positive_share, round(1 - avg(y), 6) AS non_positive_share,
    round(avg((r = 0)::INT), 6) AS zero_return_share, round(avg(r), 6) AS mean_return, round(stddev_samp(r), 6) AS std_return
  FROM (SELECT series_id, h AS horizon, r, (r > 0)::INT AS y FROM (
    SELECT series_id, unnest([21, 30]) AS h, unnest([ln(lead(px, 21) OVER w / px), ln(lead(px, 30) OVER w / px)]) AS r
    FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY ds))) WHERE r IS NOT NULL GROUP BY 1, 2""")
def target_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    made = features.targets(views.monthly_panel(spark, folder), KEYS, "ds", "px", (21, 30))
    shares = ["positive_share", "non_positive_share", "zero_return_share", "mean_return", "std_return"]
    return rounded(features.target_diagnostics(made, KEYS, (21, 30)), 6, *shares)


@registered("""
  SELECT series_id, feature, count(*) FILTER (low = 0 AND top <> 0) AS n_inf_before, 0::BIGINT AS n_inf_after
  FROM (SELECT series_id, unnest(['pct_21', 'dist_min21']) AS feature, unnest([z, z]) AS top,
          unnest([lag(z, 21) OVER w, CASE WHEN count(z) OVER w21 >= 5 THEN min(z) OVER w21 END]) AS low
        FROM (SELECT series_id, ds, (n - 1)::DOUBLE AS z FROM daily)
        WINDOW w AS (PARTITION BY series_id ORDER BY ds), w21 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
  GROUP BY 1, 2 HAVING n_inf_before > 0""")
def sanitize(spark: SparkSession, folder: str) -> DataFrame:
    z = F.col("n") - 1
    rows = views.daily_panel(spark, folder).select("series_id", "ds", z.cast("double").alias("z"))
    lows = rows.select(
        "*",
        F.lag("z", 21).over(by_series()).alias("past"),
        features.rolling(F.col("z"), by_series(), 21, 5)["min"].alias("lowest"),
    )
    return quality.ratio_report(lows, KEYS, {"pct_21": ("z", "past"), "dist_min21": ("z", "lowest")})


@registered("""
  WITH cl AS (SELECT ds, unnest(['gld_close', 'vix_close']) AS variable, unnest([gld_close, vix_close]) AS value FROM calctx),
  cf AS (SELECT ds, variable, ln(value) - lag(ln(value), 21) OVER w AS logret_21, lag(value, 1) OVER w AS lag1,
      CASE WHEN count(value) OVER w21 >= 5 THEN avg(value) OVER w21 END AS roll_mean21
    FROM cl WINDOW w AS (PARTITION BY variable ORDER BY ds), w21 AS (PARTITION BY variable ORDER BY ds ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
  lf AS (SELECT *, lag(px, 1) OVER w AS px_lag1, CASE WHEN count(px) OVER w63 >= 15 THEN stddev_samp(px) OVER w63 END AS px_roll_std63
    FROM regime WINDOW w AS (PARTITION BY series_id ORDER BY ds), w63 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
  SELECT l.series_id, l.ds, l.px, year(l.ds)::INT AS year, month(l.ds)::INT AS month, round(sin(2 * pi() * month(l.ds) / 12), 6) AS month_sin,
    l.policy_stance, (l.policy_stance = 'easing')::INT::DOUBLE AS policy_stance_easing, l.lag1_score, l.lag1_cls,
    (coalesce(l.lag1_cls, 'nan') = 'medio')::INT::DOUBLE AS lag1_cls_medio, round(px_lag1, 4) AS px_lag1, round(px_roll_std63, 4) AS px_roll_std63,
    round(g.logret_21, 6) AS gld_close_logret_21, round(g.lag1, 4) AS gld_close_lag1, round(v.roll_mean21, 4) AS vix_close_roll_mean21
  FROM lf l LEFT JOIN cf g ON l.ds = g.ds AND g.variable = 'gld_close' LEFT JOIN cf v ON l.ds = v.ds AND v.variable = 'vix_close'""")
def feature_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Local features, calendar, stance, annual lag and context features on one row per key and day."""
    regime = views.regime_panel(spark, folder)
    parts = calendar_parts(F.col("ds"))
    local = framed(
        regime, KEYS, "ds",
        lambda w: {"px_lag1": F.lag("px", 1).over(w), "px_roll_std63": features.rolling_columns(F.col("px"), w)["roll_std63"]},
        back=126,
    )
    variables = ["gld_close", "vix_close"]
    context = panel.to_long(views.calendar_context(spark, folder), [], "ds", variables)
    made = features.series_features(context, [], "ds")
    wanted = {"gld_close": ["logret_21", "lag1"], "vix_close": ["roll_mean21"]}
    wide = made.groupBy("ds").agg(
        *[F.max(F.when(F.col("variable") == v, F.col(n))).alias(f"{v}_{n}") for v, ns in wanted.items() for n in ns]
    )
    frame = local.join(wide, "ds", "left").select(
        "series_id", "ds", "px", parts["year"].alias("year"), parts["month"].alias("month"), parts["month_sin"].alias("month_sin"),
        "policy_stance", indicator(F.col("policy_stance"), "easing").alias("policy_stance_easing"),
        "lag1_score", "lag1_cls", indicator(F.col("lag1_cls"), "medio").alias("lag1_cls_medio"),
        "px_lag1", "px_roll_std63", *[f"{v}_{n}" for v, ns in wanted.items() for n in ns],
    )
    levels = ["px_lag1", "px_roll_std63", "gld_close_lag1", "vix_close_roll_mean21"]
    return rounded(rounded(frame, 4, *levels), 6, "month_sin", "gld_close_logret_21")


LOCAL_VARIABLES = ["px", "fx", "oil", "gap"]
CATALOG_FEATURES = features.feature_names()
_CONTEXT_VARIABLES = ["gld_volume", "gld_close", "si_f_volume", "si_f_close", "vix_volume", "vix_close"]
_ALL_NAMES = [f"{v}_{f}" for v in LOCAL_VARIABLES + _CONTEXT_VARIABLES for f in CATALOG_FEATURES]


def catalog_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of local and context features as ``(feature, pos, value)``."""
    local = features.series_features(
        views.long_panel(spark, folder).where(F.col("variable").isin(LOCAL_VARIABLES)), KEYS, "ds"
    )
    context = features.series_features(
        panel.to_long(views.calendar_context(spark, folder), [], "ds", _CONTEXT_VARIABLES), [], "ds"
    )
    tall = panel.union_rows(
        features.long_to_named(local, ["series_id", "ds"], CATALOG_FEATURES).drop("series_id"),
        features.long_to_named(context, ["ds"], CATALOG_FEATURES),
    )
    names = F.array(*[F.lit(n) for n in _ALL_NAMES])
    return tall.select("feature", F.array_position(names, F.col("feature")).alias("pos"), "value")


_FEATURES_OF = ", ".join([
    "ln_ok AS log", *[f"ln_ok - lag(ln_ok, {k}) OVER w AS logret_{k}" for k in features.LOG_LAGS],
    "value - lag(value, 1) OVER w AS diff_1", "value / nullif(lag(value, 21) OVER w, 0) - 1 AS pct_21",
    *[f"lag(value, {k}) OVER w AS lag{k}" for k in features.LAGS],
    *[
        f"CASE WHEN count(value) OVER w{n} >= {m} THEN {made.format(n=n)} END AS {kind}{n}"
        for n, m in ((21, 5), (63, 15), (126, 31))
        for kind, made in (
            ("roll_mean", "avg(value) OVER w{n}"), ("roll_std", "stddev_samp(value) OVER w{n}"),
            ("dist_max", "value / nullif(max(value) OVER w{n}, 0) - 1"), ("dist_min", "value / nullif(min(value) OVER w{n}, 0) - 1"),
        )
    ],
])
_CATALOG_SQL = f"""
  WITH raw AS (
    SELECT series_id, variable, ds, value FROM longp WHERE variable IN ('px', 'fx', 'oil', 'gap')
    UNION ALL SELECT 'ctx', unnest({_CONTEXT_VARIABLES!r}), ds, unnest([{', '.join(_CONTEXT_VARIABLES)}]) FROM calctx),
  gate AS (SELECT series_id, variable, avg((value > 0)::INT) > 0.98 AS ok FROM raw WHERE value IS NOT NULL GROUP BY 1, 2),
  lgs AS (SELECT r.*, CASE WHEN ok AND value > 0 THEN ln(value) END AS ln_ok FROM raw r LEFT JOIN gate g
    ON r.series_id = g.series_id AND r.variable = g.variable),
  made AS (SELECT variable, {_FEATURES_OF} FROM lgs {_WINDOWS}),
  tall AS (SELECT variable || '_' || f AS feature, value FROM (
    SELECT variable, unnest({CATALOG_FEATURES!r}) AS f, unnest([{', '.join(CATALOG_FEATURES)}]) AS value FROM made)),
  stats AS (SELECT feature, list_position({_ALL_NAMES!r}, feature) AS pos, avg((value IS NOT NULL)::INT) AS known,
    count(DISTINCT value) AS nu, var_samp(value) AS var FROM tall GROUP BY 1),
  usable AS (SELECT *, regexp_matches(feature, 'gld|si_f|vix') AS g FROM stats
    WHERE known >= CASE WHEN regexp_matches(feature, 'gld|si_f|vix') THEN 0.40 ELSE 0.70 END AND nu > 1),
  compact AS (SELECT feature, row_number() OVER (ORDER BY var DESC) AS place FROM usable
    WHERE g AND regexp_matches(feature, 'close|logret_1|logret_5|logret_21|pct_21|roll_std21|roll_mean21|dist_max63|dist_min63|lag1|lag5|lag21')
    ORDER BY var DESC LIMIT 20),
  members AS (
    SELECT s.feature_set, u.feature, u.g AS is_global, u.pos AS o FROM usable u, (SELECT unnest(['colombia_only', 'colombia_plus_global_compact',
      'colombia_plus_global_full', 'global_no_gold_direct', 'global_no_metals', 'global_macro_only']) AS feature_set) s WHERE NOT u.g
    UNION ALL SELECT 'colombia_plus_global_full', feature, g, pos FROM usable WHERE g
    UNION ALL SELECT 'global_macro_only', feature, g, pos FROM usable WHERE g AND regexp_matches(feature, 'dx_y_nyb|vix|spy|qqq|tnx|irx|cl_f')
    UNION ALL SELECT 'colombia_plus_global_compact', feature, true, place FROM compact
    UNION ALL SELECT 'global_no_gold_direct', feature, true, place FROM compact WHERE NOT regexp_matches(feature, 'gld|iau|gc_f')
    UNION ALL SELECT 'global_no_metals', feature, true, place FROM compact WHERE NOT regexp_matches(feature, 'gld|iau|gc_f|slv|si_f|pl_f|pa_f|hg_f')),
  sets AS (SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY is_global, o) - 1 AS pos FROM members)"""


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    usable = catalog.usable_features(catalog.feature_stats(catalog_values(spark, folder)), price="px")
    return catalog.feature_sets(usable, limit=20)


@registered(_CATALOG_SQL + """
  SELECT feature_set, count(*) AS n_features, string_agg(feature, '|' ORDER BY pos) AS features FROM sets GROUP BY 1""")
def feature_sets(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.sets_summary(_sets(spark, folder)).withColumn("features", F.array_join("features", "|"))


@registered(_CATALOG_SQL + """
  SELECT feature_set, feature, CASE WHEN contains(feature, 'gld') THEN 'oro_internacional' WHEN contains(feature, 'si_f') THEN 'metales'
      WHEN contains(feature, 'vix') THEN 'riesgo' ELSE 'colombia' END AS "group",
    CASE WHEN contains(feature, 'lag') THEN 'lag' WHEN contains(feature, 'roll_mean') THEN 'rolling_mean' WHEN contains(feature, 'roll_std') THEN 'rolling_std'
      WHEN contains(feature, 'logret') THEN 'log_return' WHEN contains(feature, 'pct') THEN 'pct_change' WHEN contains(feature, 'diff') THEN 'difference'
      WHEN contains(feature, 'dist_max') OR contains(feature, 'dist_min') THEN 'rolling_distance' ELSE 'raw' END AS transform,
    is_global, feature IN (SELECT feature FROM sets WHERE feature_set = 'global_no_metals') AS used_in_best FROM sets""")
def feature_catalog(spark: SparkSession, folder: str) -> DataFrame:
    sets = _sets(spark, folder)
    return catalog.feature_catalog(sets, sets.where(F.col("feature_set") == "global_no_metals"))


_MANY = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """All orders by customer: many keys, none of them large."""
    return table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("value"))


@registered(f"""
  SELECT o_custkey, o_orderkey, round(lag(value, 1) OVER w, 2) AS lag1, round(lag(value, 3) OVER w, 2) AS lag3, round(value - lag(value, 1) OVER w, 2) AS diff_1,
    round(value / nullif(lag(value, 2) OVER w, 0) - 1, 6) AS pct_2, CASE WHEN count(value) OVER w6 >= 5 THEN round(stddev_samp(value) OVER w6, 4) END AS roll_std6,
    CASE WHEN count(value) OVER w6 >= 5 THEN round(value / nullif(max(value) OVER w6, 0) - 1, 6) END AS dist_max6
  FROM (SELECT *, o_totalprice AS value FROM orders) WINDOW w AS {_MANY}), w6 AS {_MANY} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def ts_features_many_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Short features on the orders of every customer; keys are small, so nothing is sliced."""

    def columns(w):
        x = F.col("value")
        rolls = features.rolling_columns(x, w, (6,))
        return {**features.lag_columns(x, w, (1, 3)), **features.change_columns(x, w, 2), **{n: rolls[n] for n in ("roll_std6", "dist_max6")}}

    made = framed(customer_orders(spark, folder), ["o_custkey"], "o_orderdate", columns, back=6, ties=["o_orderkey"])
    shown = made.select("o_custkey", "o_orderkey", "lag1", "lag3", "diff_1", "pct_2", "roll_std6", "dist_max6")
    return rounded(rounded(rounded(shown, 2, "lag1", "lag3", "diff_1"), 6, "pct_2", "dist_max6"), 4, "roll_std6")


@registered(f"""
  SELECT o_custkey, o_orderkey, future_price_h2, round(ln(future_price_h2 / value), 6) AS future_logret_h2,
    (ln(future_price_h2 / value) > 0)::INT AS target_up_h2
  FROM (SELECT *, o_totalprice AS value, lead(o_totalprice, 2) OVER w AS future_price_h2 FROM orders WINDOW w AS {_MANY}))""")
def targets_many_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The order value two orders ahead, for every customer."""
    made = features.targets(customer_orders(spark, folder), ["o_custkey"], "o_orderdate", "value", (2,), ties=["o_orderkey"])
    return rounded(made.drop("o_orderdate", "value"), 6, "future_logret_h2")


@registered("""
  SELECT "column", dtype, count(*) AS n, count(*) FILTER (v IS NULL) AS n_missing, round(avg((v IS NULL)::INT), 6) AS pct_missing,
    count(DISTINCT v) AS n_unique, "column" IN ('px', 'gld_close', 'oil') AS is_feature_candidate, contains("column", 'gld') AS is_global
  FROM (SELECT unnest(['series_id', 'ds', 'px', 'gld_close', 'oil', 'future_price_h21', 'target_up_h21']) AS "column",
      unnest(['string', 'date', 'double', 'double', 'double', 'double', 'int']) AS dtype,
      unnest([series_id, ds::VARCHAR, px::VARCHAR, fx::VARCHAR, oil::VARCHAR, future_price_h21::VARCHAR, target_up_h21::VARCHAR]) AS v FROM target)
  GROUP BY 1, 2""")
def missingness(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.target_panel(spark, folder).drop("future_logret_h21").withColumnRenamed("fx", "gld_close")
    return rounded(quality.missingness(rows, ["px", "gld_close", "oil"]), 6, "pct_missing")
