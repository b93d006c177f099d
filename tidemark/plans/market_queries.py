"""Queries on strategies, segments of the market and expected prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import sketches, summaries
from tidemark.operators.ordered import Running, exact_quantiles, running
from tidemark.operators.panel import union_rows
from tidemark.plans import views
from tidemark.plans.evaluation_queries import sql_rounded
from tidemark.plans.registry import registered, rounded
from tidemark.session import materialize

KEYS = views.KEYS
COST, SLIPPAGE = 0.001, 0.0005


def strategy_series(spark: SparkSession, folder: str) -> DataFrame:
    log = views.prediction_log(spark, folder)
    return bt.backtest(log, KEYS, start="1998-01-01", end="2001-06-30", cost=COST, slippage=SLIPPAGE)


BACKTEST_SQL = """
  SELECT series_id, ds, px, proba_up, threshold, pred_return_direct, strategy, exposure, round(ret1, 6) AS ret1, turnover,
    round(net_return, 6) AS net_return, round(capital, 2) AS capital, round(drawdown, 6) AS drawdown FROM bt"""


@registered(BACKTEST_SQL)
def backtest(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(strategy_series(spark, folder), 6, "ret1", "net_return", "drawdown"), 2, "capital")


@registered(BACKTEST_SQL)
def backtest_carried(spark: SparkSession, folder: str) -> DataFrame:
    """The same series, year by year: each year goes on from the state the one before left."""
    log = materialize(views.prediction_log(spark, folder).where(F.col("ds").between("1998-01-01", "2001-06-30")))
    years = [r[0] for r in log.select(F.year("ds")).distinct().sort(F.year("ds")).collect()]  # the years of a fixed span
    state, made = None, []
    for year in years:
        series, state, _ = bt.advance(state, log.where(F.year("ds") == year), KEYS, cost=COST, slippage=SLIPPAGE)
        made.append(series)
    return rounded(rounded(union_rows(*made), 6, "ret1", "net_return", "drawdown"), 2, "capital")


@registered("""
  WITH s AS (SELECT series_id, strategy, arg_max(capital, ds) AS capital_final, min(drawdown) AS max_drawdown, avg((net_return > 0)::INT) AS hit_rate,
    avg(abs(exposure)) AS time_in_market, count(*) FILTER (turnover > 0) AS n_position_changes, min(ds) AS start_date, max(ds) AS end_date FROM bt GROUP BY 1, 2)
  SELECT series_id, strategy, 1000000.0::DOUBLE AS capital_initial, round(capital_final, 2) AS capital_final, round(s.capital_final / 1000000 - 1, 6) AS total_return,
    round(pow(s.capital_final / 1000000, 1 / ((end_date - start_date) / 365.25)) - 1, 6) AS cagr, round(max_drawdown, 6) AS max_drawdown,
    round(hit_rate, 6) AS hit_rate, round(time_in_market, 6) AS time_in_market, n_position_changes, 0.001::DOUBLE AS cost, 0.0005::DOUBLE AS slippage,
    start_date, end_date FROM s""")
def backtest_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = bt.backtest_summary(strategy_series(spark, folder), KEYS, cost=COST, slippage=SLIPPAGE)
    return rounded(rounded(summary, 6, "total_return", "cagr", "max_drawdown", "hit_rate", "time_in_market"), 2, "capital_final")


@registered("""
  SELECT series_id, ds, proba_up, coalesce(last_value(CASE WHEN proba_up >= 0.60 THEN 1.0 WHEN proba_up <= 0.35 THEN 0.0 END IGNORE NULLS)
    OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::DOUBLE AS state FROM preds""")
def hysteresis(spark: SparkSession, folder: str) -> DataFrame:
    log = views.prediction_log(spark, folder).select("series_id", "ds", "proba_up")
    return bt.add_state(log, KEYS, "ds", "proba_up")


@registered("""
  SELECT event_type, ts, event_id, coalesce(last_value(CASE WHEN value / 40 >= 0.60 THEN 1.0 WHEN value / 40 <= 0.35 THEN 0.0 END IGNORE NULLS) OVER w, 0)::DOUBLE AS state,
    sum(value::DECIMAL(18,2)) OVER w::DOUBLE AS total, max(value) OVER w AS highest, count(value) OVER w AS seen
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def hysteresis_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Running state and totals on raw events of five types, worked out slice by slice."""
    value = F.col("value")
    columns = {
        "state": bt.hysteresis(value / 40),
        "total": Running("total", value.cast("decimal(18,2)")),
        "highest": Running("high", value),
        "seen": Running("count", value),
    }
    made = running(views.events(spark, folder), ["event_type"], "ts", columns, rows_per_slice=1000, ties=["event_id"]).drop("value")
    return made.withColumns({"state": F.coalesce("state", F.lit(0.0)), "total": F.col("total").cast("double")})


@registered("""
  SELECT event_type, round(median(value), 6) AS p50, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99
  FROM events GROUP BY 1""")
def quantiles_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Exact quantiles of a few large groups."""
    made = exact_quantiles(views.events(spark, folder), ["event_type"], "value", {"p50": 0.5, "p01": 0.01, "p99": 0.99}, rows_per_slice=1000)
    return rounded(made, 6, "p50", "p01", "p99")


@registered()
def event_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Missing share, distinct values and quantiles of events per type and quarter, merged from one sketch per type and day."""
    events = views.events(spark, folder).withColumn("day", F.to_date("ts"))
    days = sketches.day_sketches(events, ["event_type"], "day")
    quarters = sketches.merged(days.withColumn("quarter", F.to_date(F.date_trunc("quarter", "day"))), ["event_type", "quarter"])
    return sketches.estimates(quarters, {"p01": 0.01, "p50": 0.5, "p99": 0.99})


@registered("""
  WITH a AS (SELECT series_id, ds, coalesce(px / lag(px) OVER w - 1, 0) AS ret, coalesce(lag(pred_up_calibrated) OVER w, 0)::DOUBLE AS s
    FROM preds WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
  c AS (SELECT series_id, ds, product(1 + ret) OVER w AS b, product(1 + s * ret) OVER w AS m FROM a
    WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  d AS (SELECT *, b / max(b) OVER w - 1 AS bd, m / max(m) OVER w - 1 AS md FROM c
    WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT series_id, min(ds) AS start_date, max(ds) AS end_date, round(1000000 * arg_max(b, ds), 2) AS buy_hold_final, round(1000000 * arg_max(m, ds), 2) AS model_final,
    round(min(bd), 6) AS buy_hold_max_drawdown, round(min(md), 6) AS model_max_drawdown FROM d GROUP BY 1""")
def quick_backtest(spark: SparkSession, folder: str) -> DataFrame:
    made = bt.quick_backtest(views.prediction_log(spark, folder), KEYS)
    return rounded(rounded(made, 2, "buy_hold_final", "model_final"), 6, "buy_hold_max_drawdown", "model_max_drawdown")


@registered(f"""
  SELECT series_id, inicio, fin, n_dias, regimen_mercado, {sql_rounded("buyhold_return", *bt.STRATEGIES)} FROM regime_labels""")
def market_regime_periods(spark: SparkSession, folder: str) -> DataFrame:
    made = bt.market_regime_periods(strategy_series(spark, folder), KEYS).drop("window_id")
    return rounded(made, 6, "buyhold_return", *bt.STRATEGIES)


@registered(f"""
  SELECT series_id, regimen_mercado, count(*) AS n_periodos, {", ".join(f"round(avg({c}), 6) AS {c}" for c in ["buyhold_return", *bt.STRATEGIES])}
  FROM regime_labels GROUP BY 1, 2""")
def market_regime_summary(spark: SparkSession, folder: str) -> DataFrame:
    periods = bt.market_regime_periods(strategy_series(spark, folder), KEYS)
    return rounded(bt.market_regime_summary(periods, KEYS), 6, "buyhold_return", *bt.STRATEGIES)


@registered("""
  SELECT series_id, strategy, coalesce(periodo, 'Fuera_rango') AS periodo, min(ds) AS fecha_ini, max(ds) AS fecha_fin, count(*) AS n,
    round(arg_min(capital, ds), 2) AS capital_ini_periodo, round(arg_max(capital, ds), 2) AS capital_fin_periodo,
    round(avg(net_return), 6) AS mean_daily_return, round(stddev_samp(net_return), 6) AS vol_daily_return, round(min(drawdown), 6) AS max_drawdown_period,
    round(avg(abs(exposure)), 6) AS time_in_market, round(arg_max(capital, ds) / arg_min(capital, ds) - 1, 6) AS period_return
  FROM bt LEFT JOIN periods ON ds BETWEEN a AND b GROUP BY 1, 2, 3 HAVING count(*) >= 20""")
def strategy_by_period(spark: SparkSession, folder: str) -> DataFrame:
    series = strategy_series(spark, folder)
    named = bt_period(spark, series)
    made = bt.strategy_by_period(named, KEYS, "periodo")
    rates = ["mean_daily_return", "vol_daily_return", "max_drawdown_period", "time_in_market", "period_return"]
    return rounded(rounded(made, 2, "capital_ini_periodo", "capital_fin_periodo"), 6, *rates)


def bt_period(spark: SparkSession, series: DataFrame) -> DataFrame:
    from tidemark.operators.dims import interval_lookup, intervals

    return interval_lookup(series, "ds", intervals(spark, views.PERIODS), "periodo")


@registered("""
  WITH v AS (SELECT series_id, stddev_samp(future_logret_h21) AS vol FROM target GROUP BY 1)
  SELECT series_id, ds, proba_up, round(r, 8) AS pred_return_direct, round(px * exp(r), 2) AS expected_price_h21 FROM (
    SELECT p.series_id, p.ds, p.px, p.proba_up, coalesce(p.pred_return_direct * 0.5, (p.proba_up - 0.5) * 2 * v.vol) AS r
    FROM preds p JOIN v ON p.series_id = v.series_id)""")
def expected_price(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of each magnitude prediction arrive; the later one counts."""
    log = views.prediction_log(spark, folder)
    known = log.where(F.col("pred_return_direct").isNotNull())
    versions = known.select("series_id", "ds", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "pred_return_direct")
    magnitude = versions.withColumn("pred_return_direct", F.col("pred_return_direct") / F.col("version"))
    spread = views.target_panel(spark, folder).groupBy("series_id").agg(F.stddev_samp("future_logret_h21").alias("vol"))
    preds = log.drop("pred_return_direct").join(spread, "series_id")
    made = bt.expected_prices(preds, magnitude, KEYS, "ds", "px", F.col("vol"), ["version"])
    kept = made.select("series_id", "ds", "proba_up", "pred_return_direct", "expected_price_h21")
    return rounded(rounded(kept, 8, "pred_return_direct"), 2, "expected_price_h21")


STOCHASTIC = [
    "mean_h21_return", "median_h21_return", "std_h21_return", "min_h21_return", "max_h21_return", "skew_h21_return",
    "kurtosis_h21_return", "positive_share_h21", "zero_share_h21", "acf1_h21", "acf5_h21", "daily_vol_annualized",
    "daily_mean_annualized", "sharpe_like_daily",
]


@registered(f"""
  WITH t AS (SELECT series_id, ds, future_logret_h21 AS r, logret_1d AS r1, unnest(['periodo', 'cluster_abs', 'cluster_chg', 'lag1_cls', 'policy_stance']) AS grupo,
      unnest([periodo, cluster_abs::VARCHAR, cluster_chg::VARCHAR, lag1_cls, policy_stance]) AS segmento FROM regime WHERE future_logret_h21 IS NOT NULL),
  l AS (SELECT *, lag(r, 1) OVER w AS r_1, lag(r, 5) OVER w AS r_5 FROM t WHERE segmento IS NOT NULL
    WINDOW w AS (PARTITION BY series_id, grupo, segmento ORDER BY ds)),
  s AS (SELECT series_id, grupo, segmento, count(*) AS n, min(ds) AS fecha_ini, max(ds) AS fecha_fin, avg(r) AS mean_h21_return, median(r) AS median_h21_return,
    stddev_samp(r) AS std_h21_return, min(r) AS min_h21_return, max(r) AS max_h21_return, skewness(r) AS skew_h21_return, kurtosis(r) AS kurtosis_h21_return,
    avg((r > 0)::INT) AS positive_share_h21, avg((r = 0)::INT) AS zero_share_h21, corr(r, r_1) AS acf1_h21, corr(r, r_5) AS acf5_h21,
    CASE WHEN count(r1) > 10 THEN stddev_samp(r1) * sqrt(252) END AS daily_vol_annualized, CASE WHEN count(r1) > 10 THEN avg(r1) * 252 END AS daily_mean_annualized,
    CASE WHEN count(r1) > 10 AND stddev_samp(r1) > 0 THEN avg(r1) / stddev_samp(r1) * sqrt(252) END AS sharpe_like_daily
    FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 20)
  SELECT series_id, grupo, segmento, n, fecha_ini, fecha_fin, {sql_rounded(*STOCHASTIC)} FROM s""")
def stochastic_summary(spark: SparkSession, folder: str) -> DataFrame:
    segments = ["periodo", "cluster_abs", "cluster_chg", "lag1_cls", "policy_stance"]
    made = summaries.stochastic_summary(views.regime_panel(spark, folder), KEYS, "ds", "future_logret_h21", "logret_1d", segments)
    return rounded(made, 6, *STOCHASTIC)
