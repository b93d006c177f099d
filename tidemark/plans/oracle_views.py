"""The derived panels in SQL, written apart from the Spark code they check."""

BY_SERIES = "PARTITION BY series_id ORDER BY ds"
ROWS_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

_RULE_METRICS = """
  SELECT *,
    (tn + tp)::DOUBLE / n_test AS accuracy,
    CASE WHEN tp + fn = 0 THEN tn::DOUBLE / (tn + fp) WHEN tn + fp = 0 THEN tp::DOUBLE / (tp + fn)
         ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END AS balanced_accuracy,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision_up,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall_up,
    coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_up,
    (tp::DOUBLE * tn - fp::DOUBLE * fn)
      / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc,
    tn::DOUBLE / greatest(tn + fp, 1) AS recall_not_up
  FROM {cells}
"""


def metrics_of(cells: str) -> str:
    return _RULE_METRICS.format(cells=cells)


VIEWS = {
    "daily": """
  SELECT o_orderpriority AS series_id, o_orderdate::DATE AS ds,
    floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) * 100) / 100 AS px, count(*) AS n
  FROM orders GROUP BY 1, 2""",
    "ctx": """
  SELECT CASE l_returnflag WHEN 'A' THEN 'GLD' WHEN 'N' THEN 'SI=F' WHEN 'R' THEN '^VIX' END AS source,
    l_shipdate::DATE AS ds, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS volume,
    floor(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*) * 100) / 100 AS close
  FROM lineitem GROUP BY 1, 2""",
    "ctxw": """
  SELECT coalesce(a.ds, b.ds, c.ds) AS ds, a.volume AS gld_volume, a.close AS gld_close,
    b.volume AS si_f_volume, b.close AS si_f_close, c.volume AS vix_volume, c.close AS vix_close
  FROM (SELECT * FROM ctx WHERE source = 'GLD') a
  FULL JOIN (SELECT * FROM ctx WHERE source = 'SI=F') b ON a.ds = b.ds
  FULL JOIN (SELECT * FROM ctx WHERE source = '^VIX') c ON coalesce(a.ds, b.ds) = c.ds""",
    "annual": """
  SELECT yr AS year, score, CASE WHEN score < 32 THEN 'bajo' WHEN score < 33.5 THEN 'medio' ELSE 'alto' END AS cls
  FROM (SELECT year(o_orderdate)::INT AS yr, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS score
        FROM orders GROUP BY 1)""",
    "annual_lagged": """
  SELECT year, lag(score) OVER (ORDER BY year) AS lag1_score,
    lag(cls, 1, 'Sin clasificación') OVER (ORDER BY year) AS lag1_cls FROM annual""",
    "price": """
  SELECT series_id, ds, round(avg(px) OVER w, 2) AS px FROM daily
  WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) QUALIFY count(px) OVER w = 63""",
    "base": """
  SELECT p.series_id, p.ds, p.px, last_value(c.gld_close IGNORE NULLS) OVER w AS fx,
    last_value(c.si_f_close IGNORE NULLS) OVER w AS oil
  FROM price p LEFT JOIN ctxw c ON p.ds = c.ds
  WINDOW w AS (PARTITION BY p.series_id ORDER BY p.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "target": """
  SELECT *, ln(future_price_h21 / px) AS future_logret_h21,
    CASE WHEN future_price_h21 IS NOT NULL THEN (ln(future_price_h21 / px) > 0)::INT END AS target_up_h21
  FROM (SELECT *, lead(px, 21) OVER (PARTITION BY series_id ORDER BY ds) AS future_price_h21 FROM base)""",
    "longp": """
  SELECT series_id, ds, unnest(['px', 'fx', 'oil', 'gap']) AS variable, unnest([px, fx, oil, fx - oil]) AS value FROM base""",
    "calctx": """
  SELECT d.ds, last_value(gld_volume IGNORE NULLS) OVER w AS gld_volume, last_value(gld_close IGNORE NULLS) OVER w AS gld_close,
    last_value(si_f_volume IGNORE NULLS) OVER w AS si_f_volume, last_value(si_f_close IGNORE NULLS) OVER w AS si_f_close,
    last_value(vix_volume IGNORE NULLS) OVER w AS vix_volume, last_value(vix_close IGNORE NULLS) OVER w AS vix_close
  FROM (SELECT DISTINCT ds FROM daily) d LEFT JOIN ctxw c ON d.ds = c.ds
  WINDOW w AS (ORDER BY d.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "monthly": """
  SELECT series_id, unnest(range(m, m + INTERVAL 1 MONTH, INTERVAL 1 DAY))::DATE AS ds, px
  FROM (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS m,
          round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 6) AS px FROM orders GROUP BY 1, 2)""",
    "periods": """
  SELECT * FROM (VALUES ('P1', DATE '1995-01-01', DATE '1996-12-31'), ('P2', DATE '1997-01-01', DATE '1998-12-31'),
    ('P3', DATE '1999-01-01', DATE '2000-06-30')) t(periodo, a, b)""",
    "regime": """
  SELECT m.*, CASE WHEN move < -0.03 THEN 0 WHEN move < 0 THEN 1 WHEN move < 0.03 THEN 2 WHEN move >= 0.03 THEN 3 END AS cluster_abs,
    CASE WHEN drift < 0 THEN 0 WHEN drift >= 0 THEN 1 END AS cluster_chg,
    CASE WHEN rate_change > 0.05 THEN 'tightening' WHEN rate_change < -0.05 THEN 'easing' ELSE 'neutral' END AS policy_stance,
    year(m.ds)::INT AS year, l.lag1_score, l.lag1_cls, coalesce(p.periodo, 'Fuera_rango') AS periodo
  FROM (SELECT *, ln(px / lag(px, 21) OVER w) AS move, ln(px / lag(px, 1) OVER w) AS logret_1d,
          fx - lag(fx, 21) OVER w AS drift, px / 100000 - lag(px / 100000, 30) OVER w AS rate_change
        FROM target WINDOW w AS (PARTITION BY series_id ORDER BY ds)) m
  LEFT JOIN annual_lagged l ON l.year = year(m.ds)
  LEFT JOIN periods p ON m.ds BETWEEN p.a AND p.b""",
    "preds": """
  SELECT *, CASE WHEN proba_up >= 0.5 THEN 1 ELSE 0 END AS pred_up_calibrated FROM (
    SELECT *, round(1 / (1 + exp(-10 * move)), 6) AS proba_up, future_logret_h21 AS real_return, target_up_h21 AS y_true,
      0.5::DOUBLE AS threshold, CASE WHEN day(ds) <= 20 THEN round(logret_1d, 6) END AS pred_return_direct
    FROM regime WHERE future_logret_h21 IS NOT NULL AND move IS NOT NULL)""",
    "scored": """
  SELECT doc_id, source, quality AS y_true, round(n_chars / (n_chars + 2000.0), 6) AS proba_up
  FROM labels JOIN documents USING (doc_id)""",
    "signals": """
  SELECT series_id, ds, px, future_logret_h21, target_up_h21,
    coalesce(ln(px / lag(px, 21) OVER w) > 0, false)::INT::DOUBLE AS "Momentum_21",
    coalesce(ln(px / lag(px, 63) OVER w) > 0, false)::INT::DOUBLE AS "Momentum_63",
    (count(px) OVER w21 >= 10 AND count(px) OVER w63 >= 20 AND avg(px) OVER w21 > avg(px) OVER w63)::INT::DOUBLE AS "MA_21_63",
    (count(px) OVER w63 >= 20 AND count(px) OVER w126 >= 40 AND avg(px) OVER w63 > avg(px) OVER w126)::INT::DOUBLE AS "MA_63_126",
    coalesce(ln(fx / lag(fx, 21) OVER w) > 0, false)::INT::DOUBLE AS "TRM_Momentum_21",
    coalesce(ln(oil / lag(oil, 21) OVER w) > 0, false)::INT::DOUBLE AS "Brent_Momentum_21"
  FROM target WHERE target_up_h21 IS NOT NULL
  WINDOW w AS (PARTITION BY series_id ORDER BY ds),
    w21 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
    w63 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 62 PRECEDING AND CURRENT ROW),
    w126 AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)""",
    "blocks": """
  SELECT series_id, block_id::INT AS block_id, a::DATE AS test_start, least(a + INTERVAL 6 MONTH, last_day)::DATE AS test_end
  FROM (SELECT series_id, max(ds) AS last_day FROM target WHERE target_up_h21 IS NOT NULL GROUP BY 1) s,
    (SELECT i AS block_id, DATE '1998-01-01' + INTERVAL (6 * i) MONTH AS a FROM range(0, 200) t(i)) b
  WHERE a < last_day""",
    "rule_log": """
  SELECT s.series_id, s.ds, s.px, s.future_logret_h21 AS real_return_h21, s.target_up_h21 AS y_true, s.proba_up,
    0.5::DOUBLE AS threshold, s.proba_up::INT AS pred_up_calibrated, b.block_id, b.test_start, b.test_end, 21 AS horizon,
    'deterministic_baseline' AS feature_set, s.model, 'deterministic' AS train_window_years, 'deterministic' AS weight_strategy
  FROM (UNPIVOT signals ON "Momentum_21", "Momentum_63", "MA_21_63", "MA_63_126", "TRM_Momentum_21", "Brent_Momentum_21"
        INTO NAME model VALUE proba_up) s
  JOIN blocks b ON s.series_id = b.series_id AND s.ds >= b.test_start AND s.ds < b.test_end""",
    "rule_cells": """
  SELECT series_id, horizon, feature_set, model, train_window_years, weight_strategy, block_id, test_start, test_end, threshold,
    count(*) AS n_test, count(*) FILTER (y_true = 0 AND pred_up_calibrated = 0) AS tn,
    count(*) FILTER (y_true = 0 AND pred_up_calibrated = 1) AS fp,
    count(*) FILTER (y_true = 1 AND pred_up_calibrated = 0) AS fn,
    count(*) FILTER (y_true = 1 AND pred_up_calibrated = 1) AS tp
  FROM rule_log GROUP BY ALL HAVING count(*) >= 20""",
    "rule_results": f"""
  SELECT *, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN balanced_accuracy END AS roc_auc
  FROM ({metrics_of("rule_cells")})""",
    "summary": """
  SELECT horizon, feature_set, model, train_window_years, weight_strategy,
    avg(accuracy) AS mean_accuracy, avg(balanced_accuracy) AS mean_balanced_accuracy, avg(roc_auc) AS mean_roc_auc,
    avg(precision_up) AS mean_precision_up, avg(recall_up) AS mean_recall_up, avg(recall_not_up) AS mean_recall_not_up,
    avg(f1_up) AS mean_f1_up, avg(mcc) AS mean_mcc, avg(threshold) AS mean_threshold,
    stddev_samp(accuracy) AS std_accuracy, stddev_samp(balanced_accuracy) AS std_balanced_accuracy,
    sum(tp)::BIGINT AS total_tp, sum(tn)::BIGINT AS total_tn, sum(fp)::BIGINT AS total_fp, sum(fn)::BIGINT AS total_fn,
    count(DISTINCT block_id) AS n_blocks, sum(n_test)::BIGINT AS n_test_total
  FROM rule_results GROUP BY ALL""",
    "set_results": """
  SELECT * REPLACE (CASE series_id WHEN '1-URGENT' THEN 'colombia_only' WHEN '2-HIGH' THEN 'colombia_plus_global_compact'
      WHEN '3-MEDIUM' THEN 'global_no_gold_direct' WHEN '4-NOT SPECIFIED' THEN 'global_no_metals'
      ELSE 'global_macro_only' END AS feature_set) FROM rule_results""",
    "set_summary": """
  SELECT horizon, feature_set, model, train_window_years, weight_strategy,
    avg(accuracy) AS mean_accuracy, avg(balanced_accuracy) AS mean_balanced_accuracy, avg(roc_auc) AS mean_roc_auc
  FROM set_results GROUP BY ALL""",
    "bt_rows": """
  SELECT *, row_number() OVER w AS row_no FROM (
    SELECT series_id, ds, px, proba_up, threshold, pred_return_direct, pred_up_calibrated,
      coalesce(lead(px) OVER w / px - 1, 0) AS ret1, lead(ds) OVER w AS next_ds
    FROM preds WHERE ds BETWEEN DATE '1998-01-01' AND DATE '2001-06-30' WINDOW w AS (PARTITION BY series_id ORDER BY ds))
  WHERE next_ds IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY ds)""",
    "bt_state": """
  SELECT *, first_value(pred_up_calibrated) OVER (PARTITION BY series_id, (row_no - 1) // 21 ORDER BY ds) AS held,
    coalesce(last_value(CASE WHEN proba_up >= 0.60 THEN 1.0 WHEN proba_up <= 0.35 THEN 0.0 END IGNORE NULLS) OVER
      (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::DOUBLE AS state
  FROM bt_rows""",
    "bt_long": """
  SELECT series_id, ds, px, proba_up, threshold, pred_return_direct, ret1,
    unnest(['buy_hold', 'h21_long_cash', 'clf_daily_long_cash', 'hysteresis_60_35', 'predret_long_cash', 'h21_long_short',
      'clf_daily_long_short', 'predret_long_short']) AS strategy,
    unnest([1.0, CASE WHEN held = 1 THEN 1.0 ELSE 0.0 END, CASE WHEN proba_up >= threshold THEN 1.0 ELSE 0.0 END, state,
      CASE WHEN pred_return_direct > 0 THEN 1.0 ELSE 0.0 END, CASE WHEN held = 1 THEN 1.0 ELSE -1.0 END,
      CASE WHEN proba_up >= threshold THEN 1.0 ELSE -1.0 END,
      CASE WHEN pred_return_direct > 0 THEN 1.0 ELSE -1.0 END]::DOUBLE[]) AS exposure
  FROM bt_state""",
    "bt_net": """
  SELECT *, exposure * ret1 - turnover * 0.0015 AS net_return FROM (
    SELECT *, abs(exposure - lag(exposure, 1, 0.0) OVER (PARTITION BY series_id, strategy ORDER BY ds)) AS turnover FROM bt_long)""",
    "bt": """
  SELECT *, capital / max(capital) OVER w - 1 AS drawdown FROM (
    SELECT *, 1000000 * product(1 + net_return) OVER w AS capital FROM bt_net
    WINDOW w AS (PARTITION BY series_id, strategy ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY series_id, strategy ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "regime_windows": """
  SELECT b.series_id, w.a, min(b.ds) FILTER (strategy = 'buy_hold') AS inicio, max(b.ds) FILTER (strategy = 'buy_hold') AS fin,
    product(1 + ret1) FILTER (strategy = 'buy_hold') - 1 AS buyhold_return, count(*) FILTER (strategy = 'buy_hold') AS n_dias,
    product(1 + net_return) FILTER (strategy = 'buy_hold') - 1 AS buy_hold,
    product(1 + net_return) FILTER (strategy = 'h21_long_cash') - 1 AS h21_long_cash,
    product(1 + net_return) FILTER (strategy = 'clf_daily_long_cash') - 1 AS clf_daily_long_cash,
    product(1 + net_return) FILTER (strategy = 'hysteresis_60_35') - 1 AS hysteresis_60_35,
    product(1 + net_return) FILTER (strategy = 'predret_long_cash') - 1 AS predret_long_cash,
    product(1 + net_return) FILTER (strategy = 'h21_long_short') - 1 AS h21_long_short,
    product(1 + net_return) FILTER (strategy = 'clf_daily_long_short') - 1 AS clf_daily_long_short,
    product(1 + net_return) FILTER (strategy = 'predret_long_short') - 1 AS predret_long_short
  FROM bt b JOIN (SELECT series_id, f + INTERVAL (6 * i) MONTH AS a, f + INTERVAL (6 * i + 6) MONTH AS e
      FROM (SELECT series_id, min(ds) AS f FROM bt GROUP BY 1), range(0, 100) t(i)) w
    ON b.series_id = w.series_id AND b.ds >= w.a AND b.ds < w.e
  GROUP BY 1, 2 HAVING n_dias >= 20""",
    "regime_labels": """
  SELECT *, CASE WHEN buyhold_return > 0.10 THEN 'alcista_fuerte' WHEN buyhold_return > 0.05 THEN 'alcista_moderado'
    WHEN buyhold_return >= -0.05 THEN 'lateral' ELSE 'bajista' END AS regimen_mercado FROM regime_windows""",
    "pts": """
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN x::DOUBLE ELSE 0 END)) AS axis_1,
    list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 0 THEN x::DOUBLE ELSE 0 END)) AS axis_2
  FROM embeddings""",
}
