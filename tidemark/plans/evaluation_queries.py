"""Queries on rules, metrics, calibration, walk-forward splits and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import calibration, leaderboard, metrics, models, panel, rules, summaries, walkforward
from tidemark.plans import views
from tidemark.plans.oracle_views import metrics_of
from tidemark.plans.registry import registered, rounded
from tidemark.session import materialize

KEYS = views.KEYS
RATES = ["accuracy", "balanced_accuracy", "precision_up", "recall_up", "f1_up", "mcc", "recall_not_up", "roc_auc"]
SUMMARY_RATES = [f"mean_{c}" for c in [*RATES, "threshold"]] + ["std_accuracy", "std_balanced_accuracy"]
SMALL_SLICES = 200


def sql_rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def rule_log(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_predictions(views.target_panel(spark, folder), KEYS, "ds", "px", "fx", "oil", views.BLOCK_START)


def rule_results(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_baselines(rule_log(spark, folder), KEYS)


def results_by_set(spark: SparkSession, folder: str) -> DataFrame:
    """The rule results with one audited feature set per series."""
    names = {
        "1-URGENT": "colombia_only", "2-HIGH": "colombia_plus_global_compact", "3-MEDIUM": "global_no_gold_direct",
        "4-NOT SPECIFIED": "global_no_metals",
    }
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("series_id")]
    return rule_results(spark, folder).withColumn("feature_set", F.coalesce(named, F.lit("global_macro_only")))


@registered("""
  SELECT series_id, ds, px, "Momentum_21", "Momentum_63", "MA_21_63", "MA_63_126", "TRM_Momentum_21", "Brent_Momentum_21" FROM signals""")
def rule_signals(spark: SparkSession, folder: str) -> DataFrame:
    known = views.target_panel(spark, folder).where(F.col("target_up_h21").isNotNull())
    return rules.rule_signals(known, KEYS, "ds", "px", "fx", "oil").select("series_id", "ds", "px", *rules.RULES)


@registered("SELECT series_id, block_id, test_start, test_end FROM blocks")
def walkforward_blocks(spark: SparkSession, folder: str) -> DataFrame:
    known = views.target_panel(spark, folder).where(F.col("target_up_h21").isNotNull())
    return walkforward.walkforward_blocks(known, KEYS, "ds", views.BLOCK_START)


@registered(f"""
  SELECT series_id, horizon, feature_set, model, train_window_years, weight_strategy, block_id, test_start, test_end, threshold,
    n_test, tn, fp, fn, tp, {sql_rounded(*RATES)}, NULL::DOUBLE AS cal_bacc, 1 AS n_features, 0 AS n_global_features FROM rule_results""")
def rule_baselines(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rule_results(spark, folder), 6, *RATES)


@registered(f"""
  SELECT horizon, feature_set, model, train_window_years, weight_strategy, {sql_rounded(*SUMMARY_RATES)}, 1.0::DOUBLE AS mean_n_features,
    0.0::DOUBLE AS mean_n_global_features, total_tp, total_tn, total_fp, total_fn, n_blocks, n_test_total FROM summary""")
def classification_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(leaderboard.classification_summary(rule_results(spark, folder)), 6, *SUMMARY_RATES)


@registered("""
  SELECT model, round(mean_balanced_accuracy, 6) AS mean_balanced_accuracy, round(mean_roc_auc, 6) AS mean_roc_auc,
    row_number() OVER (ORDER BY s.mean_balanced_accuracy DESC, s.mean_roc_auc DESC, model)::INT AS rank FROM summary s""")
def config_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    ranked = leaderboard.leaderboard(leaderboard.classification_summary(rule_results(spark, folder)))
    return rounded(ranked.select("model", "mean_balanced_accuracy", "mean_roc_auc", "rank"), 6, "mean_balanced_accuracy", "mean_roc_auc")


@registered("""
  SELECT feature_set, model, round(mean_balanced_accuracy, 6) AS mean_balanced_accuracy FROM set_summary s
  QUALIFY row_number() OVER (PARTITION BY feature_set ORDER BY s.mean_balanced_accuracy DESC, s.mean_roc_auc DESC, model) = 1""")
def best_per_group(spark: SparkSession, folder: str) -> DataFrame:
    summary = leaderboard.classification_summary(results_by_set(spark, folder))
    best = leaderboard.best_per_group(summary, ["feature_set"])
    return rounded(best.select("feature_set", "model", "mean_balanced_accuracy"), 6, "mean_balanced_accuracy")


@registered("""
  WITH best AS (SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY mean_balanced_accuracy DESC, mean_roc_auc DESC, model) AS rn,
    max(mean_balanced_accuracy) OVER () AS top FROM set_summary)
  SELECT horizon, feature_set AS audit_case, model AS best_model, train_window_years, round(mean_accuracy, 6) AS mean_accuracy,
    round(mean_balanced_accuracy, 6) AS mean_balanced_accuracy, round(mean_roc_auc, 6) AS mean_roc_auc,
    round(mean_balanced_accuracy - top, 6) AS delta_bacc_vs_best,
    CASE WHEN feature_set = 'colombia_plus_global_compact' THEN 'referencia' WHEN best.mean_balanced_accuracy >= top - 0.03 THEN 'verde_se_sostiene'
      WHEN best.mean_balanced_accuracy >= top - 0.10 THEN 'amarillo_baja_moderada' ELSE 'rojo_dependencia_alta' END AS status,
    CASE feature_set WHEN 'colombia_only' THEN 'Base local sin contexto global.' WHEN 'colombia_plus_global_compact' THEN 'Modelo global compacto original.'
      WHEN 'global_no_gold_direct' THEN 'Excluye GLD, IAU y GC=F.' WHEN 'global_no_metals' THEN 'Excluye oro, plata y metales cercanos.'
      WHEN 'global_macro_only' THEN 'Conserva solo macro global: dólar, VIX, tasas, equity, petróleo.' ELSE '' END AS interpretacion
  FROM best WHERE rn = 1""")
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    audit = leaderboard.audit_summary(leaderboard.classification_summary(results_by_set(spark, folder)))
    return rounded(audit, 6, "mean_accuracy", "mean_balanced_accuracy", "mean_roc_auc", "delta_bacc_vs_best")


@registered("""
  SELECT series_id, ds, px, round(real_return_h21, 6) AS real_return_h21, y_true, proba_up, block_id, model FROM rule_log
  WHERE model = (SELECT model FROM summary ORDER BY mean_balanced_accuracy DESC, mean_roc_auc DESC, model LIMIT 1)""")
def best_predictions(spark: SparkSession, folder: str) -> DataFrame:
    log = materialize(rule_log(spark, folder))
    best = leaderboard.best_config(leaderboard.classification_summary(rules.rule_baselines(log, KEYS)))
    rows = leaderboard.of_configs(log, best)
    kept = rows.select("series_id", "ds", "px", "real_return_h21", "y_true", "proba_up", "block_id", "model")
    return rounded(kept, 6, "real_return_h21")


@registered("""
  SELECT series_id, ds, model, proba_up FROM rule_log
  WHERE model IN (SELECT model FROM summary ORDER BY mean_balanced_accuracy DESC, mean_roc_auc DESC, model LIMIT 3)
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY ds DESC, series_id) <= 240""")
def top_config_sample(spark: SparkSession, folder: str) -> DataFrame:
    log = materialize(rule_log(spark, folder))
    summary = leaderboard.classification_summary(rules.rule_baselines(log, KEYS))
    sample = leaderboard.top_config_sample(log, summary, "ds", configs=3, rows=240, tiebreak=["series_id"])
    return sample.select("series_id", "ds", "model", "proba_up")


@registered("""
  SELECT series_id, model, block_id, n_test, round(accuracy, 6) AS accuracy, NULL::DOUBLE AS total FROM rule_results
  UNION ALL SELECT series_id, NULL, NULL, count(*), NULL, round(sum(px::DECIMAL(18,4))::DOUBLE, 4) FROM price GROUP BY 1""")
def union_results(spark: SparkSession, folder: str) -> DataFrame:
    results = rounded(rule_results(spark, folder), 6, "accuracy").select("series_id", "model", "block_id", "n_test", "accuracy")
    sizes = views.price_panel(spark, folder).groupBy("series_id").agg(
        F.count("*").alias("n_test"), F.round(F.sum(F.col("px").cast("decimal(18,4)")).cast("double"), 4).alias("total")
    )
    return panel.union_rows(results, sizes)


@registered("""
  SELECT series_id, unnest(['real_no_sube', 'real_sube']) AS real,
    unnest([count(*) FILTER (y_true = 0 AND pred_up_calibrated = 0), count(*) FILTER (y_true = 1 AND pred_up_calibrated = 0)]) AS pred_no_sube,
    unnest([count(*) FILTER (y_true = 0 AND pred_up_calibrated = 1), count(*) FILTER (y_true = 1 AND pred_up_calibrated = 1)]) AS pred_sube
  FROM preds GROUP BY 1""")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(views.prediction_log(spark, folder), KEYS, "y_true", "pred_up_calibrated")


_AUC = """(SELECT {by}, CASE WHEN max(y_true) > min(y_true) THEN
    (sum(CASE WHEN y_true = 1 THEN r END) - sum(y_true)::DOUBLE * (sum(y_true) + 1) / 2) / (sum(y_true)::DOUBLE * sum(1 - y_true)) END AS roc_auc
  FROM (SELECT {by}, y_true, rank() OVER (PARTITION BY {by} ORDER BY proba_up)
      + (count(*) OVER (PARTITION BY {by}, proba_up) - 1) / 2.0 AS r FROM {rows}) GROUP BY ALL)"""


@registered(f"""
  WITH cells AS (SELECT series_id, count(*) AS n_test, count(*) FILTER (y_true = 0 AND pred_up_calibrated = 0) AS tn,
      count(*) FILTER (y_true = 0 AND pred_up_calibrated = 1) AS fp, count(*) FILTER (y_true = 1 AND pred_up_calibrated = 0) AS fn,
      count(*) FILTER (y_true = 1 AND pred_up_calibrated = 1) AS tp FROM preds GROUP BY 1)
  SELECT m.series_id, n_test AS n, tn, fp, fn, tp, {sql_rounded(*RATES)}, round((tp + fn)::DOUBLE / n_test, 6) AS positive_share
  FROM ({metrics_of("cells")}) m JOIN {_AUC.format(by="series_id", rows="preds")} a ON a.series_id = m.series_id""")
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    log = views.prediction_log(spark, folder)
    scored = metrics.evaluate(log, KEYS, "y_true", "proba_up", "pred_up_calibrated", bounded=True)
    return rounded(scored, 6, *RATES, "positive_share")


@registered(f"""SELECT toxic, round(roc_auc, 6) AS roc_auc FROM {_AUC.format(by="toxic", rows="(SELECT * FROM scored JOIN labels USING (doc_id))")}""")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups that share all documents: scores are ranked slice by slice."""
    flags = views.table(spark, folder, "labels").select("doc_id", "toxic")
    rows = views.scored_labels(spark, folder).join(flags, "doc_id").withColumn("pred", (F.col("proba_up") >= 0.5).cast("int"))
    scored = metrics.evaluate(rows, ["toxic"], "y_true", "proba_up", "pred", rows_per_slice=SMALL_SLICES)
    return rounded(scored.select("toxic", "roc_auc"), 6, "roc_auc")


_GRID = """
  WITH bounds AS (SELECT lang, count(*) AS n, CASE WHEN count(*) < 10 THEN 0.15 ELSE greatest(0.05, least(0.30, quantile_cont(proba_up, 0.01))) END AS low,
    CASE WHEN count(*) < 10 THEN 0.85 ELSE least(0.95, greatest(0.70, quantile_cont(proba_up, 0.99))) END AS high,
    CASE WHEN count(*) < 10 THEN 70 ELSE 100 END AS steps FROM lang_scores GROUP BY 1),
  grid AS (SELECT lang, i::INT AS step_no, low + i * ((high - low) / steps) AS threshold FROM bounds, range(0, 101) t(i) WHERE i <= steps)"""
_LANG_SCORES = " lang_scores AS (SELECT lang, y_true, proba_up FROM scored JOIN documents USING (doc_id)),"


def lang_scores(spark: SparkSession, folder: str) -> DataFrame:
    langs = views.table(spark, folder, "documents").select("doc_id", "lang")
    return materialize(views.scored_labels(spark, folder).join(langs, "doc_id").select("lang", "y_true", "proba_up"))


@registered(_GRID.replace("WITH", "WITH" + _LANG_SCORES, 1) + " SELECT lang, step_no, round(threshold, 10) AS threshold FROM grid")
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Scores have six digits, their interpolated quantiles eight and the steps between them ten, so ten digits leave nothing to round."""
    return rounded(calibration.threshold_grid(lang_scores(spark, folder), ["lang"], "proba_up", SMALL_SLICES), 10, "threshold")


@registered(_GRID.replace("WITH", "WITH" + _LANG_SCORES, 1) + """,
  hits AS (SELECT g.lang, step_no, threshold, count(*) FILTER (y_true = 1 AND proba_up >= threshold) AS tp, count(*) FILTER (y_true = 1) AS p,
    count(*) FILTER (y_true = 0 AND proba_up < threshold) AS tn, count(*) FILTER (y_true = 0) AS n
    FROM grid g JOIN lang_scores s ON g.lang = s.lang GROUP BY 1, 2, 3),
  judged AS (SELECT *, CASE WHEN p = 0 THEN tn::DOUBLE / n WHEN n = 0 THEN tp::DOUBLE / p ELSE (tp::DOUBLE / p + tn::DOUBLE / n) / 2 END AS b FROM hits)
  SELECT lang, round(threshold, 10) AS threshold, round(b, 6) AS cal_bacc FROM judged
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY b DESC, step_no) = 1""")
def threshold_search(spark: SparkSession, folder: str) -> DataFrame:
    found = calibration.threshold_search(lang_scores(spark, folder), ["lang"], "proba_up", "y_true", SMALL_SLICES)
    return rounded(rounded(found, 10, "threshold"), 6, "cal_bacc")


_FREQ = "1 / greatest(count(*) OVER (PARTITION BY series_id, coalesce({c}::VARCHAR, 'nan'))::DOUBLE / count(*) OVER s, 1e-6)"


@registered(f"""
  WITH b AS (SELECT series_id, ds, y_true, avg(y_true) OVER s AS p, {_FREQ.format(c="cluster_abs")} AS f1, {_FREQ.format(c="cluster_chg")} AS f2,
      {_FREQ.format(c="policy_stance")} AS f3, {_FREQ.format(c="lag1_cls")} AS f4, max(ds) OVER s - ds AS age
    FROM preds WINDOW s AS (PARTITION BY series_id)),
  c AS (SELECT *, CASE WHEN y_true = 1 THEN 0.5 / greatest(p, 1e-6) ELSE 0.5 / greatest(1 - p, 1e-6) END AS wc, f1 / avg(f1) OVER s AS r1,
      (f1 / avg(f1) OVER s + f2 / avg(f2) OVER s + f3 / avg(f3) OVER s + f4 / avg(f4) OVER s) / 4 AS rm FROM b WINDOW s AS (PARTITION BY series_id)),
  w AS (SELECT series_id, ds, unnest(['none', 'balanced', 'cluster_x4', 'macrofull_x15', 'recency_4y']) AS strategy,
      unnest([1.0, wc, least(greatest(r1, 0.35), 4.0), least(greatest(rm, 0.35), 15.0) * wc,
        least(greatest(exp(-ln(2) * age / (365.25 * 4)), 0.2), 1.0)]) AS v FROM c)
  SELECT series_id, ds, strategy, round(v / avg(v) OVER (PARTITION BY series_id, strategy), 6) AS weight FROM w""")
def sample_weights(spark: SparkSession, folder: str) -> DataFrame:
    log = materialize(views.prediction_log(spark, folder))
    parts = [
        calibration.sample_weights(log, KEYS, "y_true", s).select("series_id", "ds", F.lit(s).alias("strategy"), "weight")
        for s in calibration.STRATEGIES
    ]
    return rounded(panel.union_rows(*parts), 6, "weight")


def _split_sql(first_day: str) -> str:
    return f"""
  WITH t AS (SELECT series_id, ds, ds - DATE '1970-01-01' AS day_no FROM target WHERE target_up_h21 IS NOT NULL),
  e AS (SELECT *, {first_day} AS first_day, (test_start - INTERVAL 1 YEAR)::DATE - DATE '1970-01-01' AS year_before FROM blocks),
  q AS (SELECT e.series_id, e.block_id, e.test_start, e.test_end, e.first_day, e.year_before,
      count(*) FILTER (t.ds < e.test_start AND t.ds >= e.first_day) AS n_train,
      count(*) FILTER (t.ds >= e.test_start AND t.ds < e.test_end) AS n_test,
      quantile_cont(t.day_no, 0.8) FILTER (t.ds < e.test_start AND t.ds >= e.first_day) AS q80
    FROM e JOIN t ON t.series_id = e.series_id GROUP BY ALL),
  n AS (SELECT *, greatest(q80, year_before) AS cal_day FROM q WHERE n_train >= 400 AND n_test >= 20),
  f AS (SELECT n.series_id, n.block_id, n.test_start, n.test_end, n.n_train, n.n_test, n.cal_day,
      count(*) FILTER (t.ds < n.test_start AND t.ds >= n.first_day AND t.day_no < n.cal_day) AS fit
    FROM n JOIN t ON t.series_id = n.series_id GROUP BY ALL)
  SELECT series_id, block_id, test_start, test_end, n_train, n_test, round(cal_day, 4) AS cal_start_day,
    (fit < 300 OR n_train - fit < 50) AS by_position,
    CASE WHEN fit < 300 OR n_train - fit < 50 THEN floor(n_train * 0.8)::BIGINT ELSE fit END AS n_fit,
    n_train - CASE WHEN fit < 300 OR n_train - fit < 50 THEN floor(n_train * 0.8)::BIGINT ELSE fit END AS n_cal FROM f"""


def _split(spark: SparkSession, folder: str, years: int | None) -> DataFrame:
    known = views.target_panel(spark, folder).where(F.col("target_up_h21").isNotNull())
    plan = walkforward.split_plan(known, KEYS, "ds", views.BLOCK_START, years=years, min_train=400, min_fit=300)
    return rounded(plan, 4, "cal_start_day")


def pooled_split_sql(min_fit: int, years: int | None = 2) -> str:
    """Blocks of all series together, each trained on the years before it; without ``years`` on all days."""
    first_day = "DATE '1900-01-01'" if years is None else f"(DATE '{views.BLOCK_START}' + INTERVAL (6 * i - {12 * years}) MONTH)::DATE"
    return f"""
  WITH t AS (SELECT ds, ds - DATE '1970-01-01' AS day_no FROM target WHERE target_up_h21 IS NOT NULL),
  b AS (SELECT i::INT AS block_id, (DATE '{views.BLOCK_START}' + INTERVAL (6 * i) MONTH)::DATE AS test_start,
      least(DATE '{views.BLOCK_START}' + INTERVAL (6 * i + 6) MONTH, l)::DATE AS test_end, {first_day} AS train_from
    FROM (SELECT max(ds) AS l FROM t), range(0, 400) r(i) WHERE DATE '{views.BLOCK_START}' + INTERVAL (6 * i) MONTH < l),
  q AS (SELECT b.*, count(*) FILTER (ds < test_start AND ds >= train_from) AS n_train, count(*) FILTER (ds >= test_start AND ds < test_end) AS n_test,
      quantile_cont(day_no, 0.8) FILTER (ds < test_start AND ds >= train_from) AS q80, list(day_no ORDER BY day_no) FILTER (ds < test_start AND ds >= train_from) AS days FROM b, t GROUP BY ALL),
  c AS (SELECT *, greatest(q80, (test_start - INTERVAL 1 YEAR)::DATE - DATE '1970-01-01') AS cut FROM q WHERE n_train >= 800 AND n_test >= 20),
  f AS (SELECT *, len(list_filter(days, lambda d: d < cut)) AS fit FROM c),
  g AS (SELECT *, CASE WHEN fit < {min_fit} OR n_train - fit < 50 THEN days[floor(n_train * 0.8)::BIGINT + 1] ELSE cut END AS cal FROM f)
  SELECT block_id, test_start, test_end, train_from, n_train, n_test, len(list_filter(days, lambda d: d < cal))::BIGINT AS n_fit, round(cal, 4) AS cal_start_day FROM g"""


@registered(pooled_split_sql(600))
def pooled_split(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all series together, trained on two years before each: the splits that the model runner takes."""
    known = views.target_panel(spark, folder).where(F.col("target_up_h21").isNotNull())
    plan = models.pooled_plan(known, "ds", views.BLOCK_START, 6, 2, min_train=800, min_fit=600, min_cal=50)
    return rounded(plan, 4, "cal_start_day")


@registered(_split_sql("DATE '1900-01-01'"))
def walkforward_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, None)


@registered(_split_sql("(test_start - INTERVAL 2 YEAR)::DATE"))
def walkforward_split_window(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder, 2)


@registered("""
  WITH f AS (SELECT series_id, target_up_h21 AS y, unnest(['fx', 'oil', 'px', 'lag21', 'gap']) AS feature, unnest([0, 1, 2, 3, 4]) AS pos,
      unnest([fx, oil, px, lag(px, 21) OVER (PARTITION BY series_id ORDER BY ds), CASE WHEN day(ds) > 9 THEN fx - oil END]) AS value FROM target),
  k AS (SELECT * FROM f WHERE y IS NOT NULL),
  s AS (SELECT k.series_id, k.feature, k.pos, abs(corr(coalesce(k.value, m.m), k.y::DOUBLE)) AS score FROM k
    JOIN (SELECT series_id, feature, median(value) AS m FROM k GROUP BY 1, 2) m ON m.series_id = k.series_id AND m.feature = k.feature GROUP BY 1, 2, 3)
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY s.score DESC, pos)::INT AS rank, feature, round(score, 6) AS score FROM s
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s.score DESC, pos) <= 3""")
def feature_rank(spark: SparkSession, folder: str) -> DataFrame:
    wide = views.target_panel(spark, folder).withColumns(
        {
            "lag21": F.lag("px", 21).over(Window.partitionBy("series_id").orderBy("ds")),
            "gap": F.when(F.dayofmonth("ds") > 9, F.col("fx") - F.col("oil")),
        }
    )
    names = ["fx", "oil", "px", "lag21", "gap"]
    cells = [F.struct(F.lit(n).alias("feature"), F.lit(i).alias("pos"), F.col(n).alias("value")) for i, n in enumerate(names)]
    known = materialize(wide.where(F.col("target_up_h21").isNotNull()))
    long = known.select("series_id", F.col("target_up_h21").alias("y"), F.inline(F.array(*cells)))
    return rounded(walkforward.rank_features(long, KEYS, "y", top=3, rows_per_slice=SMALL_SLICES * 10), 6, "score")


_REG = "FROM (SELECT series_id, year, real_return AS y, coalesce(pred_return_direct, (proba_up - 0.5) * 0.1) AS p FROM preds)"
_REG_SQL = f"""
  SELECT series_id, year, sqrt(avg((y - p) * (y - p))) AS rmse_return, avg(abs(y - p)) AS mae_return, corr(y, p) AS corr_return,
    list_avg([avg((p > 0)::INT) FILTER (y > 0), avg((p <= 0)::INT) FILTER (y <= 0)]) AS direction_bacc_from_return,
    avg(((y > 0) = (p > 0))::INT) AS direction_acc_from_return, count(*) AS n_test {_REG} GROUP BY 1, 2"""
REG_RATES = ["rmse_return", "mae_return", "corr_return", "direction_bacc_from_return", "direction_acc_from_return"]


def regression_results(spark: SparkSession, folder: str) -> DataFrame:
    direct = F.coalesce("pred_return_direct", (F.col("proba_up") - 0.5) * 0.1)
    log = views.prediction_log(spark, folder).withColumn("p", direct)
    return metrics.regression_metrics(log, ["series_id", "year"], "real_return", "p")


@registered(f"SELECT series_id, year, {sql_rounded(*REG_RATES)}, n_test FROM ({_REG_SQL})")
def magnitude_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(regression_results(spark, folder), 6, *REG_RATES)


@registered(f"""SELECT series_id, {", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in REG_RATES)}, count(DISTINCT year) AS n_blocks,
  sum(n_test)::BIGINT AS n_test_total FROM ({_REG_SQL}) GROUP BY 1""")
def magnitude_summary(spark: SparkSession, folder: str) -> DataFrame:
    results = regression_results(spark, folder).withColumnRenamed("year", "block_id")
    return rounded(metrics.magnitude_summary(results, KEYS), 6, *[f"mean_{c}" for c in REG_RATES])


SEGMENTS = ["cluster_abs", "cluster_chg", "policy_stance", "lag1_cls", "year"]
SEGMENT_RATES = ["positive_share", "accuracy", "balanced_accuracy", "recall_up", "recall_not_up", "roc_auc"]


def _segment_sql(tall: str, both: bool) -> str:
    return f"""
  WITH tall AS ({tall}),
  cells AS (SELECT segment_col, segment, count(*) AS n_test, count(*) FILTER (y_true = 0 AND pred_up_calibrated = 0) AS tn,
      count(*) FILTER (y_true = 0 AND pred_up_calibrated = 1) AS fp, count(*) FILTER (y_true = 1 AND pred_up_calibrated = 0) AS fn,
      count(*) FILTER (y_true = 1 AND pred_up_calibrated = 1) AS tp FROM tall GROUP BY 1, 2 HAVING count(*) >= 20)
  SELECT m.segment_col, m.segment, n_test AS n, round((tp + fn)::DOUBLE / n_test, 6) AS positive_share, round(accuracy, 6) AS accuracy,
    CASE WHEN roc_auc IS NOT NULL THEN round(balanced_accuracy, 6) END AS balanced_accuracy, round(recall_up, 6) AS recall_up,
    round(recall_not_up, 6) AS recall_not_up, round(roc_auc, 6) AS roc_auc
  FROM ({metrics_of("cells")}) m JOIN {_AUC.format(by="segment_col, segment", rows="tall")} a
    ON a.segment_col = m.segment_col AND a.segment = m.segment {"WHERE roc_auc IS NOT NULL" if both else ""}"""


@registered(_segment_sql(f"""
    SELECT y_true, proba_up, pred_up_calibrated, unnest({SEGMENTS!r}) AS segment_col,
      coalesce(unnest([cluster_abs::VARCHAR, cluster_chg::VARCHAR, policy_stance, lag1_cls, year::VARCHAR]), 'nan') AS segment FROM preds""", False))
def segment_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Segments over all series: any of them may hold most rows, so scores are ranked by slices."""
    log = materialize(views.prediction_log(spark, folder))
    return rounded(summaries.segment_metrics(log, [], SEGMENTS, rows_per_slice=SMALL_SLICES * 10), 6, *SEGMENT_RATES)


@registered(_segment_sql("""
    SELECT y_true, proba_up, pred_up_calibrated, 'periodo' AS segment_col, periodo AS segment FROM preds""", True))
def period_performance(spark: SparkSession, folder: str) -> DataFrame:
    log = materialize(views.prediction_log(spark, folder))
    return rounded(summaries.segment_metrics(log, [], ["periodo"], two_classes=True), 6, *SEGMENT_RATES)
