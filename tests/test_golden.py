"""Published figures that can be recomputed from published figures."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import effective_frequency, return_band
from tidemark.operators import backtest, dims, leaderboard, metrics, regimes

# Published summary rows (feature set, model, window, weights, balanced accuracy, accuracy, AUC).
SUMMARY = [
    ("colombia_plus_global_full", "HistGradientBoostingClassifier", "all", "balanced", 0.8734, 0.8877, 0.9478),
    ("colombia_plus_global_full", "XGBClassifier", "15", "none", 0.8559, 0.8812, 0.9423),
    ("global_macro_only", "XGBClassifier", "all", "none", 0.7264, 0.7087, 0.8429),
    ("colombia_plus_global_compact", "XGBClassifier", "all", "none", 0.6866, 0.6245, 0.7384),
    ("colombia_plus_global_compact", "LogisticRegression", "10", "recency_4y", 0.6769, 0.7287, 0.8369),
    ("global_no_gold_direct", "HistGradientBoostingClassifier", "all", "balanced", 0.6653, 0.6794, 0.7505),
    ("colombia_only", "XGBClassifier", "all", "recency_4y", 0.6521, 0.6221, 0.7427),
    ("global_no_metals", "XGBClassifier", "all", "none", 0.6261, 0.5480, 0.7076),
]


def test_audit_summary(spark):
    rows = [(21, *r) for r in SUMMARY]
    df = spark.createDataFrame(
        rows,
        "horizon int, feature_set string, model string, train_window_years string, weight_strategy string, "
        "mean_balanced_accuracy double, mean_accuracy double, mean_roc_auc double",
    )
    found = {r["audit_case"]: r for r in leaderboard.audit_summary(df).collect()}
    assert len(found) == 5
    expected = {
        "colombia_only": (-0.2213, "rojo_dependencia_alta"),
        "colombia_plus_global_compact": (-0.1868, "referencia"),
        "global_no_gold_direct": (-0.2081, "rojo_dependencia_alta"),
        "global_no_metals": (-0.2473, "rojo_dependencia_alta"),
        "global_macro_only": (-0.1470, "rojo_dependencia_alta"),
    }
    for case, (delta, status) in expected.items():
        assert found[case]["delta_bacc_vs_best"] == pytest.approx(delta, abs=2e-4)
        assert found[case]["status"] == status
    assert leaderboard.best_config(df).first()["mean_balanced_accuracy"] == 0.8734


def test_metrics_from_published_confusion(spark):
    cells = spark.createDataFrame([(1009, 145, 60, 612)], "tn bigint, fp bigint, fn bigint, tp bigint")
    row = cells.select(*[c.alias(n) for n, c in metrics.closed_forms().items()]).first()
    assert row["accuracy"] == pytest.approx(1621 / 1826)
    assert row["recall_not_up"] == pytest.approx(1009 / 1154)
    assert row["balanced_accuracy"] == pytest.approx((1009 / 1154 + 612 / 672) / 2)


def test_regime_bands_and_frequency(spark):
    bands = spark.createDataFrame([(0.164,), (0.0934,), (0.0264,), (-0.05,), (-0.0501,)], "r double")
    assert [r[0] for r in bands.select(return_band(F.col("r"))).collect()] == [
        "alcista_fuerte", "alcista_moderado", "lateral", "lateral", "bajista",
    ]
    shares = spark.createDataFrame([(0.0,), (0.361,), (0.85,), (0.96,)], "r double")
    assert [r[0] for r in shares.select(effective_frequency(F.col("r"))).collect()] == [
        "diaria", "diaria con repetidos", "semanal/trimestral→diaria (ff)", "mensual→diaria (ff)",
    ]


def test_structural_score(spark):
    df = spark.createDataFrame([(0.47006902, 0.26242183679569786, 0.06888021891477453)], "silhouette double, a double, b double")
    assert df.select(regimes.structural_score("silhouette", ["a", "b"])).first()[0] == pytest.approx(0.5163203183973891, abs=1e-7)


def test_cagr_of_published_backtest(spark):
    days = [(datetime.date(2022, 8, 7), 1000000.0), (datetime.date(2025, 4, 29), 1847233.020611965)]
    rows = [("s", d, "buy_hold", 1.0, 0.0, 0.0, 0.0, c, 0.0) for d, c in days]
    df = spark.createDataFrame(
        rows, "k string, ds date, strategy string, exposure double, ret1 double, turnover double, net_return double, capital double, drawdown double"
    )
    row = backtest.backtest_summary(df, ["k"]).first()
    assert row["total_return"] == pytest.approx(0.8472330206119651)
    assert row["cagr"] == pytest.approx(0.25238540212602234)


def test_presidential_periods(spark):
    days = ["1998-08-06", "1998-08-07", "2002-08-06", "2002-08-07", "2026-08-06", "2026-08-07"]
    df = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in days], "ds date")
    named = dims.interval_lookup(df, "ds", dims.intervals(spark, dims.PRESIDENTIAL_PERIODS), "periodo")
    assert [r["periodo"] for r in named.orderBy("ds").collect()] == [
        "Fuera_rango", "Pastrana", "Pastrana", "Uribe I", "Petro", "Fuera_rango",
    ]


def test_annual_lag_is_by_row(spark):
    annual = spark.createDataFrame([(2000, 1.0, "a"), (2001, 2.0, "b"), (2004, 5.0, "c")], "year int, score double, cls string")
    lagged = {r["year"]: (r["lag1_score"], r["lag1_cls"]) for r in dims.lag_years(annual, "score", "cls").collect()}
    assert lagged == {2000: (None, "Sin clasificación"), 2001: (1.0, "a"), 2004: (2.0, "b")}
