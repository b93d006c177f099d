"""Edge cases of the operators on literal frames."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns, markers, names
from tidemark.functions.columns import one_hot
from tidemark.operators import backtest, calibration, features, metrics, models, panel, quality, regimes, summaries, walkforward
from tidemark.operators.ordered import Running, cut_points, running

DAY = datetime.date(2020, 1, 1)


def days(n, start=DAY):
    return [start + datetime.timedelta(days=i) for i in range(n)]


def series(spark, values, key="s"):
    rows = [(key, d, None if v is None else float(v)) for d, v in zip(days(len(values)), values)]
    return spark.createDataFrame(rows, "series_id string, ds date, value double")


def by_day(df, column):
    return [r[column] for r in df.orderBy("ds").collect()]


def test_sanitize(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (5e12,), (-5e12,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(columns.sanitize(F.col("x"))).collect()] == [None, None, None, 1e12, -1e12, 1.5, None]
    clean = quality.sanitize_frame(df).collect()
    assert [r[0] for r in clean] == [None, None, None, 1e12, -1e12, 1.5, None]


def test_coercion(spark):
    df = spark.createDataFrame([("2020-02-30", "1"), ("2020-02-29", "1e400"), ("x", "2"), ("2020-03-01", "abc")], "d string, v string")
    rows = panel.coerce(df, "d", ["v"]).orderBy("d").collect()
    assert [(str(r["d"]), r["v"]) for r in rows] == [("2020-02-29", None), ("2020-03-01", None)]


def test_headers():
    assert names.normalize_header(" Precio/Oro (%) ") == "precio_oro_pct"
    assert names.normalize_header("Inflación  sin-Alimentos.") == "inflacion_sin_alimentos"
    assert names.canonical_name("tasa_tipm") == "tipm"
    assert names.source_prefix("^VIX") == "vix" and names.source_prefix("DX-Y.NYB") == "dx_y_nyb"
    assert names.date_header(["a", "fecha_dia", "b"]) == "fecha_dia" and names.date_header(["a", "b"]) == "a"


def test_markers(spark):
    df = spark.createDataFrame([("gc_f_close_lag1",), ("precio_brent_roll_mean21",), ("vix_close_pct_21",), ("dtf",), ("tipm_change_30",)], "f string")
    rows = df.select(markers.feature_group(F.col("f")), markers.transform_tag(F.col("f")), markers.is_context(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [
        ("oro_internacional", "lag", True), ("energia", "rolling_mean", False), ("riesgo", "pct_change", True),
        ("colombia", "raw", False), ("colombia", "difference", False),
    ]


def test_feature_nulls_and_zero_denominators(spark):
    long = series(spark, [1, 0, None, 2, 3, 4, 5, 6] + [7] * 30).withColumn("variable", F.lit("v"))
    made = features.series_features(long, ["series_id"], "ds")
    assert by_day(made, "roll_mean21")[:6] == [None, None, None, None, None, pytest.approx(2.0)]
    assert by_day(made, "dist_min21")[6] is None  # the minimum is zero
    assert by_day(made, "diff_1")[1:4] == [-1.0, None, None]
    assert by_day(made, "pct_21")[22] is None  # the value 21 rows ago is zero
    assert set(by_day(made, "log")) == {None}  # 36 of 37 known values are positive: below 98 %


def test_log_gate_at_98_percent(spark):
    enough = series(spark, [-1.0] + [2.0] * 99).withColumn("variable", F.lit("v"))
    logs = by_day(features.series_features(enough, ["series_id"], "ds"), "log")
    assert logs[0] is None and logs[1] == pytest.approx(math.log(2))
    short = series(spark, [-1.0] + [2.0] * 49).withColumn("variable", F.lit("v"))
    assert set(by_day(features.series_features(short, ["series_id"], "ds"), "log")) == {None}


def test_target_zero_is_not_up(spark):
    made = features.targets(series(spark, [1, 1, 2, 1]), ["series_id"], "ds", "value", (1,))
    assert by_day(made, "target_up_h1") == [0, 1, 0, None]


def test_no_look_ahead(spark):
    past = features.series_features(series(spark, range(1, 80)).withColumn("variable", F.lit("v")), ["series_id"], "ds")
    more = features.series_features(series(spark, range(1, 120)).withColumn("variable", F.lit("v")), ["series_id"], "ds")
    assert by_day(past, "roll_std63") == by_day(more, "roll_std63")[:79]
    assert by_day(past, "lag21") == by_day(more, "lag21")[:79]


def test_copies_of_a_series_do_not_mix(spark):
    one = series(spark, [1, 2, None, 4, 5], "a")
    both = one.unionByName(one.withColumn("series_id", F.lit("b")))
    filled = panel.fill_forward(both, ["series_id"], "ds", ["value"])
    for key in "ab":
        assert by_day(filled.where(F.col("series_id") == key), "value") == [1, 2, 2, 4, 5]


def scored(spark, rows):
    return spark.createDataFrame([("g", int(y), float(p)) for y, p in rows], "g string, y int, p double").withColumn(
        "pred", (F.col("p") >= 0.5).cast("int")
    )


def brute_auc(rows):
    up = [p for y, p in rows if y]
    down = [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


def test_auc_with_ties_and_slices(spark):
    rows = [((i * 7) % 3 == 0, ((i * 13) % 10) / 10) for i in range(200)]
    for per_slice in (10, 10_000):
        row = metrics.evaluate(scored(spark, rows), ["g"], "y", "p", "pred", rows_per_slice=per_slice).first()
        assert row["roc_auc"] == pytest.approx(brute_auc(rows))


def test_one_class_has_no_auc_and_no_mcc(spark):
    row = metrics.evaluate(scored(spark, [(1, 0.2), (1, 0.9)]), ["g"], "y", "p", "pred").first()
    assert row["roc_auc"] is None and row["mcc"] is None
    assert row["balanced_accuracy"] == 0.5 and row["recall_not_up"] == 0.0


def brute_threshold(rows):
    ps = sorted(p for _, p in rows)

    def quantile(q):
        at = q * (len(ps) - 1)
        low = int(at)
        return ps[low] + (at - low) * (ps[min(low + 1, len(ps) - 1)] - ps[low])

    low, high, steps = (0.15, 0.85, 70) if len(ps) < 10 else (
        max(0.05, min(0.30, quantile(0.01))), min(0.95, max(0.70, quantile(0.99))), 100)
    best = (-1.0, 0.5)
    for i in range(steps + 1):
        t = low + i * ((high - low) / steps)
        up = [p >= t for y, p in rows if y]
        down = [p < t for y, p in rows if not y]
        recalls = [sum(x) / len(x) for x in (up, down) if x]
        score = sum(recalls) / len(recalls)
        if score > best[0]:
            best = (score, t)
    return best


@pytest.mark.parametrize("n", [6, 40, 300])
def test_threshold_search_takes_the_lowest_of_equals(spark, n):
    rows = [((i * 5) % 4 < 2, ((i * 37) % 101) / 101) for i in range(n)]
    row = calibration.threshold_search(scored(spark, rows), ["g"], "p", "y", rows_per_slice=50).first()
    score, threshold = brute_threshold(rows)
    assert row["cal_bacc"] == pytest.approx(score) and row["threshold"] == pytest.approx(threshold)


@pytest.mark.parametrize("strategy", calibration.STRATEGIES)
def test_weights_have_mean_one(spark, strategy):
    rows = [(i % 3 == 0, d, i % 4, None if i % 5 == 0 else i % 2, "x" if i < 50 else "y") for i, d in enumerate(days(60))]
    df = spark.createDataFrame([(int(y), d, a, b, c) for y, d, a, b, c in rows], "y int, ds date, cluster_abs int, cluster_chg int, policy_stance string")
    weighted = calibration.sample_weights(df, [], "y", strategy)
    assert weighted.count() == 60
    assert weighted.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_blocks_end_on_the_last_day(spark):
    df = spark.createDataFrame([("s", d) for d in days(400)], "k string, ds date")
    blocks = walkforward.walkforward_blocks(df, ["k"], "ds", "2020-03-01").orderBy("block_id").collect()
    assert [(str(b["test_start"]), str(b["test_end"])) for b in blocks] == [
        ("2020-03-01", "2020-09-01"), ("2020-09-01", "2021-02-03"),
    ]
    rows = walkforward.assign_blocks(df, ["k"], "ds", "2020-03-01")
    assert rows.agg(F.max("ds")).first()[0] == datetime.date(2021, 2, 2)
    assert rows.where((F.col("ds") < F.col("test_start")) | (F.col("ds") >= F.col("test_end"))).count() == 0


def test_whole_months_at_month_ends(spark):
    pairs = [("2020-02-28", "2020-01-31", 0), ("2020-02-29", "2020-01-31", 1), ("2019-12-31", "2020-01-31", -1), ("2021-01-30", "2020-01-31", 11)]
    df = spark.createDataFrame([(datetime.date.fromisoformat(a), datetime.date.fromisoformat(b), n) for a, b, n in pairs], "d date, a date, n int")
    assert df.where(walkforward.whole_months(F.col("d"), F.col("a")) != F.col("n")).count() == 0


def test_pooled_splits_leave_test_rows_out(spark):
    df = spark.createDataFrame([(k, d) for k in "abc" for d in days(900)], "k string, ds date")
    splits = models.pooled_splits(df, "ds", "2021-07-01", 6, None)
    assert [s.block_id for s in splits] == [0, 1]
    for s in splits:
        assert s.cal_start_day < (s.test_start - datetime.date(1970, 1, 1)).days
        assert s.test_start < s.test_end


def log(spark, prices, scores, predicted=None):
    rows = [
        ("s", d, float(p), float(s), 0.5, int(s >= 0.5), None if predicted is None else predicted[i])
        for i, (d, p, s) in enumerate(zip(days(len(prices)), prices, scores))
    ]
    return spark.createDataFrame(
        rows, "k string, ds date, px double, proba_up double, threshold double, pred_up_calibrated int, pred_return_direct double"
    )


def test_backtest_against_a_plain_loop(spark):
    prices = [100 + 10 * math.sin(i / 3) + i / 5 for i in range(70)]
    scores = [0.5 + 0.4 * math.sin(i / 4) for i in range(70)]
    predicted = [None if i % 4 == 0 else math.cos(i) for i in range(70)]
    made = backtest.backtest(log(spark, prices, scores, predicted), ["k"], cost=0.001, slippage=0.0005)
    for name in ("h21_long_cash", "hysteresis_60_35", "predret_long_short", "clf_daily_long_cash"):
        rows = made.where(F.col("strategy") == name).orderBy("ds").collect()
        assert len(rows) == 69
        capital, peak, before, state, held = 1e6, 0.0, 0.0, 0.0, 0.0
        for i, row in enumerate(rows):
            state = 1.0 if scores[i] >= 0.6 else 0.0 if scores[i] <= 0.35 else state
            held = float(scores[i] >= 0.5) if i % 21 == 0 else held
            up = predicted[i] is not None and predicted[i] > 0
            exposure = {"h21_long_cash": held, "hysteresis_60_35": state, "predret_long_short": 1.0 if up else -1.0,
                        "clf_daily_long_cash": float(scores[i] >= 0.5)}[name]
            net = exposure * (prices[i + 1] / prices[i] - 1) - abs(exposure - before) * 0.0015
            capital, before = capital * (1 + net), exposure
            peak = max(peak, capital)
            assert row["exposure"] == exposure
            assert row["capital"] == pytest.approx(capital) and row["drawdown"] == pytest.approx(capital / peak - 1)


def test_total_loss(spark):
    made = backtest.backtest(log(spark, [1.0, 0.0, 5.0], [0.9, 0.9, 0.9]), ["k"]).where(F.col("strategy") == "buy_hold")
    assert by_day(made, "capital") == [0.0, 0.0]


def test_backtest_on_timestamps_is_the_same(spark):
    prices = [100 + 10 * math.sin(i / 3) for i in range(120)]
    scores = [0.5 + 0.4 * math.sin(i / 4) for i in range(120)]
    daily = log(spark, prices, scores)
    timed = daily.withColumn("ds", F.col("ds").cast("timestamp"))
    left = backtest.backtest_summary(backtest.backtest(daily, ["k"]), ["k"]).orderBy("strategy").collect()
    right = backtest.backtest_summary(backtest.backtest(timed, ["k"], rows_per_slice=25), ["k"]).orderBy("strategy").collect()
    for a, b in zip(left, right):
        assert a["capital_final"] == pytest.approx(b["capital_final"]) and a["n_position_changes"] == b["n_position_changes"]


def test_segments_need_twenty_rows(spark):
    rows = [(i % 2, 0.3 + 0.4 * (i % 2), i % 2, "a" if i < 19 else None) for i in range(39)]
    df = spark.createDataFrame(rows, "y_true int, proba_up double, pred_up_calibrated int, seg string")
    found = summaries.segment_metrics(df, [], ["seg"]).collect()
    assert [(r["segment"], r["n"]) for r in found] == [("nan", 20)]


def test_cluster_scores_against_plain_loops(spark):
    pts = [(i, i % 3, math.cos(i) + 4 * (i % 3), math.sin(i * 1.7)) for i in range(60)]
    df = spark.createDataFrame([(i, l, float(x), float(y)) for i, l, x, y in pts], "id int, l int, x double, y double")
    row = regimes.cluster_scores(df, ["x", "y"], "l").first()
    widths = []
    for i, l, x, y in pts:
        means = {m: [(x - a) ** 2 + (y - b) ** 2 for j, k, a, b in pts if k == m and j != i] for m in range(3)}
        means = {m: sum(v) / len(v) for m, v in means.items()}
        other = min(v for m, v in means.items() if m != l)
        widths.append((other - means[l]) / max(other, means[l]))
    assert row["silhouette"] == pytest.approx(sum(widths) / len(widths))
    assert row["n_rows"] == 60 and row["n_clusters"] == 3


def test_cluster_scores_of_many_points_and_dimensions(spark):
    """No sample: 5,000 points of 20 dimensions give what numpy gives for all of them."""
    draw = np.random.RandomState(1)
    points, labels = draw.randn(5000, 20), draw.randint(0, 4, 5000)
    points[:, 7] += labels
    names = [f"d{i}" for i in range(20)]
    df = spark.createDataFrame([(*map(float, p), str(l)) for p, l in zip(points, labels)], ", ".join(f"{n} double" for n in names) + ", l string")
    row = regimes.cluster_scores(df, names, "l").first()
    centres = np.array([points[labels == m].mean(axis=0) for m in range(4)])
    sizes = np.bincount(labels)
    within = ((points - centres[labels]) ** 2).sum()
    between = (sizes * ((centres - points.mean(axis=0)) ** 2).sum(axis=1)).sum()
    radius = np.array([np.sqrt(((points[labels == m] - centres[m]) ** 2).sum(axis=1)).mean() for m in range(4)])
    gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
    worst = [max((radius[a] + radius[b]) / gaps[a, b] for b in range(4) if b != a) for a in range(4)]
    assert row["n_rows"] == 5000 and row["calinski_harabasz"] == pytest.approx(between * 4996 / (within * 3))
    assert row["davies_bouldin"] == pytest.approx(np.mean(worst))


def test_nmi_of_equal_and_constant_labels(spark):
    df = spark.createDataFrame([(i % 4, (i % 4) * 10, 1) for i in range(40)], "a int, b int, c int")
    assert regimes.nmi(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert regimes.nmi(df, "a", "c").first()[0] == pytest.approx(0.0)
    assert regimes.nmi(df, "c", "c").first()[0] == pytest.approx(1.0)


def test_stochastic_moments_are_bias_corrected(spark):
    values = [0.01 * ((i * 7) % 11 - 4) ** 2 for i in range(30)]
    rows = [("s", d, v, v / 2, "x") for d, v in zip(days(30), values)]
    df = spark.createDataFrame(rows, "k string, ds date, r double, r1 double, seg string")
    row = summaries.stochastic_summary(df, ["k"], "ds", "r", "r1", ["seg"]).first()
    n, mean = 30, sum(values) / 30
    m2, m3, m4 = (sum((v - mean) ** p for v in values) / n for p in (2, 3, 4))
    assert row["skew_h21_return"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5)
    assert row["kurtosis_h21_return"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6))


def test_transition_rows_sum_to_one(spark):
    df = spark.createDataFrame([("s", d, i * i % 3) for i, d in enumerate(days(50))], "k string, ds date, c int")
    for row in summaries.transition_matrix(df, ["k"], "ds", "c", ["0", "1", "2"]).collect():
        assert row["0"] + row["1"] + row["2"] == pytest.approx(1.0)


def test_categories_are_never_lost(spark):
    df = spark.createDataFrame([("s", d, i % 4) for i, d in enumerate(days(40))], "k string, ds date, c int")
    rows = {r["from_cluster"]: r.asDict() for r in summaries.transition_matrix(df, ["k"], "ds", "c").collect()}
    assert set(rows) == set("0123") and rows["2"]["3"] == 1.0
    with pytest.raises(Exception, match="without a category"):
        summaries.transition_matrix(df, ["k"], "ds", "c", ["0", "1", "2"]).collect()
    with pytest.raises(Exception, match="without a category"):
        df.select(*one_hot(F.col("c"), ["0", "1"], "c").values()).collect()
    with pytest.raises(Exception, match="without a category"):
        panel.wide_by_source(df.select("ds", F.col("k").alias("source"), "c"), "ds", "source", ["c"], ["t"]).collect()


def test_weights_keep_every_row(spark):
    rows = [(i % 2 if i else None, d if i != 5 else None, i % 3) for i, d in enumerate(days(30))]
    df = spark.createDataFrame(rows, "y int, ds date, cluster_abs int")
    for strategy in calibration.STRATEGIES:
        made = calibration.sample_weights(df, [], "y", strategy).collect()
        assert len(made) == 30
        missing = [r for r in made if r["weight"] is None]
        assert len(missing) == (0 if strategy == "none" else 1)
        known = [r["weight"] for r in made if r["weight"] is not None]
        assert sum(known) / len(known) == pytest.approx(1.0)


def test_final_weights_are_the_runners(spark):
    """The logistic family is balanced on top of its strategy, and its penalty follows the sum of weights."""
    rows = [(float(i % 3 == 0), d, [float(i % 7), float(i % 5)]) for i, d in enumerate(days(60))]
    df = spark.createDataFrame(rows, "y double, ds date, x array<double>")
    for model in ("LogisticRegression", "XGBClassifier"):
        config = models.Config(model, weight_strategy="recency_4y", trees=2)
        w = {r["ds"]: r["w"] for r in models.training_weights(df, config, "ds").collect()}
        plain = {r["ds"]: r["weight"] for r in calibration.sample_weights(df, [], "y", "recency_4y").collect()}
        balanced = {r["ds"]: r["weight"] for r in calibration.sample_weights(df, [], "y", "balanced").collect()}
        assert all(w[d] == pytest.approx(plain[d] * (balanced[d] if model == "LogisticRegression" else 1)) for d in w)
    total = sum(plain[d] * balanced[d] for d in plain)
    fitted = models.train(df, models.Inputs(["a", "b"], [0, 1], [0.0, 0.0]), models.Config("LogisticRegression", weight_strategy="recency_4y"), "ds")
    assert fitted.stages[0].stages[-1].getRegParam() == pytest.approx(1 / (0.5 * total))


def test_small_keys_are_not_sliced(spark):
    df = spark.createDataFrame([(k, float(i)) for k in range(300) for i in range(4)], "k int, v double")
    assert cut_points(df, "v", 100, ["k"]) == [] and cut_points(df, "v", 100)
    assert len(cut_points(df.withColumn("v", F.rand(1)), "v", 1)) > 1000


def test_ties_are_ordered(spark):
    rows = [("k", i // 5, 99 - i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    for per_slice in (10, 1000):
        made = running(df, ["k"], "t", {"last": Running("last", F.col("id")), "n": Running("count", F.lit(1))}, rows_per_slice=per_slice, ties=["id"]).collect()
        order = sorted((t, i) for _, t, i in rows)
        assert {(r["t"], r["id"]): (r["n"], r["last"]) for r in made} == {(t, i): (n + 1, i) for n, (t, i) in enumerate(order)}


def test_dedup_is_ordered(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in panel.dedup(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r["k"], r["v"]) for r in panel.dedup(df, ["k"], ["o"], keep="last").collect()} == {("a", "x"), ("b", None)}


def test_empty_input(spark):
    empty = series(spark, [])
    assert features.targets(empty, ["series_id"], "ds", "value").count() == 0
    assert walkforward.walkforward_blocks(empty, ["series_id"], "ds", "2020-01-01").count() == 0
    long = empty.withColumn("variable", F.lit("v"))
    assert features.series_features(long, ["series_id"], "ds").count() == 0


def test_shuffled_column_stays_whole(spark):
    """Ranking keeps all features in order when there are few."""
    rows = [("g", f, i, float((r * (i + 3)) % 7), r % 2) for i, f in enumerate("abc") for r in range(30)]
    long = spark.createDataFrame(rows, "g string, feature string, pos int, value double, y int")
    kept = walkforward.rank_features(long, ["g"], "y", 3).orderBy("rank").collect()
    assert [r["feature"] for r in kept] == ["a", "b", "c"]
    assert walkforward.rank_features(long, ["g"], "y", 2).count() == 2
