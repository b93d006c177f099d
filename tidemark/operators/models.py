"""Models: walk-forward runs, magnitude, importance and scoring with MLlib.

A panel for models has one row per key and day with ``x``, the features as an array
in catalog order. An array keeps the plan small for thousands of features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import sanitize
from tidemark.functions.markers import CONTEXT, feature_group, is_context
from tidemark.operators.calibration import sample_weights, threshold_search
from tidemark.operators.metrics import confusion_columns, balanced_accuracy, evaluate, regression_metrics
from tidemark.operators.panel import union_rows
from tidemark.operators.selection import Span, block_inputs
from tidemark.operators.walkforward import FIT_SHARE, MIN_CAL, MIN_FIT, MIN_TEST, MIN_TRAIN
from tidemark.session import materialize

SEED = 42


@dataclass(frozen=True)
class Config:
    """One walk-forward configuration."""

    model: str
    feature_set: str = "colombia_only"
    horizon: int = 21
    train_window_years: int | None = None
    weight_strategy: str = "none"
    max_features: int = 1500
    tag: str = ""
    fast: bool = False
    trees: int | None = None


def estimator(config: Config, label: str = "y", weight: str = "w", total_weight: float | None = None):
    """The MLlib counterpart of a model name, with the published settings.

    ``total_weight`` is the sum of training weights, by which the logistic penalty is set:
    MLlib divides the loss by it.
    """
    # Trees of the full and the fast profile, depth and rate of each family.
    trees = {
        "XGBClassifier": (320, 80),
        "HistGradientBoostingClassifier": (300, 80),
        "RandomForestClassifier": (260, 100),
        "XGBRegressor": (250, 80),
        "RandomForestRegressor": (250, 250),
    }
    many = config.trees or trees.get(config.model, (0, 0))[config.fast]
    shared = {"featuresCol": "v", "labelCol": label, "weightCol": weight}
    if config.model == "XGBClassifier":
        return GBTClassifier(maxIter=many, maxDepth=3, stepSize=0.035, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=3, seed=SEED, **shared)
    if config.model == "HistGradientBoostingClassifier":
        return GBTClassifier(maxIter=many, maxDepth=5, stepSize=0.035, seed=SEED, **shared)
    if config.model == "RandomForestClassifier":
        forest = {"numTrees": many, "maxDepth": 30, "minInstancesPerNode": 4, "featureSubsetStrategy": "sqrt"}
        return RandomForestClassifier(seed=SEED, **forest, **shared)
    if config.model == "LogisticRegression":
        scaled = StandardScaler(inputCol="v", outputCol="vs", withMean=True)
        linear = LogisticRegression(maxIter=2000, regParam=1 / (0.5 * (total_weight or 1.0)), **{**shared, "featuresCol": "vs"})
        return Pipeline(stages=[scaled, linear])
    if config.model == "XGBRegressor":
        return GBTRegressor(maxIter=many, maxDepth=3, stepSize=0.035, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=3, seed=SEED, **shared)
    if config.model == "RandomForestRegressor":
        return RandomForestRegressor(numTrees=many, minInstancesPerNode=4, maxDepth=20, seed=SEED, **shared)
    raise ValueError(f"unknown model: {config.model}")


def feature_arrays(long: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(ids, feature, value)`` to one array per row, ordered like ``features``; NULL where a row lacks one.

    Names become positions by one hash lookup per value; a row's values, with the positions
    it lacks, are then sorted by position.
    """
    places = long.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, pos int")
    placed = long.join(F.broadcast(places), "feature").groupBy(*ids).agg(F.collect_list(F.struct("pos", "value")).alias("m"))
    lacking = F.array_except(F.sequence(F.lit(0), F.lit(len(features) - 1)), F.transform("m", lambda p: p["pos"]))
    gaps = F.transform(lacking, lambda i: F.struct(i.alias("pos"), F.lit(None).cast("double").alias("value")))
    whole = F.array_sort(F.concat(F.col("m"), gaps))
    return placed.select(*ids, F.transform(whole, lambda p: p["value"]).alias("x"))


@dataclass(frozen=True)
class Inputs:
    """Which features a model takes, by position, and what stands in for NULL."""

    names: list[str]
    positions: list[int]
    fill: list[float]

    def vector(self) -> Column:
        picked = F.transform(F.array(*[F.lit(i) for i in self.positions]), lambda i: F.get("x", i))
        filled = F.zip_with(picked, F.array(*[F.lit(f) for f in self.fill]), lambda v, f: F.coalesce(sanitize(v), f))
        return array_to_vector(filled)


def inputs_of_spans(rows: DataFrame, ts: str, label: str, spans: Sequence[Span], features: Sequence[str], top: int) -> dict[int, Inputs]:
    """Inputs and medians of every span, from one pass over the rows; the driver gets one row per span and chosen feature."""
    chosen: dict[int, list] = {s.block_id: [] for s in spans}
    if spans:
        for r in block_inputs(rows, F.unix_date(ts), label, spans, top).orderBy("block_id", "rank").collect():
            chosen[r["block_id"]].append(r)
    return {b: Inputs([features[r["pos"]] for r in made], [r["pos"] for r in made], [r["median"] for r in made]) for b, made in chosen.items()}


@dataclass(frozen=True)
class Split:
    block_id: int
    test_start: date
    test_end: date
    train_from: date | None
    cal_start_day: float


def pooled_plan(
    panel: DataFrame, ts: str, start: str, months: int, years: int | None,
    min_train: int = MIN_TRAIN, min_fit: int = MIN_FIT, min_cal: int = MIN_CAL, embargo_days: int = 0,
) -> DataFrame:
    """Splits of a panel whose keys share one model: block_id, test_start, test_end, train_from, n_train, n_test, n_fit, cal_start_day.

    Rows are counted per day, and running counts of the days tell the quantile of the
    training days by position; tables and windows are bounded by the calendar, however many
    rows a day has. Both calibration rules are cuts on the day, so all rows of a day
    stay on one side. Blocks with too few rows are left out; no rows give no blocks.
    """
    per_day = materialize(panel.groupBy(F.col(ts).alias("d")).agg(F.count("*").alias("n")).where("d IS NOT NULL"))
    last = per_day.agg(F.max("d")).first()[0]
    first, blocks = date.fromisoformat(start), []
    begin = first
    while last is not None and begin < last:
        end = min(_add_months(first, (len(blocks) + 1) * months), last)
        blocks.append((len(blocks), begin, end, _add_months(begin, -12 * years) if years else None, _add_months(begin, -12)))
        begin = end
    known = panel.sparkSession.createDataFrame(blocks, "block_id int, test_start date, test_end date, train_from date, year_before date")
    # days x later blocks
    each = per_day.join(F.broadcast(known), F.col("d") < F.col("test_end"))
    train = (F.col("d") < F.date_sub("test_start", embargo_days)) & (F.col("train_from").isNull() | (F.col("d") >= F.col("train_from")))
    day = F.unix_date("d")
    block = Window.partitionBy("block_id")
    counted = each.withColumns({"train": train, "in_train": F.when(train, F.col("n")).otherwise(0), "in_test": F.when(F.col("d") >= F.col("test_start"), F.col("n")).otherwise(0), "day": day})
    running = counted.withColumns({"edge": F.sum("in_train").over(block.orderBy("d")), "n_train": F.sum("in_train").over(block), "n_test": F.sum("in_test").over(block)})
    kept = running.where((F.col("n_train") >= min_train) & (F.col("n_test") >= MIN_TEST))
    at = lambda place: F.min(F.when(F.col("train") & (F.col("edge") > place), F.col("day"))).over(block)
    place = F.lit(FIT_SHARE) * (F.col("n_train") - 1)
    low, high = at(F.floor(place)), at(F.ceil(place))
    cut = F.greatest(low + (place - F.floor(place)) * (high - low), F.unix_date("year_before").cast("double"))
    cuts = kept.withColumns({"cut": cut, "by_place": at(F.floor(F.lit(FIT_SHARE) * F.col("n_train"))).cast("double")})
    fit_before = lambda c: F.sum(F.when(F.col("day") < F.col(c), F.col("in_train")).otherwise(0)).over(block)
    fitted = cuts.withColumn("fit", fit_before("cut"))
    few = (F.col("fit") < min_fit) | (F.col("n_train") - F.col("fit") < min_cal)
    final = fitted.withColumn("cal_start_day", F.when(few, F.col("by_place")).otherwise(F.col("cut"))).withColumn("n_fit", fit_before("cal_start_day"))
    return final.select("block_id", "test_start", "test_end", "train_from", "n_train", "n_test", "n_fit", "cal_start_day").distinct()


def pooled_splits(
    panel: DataFrame, ts: str, start: str, months: int, years: int | None,
    min_train: int = MIN_TRAIN, min_fit: int = MIN_FIT, min_cal: int = MIN_CAL, embargo_days: int = 0,
) -> list[Split]:
    """The rows of ``pooled_plan`` in order; the driver gets one per block."""
    plan = pooled_plan(panel, ts, start, months, years, min_train, min_fit, min_cal, embargo_days)
    return [Split(r["block_id"], r["test_start"], r["test_end"], r["train_from"], r["cal_start_day"]) for r in plan.orderBy("block_id").collect()]


def _add_months(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    following = date(year + (month == 11), (month + 1) % 12 + 1, 1)
    return date(year, month + 1, min(day.day, date.fromordinal(following.toordinal() - 1).day))


def probability() -> Column:
    return F.get(vector_to_array("probability"), F.lit(1))


def _mark(df: DataFrame, config: Config, split: Split) -> DataFrame:
    years = "all" if config.train_window_years is None else str(config.train_window_years)
    marks = {
        "block_id": split.block_id, "test_start": split.test_start, "test_end": split.test_end,
        "horizon": config.horizon, "feature_set": config.feature_set, "model": config.model,
        "train_window_years": years, "weight_strategy": config.weight_strategy,
    }
    return df.withColumns({name: F.lit(value) for name, value in marks.items()})


def days_of(day: date) -> float:
    return float((day - date(1970, 1, 1)).days)


def span_of(split: Split, embargo_days: int = 0) -> Span:
    """Days of the rows a split fits on: before its calibration and its test."""
    return Span(split.block_id, days_of(split.train_from) if split.train_from else None, min(split.cal_start_day, days_of(split.test_start) - embargo_days))


def _train_rows(panel: DataFrame, ts: str, split: Split, embargo_days: int) -> DataFrame:
    rows = panel.where(F.col(ts) < F.date_sub(F.lit(split.test_start), embargo_days))
    return rows.where(F.col(ts) >= F.lit(split.train_from)) if split.train_from else rows


def _test_rows(panel: DataFrame, ts: str, split: Split) -> DataFrame:
    return panel.where((F.col(ts) >= F.lit(split.test_start)) & (F.col(ts) < F.lit(split.test_end)))


def training_weights(fit: DataFrame, config: Config, ts: str) -> DataFrame:
    """``fit`` (label ``y``) with its training weights ``w``, for blocks and for the final model alike."""
    weighted = sample_weights(fit, [], "y", config.weight_strategy, day=ts, name="w")
    if config.model != "LogisticRegression":
        return weighted
    # This family is always balanced, on top of the strategy.
    balanced = sample_weights(weighted, [], "y", "balanced", name="__b")
    return balanced.withColumn("w", F.col("w") * F.col("__b")).drop("__b")


def train(fit: DataFrame, inputs: Inputs, config: Config, ts: str) -> PipelineModel:
    """A model of ``config`` on ``fit``, which has the label ``y`` and the features ``x``."""
    weighted = training_weights(fit, config, ts).withColumn("v", inputs.vector())
    total = weighted.agg(F.sum("w")).first()[0] if config.model == "LogisticRegression" else None
    return Pipeline(stages=[estimator(config, total_weight=total)]).fit(weighted)


def walkforward(
    panel: DataFrame, features: Sequence[str], config: Config, keys: Sequence[str], ts: str = "ds", price: str = "px",
    start: str = "2020-05-01", months: int = 6, embargo_days: int = 0, parallel: int = 2,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Block results, prediction log and selected features of one configuration.

    ``panel`` has keys, time, price, ``x``, ``target_up_h*`` and ``future_logret_h*``.
    The driver loops over blocks, whose number follows the calendar; every step of a
    block is a distributed job. A few blocks are in flight at once.
    """
    label, real = f"target_up_h{config.horizon}", f"future_logret_h{config.horizon}"
    known = materialize(panel.where(F.col(label).isNotNull() & F.col(real).isNotNull()))
    splits = pooled_splits(known, ts, start, months, config.train_window_years, embargo_days=embargo_days)
    if not splits:
        raise ValueError("no block has enough training and test rows")
    chosen_inputs = inputs_of_spans(known, ts, label, [span_of(s, embargo_days) for s in splits], features, config.max_features)

    def one(split: Split) -> tuple[DataFrame, DataFrame, DataFrame]:
        before = _train_rows(known, ts, split, embargo_days).withColumn("y", F.col(label).cast("double"))
        early = F.unix_date(ts) < split.cal_start_day
        fit, cal, test = before.where(early), before.where(~early), _test_rows(known, ts, split)
        inputs = chosen_inputs[split.block_id]
        model = train(fit, inputs, config, ts)
        scored_cal = model.transform(cal.withColumn("v", inputs.vector())).select("y", probability().alias("p"), F.lit(0).alias("g"))
        found = threshold_search(scored_cal, ["g"], "p", "y").first()
        scored = model.transform(test.withColumn("v", inputs.vector())).select(
            *keys, ts, price, F.col(real).alias(f"real_return_h{config.horizon}"), F.col(label).cast("int").alias("y_true"),
            probability().alias("proba_up"), F.lit(found["threshold"]).alias("threshold"),
        )
        log = scored.withColumn("pred_up_calibrated", (F.col("proba_up") >= F.col("threshold")).cast("int"))
        result = evaluate(log.withColumn("g", F.lit(0)), ["g", "threshold"], "y_true", "proba_up", "pred_up_calibrated")
        n_context = sum(any(m in name.lower() for m in CONTEXT) for name in inputs.names)
        result = result.drop("g", "positive_share").withColumnRenamed("n", "n_test").withColumns(
            {"cal_bacc": F.lit(found["cal_bacc"]), "n_features": F.lit(len(inputs.names)), "n_global_features": F.lit(n_context)}
        )
        chosen = known.sparkSession.createDataFrame(
            [(i + 1, name) for i, name in enumerate(inputs.names)], "rank int, feature string"
        ).withColumn("is_global", is_context(F.col("feature")))
        return _mark(result, config, split), _mark(log, config, split), _mark(chosen, config, split)

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, splits))
    results, logs, chosen = (union_rows(*frames) for frames in zip(*parts))
    return results, logs, chosen


def magnitude(
    panel: DataFrame, features: Sequence[str], config: Config, keys: Sequence[str], ts: str = "ds", price: str = "px",
    start: str = "2020-05-01", months: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Direct regression of the future return, per block; all earlier rows train."""
    label, real = f"target_up_h{config.horizon}", f"future_logret_h{config.horizon}"
    known = materialize(panel.where(F.col(label).isNotNull() & F.col(real).isNotNull()))
    splits = pooled_splits(known, ts, start, months, None, min_fit=0, min_cal=0)
    if not splits:
        raise ValueError("no block has enough training and test rows")
    spans = [Span(s.block_id, None, days_of(s.test_start)) for s in splits]
    chosen_inputs = inputs_of_spans(known, ts, label, spans, features, config.max_features)
    results, logs = [], []
    for split in splits:
        before = _train_rows(known, ts, split, 0).withColumns({"y": F.col(real), "w": F.lit(1.0)})
        inputs = chosen_inputs[split.block_id]
        model = estimator(config).fit(before.withColumn("v", inputs.vector()))
        log = model.transform(_test_rows(known, ts, split).withColumn("v", inputs.vector())).select(
            *keys, ts, price, F.col(real).alias(f"real_return_h{config.horizon}"),
            F.col("prediction").alias("pred_return_direct"),
            (F.col(price) * F.exp("prediction")).alias("expected_price_h21"),
        )
        logs.append(_mark(log, config, split))
        by = ["block_id", "test_start", "test_end", "feature_set", "model"]
        scored = regression_metrics(logs[-1], by, f"real_return_h{config.horizon}", "pred_return_direct")
        results.append(scored.withColumn("n_features", F.lit(len(inputs.names))))
    method = F.lit("direct_return_regression")
    return union_rows(*results).withColumn("magnitude_method", method), union_rows(*logs)


SHUFFLE_BUCKET = 1000


def permutation_importance(
    model: Model, test: DataFrame, inputs: Inputs, label: str, ident: Sequence[str], repeats: int = 5, threshold: float = 0.5, config: Config | None = None
) -> DataFrame:
    """Loss of balanced accuracy when one feature is shuffled; mean, deviation, rank and the feature's group.

    With ``config`` its model and feature set are columns too.

    Rows are dealt at random into buckets of about a thousand and the feature's values
    move one row on in a random order inside each bucket. That is a permutation of the
    whole column, and no task has to hold the column. Only single values are shuffled:
    those dealt to a row come back to it as one list, and a row's array is read once and
    changed value by value where the model scores it.
    """
    rows = materialize(test.select(*ident, F.col(label).cast("int").alias("y"), vector_to_array(inputs.vector()).alias("a")))
    buckets = max(1, rows.count() // SHUFFLE_BUCKET)
    narrow = rows.select(*ident, F.posexplode("a").alias("f", "own"))
    tried = narrow.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    slot = F.pmod(F.xxhash64(F.lit(SEED), "f", "trial", *ident), F.lit(buckets))
    tried = tried.withColumns({"slot": slot, "turn": F.xxhash64(F.lit(SEED + 1), "f", "trial", *ident)})
    ring = Window.partitionBy("f", "trial", "slot").orderBy("turn", *ident)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = tried.withColumn("new", F.coalesce(F.lead("own", 1).over(ring), F.first("own").over(whole)))
    moves = dealt.groupBy(*ident).agg(F.collect_list(F.struct("f", "trial", "new")).alias("moves"))
    moved = rows.join(moves, list(ident)).select("y", "a", F.inline("moves"))
    swapped = F.transform("a", lambda v, i: F.when(i == F.col("f"), F.col("new")).otherwise(v))

    def accuracy(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        hits = model.transform(frame).withColumn("hit", (probability() >= threshold).cast("int"))
        cells = hits.groupBy(*by).agg(*confusion_columns("y", "hit"))
        return cells.select(*by, balanced_accuracy(*[F.col(c) for c in ("tn", "fp", "fn", "tp")]).alias("bacc"))

    base = accuracy(rows.withColumn("v", array_to_vector("a")), []).first()["bacc"]
    shuffled = accuracy(moved.withColumn("v", array_to_vector(swapped)), ["f", "trial"])
    names = F.array(*[F.lit(n) for n in inputs.names])
    summary = shuffled.groupBy("f").agg(
        F.avg(F.lit(base) - F.col("bacc")).alias("importance"), F.stddev_pop("bacc").alias("importance_std")
    )
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "f"))
    ranked = summary.select(F.get(names, F.col("f")).alias("feature"), "importance", "importance_std", rank.alias("rank"))
    marks = {} if config is None else {"model": F.lit(config.model), "feature_set": F.lit(config.feature_set)}
    return ranked.withColumns({"group": feature_group(F.col("feature")), **marks})


def fit_final(
    panel: DataFrame, features: Sequence[str], config: Config, ts: str = "ds"
) -> tuple[PipelineModel, Inputs]:
    """One model on all rows with a known target."""
    label = f"target_up_h{config.horizon}"
    known = panel.where(F.col(label).isNotNull()).withColumn("y", F.col(label).cast("double"))
    inputs = inputs_of_spans(known, ts, "y", [Span(0, None, math.inf)], features, config.max_features)[0]
    return train(known, inputs, config, ts), inputs


def save_bundle(spark: SparkSession, path: str, model: PipelineModel, inputs: Inputs, config: Config, threshold: float) -> None:
    """Model, inputs and configuration in one folder."""
    model.write().overwrite().save(f"{path}/model")
    row = (config.model, config.feature_set, config.horizon, config.weight_strategy, threshold, inputs.names, inputs.fill)
    schema = (
        "model string, feature_set string, horizon int, weight_strategy string, mean_threshold double, "
        "features array<string>, fill array<double>"
    )
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{path}/config")


def score_latest(spark: SparkSession, path: str, panel: DataFrame, features: Sequence[str], keys: Sequence[str], ts: str = "ds") -> DataFrame:
    """Probability of a rise for the last row of each key; refuses a panel that lacks a feature."""
    bundle = spark.read.json(f"{path}/config").first()
    absent = [f for f in bundle["features"] if f not in features]
    if absent:
        raise ValueError(f"the panel lacks features of the model: {absent}")
    inputs = Inputs(bundle["features"], [list(features).index(f) for f in bundle["features"]], bundle["fill"])
    latest = panel.groupBy(*keys).agg(F.max_by(F.struct(ts, "x"), ts).alias("r")).select(*keys, "r.*")
    scored = PipelineModel.load(f"{path}/model").transform(latest.withColumn("v", inputs.vector()))
    up = probability()
    return scored.select(
        *keys, ts, up.alias("proba_up"), F.lit(bundle["mean_threshold"]).alias("threshold"),
        (up >= bundle["mean_threshold"]).cast("int").alias("pred_up_calibrated"),
    )


