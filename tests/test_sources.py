"""Files in, files out, and work that resumes."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, quality
from tidemark.session import checkpoint_dir, materialize
from tidemark.sources import files
from tidemark.sources.tables import all_tables
from tidemark.streaming import ledger


def test_find_file(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / ".ipynb_checkpoints").mkdir()
    (tmp_path / "deep" / "er" / "base_long.csv").write_text("a\n1\n2\n")
    (tmp_path / "b_1.csv").write_text("a\n")
    (tmp_path / "b_2.csv").write_text("a\n1\n")
    (tmp_path / "b.csv").write_text("")
    found = files.find_file(spark, [str(tmp_path / "absent"), str(tmp_path)], ["b*.csv", "none*"])
    assert found.endswith("/b_2.csv")
    assert files.find_file(spark, [str(tmp_path)], ["*.xlsx"]) is None


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", 1.5), ("2020-01-02", None)], "fecha string, v double")
    path = files.write_table(df, str(tmp_path / "t"), "csv")
    back = files.read_csv(spark, path, "fecha date, v double")
    assert back.count() == 2 and back.agg(F.sum("v")).first()[0] == 1.5
    assert files.read_csv(spark, path).schema["v"].dataType.simpleString() == "string"
    (tmp_path / "c.json").write_text('{"horizon": 21,\n "model": "m"}')
    assert files.read_config(spark, str(tmp_path / "c.json")) == {"horizon": 21, "model": "m"}


def test_work_resumes(spark, tmp_path):
    configs = spark.createDataFrame(
        [(21, "set", "A", None, "none", "t1"), (21, "set", "B", 15, "balanced", "t2")],
        "horizon int, feature_set string, model string, train_window_years int, weight_strategy string, tag string",
    )
    results, done = str(tmp_path / "results"), str(tmp_path / "done")
    calls = []

    def run(config):
        calls.append(config["model"])
        if config["model"] == "B" and len(calls) < 3:
            raise RuntimeError("lost")
        return spark.createDataFrame([(1,)], "block_id int")

    with pytest.raises(RuntimeError):
        ledger.run_pending(configs, results, done, run)
    assert ledger.run_pending(configs, results, done, run) == ["h21__set__B__win15__wbalanced__t2"]
    assert ledger.run_pending(configs, results, done, run) == []
    assert calls == ["A", "B", "B"]
    keys = {r[0] for r in spark.read.parquet(results).select("config_key").collect()}
    assert keys == {"h21__set__A__winall__wnone__t1", "h21__set__B__win15__wbalanced__t2"}


def test_missing_tables(spark, folder):
    dictionary = quality.data_dictionary(all_tables(spark, folder))
    assert quality.missing_tables(dictionary, ["orders", "absent"]) == ["absent"]


def test_materialize_uses_the_checkpoint_folder(spark):
    df = materialize(spark.range(10).withColumn("x", F.rand(1)))
    assert checkpoint_dir(spark) and df.count() == 10
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["XGBClassifier", "HistGradientBoostingClassifier", "RandomForestClassifier", "XGBRegressor", "RandomForestRegressor"])
def test_estimators_have_the_published_sizes(name):
    many = {"XGBClassifier": 320, "HistGradientBoostingClassifier": 300, "RandomForestClassifier": 260, "XGBRegressor": 250, "RandomForestRegressor": 250}
    made = models.estimator(models.Config(name))
    trees = made.getNumTrees() if hasattr(made, "getNumTrees") and "Forest" in name else made.getMaxIter()
    assert trees == many[name]
    with pytest.raises(ValueError):
        models.estimator(models.Config("unknown"))


def test_score_refuses_a_panel_without_the_features(spark, tmp_path):
    inputs = models.Inputs(["a", "b"], [0, 1], [0.0, 0.0])

    class Saved:
        def write(self):
            return self

        def overwrite(self):
            return self

        def save(self, path):
            return None

    models.save_bundle(spark, str(tmp_path), Saved(), inputs, models.Config("XGBClassifier"), 0.5)
    with pytest.raises(ValueError, match="lacks"):
        models.score_latest(spark, str(tmp_path), spark.range(1), ["a"], ["id"])


def test_append_and_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, config_key string")
    path = files.append_table(rows, str(tmp_path / "t"))
    files.append_table(rows.where("v = 1"), path)
    assert spark.read.parquet(path).count() == 3
    files.replace_partitions(rows.where("v = 1"), path)
    assert spark.read.parquet(path).count() == 2


def test_experiment_resumes(spark, folder, tmp_path):
    from tidemark.plans import experiment, regime_queries

    panel = materialize(regime_queries.model_panel(spark, folder))
    configs = experiment.selected_configs(spark).where(F.col("tag") == "referencia_colombia_only_XGB_all_recency")
    panels = {"colombia_only": (panel, regime_queries.MODEL_FEATURES)}
    settings = {"keys": ["series_id"], "start": "2000-07-01", "trees": 2}
    done = experiment.run_experiment(configs, panels, str(tmp_path), **settings)
    assert len(done) == 1 and experiment.run_experiment(configs, panels, str(tmp_path), **settings) == []
    results = spark.read.parquet(f"{tmp_path}/results")
    log = spark.read.parquet(f"{tmp_path}/predictions")
    assert results.agg(F.sum("n_test")).first()[0] == log.count() > 0
    assert experiment.selected_configs(spark).count() == 15
