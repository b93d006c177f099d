"""Resumable work: results arrive per configuration and finished ones are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import NOTHING_THERE, replace_partitions

LEDGER_SCHEMA = "config_key string"


def config_key() -> Column:
    """The name of a configuration: ``h21__set__model__winall__wnone__tag``."""
    window = F.coalesce(F.col("train_window_years").cast("int").cast("string"), F.lit("all"))
    return F.concat_ws(
        "__",
        F.concat(F.lit("h"), F.col("horizon").cast("string")),
        "feature_set",
        "model",
        F.concat(F.lit("win"), window),
        F.concat(F.lit("w"), "weight_strategy"),
        "tag",
    )


def pending(configs: DataFrame, done: DataFrame) -> DataFrame:
    """Configurations whose key is not in the ledger."""
    return configs.withColumn("config_key", config_key()).join(done.select("config_key").distinct(), "config_key", "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path).select("config_key").distinct()
    except AnalysisException as error:
        if error.getCondition() not in NOTHING_THERE:
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def run_pending(
    configs: DataFrame, results_path: str, ledger_path: str, run: Callable[[dict], DataFrame | None]
) -> list[str]:
    """Run what is not finished; results first, the ledger entry after them.

    The driver loops over configurations (a handful of rows); each run is a Spark
    job of its own. A run that fails leaves no ledger entry; it is tried again and
    replaces the results it left behind.
    """
    spark = configs.sparkSession
    todo = [r.asDict() for r in pending(configs, read_ledger(spark, ledger_path)).collect()]
    for config in todo:
        result = run(config)
        if result is not None:
            replace_partitions(result.withColumn("config_key", F.lit(config["config_key"])), results_path)
        done = spark.createDataFrame([(config["config_key"],)], LEDGER_SCHEMA)
        done.write.mode("append").parquet(ledger_path)
    return [c["config_key"] for c in todo]
