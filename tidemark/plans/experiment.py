"""The selected configurations and the resumable run over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.models import Config, walkforward
from tidemark.sources.files import replace_partitions
from tidemark.streaming.ledger import run_pending

FULL, COMPACT, LINEAR = 2200, 1500, 900

# Tag, feature set, model, training window in years (None is all), weights, most features.
CONFIGS = [
    ("competitivo_HGB_full_all_balanced", "colombia_plus_global_full", "HistGradientBoostingClassifier", None, "balanced", FULL),
    ("competitivo_XGB_full_15_none", "colombia_plus_global_full", "XGBClassifier", 15, "none", FULL),
    ("competitivo_XGB_full_all_recency", "colombia_plus_global_full", "XGBClassifier", None, "recency_4y", FULL),
    ("competitivo_XGB_full_15_cluster", "colombia_plus_global_full", "XGBClassifier", 15, "cluster_x4", FULL),
    ("competitivo_HGB_full_all_none", "colombia_plus_global_full", "HistGradientBoostingClassifier", None, "none", FULL),
    ("historico_XGB_compact_all_none", "colombia_plus_global_compact", "XGBClassifier", None, "none", COMPACT),
    ("compact_XGB_all_recency", "colombia_plus_global_compact", "XGBClassifier", None, "recency_4y", COMPACT),
    ("auditoria_XGB_no_gold_direct_all_none", "global_no_gold_direct", "XGBClassifier", None, "none", COMPACT),
    ("auditoria_HGB_no_gold_direct_all_balanced", "global_no_gold_direct", "HistGradientBoostingClassifier", None, "balanced", COMPACT),
    ("auditoria_XGB_no_metals_all_none", "global_no_metals", "XGBClassifier", None, "none", COMPACT),
    ("auditoria_XGB_macro_only_all_none", "global_macro_only", "XGBClassifier", None, "none", COMPACT),
    ("referencia_colombia_only_XGB_all_recency", "colombia_only", "XGBClassifier", None, "recency_4y", COMPACT),
    ("referencia_colombia_only_HGB_all_macrofull", "colombia_only", "HistGradientBoostingClassifier", None, "macrofull_x15", COMPACT),
    ("referencia_RF_compact_15_macrofull", "colombia_plus_global_compact", "RandomForestClassifier", 15, "macrofull_x15", COMPACT),
    ("referencia_logit_compact_10_recency", "colombia_plus_global_compact", "LogisticRegression", 10, "recency_4y", LINEAR),
]
SCHEMA = (
    "tag string, feature_set string, model string, train_window_years int, weight_strategy string, max_features int, horizon int"
)


def selected_configs(spark: SparkSession, horizons: Sequence[int] = (21,)) -> DataFrame:
    return spark.createDataFrame([(*c, h) for h in horizons for c in CONFIGS], SCHEMA)


def run_experiment(
    configs: DataFrame,
    panels: Mapping[str, tuple[DataFrame, Sequence[str]]],
    folder: str,
    keys: Sequence[str],
    ts: str = "ds",
    start: str = "2020-05-01",
    months: int = 6,
    fast: bool = False,
    trees: int | None = None,
) -> list[str]:
    """Run every configuration that is not finished and append its three tables.

    ``panels`` gives the panel and the feature names of each feature set. Block results,
    prediction log and selected features land in ``folder``, partitioned by configuration;
    a run that was cut short is repeated as a whole and replaces what it left behind.
    """
    def run(row: dict) -> DataFrame:
        panel, features = panels[row["feature_set"]]
        config = Config(
            row["model"], row["feature_set"], row["horizon"], row["train_window_years"], row["weight_strategy"],
            row["max_features"], row["tag"], fast, trees,
        )
        results, log, chosen = walkforward(panel, features, config, keys, ts, start=start, months=months)
        for name, frame in (("predictions", log), ("selected_features", chosen)):
            marked = frame.withColumns({"config_key": F.lit(row["config_key"]), "config_tag": F.lit(row["tag"])})
            replace_partitions(marked, f"{folder}/{name}")
        return results.withColumn("config_tag", F.lit(row["tag"]))

    return run_pending(configs, f"{folder}/results", f"{folder}/ledger", run)
