"""Feature filters, feature sets and the feature catalog.

A catalog has one row per feature, so its size follows the number of columns and
not the number of rows of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import markers

# Names of the feature sets.
SETS = [
    "colombia_only", "colombia_plus_global_compact", "colombia_plus_global_full", "global_no_gold_direct",
    "global_no_metals", "global_macro_only",
]
LOCAL_SHARE, CONTEXT_SHARE = 0.70, 0.40
COMPACT_LIMIT = 250


def feature_stats(values: DataFrame) -> DataFrame:
    """Known share, distinct values and variance per feature of ``(feature, pos, value)``."""
    x = F.col("value")
    return values.groupBy("feature", "pos").agg(
        F.count("*").alias("n"),
        F.avg(x.isNotNull().cast("double")).alias("known_share"),
        F.count_distinct(x).alias("n_unique"),
        F.var_samp(x).alias("variance"),
    )


def usable_features(stats: DataFrame, local_share: float = LOCAL_SHARE, context_share: float = CONTEXT_SHARE, price: str = "precio_oro") -> DataFrame:
    """Features that vary, are known often enough and say nothing about the future."""
    name = F.col("feature")
    reserved = F.lit(False)
    for prefix in markers.NOT_A_FEATURE:
        reserved = reserved | name.startswith(prefix)
    marked = stats.where(~reserved & (name != price)).withColumn("is_global", markers.is_context(name))
    share = F.when(F.col("is_global"), context_share).otherwise(local_share)
    return marked.where((F.col("known_share") >= share) & (F.col("n_unique") > 1))


def feature_sets(usable: DataFrame, limit: int = COMPACT_LIMIT) -> DataFrame:
    """Rows ``(feature_set, pos, feature)`` of the six sets.

    The compact context features are limited to the ``limit`` with the largest
    variance, in that order; within the limit they keep their column order.
    """
    name = F.col("feature")
    compact_candidate = F.col("is_global") & markers.contains_any(name, markers.COMPACT, ignore_case=False)
    everything = Window.partitionBy("__candidate")
    marked = usable.withColumn("__candidate", compact_candidate)
    marked = marked.withColumn("__many", F.count("*").over(everything) > limit)
    marked = marked.withColumn(
        "__place", F.row_number().over(everything.orderBy(F.when(F.col("__many"), -F.col("variance")), "pos"))
    )
    compact = F.col("__candidate") & (F.col("__place") <= limit)
    order = F.when(F.col("__candidate") & F.col("__many"), F.col("__place")).otherwise(F.col("pos"))
    local = ~F.col("is_global")
    only, plus_compact, plus_full, no_gold, no_metals, macro = SETS
    members = F.array_compact(
        F.array(
            F.when(local, only),
            F.when(local | compact, plus_compact),
            F.lit(plus_full),
            F.when(local | (compact & ~markers.contains_any(name, markers.GOLD_DIRECT)), no_gold),
            F.when(local | (compact & ~markers.contains_any(name, markers.METALS)), no_metals),
            F.when(local | markers.contains_any(name, markers.MACRO), macro),
        )
    )
    tall = marked.select("feature", "is_global", "pos", order.alias("__order"), F.explode(members).alias("feature_set"))
    full = F.col("feature_set").isin(plus_full, macro)
    place = F.when(full, F.col("pos")).otherwise(F.col("__order"))
    by_set = Window.partitionBy("feature_set").orderBy("is_global", place)
    return tall.select("feature_set", (F.row_number().over(by_set) - 1).alias("pos"), "feature", "is_global")


def sets_summary(sets: DataFrame) -> DataFrame:
    """Number and ordered names of the features of each set."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "feature")))
    return sets.groupBy("feature_set").agg(
        F.count("*").alias("n_features"), F.transform(in_order, lambda x: x["feature"]).alias("features")
    )


def feature_catalog(sets: DataFrame, selected: DataFrame) -> DataFrame:
    """Group, transform and use of every feature of every set."""
    used = selected.select("feature").distinct().withColumn("used_in_best", F.lit(True))
    name = F.col("feature")
    return sets.join(used, "feature", "left").select(
        "feature_set",
        "feature",
        markers.feature_group(name).alias("group"),
        markers.transform_tag(name).alias("transform"),
        markers.is_context(name).alias("is_global"),
        F.coalesce("used_in_best", F.lit(False)).alias("used_in_best"),
    )
