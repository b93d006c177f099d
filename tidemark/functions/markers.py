"""Name markers that sort feature names into groups, transforms and sets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of feature names.
CONTEXT = [
    "gld", "iau", "slv", "gc_f", "si_f", "cl_f", "hg_f", "pl_f", "pa_f", "dx_y_nyb", "vix", "spy", "qqq", "tnx", "irx",
]
GOLD_DIRECT = ["gld", "iau", "gc_f"]
METALS = ["gld", "iau", "gc_f", "slv", "si_f", "pl_f", "pa_f", "hg_f"]
MACRO = ["dx_y_nyb", "vix", "spy", "qqq", "tnx", "irx", "cl_f"]
COMPACT = [
    "close", "adj_close", "logret_1", "logret_5", "logret_21", "pct_21", "roll_std21", "roll_mean21", "dist_max63",
    "dist_min63", "lag1", "lag5", "lag21",
]
NOT_A_FEATURE = ["future_", "target_", "fecha", "date"]
GROUPS = [
    ("oro_internacional", ["gld", "iau", "gc_f"]),
    ("metales", ["slv", "si_f", "pl_f", "pa_f", "hg_f"]),
    ("dolar", ["dx_y_nyb"]),
    ("riesgo", ["vix"]),
    ("tasas", ["tnx", "irx"]),
    ("renta_variable", ["spy", "qqq"]),
    ("energia", ["cl_f", "brent"]),
    ("regimen", ["cluster"]),
    ("enfermedad_holandesa", ["dd_", "holand"]),
]
DEFAULT_GROUP = "colombia"
TRANSFORMS = [
    ("lag", ["lag"]),
    ("rolling_mean", ["roll_mean"]),
    ("rolling_std", ["roll_std"]),
    ("log_return", ["logret"]),
    ("pct_change", ["pct"]),
    ("difference", ["diff", "change"]),
    ("rolling_distance", ["dist_max", "dist_min"]),
    ("regime_cluster", ["cluster"]),
    ("dutch_disease_lag", ["dd_"]),
]
DEFAULT_TRANSFORM = "raw"


def contains_any(name: Column, parts: Sequence[str], ignore_case: bool = True) -> Column:
    return (F.lower(name) if ignore_case else name).rlike("|".join(re.escape(p) for p in parts))


def _first_label(name: Column, rules: Sequence[tuple[str, list[str]]], default: str, ignore_case: bool) -> Column:
    tests = [F.when(contains_any(name, parts, ignore_case), label) for label, parts in rules]
    return F.coalesce(*tests, F.lit(default))


def is_context(name: Column) -> Column:
    return contains_any(name, CONTEXT)


def feature_group(name: Column) -> Column:
    return _first_label(name, GROUPS, DEFAULT_GROUP, ignore_case=True)


def transform_tag(name: Column) -> Column:
    return _first_label(name, TRANSFORMS, DEFAULT_TRANSFORM, ignore_case=False)
