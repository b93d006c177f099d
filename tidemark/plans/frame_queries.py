"""Queries on the whole feature frame and on what each walk-forward block takes of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import frame, models, selection
from tidemark.operators.walkforward import MIN_FIT
from tidemark.plans import views
from tidemark.plans.evaluation_queries import pooled_split_sql
from tidemark.plans.panel_queries import _FEATURES_OF, _WINDOWS, TIE
from tidemark.plans.registry import registered, rounded
from tidemark.session import materialize

KEYS = views.KEYS
LAYOUT = frame.Layout(
    local=["px", "fx", "oil", "gap"], context=views.context_names(), numbers=["lag1_score"],
    categories={"policy_stance": ["easing", "neutral", "tightening"], "lag1_cls": ["alto", "bajo", "medio", "Sin clasificación", "nan"]},
)
TOP = 40

#: Every variable with its features per key and day; context stands under the key ``ctx``.
_MADE = f"""
  raw AS (SELECT series_id, variable, ds, value FROM longp
    UNION ALL SELECT 'ctx', unnest({LAYOUT.context!r}), ds, unnest([{', '.join(LAYOUT.context)}]) FROM calctx),
  gate AS (SELECT series_id, variable, avg((value > 0)::INT) > 0.98 AS ok FROM raw WHERE value IS NOT NULL GROUP BY 1, 2),
  lgs AS (SELECT r.*, CASE WHEN ok AND value > 0 THEN ln(value) END AS ln_ok FROM raw r LEFT JOIN gate g ON r.series_id = g.series_id AND r.variable = g.variable),
  made AS MATERIALIZED (SELECT series_id, variable, ds, value, {_FEATURES_OF} FROM lgs {_WINDOWS})"""


def _shown_sql(variable: str, feature: str) -> str:
    if feature.startswith("roll_mean"):
        return f"floor({variable}_m.{feature} * 1000 + {TIE}) / 1000"
    return f"round({variable}_m.{feature}, {_digits(feature)})"


def _digits(feature: str) -> int:
    return 3 if feature.startswith(("diff", "lag", "roll")) else 6


def _series_sql(variables) -> str:
    each = lambda v: [f"round({v}_m.value, 3) AS {v}"] + [f"{_shown_sql(v, f)} AS {v}_{f}" for f in LAYOUT.per_variable()]
    return ", ".join(x for v in variables for x in each(v))


_ROW_SQL = ", ".join(
    ["round(r.lag1_score, 6) AS lag1_score"]
    + [f"(coalesce(r.{c}, 'nan') = '{v}')::INT::DOUBLE AS \"{c}_{v}\"" for c, values in LAYOUT.categories.items() for v in values]
)
_JOINS = " ".join(
    [f"LEFT JOIN (SELECT * FROM made WHERE variable = '{v}') {v}_m ON {v}_m.series_id = r.series_id AND {v}_m.ds = r.ds" for v in LAYOUT.local]
    + [f"LEFT JOIN (SELECT * FROM made WHERE series_id = 'ctx' AND variable = '{v}') {v}_m ON {v}_m.ds = r.ds" for v in LAYOUT.context]
)
_CALENDAR_SQL = """year(r.ds)::DOUBLE AS year, month(r.ds)::DOUBLE AS month, quarter(r.ds)::DOUBLE AS quarter, dayofyear(r.ds)::DOUBLE AS dayofyear,
    round(sin(month(r.ds) * 2 * pi() / 12), 6) AS month_sin, round(cos(month(r.ds) * 2 * pi() / 12), 6) AS month_cos"""


def whole_frame(spark: SparkSession, folder: str, keep: Sequence[str] = ("target_up_h21",)) -> DataFrame:
    """All features of all variables, calendar, stance and annual class, with the target."""
    panel = views.regime_panel(spark, folder).withColumn("gap", F.col("fx") - F.col("oil"))
    return frame.feature_frame(panel, views.calendar_context(spark, folder), LAYOUT, KEYS, "ds", keep=keep)


@registered(f"""
  WITH {_MADE}
  SELECT r.series_id, r.ds, {_CALENDAR_SQL}, {_series_sql(LAYOUT.local)}, {_ROW_SQL}, {_series_sql(LAYOUT.context)} FROM regime r {_JOINS}""")
def feature_frame_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the frame by name, on every row."""
    wide = frame.spread(whole_frame(spark, folder), LAYOUT, [*KEYS, "ds"])
    made = {f"{v}_{f}": f for v in [*LAYOUT.local, *LAYOUT.context] for f in LAYOUT.per_variable()}
    means = {n: F.floor(F.col(n) * 1000 + TIE) / 1000 for n, f in made.items() if f.startswith("roll_mean")}
    levels = [n for n, f in made.items() if n not in means and _digits(f) == 3] + [*LAYOUT.local, *LAYOUT.context]
    shares = [n for n, f in made.items() if _digits(f) == 6] + ["month_sin", "month_cos", "lag1_score"]
    return rounded(rounded(wide.withColumns(means), 3, *levels), 6, *shares)


def block_spans(known: DataFrame) -> list[selection.Span]:
    """Training days of every block of the calendar, without its calibration days."""
    return [models.span_of(s) for s in models.pooled_splits(known, "ds", views.BLOCK_START, 6, None)]


_VALUES_SQL = ", ".join(
    [f"year(r.ds)::DOUBLE, month(r.ds)::DOUBLE, quarter(r.ds)::DOUBLE, dayofyear(r.ds)::DOUBLE, sin(month(r.ds) * 2 * pi() / 12), cos(month(r.ds) * 2 * pi() / 12)"]
    + [f"{v}_m.{f}" for v in LAYOUT.local for f in ["value", *LAYOUT.per_variable()]] + ["r.lag1_score"]
    + [f"(coalesce(r.{c}, 'nan') = '{v}')::INT::DOUBLE" for c, values in LAYOUT.categories.items() for v in values]
    + [f"{v}_m.{f}" for v in LAYOUT.context for f in ["value", *LAYOUT.per_variable()]]
)


#: block_id, rank, feature, score, median.
BLOCK_FEATURES_SQL = f"""
  WITH {_MADE},
  splits AS ({pooled_split_sql(MIN_FIT, None)}),
  xs AS MATERIALIZED (SELECT r.ds, r.ds - DATE '1970-01-01' AS day_no, r.target_up_h21::DOUBLE AS y, [{_VALUES_SQL}]::DOUBLE[] AS x
    FROM regime r {_JOINS} WHERE r.target_up_h21 IS NOT NULL),
  tall AS (SELECT s.block_id, y, unnest(x) AS value, unnest(range(0, {len(LAYOUT.names())})) AS pos FROM xs JOIN splits s ON ds >= train_from AND day_no < cal_start_day),
  mids AS (SELECT block_id, pos, median(value) AS m FROM tall GROUP BY 1, 2 HAVING min(value) < max(value)),
  rated AS (SELECT block_id, pos, count(*) AS n, any_value(m) AS m, round(abs(corr(coalesce(value, m), y)), 10) AS score FROM tall JOIN mids USING (block_id, pos) GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, pos) AS rank FROM rated)
  SELECT block_id, rank::INT AS rank, {LAYOUT.names()!r}[pos + 1] AS feature, round(score, 6) AS score, round(m, 6) AS median FROM ranked WHERE rank <= {TOP}"""


@registered(BLOCK_FEATURES_SQL)
def block_features(spark: SparkSession, folder: str) -> DataFrame:
    """The features with the largest correlation in the training rows of every block, out of the whole frame."""
    known = materialize(whole_frame(spark, folder).where(F.col("target_up_h21").isNotNull()))
    chosen = selection.block_inputs(known, F.unix_date("ds"), "target_up_h21", block_spans(known), TOP)
    names = F.array(*[F.lit(n) for n in LAYOUT.names()])
    return rounded(chosen.select("block_id", "rank", F.element_at(names, F.col("pos") + 1).alias("feature"), "score", "median"), 6, "score", "median")
