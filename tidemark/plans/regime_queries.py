"""Queries on regimes, clusters and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import clusters, features, models, panel, regimes, summaries
from tidemark.operators.walkforward import MIN_FIT
from tidemark.plans import frame_queries, views
from tidemark.plans.evaluation_queries import pooled_split_sql, sql_rounded
from tidemark.plans.registry import registered, rounded
from tidemark.session import checkpoint_dir, materialize

KEYS = views.KEYS
LEVELS = ["px", "fx", "oil", "lag1_score"]


@registered("""
  WITH c AS (SELECT coalesce(cluster_abs::VARCHAR, 'nan') AS cluster, * FROM regime)
  SELECT 'cluster_abs' AS cluster_col, cluster, count(*) AS n, min(ds) AS fecha_ini, max(ds) AS fecha_fin,
    round(avg(px), 3) AS px_mean, round(median(px), 3) AS px_median, round(stddev_samp(px), 3) AS px_std,
    round(avg(fx), 3) AS fx_mean, round(median(fx), 3) AS fx_median, round(stddev_samp(fx), 3) AS fx_std,
    round(avg(lag1_score), 3) AS lag1_score_mean, round(median(lag1_score), 3) AS lag1_score_median, round(stddev_samp(lag1_score), 3) AS lag1_score_std,
    round(avg(future_logret_h21), 6) AS mean_future_return_h21, round(avg(coalesce(future_logret_h21 > 0, false)::INT), 6) AS positive_share_h21
  FROM c GROUP BY 2""")
def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters span all series, so their medians are found by slices."""
    variables = ["px", "fx", "lag1_score"]
    rows = materialize(views.regime_panel(spark, folder))
    made = summaries.cluster_profile(
        rows, "cluster_abs", "ds", variables, "future_logret_h21", rows_per_slice=2000
    )
    stats = [f"{v}_{s}" for v in variables for s in ("mean", "median", "std")]
    return rounded(rounded(made, 3, *stats), 6, "mean_future_return_h21", "positive_share_h21")


@registered("""
  WITH m AS (SELECT coalesce(cluster_abs::VARCHAR, 'nan') AS t, lag(coalesce(cluster_abs::VARCHAR, 'nan')) OVER (PARTITION BY series_id ORDER BY ds) AS f FROM regime)
  SELECT f AS from_cluster, round(avg((t = '0')::INT), 6) AS "0", round(avg((t = '1')::INT), 6) AS "1", round(avg((t = '2')::INT), 6) AS "2",
    round(avg((t = '3')::INT), 6) AS "3", round(avg((t = 'nan')::INT), 6) AS "nan" FROM m WHERE f IS NOT NULL GROUP BY 1""")
def transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    values = ["0", "1", "2", "3", "nan"]
    made = summaries.transition_matrix(views.regime_panel(spark, folder), KEYS, "ds", "cluster_abs", values)
    return rounded(made, 6, *values)


def level_rows(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(views.regime_panel(spark, folder).select("series_id", "ds", *LEVELS))


def change_rows(spark: SparkSession, folder: str) -> DataFrame:
    """21-row changes of the level variables."""
    from tidemark.operators.ordered import framed

    rows = views.regime_panel(spark, folder).select("series_id", "ds", *LEVELS)
    changes = framed(rows, KEYS, "ds", lambda w: {f"{c}_chg": F.col(c) - F.lag(c, 21).over(w) for c in LEVELS}, back=21)
    return materialize(changes.drop(*LEVELS))


@registered(f"""
  WITH f AS (SELECT series_id, ds, {", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in LEVELS)} FROM regime)
  SELECT series_id, ds, {", ".join(f"round((f.{c} - avg(f.{c}) OVER ()) / stddev_pop(f.{c}) OVER (), 6) AS {c}" for c in LEVELS)} FROM f""")
def regime_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(regimes.regime_matrix(level_rows(spark, folder), LEVELS, rows_per_slice=5000), 6, *LEVELS)


def _labelled(spark: SparkSession, folder: str, k: int = 6) -> DataFrame:
    embedded = regimes.embed_2d(regimes.regime_matrix(level_rows(spark, folder), LEVELS), LEVELS)
    return regimes.kmeans_labels(materialize(embedded), ["axis_1", "axis_2"], k, seeds=(42, 43))


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    return regimes.embed_2d(regimes.regime_matrix(level_rows(spark, folder), LEVELS), LEVELS)


@registered("SELECT series_id, count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered FROM regime GROUP BY 1")
def regime_pca(spark: SparkSession, folder: str) -> DataFrame:
    """What is determined of the two axes: rows per series, zero mean, no correlation, falling variance."""
    rows = materialize(embedded(spark, folder))
    m1, m2, v1, v2, c = rows.agg(F.avg("axis_1"), F.avg("axis_2"), F.var_pop("axis_1"), F.var_pop("axis_2"), F.corr("axis_1", "axis_2")).first()
    facts = {"centred": max(abs(m1), abs(m2)) < 1e-6, "uncorrelated": abs(c) < 1e-6, "ordered": v1 >= v2}
    return rows.groupBy("series_id").agg(F.count("*").alias("n")).withColumns({k: F.lit(bool(v)) for k, v in facts.items()})


def change_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Seven clusters of the 21-row changes, the best of five starts."""
    changes = [f"{c}_chg" for c in LEVELS]
    matrix = regimes.regime_matrix(change_rows(spark, folder), changes)
    return regimes.kmeans_labels(materialize(regimes.embed_2d(matrix, changes)), ["axis_1", "axis_2"], 7, seeds=range(42, 47))


@registered("SELECT series_id, count(*) AS n, 7::BIGINT AS n_clusters, true AS at_nearest FROM regime GROUP BY 1")
def regime_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """What is determined of the clusters: rows per series, their number, and that rows lie nearest to their own centre."""
    rows = materialize(change_labels(spark, folder))
    centres = rows.groupBy("cluster").agg(F.avg("axis_1").alias("x"), F.avg("axis_2").alias("y"))
    held = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in centres.collect()])
    gap = F.transform(held, lambda c: F.struct(F.hypot(F.col("axis_1") - c["x"], F.col("axis_2") - c["y"]).alias("d"), c["cluster"].alias("c")))
    nearest = rows.select((F.array_min(gap)["c"] == F.col("cluster")).cast("int").alias("near"), F.col("cluster"))
    share, n = nearest.agg(F.avg("near"), F.count_distinct("cluster")).first()
    return rows.groupBy("series_id").agg(F.count("*").alias("n")).withColumns({"n_clusters": F.lit(n).cast("bigint"), "at_nearest": F.lit(share > 0.99)})


def with_regimes(spark: SparkSession, folder: str) -> DataFrame:
    """Target panel with the clusters of the levels."""
    labels = regimes.kmeans_labels(materialize(embedded(spark, folder)), ["axis_1", "axis_2"], 6, seeds=(42, 43))
    return views.target_panel(spark, folder).join(labels.select("series_id", "ds", F.col("cluster").alias("regime")), ["series_id", "ds"], "left")


@registered("SELECT series_id, ds, round(px, 2) AS px, target_up_h21, true AS regime_in_range FROM target")
def regime_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the target panel with a regime from 0 to 5."""
    found = F.coalesce(F.col("regime").between(0, 5), F.lit(False)).alias("regime_in_range")
    return with_regimes(spark, folder).select("series_id", "ds", F.round("px", 2).alias("px"), "target_up_h21", found)


def _scores_sql(rows: str) -> str:
    """Scores of a relation with an id ``i``, a label ``l`` and a vector ``v``, from sums of squares over all pairs and centres."""
    return f"""
  (WITH p AS ({rows}),
  d AS (SELECT a.i, a.l AS own, b.l AS other, sum(list_distance(a.v, b.v) ** 2) AS total, count(*) AS n
    FROM p a JOIN p b ON a.i <> b.i GROUP BY 1, 2, 3),
  s AS (SELECT i, coalesce((min(total / n) FILTER (own <> other) - max(total / n) FILTER (own = other))
      / greatest(min(total / n) FILTER (own <> other), max(total / n) FILTER (own = other)), 0) AS width FROM d GROUP BY 1),
  m AS (SELECT l, j, count(*) AS n, avg(x) AS x FROM (SELECT l, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM p) GROUP BY 1, 2),
  c AS (SELECT l, any_value(n) AS n, list(x ORDER BY j) AS c FROM m GROUP BY 1),
  g AS (SELECT list(x ORDER BY j) AS g FROM (SELECT j, sum(n * x) / sum(n) AS x FROM m GROUP BY 1)),
  q AS (SELECT c.l, any_value(c.n) AS n, any_value(c.c) AS c, avg(list_distance(v, c.c)) AS r, sum(list_distance(v, c.c) ** 2) AS within
    FROM p JOIN c ON p.l = c.l GROUP BY 1),
  w AS (SELECT a.l, max((a.r + b.r) / list_distance(a.c, b.c)) AS worst FROM q a JOIN q b ON a.l <> b.l GROUP BY 1)
  SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_clusters, (SELECT avg(width) FROM s) AS silhouette,
    sum(n * list_distance(c, g) ** 2) * (sum(n) - count(*)) / (sum(within) * (count(*) - 1)) AS calinski_harabasz,
    (SELECT avg(worst) FROM w) AS davies_bouldin FROM q, g)"""


def spread_vectors(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The vectors ``e`` as one column per dimension."""
    names = [f"e{i}" for i in range(views.dimensions(rows))]
    return rows.select(*[c for c in rows.columns if c != "e"], *[F.get("e", F.lit(i)).alias(n) for i, n in enumerate(names)]), names


@registered(f"SELECT n_rows, n_clusters, {sql_rounded('silhouette', 'calinski_harabasz', 'davies_bouldin', digits=5)} FROM {_scores_sql('SELECT vec_id AS i, label AS l, e AS v FROM pts')}")
def cluster_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the labels over all vectors and all of their dimensions."""
    rows, axes = spread_vectors(views.points(spark, folder))
    made = regimes.cluster_scores(rows, axes, "label")
    return rounded(made, 5, "silhouette", "calinski_harabasz", "davies_bouldin")


def _nmi_sql(a: str, b: str) -> str:
    return f"""(WITH t AS (SELECT coalesce(({a})::VARCHAR, 'nan') AS a, coalesce(({b})::VARCHAR, 'nan') AS b, count(*)::DOUBLE AS n FROM {{rows}} GROUP BY 1, 2),
    p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM t)
    SELECT 2 * sum(p * ln(p / (pa * pb))) / (sum(-p * ln(pa)) + sum(-p * ln(pb))) FROM p)"""


@registered(f"""
  SELECT round({_nmi_sql("cluster_abs", "policy_stance").format(rows="regime")}, 6) AS nmi_policy_stance,
    round({_nmi_sql("cluster_abs", "lag1_cls").format(rows="regime")}, 6) AS nmi_class""")
def nmi(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(views.regime_panel(spark, folder).select("cluster_abs", "policy_stance", "lag1_cls"))
    stance = regimes.nmi(rows, "cluster_abs", "policy_stance", "nmi_policy_stance").withColumn("one", F.lit(1))
    label = regimes.nmi(rows, "cluster_abs", "lag1_cls", "nmi_class").withColumn("one", F.lit(1))
    return rounded(stance.join(label, "one").drop("one"), 6, "nmi_policy_stance", "nmi_class")


_DESIGNS = {"abs": "cluster_abs", "changes": "cluster_chg"}
_COMPLETE = "px IS NOT NULL AND fx IS NOT NULL AND oil IS NOT NULL AND move IS NOT NULL"


@registered("WITH d AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS embedding, n_clusters, n_rows, silhouette, calinski_harabasz, davies_bouldin,
    {_nmi_sql(label, "lag1_cls").format(rows=f"(FROM regime WHERE {_COMPLETE} AND {label} IS NOT NULL)")} AS nmi_class,
    {_nmi_sql(label, "policy_stance").format(rows=f"(FROM regime WHERE {_COMPLETE} AND {label} IS NOT NULL)")} AS nmi_policy_stance
    FROM {_scores_sql(f"SELECT series_id || ds AS i, {label} AS l, [px / 1000, fx / 1000, oil / 1000, move * 100]::DOUBLE[] AS v FROM regime WHERE {_COMPLETE} AND {label} IS NOT NULL")} s_{name}"""
    for name, label in _DESIGNS.items()
) + f""") SELECT embedding, n_clusters, n_rows, {sql_rounded("silhouette", "calinski_harabasz", "davies_bouldin", "nmi_class", "nmi_policy_stance", digits=5)},
    round(d.silhouette + 0.15 * d.nmi_class + 0.10 * d.nmi_policy_stance, 5) AS structural_silhouette_score,
    row_number() OVER (PARTITION BY embedding ORDER BY d.silhouette + 0.15 * d.nmi_class + 0.10 * d.nmi_policy_stance DESC, n_clusters)::INT AS rank FROM d""")
def regime_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the panel's two regime labels, with their relation to annual class and policy stance."""
    known = materialize(views.regime_panel(spark, folder).where(_COMPLETE))
    axes = {"px_s": F.col("px") / 1000, "fx_s": F.col("fx") / 1000, "oil_s": F.col("oil") / 1000, "move_s": F.col("move") * 100}
    designs = []
    for name, label in _DESIGNS.items():
        rows = known.where(F.col(label).isNotNull())
        scores = regimes.cluster_scores(rows.withColumns(axes), list(axes), label).withColumn("embedding", F.lit(name))
        for column, other in (("nmi_class", "lag1_cls"), ("nmi_policy_stance", "policy_stance")):
            scores = scores.withColumn(column, F.lit(regimes.nmi(rows, label, other, column).first()[0]))
        designs.append(scores)
    ranked = regimes.rank_designs(panel.union_rows(*designs), ["nmi_class", "nmi_policy_stance"], "n_clusters")
    numbers = ["silhouette", "calinski_harabasz", "davies_bouldin", "nmi_class", "nmi_policy_stance", "structural_silhouette_score"]
    return rounded(ranked, 5, *numbers)


CHANGES = [f"{c}_chg" for c in LEVELS]
REGIME_VIEWS = {"abs": LEVELS, "chg": CHANGES}
REGIME_KS = (6, 7)

_CHANGED = ", ".join(f"{c} - lag({c}, 21) OVER (PARTITION BY series_id ORDER BY ds) AS {c}_chg" for c in LEVELS)
_FILLED = ", ".join(f"coalesce({c}, median({c}) OVER ())::DOUBLE AS {c}" for c in LEVELS + CHANGES)
_SCALED = ", ".join(f"(f.{c} - avg(f.{c}) OVER ()) / stddev_pop(f.{c}) OVER () AS {c}" for c in LEVELS + CHANGES)
_DISTANCES = "list_transform(cs, lambda c: list_distance(c, p.x))"

#: K-means from all starts as a recursion; ``assigned`` has each row's cluster in each view's and k's best start.
_KMEANS = f"""
  WITH RECURSIVE changed AS (SELECT series_id, ds, policy_stance, lag1_cls, {", ".join(LEVELS)}, {_CHANGED} FROM regime),
  filled AS (SELECT series_id, ds, policy_stance, lag1_cls, {_FILLED} FROM changed),
  scaled AS MATERIALIZED (SELECT series_id, ds, policy_stance, lag1_cls, series_id || '|' || ds AS key, {_SCALED} FROM filled f),
  vectors AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{v}' AS embedding, key, policy_stance, lag1_cls, [{', '.join(axes)}] AS x FROM scaled" for v, axes in REGIME_VIEWS.items())}),
  drawn AS (SELECT key FROM scaled ORDER BY md5(key), key LIMIT {clusters.START_ROWS}),
  starts AS (SELECT key, s, row_number() OVER (PARTITION BY s ORDER BY md5(key || '|' || s), key) AS place FROM drawn, range({clusters.STARTS}) t(s)),
  km(embedding, k, s, it, cs, moved) AS (
    SELECT embedding, k, s, 0, list(x ORDER BY place), 1e0::DOUBLE FROM starts JOIN vectors USING (key), (VALUES {", ".join(f"({k})" for k in REGIME_KS)}) g(k) WHERE place <= k GROUP BY embedding, k, s
    UNION ALL
    SELECT embedding, k, s, it + 1, new, list_sum(list_transform(new, lambda c, i: list_distance(c, cs[i]) ** 2)) FROM (
      SELECT embedding, k, s, it, cs, list_transform(generate_series(1, k), lambda j: coalesce(list_filter(found, lambda f: f.j = j)[1].c, cs[j])) AS new FROM (
        SELECT embedding, k, s, it, any_value(cs) AS cs, list({{'j': j, 'c': c}}) AS found FROM (
          SELECT embedding, k, s, it, j, any_value(cs) AS cs, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS c FROM (
            SELECT m.*, p.x, list_position({_DISTANCES}, list_min({_DISTANCES})) AS j FROM km m JOIN vectors p USING (embedding) WHERE moved > {clusters.STILL} AND it < {clusters.MAX_ROUNDS})
          GROUP BY ALL)
        GROUP BY embedding, k, s, it))),
  ended AS (SELECT embedding, k, s, arg_max(cs, it) AS cs FROM km GROUP BY ALL),
  costs AS (SELECT embedding, k, s, any_value(cs) AS cs, sum(list_min({_DISTANCES}) ** 2) AS cost FROM ended JOIN vectors p USING (embedding) GROUP BY embedding, k, s),
  best AS (SELECT embedding, k, list_sort(cs) AS cs FROM costs QUALIFY row_number() OVER (PARTITION BY embedding, k ORDER BY printf('%.9g', cost)::DOUBLE, s) = 1),
  assigned AS MATERIALIZED (SELECT embedding, k, key, policy_stance, lag1_cls, x, list_position({_DISTANCES}, list_min({_DISTANCES})) - 1 AS label FROM best JOIN vectors p USING (embedding))"""

#: Scores of all designs from one grouped table, and silhouettes from the closed form.
_DESIGN_SCORES = _KMEANS + f""",
  sums AS (SELECT embedding, k, label, count(*) AS n, [sum(x[1]), sum(x[2]), sum(x[3]), sum(x[4])] AS sx, sum(list_inner_product(x, x)) AS q,
    [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS c FROM assigned GROUP BY ALL),
  far AS (SELECT a.embedding, a.k, a.key, a.label, s.label AS other, s.n, list_inner_product(a.x, a.x) * s.n - 2 * list_inner_product(a.x, s.sx) + s.q AS total FROM assigned a JOIN sums s USING (embedding, k)),
  widths AS (SELECT embedding, k, key, max(total / greatest(n - 1, 1)) FILTER (label = other) AS a, min(total / n) FILTER (label <> other) AS b, max(n) FILTER (label = other) AS n FROM far GROUP BY ALL),
  sil AS (SELECT embedding, k, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM widths GROUP BY ALL),
  radii AS (SELECT a.embedding, a.k, a.label, any_value(s.n) AS n, any_value(s.c) AS c, avg(list_distance(a.x, s.c)) AS r, sum(list_distance(a.x, s.c) ** 2) AS within FROM assigned a JOIN sums s USING (embedding, k, label) GROUP BY ALL),
  worst AS (SELECT a.embedding, a.k, a.label, max((a.r + b.r) / list_distance(a.c, b.c)) AS w FROM radii a JOIN radii b USING (embedding, k) WHERE a.label <> b.label GROUP BY ALL),
  db AS (SELECT embedding, k, avg(w) AS davies_bouldin FROM worst GROUP BY ALL),
  middle AS (SELECT embedding, k, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS g FROM assigned GROUP BY ALL),
  ch AS (SELECT embedding, k, count(*) AS found, sum(n)::BIGINT AS n_rows, sum(n * list_distance(c, g) ** 2) * (sum(n) - count(*)) / (sum(within) * (count(*) - 1)) AS calinski_harabasz FROM radii JOIN middle USING (embedding, k) GROUP BY embedding, k),
  {", ".join(f"""t_{c} AS (SELECT embedding, k, label, coalesce({c}::VARCHAR, 'nan') AS c, count(*)::DOUBLE AS n FROM assigned GROUP BY ALL),
  p_{c} AS (SELECT embedding, k, n / sum(n) OVER e AS p, sum(n) OVER (PARTITION BY embedding, k, label) / sum(n) OVER e AS pa, sum(n) OVER (PARTITION BY embedding, k, c) / sum(n) OVER e AS pb FROM t_{c} WINDOW e AS (PARTITION BY embedding, k)),
  m_{c} AS (SELECT embedding, k, 2 * sum(p * ln(p / (pa * pb))) / (sum(-p * ln(pa)) + sum(-p * ln(pb))) AS nmi_{c} FROM p_{c} GROUP BY ALL)""" for c in ("lag1_cls", "policy_stance"))},
  judged AS (SELECT *, silhouette + 0.15 * nmi_lag1_cls + 0.10 * nmi_policy_stance AS score FROM sil JOIN db USING (embedding, k) JOIN ch USING (embedding, k) JOIN m_lag1_cls USING (embedding, k) JOIN m_policy_stance USING (embedding, k)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY embedding ORDER BY score DESC, silhouette DESC, calinski_harabasz DESC, davies_bouldin, k)::INT AS rank FROM judged)"""


def regime_points(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled levels and 21-row changes of every row, with annual class and policy stance."""
    from tidemark.operators.ordered import framed

    rows = views.regime_panel(spark, folder).select("series_id", "ds", "lag1_cls", "policy_stance", *LEVELS)
    changed = framed(rows, KEYS, "ds", lambda w: {f"{c}_chg": F.col(c) - F.lag(c, 21).over(w) for c in LEVELS}, back=21)
    # a small panel comes out of its windows in few partitions; each round of k-means reads all
    spread = regimes.regime_matrix(materialize(changed), LEVELS + CHANGES, rows_per_slice=5000).repartition(spark.sparkContext.defaultParallelism)
    return materialize(spread)


def selected_regimes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All designs of both views over all rows, and the rows with the clusters of the best."""
    return clusters.select_regimes(regime_points(spark, folder), ["series_id", "ds"], REGIME_VIEWS, ["lag1_cls", "policy_stance"], REGIME_KS)


@registered(_DESIGN_SCORES + f"""
  SELECT embedding, k::INT AS n_clusters, n_rows, {sql_rounded("silhouette", "calinski_harabasz", "davies_bouldin", "nmi_lag1_cls", "nmi_policy_stance", digits=5)},
    round(score, 5) AS structural_silhouette_score, rank FROM ranked""")
def regime_designs(spark: SparkSession, folder: str) -> DataFrame:
    """Four designs by k-means from thirty starts each, scored over all rows and ranked."""
    ranked, _ = selected_regimes(spark, folder)
    numbers = ["silhouette", "calinski_harabasz", "davies_bouldin", "nmi_lag1_cls", "nmi_policy_stance", "structural_silhouette_score"]
    return rounded(ranked.drop("design"), 5, *numbers)


@registered(_DESIGN_SCORES + """
  SELECT p.series_id, p.ds, a.label::INT AS cluster_abs, c.label::INT AS cluster_chg FROM scaled p
  JOIN assigned a ON a.key = p.key AND a.embedding = 'abs' AND a.k = (SELECT k FROM ranked WHERE embedding = 'abs' AND rank = 1)
  JOIN assigned c ON c.key = p.key AND c.embedding = 'chg' AND c.k = (SELECT k FROM ranked WHERE embedding = 'chg' AND rank = 1)""")
def regime_labels_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the panel with the clusters of the best design of levels and of changes."""
    _, labelled = selected_regimes(spark, folder)
    return labelled.select("series_id", "ds", "cluster_abs", "cluster_chg")


@registered("""
  SELECT feature, round(loading_x, 6) AS loading_x, round(loading_y, 6) AS loading_y, round(sqrt(f.loading_x ** 2 + f.loading_y ** 2), 6) AS loading_norm FROM (
    SELECT feature, coalesce(corr(x, value), 0) AS loading_x, coalesce(corr(y, value), 0) AS loading_y FROM (
      SELECT axis_1 AS x, axis_2 AS y, 'e' || (generate_subscripts(e, 1) - 1) AS feature, unnest(e) AS value FROM pts)
    WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 30) f""")
def biplot_loadings(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of every dimension with the two axes."""
    rows, variables = spread_vectors(views.points(spark, folder))
    made = regimes.biplot_loadings(rows, "axis_1", "axis_2", variables)
    return rounded(made, 6, "loading_x", "loading_y", "loading_norm")


MODEL_FEATURES = ["px_logret_21", "px_pct_21", "px_dist_max63", "px_dist_min63", "fx_logret_5", "fx_dist_max21", "oil_logret_21", "oil_roll_std21"]


def model_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Target panel with an array of eight features and the weighting categories."""
    made = features.series_features(views.long_panel(spark, folder).where(F.col("variable") != "gap"), KEYS, "ds")
    tall = features.long_to_named(made, ["series_id", "ds"], ["logret_5", "logret_21", "pct_21", "dist_max21", "dist_max63", "dist_min63", "roll_std21"])
    arrays = models.feature_arrays(tall, ["series_id", "ds"], MODEL_FEATURES)
    return views.regime_panel(spark, folder).join(arrays, ["series_id", "ds"])


def _config(model: str = "XGBClassifier", **settings) -> models.Config:
    return models.Config(model, max_features=6, trees=5, **settings)


_BLOCKS = f"""
  SELECT block_id::INT AS block_id, a::DATE AS test_start, least(a + INTERVAL 6 MONTH, last_day)::DATE AS test_end, count(*) FILTER (ds >= a AND ds < least(a + INTERVAL 6 MONTH, last_day)) AS n_test
  FROM (SELECT ds, max(ds) OVER () AS last_day FROM target WHERE target_up_h21 IS NOT NULL), (SELECT i AS block_id, DATE '{views.BLOCK_START}' + INTERVAL (6 * i) MONTH AS a FROM range(0, 100) t(i))
  WHERE a < last_day GROUP BY ALL HAVING count(*) FILTER (ds < a) >= 800 AND n_test >= 20"""


def block_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Results and chosen features of every block, out of the whole frame."""
    rows = frame_queries.whole_frame(spark, folder, ["px", "target_up_h21", "future_logret_h21"])
    config = models.Config("XGBClassifier", max_features=frame_queries.TOP, trees=5, weight_strategy="balanced")
    results, _, chosen = models.walkforward(rows, frame_queries.LAYOUT.names(), config, KEYS, start=views.BLOCK_START, months=6)
    return results, chosen


@registered(f"""
  WITH chosen AS ({frame_queries.BLOCK_FEATURES_SQL}), planned AS ({pooled_split_sql(MIN_FIT, None)})
  SELECT block_id, test_start, test_end, n_test, count(*) AS n_features, string_agg(feature, ',' ORDER BY rank) AS features, true AS adds_up, true AS in_range
  FROM chosen JOIN planned USING (block_id) GROUP BY ALL""")
def walkforward_model(spark: SparkSession, folder: str) -> DataFrame:
    """What is determined of the blocks' results: dates, sizes, the chosen features in their order, and that cells and metrics agree."""
    results, chosen = block_results(spark, folder)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",")
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "balanced_accuracy", "roc_auc")] + [F.col("threshold").between(0.05, 0.95)]
    within = shares[0] & shares[1] & shares[2] & shares[3]
    return results.join(chosen.groupBy("block_id").agg(names.alias("features")), "block_id").select(
        "block_id", "test_start", "test_end", "n_test", F.col("n_features").cast("bigint").alias("n_features"), "features",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("n_test")).alias("adds_up"), within.alias("in_range"),
    )


def magnitude_results(spark: SparkSession, folder: str) -> DataFrame:
    results, _ = models.magnitude(model_panel(spark, folder), MODEL_FEATURES, _config("XGBRegressor"), KEYS, start=views.BLOCK_START, months=6)
    return results


@registered(f"SELECT *, 6::BIGINT AS n_features, true AS in_order FROM ({_BLOCKS})")
def magnitude_model(spark: SparkSession, folder: str) -> DataFrame:
    """What is determined of the regressions: dates, sizes, number of features, and the order of the errors."""
    return magnitude_results(spark, folder).select(
        "block_id", "test_start", "test_end", "n_test", F.col("n_features").cast("bigint").alias("n_features"),
        ((F.col("rmse_return") >= F.col("mae_return")) & (F.col("mae_return") >= 0)).alias("in_order"),
    )


def importances(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(model_panel(spark, folder).where(F.col("target_up_h21").isNotNull()))
    train, test = rows.where(F.col("ds") < "2000-01-01"), rows.where(F.col("ds") >= "2000-01-01")
    model, inputs = models.fit_final(train, MODEL_FEATURES, _config())
    return models.permutation_importance(model, test, inputs, "target_up_h21", ["series_id", "ds"], config=_config())


@registered("SELECT i::INT AS rank, true AS known, true AS falling, true AS bounded FROM range(1, 7) t(i)")
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    """What is determined of the importances: ranks, names from the list, falling values, none beyond 1."""
    before = F.lag("importance").over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    return importances(spark, folder).select(
        "rank", F.col("feature").isin(MODEL_FEATURES).alias("known"), F.coalesce(before >= F.col("importance"), F.lit(True)).alias("falling"),
        (F.abs("importance") <= 1).alias("bounded"),
    )


def latest_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(model_panel(spark, folder))
    model, inputs = models.fit_final(rows, MODEL_FEATURES, _config("LogisticRegression"))
    path = f"{checkpoint_dir(spark)}/model_bundle_{spark.sparkContext.applicationId}"
    models.save_bundle(spark, path, model, inputs, _config("LogisticRegression"), 0.5)
    return models.score_latest(spark, path, rows, MODEL_FEATURES, KEYS)


@registered("SELECT series_id, max(ds) AS ds, 0.5::DOUBLE AS threshold, true AS in_range, true AS agrees FROM regime GROUP BY 1")
def score_latest(spark: SparkSession, folder: str) -> DataFrame:
    """What is determined of the scores: last day per series, range, and that the call follows the threshold."""
    up = F.col("proba_up")
    return latest_scores(spark, folder).select(
        "series_id", "ds", F.col("threshold").cast("double").alias("threshold"), up.between(0, 1).alias("in_range"),
        ((up >= F.col("threshold")).cast("int") == F.col("pred_up_calibrated")).alias("agrees"),
    )
