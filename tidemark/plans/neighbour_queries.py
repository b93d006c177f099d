"""Queries on neighbour graphs of the embeddings and on regimes laid out by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clusters, neighbours
from tidemark.plans import views
from tidemark.plans.regime_queries import LEVELS, regime_points
from tidemark.plans.registry import registered, rounded
from tidemark.session import materialize

_NEAREST = f"""nearest AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM pts a JOIN pts b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) <= {neighbours.NEIGHBOURS})"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return views.points(spark, folder).select(F.col("vec_id").alias("id"), F.col("e").alias("v"))


@registered(f"WITH {_NEAREST} SELECT a, row_number() OVER (PARTITION BY a ORDER BY d, b)::INT AS i, b, round(d, 6) AS d FROM nearest")
def neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen nearest vectors of each vector, by NN-descent; beyond a few hundred vectors recall is below 1, so that the SQL has a few other rows."""
    return rounded(neighbours.neighbour_graph(vectors(spark, folder)).select("a", "i", "b", "d"), 6, "d")


@registered(f"""WITH queries AS (SELECT vec_id, e FROM pts WHERE vec_id % 100 = 0),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM queries a JOIN pts b ON a.vec_id <> b.vec_id)
  SELECT a, row_number() OVER (PARTITION BY a ORDER BY d, b)::INT AS i, b, round(d, 6) AS d FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= {neighbours.NEIGHBOURS}""")
def exact_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The true nearest vectors of every vector whose id 100 divides, among all vectors."""
    rows = vectors(spark, folder)
    return rounded(neighbours.exact_neighbours(rows, rows.where("id % 100 = 0")).select("a", "i", "b", "d"), 6, "d")


@registered(f"""WITH RECURSIVE {_NEAREST},
  lists AS (SELECT a, list(d) AS ds, coalesce(min(d) FILTER (d > 0), 0) AS rho, greatest(max(d), 1e-12) * 1024 AS top FROM nearest GROUP BY a),
  bracket(a, step, lo, hi) AS (
    SELECT a, 0, 0::DOUBLE, top FROM lists
    UNION ALL
    SELECT a, step + 1, CASE WHEN less THEN mid ELSE lo END, CASE WHEN less THEN hi ELSE mid END FROM (
      SELECT a, step, lo, hi, (lo + hi) / 2 AS mid, list_sum(list_transform(ds, lambda x: exp(-greatest(x - rho, 0) / ((lo + hi) / 2)))) < log2({neighbours.NEIGHBOURS}) AS less
      FROM bracket JOIN lists USING (a) WHERE step < 64)),
  seen AS (SELECT least(n.a, b) AS a, greatest(n.a, b) AS b, exp(-greatest(d - rho, 0) / greatest((lo + hi) / 2, 1e-12)) AS w
    FROM nearest n JOIN lists l ON l.a = n.a JOIN bracket k ON k.a = n.a AND step = 64)
  SELECT a, b, round(sum(w) - CASE WHEN count(*) > 1 THEN product(w) ELSE 0 END, 6) AS w FROM seen GROUP BY 1, 2""")
def fuzzy_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the edges of the neighbour graph, joined from both ends."""
    return rounded(neighbours.fuzzy_graph(neighbours.neighbour_graph(vectors(spark, folder))), 6, "w")


def laid_out(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the regime panel with the two axes of the layout of their scaled levels."""
    rows = materialize(regime_points(spark, folder).withColumn("id", F.monotonically_increasing_id()))
    graph = neighbours.neighbour_graph(rows.select("id", F.array(*[F.col(c).cast("double") for c in LEVELS]).alias("v")))
    return materialize(rows.join(neighbours.spectral_layout(neighbours.fuzzy_graph(graph)), "id"))


@registered()
def regime_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the panel on the layout of its levels, with its cluster in the better of the two designs."""
    _, labelled = clusters.select_regimes(laid_out(spark, folder), ["series_id", "ds"], {"layout": ["x", "y"]}, ["lag1_cls", "policy_stance"])
    return labelled.select("series_id", "ds", "x", "y", "cluster_layout")
