"""Regime matrix, embedding, clustering and their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, sanitize
from tidemark.operators.ordered import ROWS_PER_SLICE, exact_quantiles
from tidemark.session import materialize

MAX_CLUSTERS = 1000
MIN_PAIRS = 30
NMI_SHARES = (0.15, 0.10)


def medians(df: DataFrame, columns: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> dict[str, float]:
    """Exact medians of columns; the driver receives one number per column."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "value")
    found = exact_quantiles(tall, ["variable"], "value", {"median": 0.5}, rows_per_slice).collect()
    return {r["variable"]: r["median"] for r in found}


def regime_matrix(df: DataFrame, columns: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Columns with NULLs set to the median, then scaled to mean 0 and population deviation 1.

    The statistics are a few literals in the plan, so the scaling is a projection
    without shuffle. A constant column becomes 0.
    """
    clean = df.withColumns({c: sanitize(F.col(c).cast("double")) for c in columns})
    fill = medians(clean, columns, rows_per_slice)
    filled = clean.fillna({c: fill[c] for c in columns if fill.get(c) is not None})
    stats = filled.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return filled.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in columns})


def _vector(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def embed_2d(matrix: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("axis_1", "axis_2")) -> DataFrame:
    """First two principal components of a scaled matrix."""
    vectors = _vector(matrix, columns, "__v")
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(vectors)
    axes = model.transform(vectors).withColumn("__a", vector_to_array("__p"))
    return axes.select(*matrix.columns, *[F.col("__a")[i].alias(n) for i, n in enumerate(names)])


def kmeans_labels(
    points: DataFrame, axes: Sequence[str], k: int, seeds: Sequence[int] = (42,), name: str = "cluster"
) -> DataFrame:
    """Best of several k-means runs; labels follow the order of the centres."""
    vectors = _vector(points, axes, "__v")
    models = [KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__k").fit(vectors) for seed in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = sorted(range(len(best.clusterCenters())), key=lambda i: tuple(best.clusterCenters()[i]))
    place = F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)])
    return best.transform(vectors).select(*points.columns, place[F.col("__k")].alias(name))


def silhouette(points: DataFrame, axes: Sequence[str], label: str) -> float | None:
    """Mean silhouette of all points, by squared Euclidean distance; None for one cluster.

    The mean squared distance from a point to a cluster follows from the cluster's size,
    its sum of vectors and its sum of squared norms, so no pair of points is formed. Labels
    may be of any type and few; NULL is a label.
    """
    names = [r[0] for r in points.select(F.col(label).cast("string")).distinct().limit(MAX_CLUSTERS + 1).collect()]
    if len(names) > MAX_CLUSTERS:
        raise ValueError(f"{label} has more than {MAX_CLUSTERS} values")
    if len(names) < 2:
        return None
    known = F.array(*[F.lit(n) for n in sorted(n for n in names if n is not None)])
    number = F.coalesce(F.array_position(known, F.col(label).cast("string")), F.lit(0)).cast("double")
    vectors = _vector(points.select(*axes, number.alias("__n")), axes, "__v")
    return ClusteringEvaluator(predictionCol="__n", featuresCol="__v", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(vectors)


def cluster_scores(points: DataFrame, axes: Sequence[str], label: str) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin of labelled points, one row.

    All rows and axes count. Sums per cluster give everything but the mean distance to
    the centre, for which the few centres are joined back to the rows.
    """
    width = silhouette(points, axes, label)
    everywhere = Window.partitionBy(F.lit(0))
    sums = points.groupBy(F.col(label).alias("__l")).agg(
        F.count("*").alias("n"), *[F.avg(a).alias(f"c_{a}") for a in axes]
    )
    centres = materialize(sums)

    def gap2(left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        return sum((F.pow(left(a) - right(a), F.lit(2)) for a in axes), F.lit(0.0))

    centre = lambda a: F.col(f"c_{a}")
    total = {f"g_{a}": F.sum(F.col(f"c_{a}") * F.col("n")).over(everywhere) / F.sum("n").over(everywhere) for a in axes}
    around = points.join(F.broadcast(centres), F.col(label).eqNullSafe(F.col("__l")))
    radii = around.groupBy("__l").agg(F.avg(F.sqrt(gap2(F.col, centre))).alias("radius"), F.sum(gap2(F.col, centre)).alias("within"))
    spread = centres.withColumns(total).withColumn("between", gap2(centre, lambda a: F.col(f"g_{a}"))).join(
        radii.withColumnRenamed("__l", "__r"), F.col("__l").eqNullSafe(F.col("__r"))
    )
    rivals = F.collect_list(F.struct(F.col("__l").alias("l"), "radius", *[f"c_{a}" for a in axes])).over(everywhere)

    def closeness(rival: Column) -> Column:
        gap = F.sqrt(gap2(centre, lambda a: rival[f"c_{a}"]))
        return F.when(~rival["l"].eqNullSafe(F.col("__l")), ratio(F.col("radius") + rival["radius"], gap))

    judged = spread.withColumn("rivals", rivals).withColumn("worst", F.array_max(F.transform("rivals", closeness)))
    n, k = F.sum("n"), F.count("*")
    return judged.agg(
        n.alias("n_rows"),
        k.alias("n_clusters"),
        F.lit(width).cast("double").alias("silhouette"),
        F.when(k > 1, ratio(F.sum(F.col("n") * F.col("between")) * (n - k), F.sum("within") * (k - 1))).alias("calinski_harabasz"),
        F.when(k > 1, F.avg("worst")).alias("davies_bouldin"),
    )


def nmi(df: DataFrame, left: str, right: str, name: str = "nmi") -> DataFrame:
    """Normalised mutual information of two labellings; NULL is a category of its own."""
    pairs = df.groupBy(
        F.coalesce(F.col(left).cast("string"), F.lit("nan")).alias("a"),
        F.coalesce(F.col(right).cast("string"), F.lit("nan")).alias("b"),
    ).agg(F.count("*").alias("n"))
    all_rows = F.sum("n").over(Window.partitionBy(F.lit(0)))
    shares = pairs.select(
        (F.col("n") / all_rows).alias("p"),
        (F.sum("n").over(Window.partitionBy("a")) / all_rows).alias("pa"),
        (F.sum("n").over(Window.partitionBy("b")) / all_rows).alias("pb"),
    )
    p, pa, pb = F.col("p"), F.col("pa"), F.col("pb")
    sums = shares.agg(
        F.sum(p * F.ln(p / (pa * pb))).alias("i"), F.sum(-p * F.ln(pa)).alias("ha"), F.sum(-p * F.ln(pb)).alias("hb")
    )
    both = F.col("ha") + F.col("hb")
    return sums.select(F.when(both == 0, 1.0).otherwise(ratio(2 * F.col("i"), both)).alias(name))


def structural_score(silhouette_col: str, nmis: Sequence[str]) -> Column:
    score = F.coalesce(silhouette_col, F.lit(-999.0))
    for share, column in zip(NMI_SHARES, nmis):
        score = score + share * F.coalesce(column, F.lit(0.0))
    return score


def rank_designs(grid: DataFrame, nmis: Sequence[str], position: str) -> DataFrame:
    """Grid rows with their score and rank; the earliest of equals comes first. One row per design."""
    scored = grid.withColumn("structural_silhouette_score", structural_score("silhouette", nmis))
    order = Window.partitionBy("embedding").orderBy(F.desc("structural_silhouette_score"), position)
    return scored.withColumn("rank", F.row_number().over(order))


def biplot_loadings(df: DataFrame, x: str, y: str, variables: Sequence[str]) -> DataFrame:
    """Correlation of each variable with the two axes."""
    tall = df.select(x, y, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot([x, y], list(variables), "feature", "value")
    complete = tall.dropna(subset=[x, y, "value"])
    zero = F.lit(0.0)
    sums = complete.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.coalesce(sanitize(F.corr(x, "value")), zero).alias("loading_x"),
        F.coalesce(sanitize(F.corr(y, "value")), zero).alias("loading_y"),
    )
    norm = F.sqrt(F.pow("loading_x", F.lit(2)) + F.pow("loading_y", F.lit(2)))
    return sums.where(F.col("n") >= MIN_PAIRS).drop("n").withColumn("loading_norm", norm)
