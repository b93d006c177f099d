"""K-means from many starts in one scan a round, scores of many labellings in two, and the choice among them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.regimes import structural_score
from tidemark.session import materialize

#: Rows, the first by md5 of their key, among which starts are drawn; all rows are clustered.
START_ROWS = 1000
STARTS = 30
MAX_ROUNDS = 300
#: A start is done when its centres move by less than this, squared and summed.
STILL = 1e-6


@dataclass(frozen=True)
class Design:
    """K-means of a view (a list of columns) into k clusters."""

    view: str
    k: int

    @property
    def label(self) -> str:
        return f"{self.view}_{self.k}"


def start_centres(points: DataFrame, keys: Sequence[str], views: Mapping[str, Sequence[str]], designs: Sequence[Design], starts: int) -> dict[tuple[Design, int], np.ndarray]:
    """Centres of each start: the k rows with the least md5 of key and start among the ``START_ROWS`` with the least md5 of their key."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    axes = sorted({a for v in views.values() for a in v})
    drawn = points.select(key.alias("__key"), *axes).orderBy(F.md5(F.col("__key").cast("binary")), "__key").limit(START_ROWS)
    order = F.array(*[F.md5(F.concat(F.col("__key"), F.lit(f"|{s}")).cast("binary")) for s in range(starts)])
    rows = drawn.select("*", order.alias("__order")).toPandas()
    made = {}
    for s in range(starts):
        placed = rows.iloc[np.lexsort((rows["__key"], rows["__order"].map(lambda o: o[s])))] if len(rows) else rows
        for d in designs:
            made[d, s] = placed[list(views[d.view])].to_numpy(dtype=float)[: d.k]
    return {x: c for x, c in made.items() if len(c)}


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, the first of equal ones, and the squared distance to it."""
    gaps = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    best = gaps.argmin(axis=1)
    return best, gaps[np.arange(len(x)), best]


def round_sums(views: Mapping[str, Sequence[str]], centres: dict[tuple[Design, int], np.ndarray]):
    """Sums per set and centre over one partition, for all sets."""
    sets = list(centres.items())

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((len(c), c.shape[1] + 2)) for _, c in sets]
        for batch in batches:
            for (design, _), c, total in ((s, c, t) for (s, c), t in zip(sets, sums)):
                x = batch[list(views[design.view])].to_numpy(dtype=float)
                label, gap = nearest(x, c)
                total[:, 0] += np.bincount(label, minlength=len(c))
                total[:, 1] += np.bincount(label, weights=gap, minlength=len(c))
                for a in range(x.shape[1]):
                    total[:, 2 + a] += np.bincount(label, weights=x[:, a], minlength=len(c))
        rows = [(i, j, row.tolist()) for i, total in enumerate(sums) for j, row in enumerate(total) if row[0]]
        yield pd.DataFrame(rows, columns=["set", "centre", "sums"])

    return of_partition


def folded_round(points: DataFrame, views: Mapping[str, Sequence[str]], centres: dict[tuple[Design, int], np.ndarray]) -> tuple[dict[tuple[Design, int], np.ndarray], dict[tuple[Design, int], float]]:
    """New centres of every set, and the cost of the old ones, from one scan; a centre without rows stays. The driver gets a row per centre."""
    width = max(c.shape[1] for c in centres.values()) + 2
    partial = points.mapInPandas(round_sums(views, centres), "set int, centre int, sums array<double>")
    total = F.array(*[F.sum(F.coalesce(F.get("sums", F.lit(i)), F.lit(0.0))) for i in range(width)])
    made, cost = {s: c.copy() for s, c in centres.items()}, dict.fromkeys(centres, 0.0)
    names = list(centres)
    for number, centre, sums in partial.groupBy("set", "centre").agg(total.alias("sums")).collect():
        name = names[number]
        made[name][centre] = np.array(sums[2 : 2 + made[name].shape[1]]) / sums[0]
        cost[name] += sums[1]
    return made, cost


def kmeans_grid(
    points: DataFrame, keys: Sequence[str], views: Mapping[str, Sequence[str]], ks: Sequence[int], starts: int = STARTS, max_rounds: int = MAX_ROUNDS
) -> tuple[DataFrame, dict[Design, tuple[np.ndarray, float]]]:
    """``points`` with a label column ``<view>_<k>`` per design, and centres and cost of each design's best start.

    All designs and starts share one scan a round: rows meet an array of sets of centres
    and are folded to one row per set and centre in each partition. Sets that stand still
    leave the round. Of equal costs (to nine digits) the earliest start stays. Labels are
    numbered by centre, in the order of its coordinates. Axes must not be null. Fewer rows
    than k give fewer clusters; an empty table has labels of type int and no rows.
    """
    designs = [Design(v, k) for v in views for k in ks]
    axes = sorted({a for v in views.values() for a in v})
    narrow = points.select(*axes)
    open_ = start_centres(points, keys, views, designs, starts)
    done: dict[tuple[Design, int], np.ndarray] = {}
    for _ in range(max_rounds):
        if not open_:
            break
        new, _ = folded_round(narrow, views, open_)
        for name, c in list(new.items()):
            if ((c - open_[name]) ** 2).sum() <= STILL:
                done[name] = new.pop(name)
        open_ = new
    done |= open_
    best: dict[Design, tuple[np.ndarray, float]] = {}
    if done:
        _, cost = folded_round(narrow, views, done)
        for d in designs:
            _, start = min((float(f"{cost[d, s]:.9g}"), s) for s in range(starts) if (d, s) in done)
            c = done[d, start]
            best[d] = c[np.lexsort(c.T[::-1])], cost[d, start]
    return with_labels(points, views, designs, {d: c for d, (c, _) in best.items()}), best


def nearest_centre(axes: Sequence[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre as an expression; the centres are literals."""
    gaps = [sum(((F.col(a) - F.lit(float(c))) * (F.col(a) - F.lit(float(c))) for a, c in zip(axes, centre)), F.lit(0.0)) for centre in centres]
    return F.array_min(F.array(*[F.struct(g.alias("gap"), F.lit(i).alias("i")) for i, g in enumerate(gaps)]))["i"]


def with_labels(points: DataFrame, views: Mapping[str, Sequence[str]], designs: Sequence[Design], centres: Mapping[Design, np.ndarray]) -> DataFrame:
    return points.withColumns({d.label: nearest_centre(views[d.view], centres[d]) if d in centres else F.lit(None).cast("int") for d in designs})


def _labelled_sums(points: DataFrame, views: Mapping[str, Sequence[str]], designs: Sequence[Design], categories: Sequence[str]) -> DataFrame:
    """One grouped table for all designs: design, label, categories, n, sums of the axes, sum of squared norms."""
    width = max(len(views[d.view]) for d in designs)
    item = lambda d: F.struct(F.lit(d.label).alias("design"), F.col(d.label).alias("label"), F.array(*[F.col(a).cast("double") for a in views[d.view]]).alias("x"))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categories]
    long = points.select(*names, F.explode(F.array(*[item(d) for d in designs])).alias("i")).select(*categories, "i.*")
    x = [F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)) for i in range(width)]
    return long.groupBy("design", "label", *categories).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], F.sum(sum((v * v for v in x), F.lit(0.0))).alias("q"))


def mutual_information(cells: DataFrame, category: str) -> DataFrame:
    """(design, nmi_<category>): normalised mutual information of label and category, from counts per cell."""
    pairs = cells.groupBy("design", "label", category).agg(F.sum("n").alias("n"))
    share = lambda *by: F.sum("n").over(Window.partitionBy("design", *by)) / F.sum("n").over(Window.partitionBy("design"))
    p, pa, pb = F.col("p"), F.col("pa"), F.col("pb")
    shares = pairs.select("design", share("label", category).alias("p"), share("label").alias("pa"), share(category).alias("pb"))
    sums = shares.groupBy("design").agg(F.sum(p * F.ln(p / (pa * pb))).alias("i"), F.sum(-p * F.ln(pa)).alias("ha"), F.sum(-p * F.ln(pb)).alias("hb"))
    both = F.col("ha") + F.col("hb")
    return sums.select("design", F.when(both == 0, 1.0).otherwise(ratio(2 * F.col("i"), both)).alias(f"nmi_{category}"))


def row_scores(views: Mapping[str, Sequence[str]], designs: Sequence[Design], stats: Mapping[str, pd.DataFrame]):
    """Per design and label: rows, sums of silhouettes, of distances to the centre and of their squares, over one partition."""

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {d: np.zeros((len(stats[d.label]), 4)) for d in designs}
        for batch in batches:
            for d, total in totals.items():
                s = stats[d.label]
                x = batch[list(views[d.view])].to_numpy(dtype=float)
                n, sums, q = s["n"].to_numpy(float), s[[f"s{i}" for i in range(x.shape[1])]].to_numpy(float), s["q"].to_numpy(float)
                own = np.searchsorted(s["label"].to_numpy(), batch[d.label].to_numpy())
                at = np.arange(len(x))
                norm = (x * x).sum(axis=1)
                # sum of squared distances from each row to each cluster
                far = np.maximum(norm[:, None] * n - 2 * x @ sums.T + q, 0.0)
                gap = np.sqrt(((x - (sums / n[:, None])[own]) ** 2).sum(axis=1))
                inside = far[at, own] / np.maximum(n[own] - 1, 1)
                mean = far / n
                mean[at, own] = np.inf
                outside = mean.min(axis=1)
                width = np.where((n[own] > 1) & np.isfinite(outside), (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0.0)
                for c, w in enumerate((np.ones(len(x)), width, gap, gap * gap)):
                    total[:, c] += np.bincount(own, weights=w, minlength=len(total))
        rows = [(d.label, int(lab), *t.tolist()) for d, total in totals.items() for lab, t in zip(stats[d.label]["label"], total)]
        yield pd.DataFrame(rows, columns=["design", "label", "n", "width", "radius", "within"])

    return of_partition


def design_scores(points: DataFrame, views: Mapping[str, Sequence[str]], designs: Sequence[Design], categories: Sequence[str]) -> DataFrame:
    """Scores of all designs: embedding, n_clusters, n_rows, silhouette, calinski_harabasz, davies_bouldin, nmi of each category.

    One grouped table has all that is needed but silhouettes and radii, which a second
    scan folds for all designs at once; neither grows with the number of designs.
    Silhouettes are those of squared distances, over all rows. Labels must not be null.
    """
    cells = materialize(_labelled_sums(points, views, designs, categories))
    width = max(len(views[d.view]) for d in designs)
    sums = cells.groupBy("design", "label").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)], F.sum("q").alias("q")).toPandas()
    stats = {name: part.sort_values("label").reset_index(drop=True) for name, part in sums.groupby("design")}
    known = [d for d in designs if d.label in stats]
    axes = sorted({a for d in designs for a in views[d.view]})
    partial = points.select(*axes, *[d.label for d in known]).mapInPandas(row_scores(views, known, stats), "design string, label int, n double, width double, radius double, within double")
    folded = partial.groupBy("design", "label").agg(*[F.sum(c).alias(c) for c in ("n", "width", "radius", "within")]).toPandas()
    rows = []
    for d in known:
        s, f = stats[d.label], folded[folded["design"] == d.label].sort_values("label")
        n, k, dims = s["n"].to_numpy(float), len(s), len(views[d.view])
        centres = s[[f"s{i}" for i in range(dims)]].to_numpy(float) / n[:, None]
        middle = (centres * n[:, None]).sum(axis=0) / n.sum()
        between = (n * ((centres - middle) ** 2).sum(axis=1)).sum()
        radius, within = f["radius"].to_numpy() / n, f["within"].sum()
        gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        worst = ((radius[:, None] + radius[None]) / gap).max(axis=1) if k > 1 else np.zeros(1)
        several = k > 1
        rows.append((d.label, d.view, d.k, int(n.sum()), float(f["width"].sum() / n.sum()) if several else None, float(between * (n.sum() - k) / (within * (k - 1))) if several and within > 0 else None, float(worst.mean()) if several and np.isfinite(worst).all() else None))
    scored = points.sparkSession.createDataFrame(rows, "design string, embedding string, n_clusters int, n_rows long, silhouette double, calinski_harabasz double, davies_bouldin double")
    for category in categories:
        scored = scored.join(F.broadcast(mutual_information(cells, category)), "design")
    return scored


def select_regimes(
    points: DataFrame, keys: Sequence[str], views: Mapping[str, Sequence[str]], categories: Sequence[str], ks: Sequence[int] = (6, 7), starts: int = STARTS
) -> tuple[DataFrame, DataFrame]:
    """Ranked designs, and ``points`` with the labels ``cluster_<view>`` of each view's best.

    Every view is clustered for every k from ``starts`` starts; designs are ranked by
    silhouette, with 0.15 and 0.10 of the mutual information with the two categories, then by the other
    scores. ``points`` should be stored, as each round of k-means reads it.
    """
    labelled, _ = kmeans_grid(points, keys, views, ks, starts)
    labelled = materialize(labelled)
    designs = [Design(v, k) for v in views for k in ks]
    scored = design_scores(labelled, views, designs, categories)
    scored = scored.withColumn("structural_silhouette_score", structural_score("silhouette", [f"nmi_{c}" for c in categories]))
    order = [F.desc("structural_silhouette_score"), F.desc("silhouette"), F.desc("calinski_harabasz"), "davies_bouldin", "n_clusters"]
    # a row per design
    ranked = materialize(scored.withColumn("rank", F.row_number().over(Window.partitionBy("embedding").orderBy(*order))))
    best = {r["embedding"]: r["design"] for r in ranked.where("rank = 1").collect()}
    chosen = labelled.withColumns({f"cluster_{v}": F.col(best[v]) if v in best else F.lit(None).cast("int") for v in views})
    return ranked, chosen.drop(*[d.label for d in designs])
