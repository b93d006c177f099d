"""K-means in one scan beside MLlib, scores beside plain formulas, and neighbour graphs beside brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tidemark.operators import clusters as cl
from tidemark.operators import neighbours as nn
from tidemark.operators import regimes

VIEWS = {"u": ["x", "y"], "w": ["z"]}


@pytest.fixture(scope="module")
def blobs(spark):
    draw = np.random.default_rng(3)
    centres = draw.uniform(-6, 6, (5, 2))
    rows = [(i, *map(float, centres[i % 5] + draw.normal(0, 0.7, 2)), float(draw.normal()), "ab"[i % 2], None if i % 7 == 0 else str(i % 5)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, kind string, group string").repartition(5).cache()


@pytest.fixture(scope="module")
def grid(blobs):
    return cl.kmeans_grid(blobs, ["id"], VIEWS, (3, 5), starts=10)


def test_cost_is_not_above_the_best_of_mllib(blobs, grid):
    _, best = grid
    for design, axes in ((cl.Design("u", 3), ["x", "y"]), (cl.Design("u", 5), ["x", "y"]), (cl.Design("w", 3), ["z"])):
        vectors = regimes._vector(blobs, axes, "v")
        theirs = min(KMeans(k=design.k, seed=s, featuresCol="v").fit(vectors).summary.trainingCost for s in range(10))
        assert best[design][1] <= theirs * (1 + 1e-3)


def test_labels_are_the_nearest_centres_and_centres_the_means(blobs, grid):
    labelled, best = grid
    assert labelled.columns == [*blobs.columns, "u_3", "u_5", "w_3", "w_5"]
    rows = labelled.toPandas()
    for design, (centres, cost) in best.items():
        x = rows[VIEWS[design.view]].to_numpy()
        label, gap = cl.nearest(x, centres)
        assert (label == rows[design.label]).all() and gap.sum() == pytest.approx(cost, rel=1e-6)
        assert (np.diff(centres[:, 0]) >= 0).all()
        for j in range(design.k):
            assert centres[j] == pytest.approx(x[label == j].mean(axis=0), abs=2e-3)


def test_one_scan_serves_all_sets(blobs):
    """A round folds every set; the plan reads the rows once."""
    centres = {(cl.Design("u", 3), s): np.random.default_rng(s).normal(size=(3, 2)) for s in range(4)}
    made, cost = cl.folded_round(blobs, VIEWS, centres)
    x = blobs.select("x", "y").toPandas().to_numpy()
    for name, c in centres.items():
        label, gap = cl.nearest(x, c)
        assert cost[name] == pytest.approx(gap.sum())
        assert made[name][0] == pytest.approx(x[label == 0].mean(axis=0) if (label == 0).any() else c[0])


def test_scores_beside_pairs(blobs, grid):
    labelled, _ = grid
    designs = [cl.Design("u", 3), cl.Design("u", 5), cl.Design("w", 3)]
    made = {r["design"]: r for r in cl.design_scores(labelled, VIEWS, designs, ["kind", "group"]).collect()}
    rows = labelled.toPandas()
    for d in designs:
        x, label = rows[VIEWS[d.view]].to_numpy(), rows[d.label].to_numpy()
        far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        mean = np.stack([far[:, label == j].sum(axis=1) / ((label == j).sum() - (label == j)) for j in range(d.k)], axis=1)
        own = mean[np.arange(len(x)), label]
        mean[np.arange(len(x)), label] = np.inf
        other = mean.min(axis=1)
        assert made[d.label]["silhouette"] == pytest.approx(((other - own) / np.maximum(own, other)).mean())
        assert made[d.label]["nmi_kind"] == pytest.approx(regimes.nmi(labelled, d.label, "kind").first()[0])
        assert made[d.label]["nmi_group"] == pytest.approx(regimes.nmi(labelled, d.label, "group").first()[0])
        one = regimes.cluster_scores(labelled, VIEWS[d.view], d.label).first()
        for c in ("n_rows", "silhouette", "calinski_harabasz", "davies_bouldin"):
            assert made[d.label][c] == pytest.approx(one[c])


def test_selection(blobs):
    ranked, chosen = cl.select_regimes(blobs, ["id"], {"u": ["x", "y"]}, ["kind", "group"], ks=(3, 5), starts=5)
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["structural_silhouette_score"] >= rows[1]["structural_silhouette_score"]
    assert chosen.columns == [*blobs.columns, "cluster_u"] and chosen.select("cluster_u").distinct().count() == rows[0]["n_clusters"]


def test_few_and_no_rows(spark):
    schema = "id long, x double, y double, z double"
    few, best = cl.kmeans_grid(spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0)], schema), ["id"], VIEWS, (3,), starts=2)
    assert {r["u_3"] for r in few.collect()} == {0} and best[cl.Design("u", 3)][1] == 0
    none, best = cl.kmeans_grid(spark.createDataFrame([], schema), ["id"], VIEWS, (3,), starts=2)
    assert none.count() == 0 and not best


@pytest.fixture(scope="module")
def points(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def test_recall_of_the_graph(points):
    """Rounds of introductions find nine in ten true neighbours, here 98 in 100, of 2000 vectors of 64 dimensions."""
    queries = points.where("id % 10 = 0")
    exact = nn.exact_neighbours(points, queries, block=64)
    graph = nn.neighbour_graph(points)
    assert exact.count() == 15 * queries.count()
    assert exact.join(graph, ["a", "b"]).count() / exact.count() >= 0.9
    assert graph.groupBy("a").count().where("count <> 15").count() == 0 and graph.where("a = b").count() == 0


def test_small_and_equal_vectors(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(10 + i, [1.0, float(i)]) for i in range(4)]
    graph = nn.neighbour_graph(spark.createDataFrame(rows, "id long, v array<double>"), k=3)
    made = {a: [r["b"] for r in sorted(rs, key=lambda r: r["i"])] for a, rs in _by(graph.collect()).items()}
    assert made[0] == [1, 2, 3] and made[5] == [0, 1, 2] and made[13] == [12, 11, 10]
    weights = nn.fuzzy_graph(graph, 3)
    assert weights.where("w < 0 OR w > 1.0000001 OR a >= b").count() == 0
    for n in (0, 1):
        assert nn.neighbour_graph(spark.createDataFrame(rows[:n], "id long, v array<double>")).count() == 0


def test_vectors_move_once_to_a_block(spark, points, monkeypatch):
    """What a round sends to its blocks is bounded by rows times blocks, not by the edges."""
    seen, rounds = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    plain = nn.introduced

    def counted(k):
        made = plain(k)
        rounds.add(1)

        def of(lists, vectors):
            seen.add(len(vectors))
            return made(lists, vectors)

        return of

    monkeypatch.setattr(nn, "introduced", counted)
    nn.neighbour_graph(points, max_rounds=1).count()
    assert rounds.value == 1 and 0 < seen.value <= 2000


def test_introductions_beside_loops():
    """All pairs of each list with a fresh end and nearer than an end's farthest, the k nearest of each row, ties by id."""
    draw = np.random.default_rng(3)
    x = np.round(draw.standard_normal((40, 3)) * 2) + 1e7
    far = draw.uniform(0.5, 4, 40)
    lists = [sorted(draw.choice(40, size=n).tolist()) for n in (1, 5, 9, 14, 14)]
    fresh = [[bool(b) for b in draw.integers(0, 2, len(r))] for r in lists]
    found = set()
    for ids, new in zip(lists, fresh):
        recent = {i for i, f in zip(ids, new) if f}
        found |= {(a, b) for a in ids for b in ids if a != b and (a in recent or b in recent) and np.linalg.norm(x[a] - x[b]) <= far[a]}
    wanted = [(a, b) for a in range(40) for b in [b for _, b in sorted((np.linalg.norm(x[a] - x[b]), b) for s, b in found if s == a)[:4]]]
    order = draw.permutation(40)
    vectors = pa.table({"to": [0] * 40, "id": order, "v": [x[i].tolist() for i in order], "far": far[order]})
    made = nn.introduced(4)(pa.table({"block": [0] * 5, "ids": lists, "fresh": fresh}), vectors)
    assert list(zip(made["a"].to_pylist(), made["b"].to_pylist())) == wanted
    assert len(found) > len(wanted) > 20


def test_first_graph_far_from_the_origin(spark):
    """Inner products of such vectors lose all digits of their distances; the neighbours are exact all the same."""
    x = np.random.default_rng(4).standard_normal((120, 5)) + 1e8
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    made = {(r["a"], r["b"]): r["d"] for r in nn.neighbour_graph(rows, k=4).collect()}
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    assert made == {(a, int(b)): gaps[a, b] for a in range(120) for b in np.lexsort((np.arange(120), gaps[a]))[:4]}


def test_scales_beside_halving(spark):
    lists = [[0.5, 0.7, 0.9, 1.5], [0.0, 0.0, 1.0, 2.0], [1.0, 1.0, 1.0, 1.0], [0.0, 0.0], [3.0]]
    nearest, scale = nn.local_scale(F.col("ds"), 3)
    made = spark.createDataFrame([(i, d) for i, d in enumerate(lists)], "a long, ds array<double>").select("a", nearest.alias("nearest"), scale.alias("scale")).orderBy("a").collect()
    for d, row in zip(lists, made):
        near = min((x for x in d if x > 0), default=0.0)
        lo, hi = 0.0, max(*d, 1e-12) * 1024
        for _ in range(64):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(np.exp(-max(x - near, 0.0) / mid) for x in d) < np.log2(3) else (lo, mid)
        assert row["nearest"] == near and row["scale"] == pytest.approx(max((lo + hi) / 2, 1e-12))
    # the nearest distance once a list, not once an item and halving
    assert str(scale).count("array_min") == 1


def _by(rows):
    made = {}
    for r in rows:
        made.setdefault(r["a"], []).append(r)
    return made


def test_layout_beside_all_eigenvectors(spark):
    """A strip of points: the leading vectors are its first two waves."""
    n = 120
    edges = [(i, j, 1.0 / (j - i)) for i in range(n) for j in range(i + 1, min(n, i + 12))]
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    deg = w.sum(axis=1)
    _, vectors = np.linalg.eigh(w / np.sqrt(np.outer(deg, deg)))
    made = nn.spectral_layout(spark.createDataFrame(edges, "a long, b long, w double")).orderBy("id").toPandas()
    for at, axis in ((-2, "x"), (-3, "y")):
        assert abs(np.corrcoef(vectors[:, at] / np.sqrt(deg), made[axis])[0, 1]) > 0.95
        assert made[axis].std(ddof=0) == pytest.approx(1)
