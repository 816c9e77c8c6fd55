"""k-means|| starts, the Euclidean silhouette and wide principal components on small fixtures."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tablelens.operators import cluster as cl
from tablelens.operators import silhouette
from tablelens.operators.silhouette import euclidean_silhouettes


def brute_silhouette(x, labels, power=1):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) ** power
    scores = []
    for i, own in enumerate(labels):
        same = [j for j in range(len(x)) if labels[j] == own]
        if len(same) == 1:
            scores.append(0.0)
            continue
        a = d[i, same].sum() / (len(same) - 1)
        b = min(d[i, [j for j in range(len(x)) if labels[j] == other]].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def points(rng, n):
    x = [(rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randint(0, 2))) for _ in range(n)]
    return x + x[: n // 4] + [x[0]] * (n // 3)  # repeats, one point very often


@pytest.mark.parametrize("block", [7, 40, 8192])
def test_euclidean_silhouette_in_blocks(spark, block):
    rng = random.Random(21)
    x = points(rng, 60)
    rows = [(*p, rng.choice(["a", "b", "c"]), rng.randint(0, 1)) for p in x]
    rows += [(9.0, 9.0, 9.0, "only", 1), (1.0, 2.0, 0.0, None, 0), (1.5, 2.0, 0.0, None, 1)]
    df = spark.createDataFrame(rows, "x double, y double, z double, l string, `m.n` int")
    got = euclidean_silhouettes(df, ["x", "y", "z"], ["l", "m.n"], block_rows=block)
    m = np.array([r[:3] for r in rows])
    assert got == pytest.approx([brute_silhouette(m, [r[3] for r in rows]), brute_silhouette(m, [r[4] for r in rows])], abs=1e-12)


def test_euclidean_silhouette_of_weights_and_one_cluster(spark):
    rng = random.Random(22)
    rows = [(float(rng.randint(0, 5)), float(rng.randint(0, 5)), rng.randint(0, 1), rng.randint(1, 4)) for _ in range(30)]
    df = spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "x double, y double, l int, w double")
    every = [r[:3] for r in rows for _ in range(r[3])]
    want = brute_silhouette(np.array([r[:2] for r in every]), [r[2] for r in every])
    assert euclidean_silhouettes(df, ["x", "y"], ["l"], "w")[0] == pytest.approx(want, abs=1e-12)
    assert euclidean_silhouettes(df.where("l = 1"), ["x", "y"], ["l"]) == [None]
    assert euclidean_silhouettes(df.limit(0), ["x", "y"], ["l"]) == [None]


def test_no_row_is_copied_more_than_once_a_block(spark):
    """The copies that leave for the pairs: rows x blocks, however many share a point."""
    df = spark.createDataFrame([(float(i % 50), float(i % 7), i % 2) for i in range(5000)], "x double, y double, l int")
    assert euclidean_silhouettes(df, ["x", "y"], ["l"], block_rows=100)[0] == pytest.approx(
        euclidean_silhouettes(df, ["x", "y"], ["l"])[0], abs=1e-12)


def clumps(rng, n):
    """Points spread out, in a dense clump, on a line, and one far away."""
    x = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)] + [(5 + 1e-6 * rng.gauss(0, 1), 5 + 1e-6 * rng.gauss(0, 1)) for _ in range(n // 2)]
    return x + [(-3.0, rng.gauss(0, 2)) for _ in range(n // 4)] + [(60.0, -40.0)] + x[:30]


def test_euclidean_silhouette_by_cells(spark):
    rng = random.Random(27)
    rows = [(*p, rng.choice(["a", "b", None]), int(p[0] > 0.3)) for p in clumps(rng, 400)]
    df = spark.createDataFrame(rows, "x double, y double, l string, `m.n` int")
    x = np.array([r[:2] for r in rows])
    want = [brute_silhouette(x, [r[i] for r in rows]) for i in (2, 3)]
    assert euclidean_silhouettes(df, ["x", "y"], ["l", "m.n"], block_rows=100, leaf_rows=32) == pytest.approx(want, abs=1e-11)


def test_euclidean_silhouette_does_not_measure_every_pair(spark, monkeypatch):
    """Four times the points: the distances that are measured grow about as the points do, not with their square."""
    rng = random.Random(28)
    measured = []
    for n in (2000, 8000):
        df = spark.createDataFrame([(rng.random(), rng.random(), rng.randint(0, 1)) for _ in range(n)], "x double, y double, l int")
        pairs = spark.sparkContext.accumulator(0)

        def counted(x, y, y_of, pairs=pairs):
            pairs.add(len(x) * len(y))
            return silhouette._block_sums(x, y, np.zeros((len(x), 0)), y_of, True)[0]

        monkeypatch.setattr(silhouette, "_near_sums", counted)
        euclidean_silhouettes(df, ["x", "y"], ["l"], block_rows=500, leaf_rows=64)
        measured.append(pairs.value)
    assert 0 < measured[0] < 2000**2 / 2 and measured[1] < 6 * measured[0]


def features(spark, rows):
    return cl.cluster_features(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])


@pytest.mark.parametrize("k", [2, 5, 12])
def test_starts_hold_different_points(spark, k):
    """Most rows equal: the starts still hold k points, or all the distinct ones."""
    rows = [(0.0, 0.0)] * 2000 + [(float(i), float(j)) for i in range(3) for j in range(3)]
    found = cl.start_costs(features(spark, rows), k)
    assert [x["points"] for x in found] == [min(k, 9)] * 10
    assert min(x["cost"] for x in found) <= min(x["uniform_cost"] for x in found)
    if k >= 9:
        assert max(x["cost"] for x in found) < 1e-9


def test_starts_do_not_depend_on_partitions(spark):
    rng = random.Random(23)
    rows = [(rng.gauss(i % 4 * 10, 1), rng.gauss(i % 3 * 10, 1)) for i in range(400)]
    feat = features(spark, rows)
    again = cl.Features(feat.df.repartition(7), *[getattr(feat, f) for f in ("cols", "zcols", "means", "stds")])
    assert [x["points"] for x in cl.start_costs(feat, 4)] == [4] * 10
    one, two = (cl.best_kmeans(f, 4, starts=3) for f in (feat, again))
    assert one[0] == pytest.approx(two[0], rel=1e-9) and np.allclose(one[1], two[1])


def test_kmeans_finds_separate_clusters(spark):
    rng = random.Random(24)
    centers = [(0, 0), (0, 20), (20, 0), (20, 20), (50, 50), (-40, 10)]
    rows = [(rng.gauss(a, 0.5), rng.gauss(b, 0.5)) for a, b in centers for _ in range(50)] + [(0.0, 0.0)] * 3000
    cost, centroids = cl.best_kmeans(features(spark, rows), 6)
    assert cost < 5 and len({tuple(np.round(c, 3)) for c in centroids}) == 6


def test_metrics_of_models_with_both_distances(spark):
    rng = random.Random(25)
    rows = [(rng.gauss(i % 3, 0.4), rng.gauss(i % 2, 0.4)) for i in range(90)] + [(1.0, 1.0)] * 20
    feat = features(spark, rows)
    z = np.array([r[:] for r in feat.df.select(*feat.zcols).collect()], float)
    models = {2: [[-1.0, 0.0], [1.0, 0.0]], 3: [[-1.0, 0.0], [0.0, 0.0], [1.0, 0.5]]}
    for distance, power in (("squared", 2), ("euclidean", 1)):
        for r in cl.metrics_of_models(feat, models, distance).collect():
            d = ((z[:, None, :] - np.array(models[r.k])[None]) ** 2).sum(axis=2)
            assert r.inertia == pytest.approx(d.min(axis=1).sum())
            assert r.silhouette == pytest.approx(brute_silhouette(z, d.argmin(axis=1).tolist(), power))
    with pytest.raises(ValueError):
        cl.metrics_of_models(feat, models, "cosine")
    metrics = cl.kmeans_metrics(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], starts=2, max_k=3, distance="euclidean").collect()
    assert [r.k for r in metrics] == [2, 3] and all(0 < r.silhouette < 1 for r in metrics)


def test_components_of_many_columns(spark):
    rng = np.random.default_rng(26)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 9)) + 0.1 * rng.normal(size=(300, 9))
    names = [f"c{i}" for i in range(9)]
    feat = cl.cluster_features(spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)), names)
    axes, variances = cl.pca_axes(feat, 9)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    assert np.allclose(variances, want, atol=1e-9) and np.allclose(np.array(axes) @ np.array(axes).T, np.eye(9), atol=1e-9)
    scores = cl.pca_project(feat, 4)
    assert scores.columns[-4:] == ["PCA1", "PCA2", "PCA3", "PCA4"]
    got = np.array([r[:] for r in scores.select("PCA1", "PCA2", "PCA3", "PCA4").collect()])
    assert np.allclose(got.var(axis=0), want[:4])
