"""Clustering and projection.

* Features are standardised with the population standard deviation (C9),
  over the rows where every chosen feature is present.
* k-means runs all its models together: one pass over one cached table of
  distinct points and their counts moves the centroids of every (k, start)
  that has not settled, from partial sums per model and cluster (numpy inside
  the tasks; what leaves a task is one row per cluster).  So the number of
  passes is that of the slowest model, whatever the number of starts and k.
  Starts come from k-means|| (:mod:`tablelens.operators.starts`).  Clusters
  are renumbered by centroid order so labels are stable.
* Labels, PCA scores and inertia are plain column expressions over at most
  k x d literal numbers (centroids, loadings): no join, no pairwise work.
  The d x d covariance is a sum of the tasks' products, one number an entry.
* Silhouette: by default with the squared Euclidean distance, which
  decomposes into per-cluster sums and is exact in O(n k), all k of an elbow
  in one pass; with the plain distance (:mod:`tablelens.operators.silhouette`)
  by a tree of cells, or over all pairs of distinct points in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablelens.constants import CLUSTER_COLUMN, KMEANS_SEED, KMEANS_STARTS, PCA_COLUMNS
from tablelens.functions.scalar import label_cluster
from tablelens.operators.silhouette import euclidean_silhouettes
from tablelens.operators.starts import parallel_starts, uniform_starts
from tablelens.session import materialize
from tablelens.sources.schema import col, drop_derived, is_plain_number, num, quote

Z = "__tl_z{}"


@dataclass
class Features:
    df: DataFrame          # original columns + standardised features Z0..Zd-1 (complete rows only)
    cols: list[str]        # feature source columns
    zcols: list[str]       # standardised feature column names
    means: list[float]
    stds: list[float]


def cluster_features(df: DataFrame, cols, min_rows: int = 3) -> Features | None:
    """chosen numeric (non-boolean) columns, at least two, rows with any
    missing value excluded, standardised; None when fewer than ``min_rows``
    rows or two columns remain."""
    use = [c for c in dict.fromkeys(cols or []) if c in df.columns and is_plain_number(df, c)]
    if len(use) < 2:
        return None
    comp = df.dropna(how="any", subset=use)
    stats = comp.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(use)],
        *[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(use)],
    ).first()
    if stats["n"] < min_rows:
        return None
    means = [float(stats[f"m{i}"]) for i in range(len(use))]
    stds = [float(stats[f"s{i}"]) if stats[f"s{i}"] and stats[f"s{i}"] > 0 else 1.0 for i in range(len(use))]
    zcols = [Z.format(i) for i in range(len(use))]
    fdf = comp.withColumns({
        z: (num(c) - F.lit(m)) / F.lit(s) for z, c, m, s in zip(zcols, use, means, stds)
    })
    return Features(fdf, use, zcols, means, stds)


def _sqdist(zcols: list[str], center) -> Column:
    e = None
    for z, v in zip(zcols, center):
        t = (F.col(z) - F.lit(float(v))) * (F.col(z) - F.lit(float(v)))
        e = t if e is None else e + t
    return e


def nearest_centroid(zcols: list[str], centroids) -> Column:
    """0-based index of the nearest centroid (first on a tie)."""
    arr = F.array(*[F.struct(_sqdist(zcols, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    return F.array_min(arr).getField("i")


def assign_to_centroids(feat: Features, centroids, out: str = CLUSTER_COLUMN) -> DataFrame:
    """F3 as a frame: complete rows with their cluster label."""
    return feat.df.withColumn(out, label_cluster(nearest_centroid(feat.zcols, centroids)))


def inertia_frame(feat: Features, centroids) -> DataFrame:
    """One row ``inertia``: sum of squared distances to the nearest centroid."""
    d = F.least(*[_sqdist(feat.zcols, c) for c in centroids]) if len(centroids) > 1 else _sqdist(feat.zcols, centroids[0])
    return feat.df.agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("inertia"))


WEIGHT = "__tl_weight"
ROWS_AT_ONCE = 4096
PARTS_ON_DRIVER = 16


def _cached(feat: Features) -> DataFrame:
    """The distinct points with their counts, computed once and cached for the
    passes (a lost block is read again from the checkpoint)."""
    points = feat.df.groupBy(*feat.zcols).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    return materialize(points).persist(StorageLevel.MEMORY_AND_DISK)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :], 0.0)


def _blocks(batches, zcols):
    """(points, weights) of a task's batches, a few thousand rows at a time."""
    for batch in batches:
        x = np.column_stack([batch.column(z).to_numpy(zero_copy_only=False) for z in (*zcols, WEIGHT)])
        for at in range(0, len(x), ROWS_AT_ONCE):
            yield x[at:at + ROWS_AT_ONCE, :-1], x[at:at + ROWS_AT_ONCE, -1]


def _sums(table: DataFrame, zcols: list[str], models: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """One pass: per model the rows (n), coordinate sums (s), squared norms (q)
    and squared distances (cost) of its clusters."""
    ends = np.cumsum([0] + [len(m) for m in models])
    centers, d = np.concatenate(models), len(zcols)

    def run(batches):
        total = np.zeros((len(centers), d + 3))
        for x, w in _blocks(batches, zcols):
            distance, square = _distances(x, centers), (x * x).sum(axis=1)
            for lo, hi in zip(ends, ends[1:]):
                label = distance[:, lo:hi].argmin(axis=1)
                columns = [w, *(x * w[:, None]).T, square * w, distance[np.arange(len(x)), lo + label] * w]
                for i, c in enumerate(columns):
                    total[lo:hi, i] += np.bincount(label, weights=c, minlength=hi - lo)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centers))), *(pa.array(c) for c in np.ascontiguousarray(total.T))],
            names=["cluster", *(f"t{i}" for i in range(d + 3))])

    schema = "cluster long, " + ", ".join(f"t{i} double" for i in range(d + 3))
    parts = table.mapInArrow(run, schema)
    if table.rdd.getNumPartitions() > PARTS_ON_DRIVER:  # else the driver adds the tasks' few rows, without a shuffle
        parts = parts.groupBy("cluster").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(d + 3)])
    total = np.zeros((len(centers), d + 3))
    for r in parts.collect():
        total[r["cluster"]] += r[1:]
    return [{"n": t[:, 0], "s": t[:, 1:d + 1], "q": t[:, d + 1], "cost": t[:, d + 2]}
            for t in (total[lo:hi] for lo, hi in zip(ends, ends[1:]))]


def start_centroids(table: DataFrame, zcols: list[str], ks: list[int], starts: int = KMEANS_STARTS,
                    seed: int = KMEANS_SEED) -> dict[tuple[int, int], np.ndarray]:
    """k-means|| start of every model ``(k, start)``: ``k`` different points wherever the table has as many."""
    return parallel_starts(table, lambda batches: _blocks(batches, zcols), lambda models: [t["n"] for t in _sums(table, zcols, models)],
                           _distances, zcols, ks, starts, seed)


def start_costs(feat: Features, k: int, starts: int = KMEANS_STARTS, seed: int = KMEANS_SEED) -> list[dict]:
    """For each start its number of different points, and its cost before any pass beside that of a uniform draw."""
    table, zcols = _cached(feat), feat.zcols
    try:
        ours = [m for _, m in sorted(start_centroids(table, zcols, [k], starts, seed).items())]
        plain = uniform_starts(table, lambda batches: _blocks(batches, zcols), zcols, k, starts, seed)
        cost = [float(t["cost"].sum()) for t in _sums(table, zcols, ours + plain)]
    finally:
        table.unpersist()
    return [{"start": i, "points": len(np.unique(m, axis=0)), "cost": a, "uniform_cost": b} for i, (m, a, b) in enumerate(zip(ours, cost, cost[starts:]))]


def fit_models(table: DataFrame, zcols: list[str], ks: list[int], starts: int = KMEANS_STARTS, seed: int = KMEANS_SEED,
               max_iter: int = 300, tol: float = 1e-4) -> dict[int, tuple[float, list[list[float]]]]:
    """Best of ``starts`` seeded Lloyd runs for every k: ``{k: (cost, centroids)}``.

    A run stops once its total squared centroid shift is at most ``tol`` (the
    mean feature variance is 1) or after ``max_iter`` passes; an empty
    cluster stays where it is.  Centroids are sorted.
    """
    models = start_centroids(table, zcols, ks, starts, seed)
    moving = list(models)
    for _ in range(max_iter):
        if not moving:
            break
        stats = _sums(table, zcols, [models[m] for m in moving])
        still = []
        for m, t in zip(moving, stats):
            moved = np.where(t["n"][:, None] > 0, t["s"] / np.maximum(t["n"], 1)[:, None], models[m])
            if ((moved - models[m]) ** 2).sum() > tol:
                still.append(m)
            models[m] = moved
        moving = still
    names = list(models)
    cost = {m: float(t["cost"].sum()) for m, t in zip(names, _sums(table, zcols, [models[m] for m in names]))}
    best = {k: min((m for m in names if m[0] == k), key=lambda m: (cost[m], m)) for k in ks}
    return {k: (cost[m], sorted(map(list, models[m].tolist()))) for k, m in best.items()}


def best_kmeans(feat: Features, k: int, starts: int = KMEANS_STARTS, seed: int = KMEANS_SEED,
                max_iter: int = 300, tol: float = 1e-4) -> tuple[float, list[list[float]]]:
    """Best of ``starts`` seeded runs (lowest cost): ``(cost, sorted centroids)``."""
    table = _cached(feat)
    try:
        return fit_models(table, feat.zcols, [k], starts, seed, max_iter, tol)[k]
    finally:
        table.unpersist()


def _covariance(feat: Features) -> np.ndarray:
    """Population covariance of the standardised features (their means are 0):
    tasks send one number for each entry of the upper triangle."""
    zcols, upper = feat.zcols, np.triu_indices(len(feat.zcols))

    def run(batches):
        total, n = np.zeros((len(zcols), len(zcols))), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = np.column_stack([part.column(z).to_numpy(zero_copy_only=False) for z in zcols])
                total += x.T @ x
                n += len(x)
        sums = np.concatenate([[n], total[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "s"])

    rows = feat.df.select(*zcols).mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(1 + len(upper[0]))
    for r in rows:
        sums[r["at"]] = r["s"]
    cov = np.zeros((len(zcols), len(zcols)))
    cov[upper] = sums[1:] / max(sums[0], 1)
    return cov + np.triu(cov, 1).T


def pca_axes(feat: Features, n_components: int = 2) -> tuple[list[list[float]], list[float]]:
    """Leading principal axes of the standardised features and their variances.

    One pass gives the d x d covariance; its eigenvectors (d <= number of
    chosen columns) are computed on the driver.  Sign: the largest absolute
    loading of each axis is positive (the first one on a tie).
    """
    vals, vecs = np.linalg.eigh(_covariance(feat))
    axes, variances = [], []
    for idx in np.argsort(-vals, kind="stable")[:n_components]:
        v = vecs[:, idx]
        # First of the largest |loading|; loadings within 1e-9 count as tied
        # (standardised variances carry ~1e-12 noise that would pick at random).
        m = int(np.flatnonzero(np.abs(v) >= np.abs(v).max() - 1e-9)[0])
        axes.append([float(x) for x in (-v if v[m] < 0 else v)])
        variances.append(float(max(vals[idx], 0.0)))
    return axes, variances


def pca_loadings(feat: Features, n_components: int = 2) -> list[list[float]]:
    """The axes of :func:`pca_axes`."""
    return pca_axes(feat, n_components)[0]


def pca_names(n_components: int) -> list[str]:
    """``PCA1``, ``PCA2``, ... (the first two names are fixed)."""
    return [*PCA_COLUMNS, *(f"PCA{i}" for i in range(len(PCA_COLUMNS) + 1, n_components + 1))][:n_components]


def _score_columns(feat: Features, n_components: int) -> dict[str, Column]:
    adds = {}
    for name, v in zip(pca_names(n_components), pca_loadings(feat, n_components)):
        e = None
        for zc, w in zip(feat.zcols, v):
            t = F.col(zc) * F.lit(w)
            e = t if e is None else e + t
        adds[name] = e
    return adds


def pca_project(feat: Features, n_components: int = 2) -> DataFrame:
    """``PCA1``, ``PCA2``, ... scores of every complete row (as many as there are features at most)."""
    return feat.df.withColumns(_score_columns(feat, n_components))


def kmeans_cluster(df: DataFrame, cols, k: int = 4, starts: int = KMEANS_STARTS, seed: int = KMEANS_SEED,
                   with_pca: bool = True) -> DataFrame:
    """add ``Кластеры`` (``Кластер i``) and ``PCA1``/``PCA2``.

    Earlier cluster outputs are dropped first; rows with a missing feature
    keep missing outputs.  Every input row is kept.
    """
    if k is None or int(k) < 2:
        raise ValueError("k must be at least 2")
    base = drop_derived(df, "clusters")
    feat = cluster_features(base, cols)
    if feat is None:
        return base
    n = feat.df.count()
    if int(k) > n:
        raise ValueError(f"k={k} exceeds the {n} complete rows")
    _, centers = best_kmeans(feat, int(k), starts, seed)
    # Standardised features as expressions on the original rows; NULL when
    # any feature is missing, so such rows keep missing outputs.
    zexpr = {z: (num(c) - F.lit(m)) / F.lit(s)
             for z, c, m, s in zip(feat.zcols, feat.cols, feat.means, feat.stds)}
    out = base.withColumns(zexpr).withColumn(
        CLUSTER_COLUMN, F.when(_complete(feat), label_cluster(nearest_centroid(feat.zcols, centers)))
    )
    if with_pca:
        out = out.withColumns(_score_columns(feat, 2))
    return out.drop(*feat.zcols)


def _complete(feat: Features) -> Column:
    e = None
    for c in feat.cols:
        t = num(c).isNotNull()  # NaN is missing too
        e = t if e is None else e & t
    return e


def silhouette_frame(feat_df: DataFrame, zcols: list[str], label: str) -> DataFrame | None:
    """mean silhouette with squared Euclidean dissimilarity, exact.

    For a point x in cluster A: a = sum_{y in A} |x-y|^2 / (n_A - 1),
    b = min over other clusters B of sum_{y in B} |x-y|^2 / n_B, where
    sum_{y in C} |x-y|^2 = n_C |x|^2 - 2 x.S_C + Q_C from per-cluster sums
    (n_C, S_C, Q_C).  s = (b - a) / max(a, b); 0 for a one-point cluster.
    """
    sq = None
    for z in zcols:
        t = F.col(z) * F.col(z)
        sq = t if sq is None else sq + t
    stats = feat_df.groupBy(F.col(quote(label)).alias("lab")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"), *[F.sum(F.col(z)).alias(f"s{i}") for i, z in enumerate(zcols)]
    ).collect()  # one row per cluster (k rows)
    if len(stats) < 2:
        return None
    x2 = sq

    def total(r) -> Column:
        dot = None
        for i, z in enumerate(zcols):
            t = F.col(z) * F.lit(float(r[f"s{i}"]))
            dot = t if dot is None else dot + t
        return F.lit(float(r["n"])) * x2 - F.lit(2.0) * dot + F.lit(float(r["q"]))

    lab = F.col(quote(label))
    a = None
    own_n = None
    for r in stats:
        ai = F.when(lab == F.lit(r["lab"]), total(r) / F.lit(max(float(r["n"]) - 1.0, 1.0)))
        ni = F.when(lab == F.lit(r["lab"]), F.lit(int(r["n"])))
        a = ai if a is None else F.coalesce(a, ai)
        own_n = ni if own_n is None else F.coalesce(own_n, ni)
    b = F.least(*[F.when(lab != F.lit(r["lab"]), total(r) / F.lit(float(r["n"]))) for r in stats])
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return feat_df.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def silhouette_sq(feat_df: DataFrame, zcols: list[str], label: str) -> float | None:
    """F6 as a number (see :func:`silhouette_frame`)."""
    f = silhouette_frame(feat_df, zcols, label)
    if f is None:
        return None
    v = f.first()[0]
    return None if v is None else float(v)


def _silhouettes(table: DataFrame, zcols: list[str], models: list[np.ndarray]) -> list[float | None]:
    """F6 of several models in one pass over the rows (see :func:`silhouette_frame`)."""
    stats = _sums(table, zcols, models)
    used = [(np.flatnonzero(t["n"] > 0), t) for t in stats]
    ready = [i for i, (of, _) in enumerate(used) if len(of) > 1]

    def run(batches):
        total = np.zeros(len(models))
        for x, w in _blocks(batches, zcols):
            square, row = (x * x).sum(axis=1), np.arange(len(x))
            for i in ready:
                of, t = used[i]
                n, s, q = t["n"][of], t["s"][of], t["q"][of]
                label = _distances(x, models[i][of]).argmin(axis=1)
                apart = np.maximum(n[None, :] * square[:, None] - 2 * x @ s.T + q[None, :], 0.0)
                own = apart[row, label] / np.maximum(n[label] - 1, 1)
                apart = apart / n[None, :]
                apart[row, label] = np.inf
                other = apart.min(axis=1)
                most = np.maximum(own, other)
                score = np.divide(other - own, most, out=np.zeros(len(x)), where=most > 0)
                total[i] += (score * w)[n[label] > 1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(total)], names=["model", "total"])

    rows = table.mapInArrow(run, "model long, total double").groupBy("model").agg(F.sum("total").alias("total")).collect()
    total = {r["model"]: r["total"] for r in rows}
    return [float(total[i] / t["n"].sum()) if i in ready else None for i, (_, t) in enumerate(used)]


def euclidean_silhouette(feat_df: DataFrame, zcols: list[str], label: str) -> float | None:
    """F6 with plain distances (see :mod:`tablelens.operators.silhouette`)."""
    return euclidean_silhouettes(feat_df, zcols, [label])[0]


def metrics_of_models(feat: Features, models: dict[int, list], distance: str = "squared", table: DataFrame | None = None) -> DataFrame:
    """F5/F6 of given centroids: ``(k, inertia, silhouette)`` for each model, in two passes over
    the distinct points (``distance="squared"``) or by their distances (``"euclidean"``)."""
    if distance not in ("squared", "euclidean"):
        raise ValueError(f"unknown distance {distance!r}")
    own = table is None
    table = _cached(feat) if own else table
    try:
        ks, centers = list(models), [np.array(m, float) for m in models.values()]
        cost = [float(t["cost"].sum()) for t in _sums(table, feat.zcols, centers)]
        if distance == "euclidean":
            labels = {f"__tl_k{i}": nearest_centroid(feat.zcols, m) for i, m in enumerate(centers)}
            scores = euclidean_silhouettes(table.withColumns(labels), feat.zcols, list(labels), WEIGHT)
        else:
            scores = _silhouettes(table, feat.zcols, centers)
    finally:
        if own:
            table.unpersist()
    return feat.df.sparkSession.createDataFrame(list(zip(ks, cost, scores)), "k int, inertia double, silhouette double")


def kmeans_metrics(df: DataFrame, cols, starts: int = KMEANS_STARTS, seed: int = KMEANS_SEED,
                   max_k: int | None = None, min_rows: int = 5, distance: str = "squared") -> DataFrame:
    """``(k, inertia, silhouette)`` for k = 2 .. max(3, min(12, n-1)).

    The chosen columns are read as numbers first (text that is none is
    missing).  Inertia is the best-of-``starts`` cost on standardised
    features; the silhouette is that model's, with squared distances or, if
    ``distance`` is "euclidean", with plain ones (of three columns and more, work
    grows with the square of the distinct points); NULL when n <= k.  Needs two columns and
    ``min_rows`` complete rows.
    """
    spark = df.sparkSession
    schema = "k int, inertia double, silhouette double"
    texts = [c for c in dict.fromkeys(cols or []) if c in df.columns and isinstance(df.schema[c].dataType, StringType)]
    feat = cluster_features(df.withColumns({c: num(c) for c in texts}) if texts else df, cols, min_rows=min_rows)
    if feat is None:
        return spark.createDataFrame([], schema)
    n = feat.df.count()
    every = list(range(2, (max_k or max(3, min(12, n - 1))) + 1))
    ks = [k for k in every if k <= n]
    table = _cached(feat)
    try:
        best = fit_models(table, feat.zcols, ks, starts, seed)
        scores = {r["k"]: r["silhouette"] for r in metrics_of_models(feat, {k: best[k][1] for k in ks}, distance, table).collect()}
    finally:
        table.unpersist()
    rows = [(k, best[k][0] if k in best else None, scores[k] if k < n else None) for k in every]
    return spark.createDataFrame(rows, schema)


__all__ = [
    "Features", "cluster_features", "nearest_centroid", "assign_to_centroids", "fit_models", "best_kmeans",
    "pca_axes", "pca_loadings", "pca_project", "kmeans_cluster", "silhouette_sq", "silhouette_frame", "euclidean_silhouette",
    "inertia_frame", "kmeans_metrics", "metrics_of_models", "start_centroids", "start_costs",
]
