"""Registered queries: standardisation, clustering, projection (C9, F, H18)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelens.functions.scalar import standardize
from tablelens.operators.cluster import (
    assign_to_centroids,
    cluster_features,
    euclidean_silhouette,
    inertia_frame,
    kmeans_cluster,
    kmeans_metrics,
    metrics_of_models,
    pca_names,
    pca_project,
    silhouette_frame,
    start_costs,
)
from tablelens.plans.catalog import query, table

CENTROIDS = [[-1.0, -1.0], [0.0, 0.0], [1.0, 1.0], [1.0, -1.0]]


def _customers(spark, sf):
    """Customers with their balance and total order value (missing when no orders)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("order_total"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_acctbal", "order_total")


_CUST_SQL = """c AS (SELECT c_custkey, c_acctbal, order_total FROM customer
  LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS order_total FROM orders GROUP BY 1) o ON c_custkey = o_custkey),
f0 AS (SELECT * FROM c WHERE c_acctbal IS NOT NULL AND order_total IS NOT NULL),
s AS (SELECT avg(c_acctbal) AS m1, CASE WHEN stddev_pop(c_acctbal) > 0 THEN stddev_pop(c_acctbal) ELSE 1 END AS s1,
             avg(order_total) AS m2, CASE WHEN stddev_pop(order_total) > 0 THEN stddev_pop(order_total) ELSE 1 END AS s2 FROM f0),
f AS (SELECT c_custkey, (c_acctbal - m1) / s1 AS z1, (order_total - m2) / s2 AS z2 FROM f0, s)"""


def _d(i):
    a, b = CENTROIDS[i]
    return f"((z1 - ({a})) * (z1 - ({a})) + (z2 - ({b})) * (z2 - ({b})))"


_ARGMIN = f"""CASE WHEN {_d(0)} <= {_d(1)} AND {_d(0)} <= {_d(2)} AND {_d(0)} <= {_d(3)} THEN 0
  WHEN {_d(1)} <= {_d(2)} AND {_d(1)} <= {_d(3)} THEN 1 WHEN {_d(2)} <= {_d(3)} THEN 2 ELSE 3 END"""


@query("standardize", """
WITH s AS (SELECT avg(p_size) AS m1, CASE WHEN stddev_pop(p_size) > 0 THEN stddev_pop(p_size) ELSE 1 END AS s1,
                  avg(p_retailprice) AS m2, CASE WHEN stddev_pop(p_retailprice) > 0 THEN stddev_pop(p_retailprice) ELSE 1 END AS s2
           FROM part)
SELECT p_partkey, round((p_size - m1) / s1, 8) + 0.0 AS p_size_z, round((p_retailprice - m2) / s2, 8) + 0.0 AS p_retailprice_z FROM part, s
""")
def q_standardize(spark, sf):
    """Z-scores with the population standard deviation."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    z = standardize(p, ["p_size", "p_retailprice"], suffix="_z")
    return z.select("p_partkey", F.round("p_size_z", 8).alias("p_size_z"), F.round("p_retailprice_z", 8).alias("p_retailprice_z"))


@query("cluster_features", f"WITH {_CUST_SQL}\nSELECT c_custkey, round(z1, 8) + 0.0 AS z1, round(z2, 8) + 0.0 AS z2 FROM f")
def q_cluster_features(spark, sf):
    """complete rows of the chosen features, standardised."""
    feat = cluster_features(_customers(spark, sf), ["c_acctbal", "order_total", "c_custkey_missing"])
    return feat.df.select("c_custkey", F.round(feat.zcols[0], 8).alias("z1"), F.round(feat.zcols[1], 8).alias("z2"))


@query("assign_to_centroids", f"WITH {_CUST_SQL}\nSELECT c_custkey, 'Кластер ' || CAST({_ARGMIN} AS VARCHAR) AS label FROM f")
def q_assign(spark, sf):
    """nearest of four fixed centroids in standardised space."""
    feat = cluster_features(_customers(spark, sf), ["c_acctbal", "order_total"])
    return assign_to_centroids(feat, CENTROIDS, out="label").select("c_custkey", "label")


@query("kmeans_inertia_fixed", f"""WITH {_CUST_SQL}
SELECT round(sum(least({_d(0)}, {_d(1)}, {_d(2)}, {_d(3)})), 6) AS inertia FROM f""")
def q_inertia(spark, sf):
    """F5 core: inertia of fixed centroids."""
    feat = cluster_features(_customers(spark, sf), ["c_acctbal", "order_total"])
    return inertia_frame(feat, CENTROIDS).select(F.round("inertia", 6).alias("inertia"))


@query("silhouette", f"""WITH {_CUST_SQL},
l AS (SELECT c_custkey, z1, z2, {_ARGMIN} AS lab FROM f),
n AS (SELECT lab, count(*) AS n FROM l GROUP BY lab),
p AS (SELECT a.c_custkey, a.lab AS la, b.lab AS lb,
             sum((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)) AS tot
      FROM l a JOIN l b ON TRUE GROUP BY 1, 2, 3),
q AS (SELECT p.c_custkey, p.la, n1.n AS na,
             max(CASE WHEN p.lb = p.la THEN p.tot / greatest(n1.n - 1, 1) END) AS a,
             min(CASE WHEN p.lb <> p.la THEN p.tot / n2.n END) AS b
      FROM p JOIN n n1 ON n1.lab = p.la JOIN n n2 ON n2.lab = p.lb GROUP BY 1, 2, 3)
SELECT round(avg(CASE WHEN na <= 1 THEN 0.0 ELSE coalesce((b - a) / greatest(a, b), 0.0) END), 8) AS silhouette FROM q""")
def q_silhouette(spark, sf):
    """squared-Euclidean silhouette of the fixed-centroid labels, exact
    from per-cluster sums (the SQL check sums over every pair instead)."""
    feat = cluster_features(_customers(spark, sf), ["c_acctbal", "order_total"])
    lab = assign_to_centroids(feat, CENTROIDS, out="lab")
    return silhouette_frame(lab, feat.zcols, "lab").select(F.round("silhouette", 8).alias("silhouette"))


_R = "corr(z1, z2)"


@query("pca_project", f"""WITH s AS (SELECT avg(p_size) AS m1, CASE WHEN stddev_pop(p_size) > 0 THEN stddev_pop(p_size) ELSE 1 END AS s1,
                  avg(p_retailprice) AS m2, CASE WHEN stddev_pop(p_retailprice) > 0 THEN stddev_pop(p_retailprice) ELSE 1 END AS s2
           FROM part),
f AS (SELECT p_partkey, (p_size - m1) / s1 AS z1, (p_retailprice - m2) / s2 AS z2 FROM part, s),
r AS (SELECT {_R} AS r FROM f)
SELECT p_partkey,
  round(CASE WHEN r >= 0 THEN (z1 + z2) ELSE (z1 - z2) END / {math.sqrt(2)!r}, 6) + 0.0 AS "PCA1",
  round(CASE WHEN r >= 0 THEN (z1 - z2) ELSE (z1 + z2) END / {math.sqrt(2)!r}, 6) + 0.0 AS "PCA2"
FROM f, r""")
def q_pca(spark, sf):
    """first two principal components of two standardised columns."""
    feat = cluster_features(table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return pca_project(feat).select("p_partkey", F.round("PCA1", 6).alias("PCA1"), F.round("PCA2", 6).alias("PCA2"))


_CUST = ["c_acctbal", "order_total"]
# PCA of two standardised columns: the axes are (1, 1) and (1, -1), the larger variance first.
_PCA = f"""r AS (SELECT {_R} AS r FROM f),
p AS (SELECT c_custkey, round(CASE WHEN r >= 0 THEN (z1 + z2) ELSE (z1 - z2) END / {math.sqrt(2)!r}, 6) + 0.0 AS "PCA1",
             round(CASE WHEN r >= 0 THEN (z1 - z2) ELSE (z1 + z2) END / {math.sqrt(2)!r}, 6) + 0.0 AS "PCA2" FROM f, r)"""


@query("kmeans_cluster", f"""WITH {_CUST_SQL}, {_PCA}
SELECT c.c_custkey, p.c_custkey IS NOT NULL AS labelled, "PCA1", "PCA2" FROM c LEFT JOIN p ON c.c_custkey = p.c_custkey""")
def q_kmeans(spark, sf):
    """k-means (k = 4, best of 10 seeded starts) on customer balance and
    order value; which rows have a label, and their PCA scores."""
    out = kmeans_cluster(_customers(spark, sf), _CUST, k=4)
    return out.select("c_custkey", F.col("Кластеры").isNotNull().alias("labelled"),
                      F.round("PCA1", 6).alias("PCA1"), F.round("PCA2", 6).alias("PCA2"))


@query("kmeans_labels", None)
def q_kmeans_labels(spark, sf):
    """the cluster label of each row (k = 4, as in kmeans_cluster); rows only,
    since the labels depend on the seeded starts."""
    return kmeans_cluster(_customers(spark, sf), _CUST, k=4, with_pca=False).select("c_custkey", F.col("Кластеры").alias("label"))


@query("kmeans_fixed_point", f"WITH {_CUST_SQL}\nSELECT count(*) AS n, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM f")
def q_kmeans_fixed_point(spark, sf):
    """the labels are a fixed point of Lloyd's rule: every row is nearest to
    the mean of its own cluster (within 0.05, the slack of the stop rule)."""
    feat = cluster_features(kmeans_cluster(_customers(spark, sf), _CUST, k=4, with_pca=False), _CUST)
    z, label = feat.zcols, F.col("Кластеры")
    means = feat.df.groupBy(label.alias("l")).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).collect()  # 4 rows
    away = [F.sqrt(sum((F.col(c) - F.lit(m[f"m{i}"])) ** 2 for i, c in enumerate(z))) for m in means]
    own = F.coalesce(*[F.when(label == F.lit(m["l"]), d) for m, d in zip(means, away)])
    return feat.df.agg(F.count("*").alias("n"), F.count_distinct(label).alias("clusters"),
                       F.count(F.when(own > F.least(*away) + 0.05, 1)).alias("misplaced"))


@query("kmeans_nan_feature", f"""WITH {_CUST_SQL}
SELECT c.c_custkey, c.c_custkey IN (SELECT c_custkey FROM f WHERE c_custkey % 7 <> 0) AS labelled FROM c""")
def q_kmeans_nan(spark, sf):
    """F2: a row with a NaN feature has no label and no scores."""
    c = _customers(spark, sf).withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")))
    out = kmeans_cluster(c, _CUST, k=4)
    return out.select("c_custkey", (F.col("Кластеры").isNotNull() & F.col("PCA1").isNotNull()).alias("labelled"))


@query("chart_cluster_metrics", None)
def q_cluster_metrics(spark, sf):
    """Elbow (inertia) and silhouette for k = 2..12."""
    return kmeans_metrics(_customers(spark, sf), _CUST)


@query("cluster_metrics_of_text", f"""WITH {_CUST_SQL}
SELECT CAST(k AS INTEGER) AS k, TRUE AS falls, TRUE AS bounded
FROM (SELECT unnest(range(2, greatest(3, least(12, count(*) - 1)) + 1)) AS k FROM f)""")
def q_cluster_metrics_text(spark, sf):
    """F5/H18 on numbers held as text: every k, inertia below that of the k
    before and below the total variance, silhouette within -1 and 1."""
    c = _customers(spark, sf).select(*[F.col(x).cast("string").alias(x) for x in _CUST])
    m = kmeans_metrics(c, _CUST, starts=3)
    n = cluster_features(_customers(spark, sf), _CUST).df.count()
    before = F.lag("inertia", 1, 2.0 * n).over(Window.orderBy("k"))  # at most 11 rows
    return m.select("k", (F.col("inertia") <= before).alias("falls"), F.abs("silhouette").between(0, 1).alias("bounded"))


def _silhouette_sql(label: str, distance: str) -> str:
    """Mean silhouette of the rows of ``f`` labelled by ``label``, over all pairs."""
    return f"""l AS (SELECT c_custkey, z1, z2, {label} AS lab FROM f),
n AS (SELECT lab, count(*) AS n FROM l GROUP BY lab),
p AS (SELECT a.c_custkey, a.lab AS la, b.lab AS lb, sum({distance}) AS tot FROM l a JOIN l b ON TRUE GROUP BY 1, 2, 3),
q AS (SELECT p.c_custkey, p.la, n1.n AS na, max(CASE WHEN p.lb = p.la THEN p.tot / greatest(n1.n - 1, 1) END) AS a,
             min(CASE WHEN p.lb <> p.la THEN p.tot / n2.n END) AS b
      FROM p JOIN n n1 ON n1.lab = p.la JOIN n n2 ON n2.lab = p.lb GROUP BY 1, 2, 3)
SELECT round(avg(CASE WHEN na <= 1 THEN 0.0 ELSE coalesce((b - a) / greatest(a, b), 0.0) END), 8) AS silhouette FROM q"""


_SQUARE = "(a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)"


@query("silhouette_euclidean", f"WITH {_CUST_SQL},\n{_silhouette_sql(_ARGMIN, f'sqrt({_SQUARE})')}")
def q_silhouette_euclidean(spark, sf):
    """plain Euclidean silhouette of the fixed-centroid labels; many points go by a tree of cells, few by blocks of pairs."""
    feat = cluster_features(_customers(spark, sf), _CUST)
    value = euclidean_silhouette(assign_to_centroids(feat, CENTROIDS, out="lab"), feat.zcols, "lab")
    return spark.createDataFrame([(None if value is None else round(value, 8),)], "silhouette double")


# Centroids of one model a k, in standardised space.
MODELS = {2: [[-0.5, -0.5], [0.5, 0.5]], 3: [[-1.0, 0.0], [0.0, 0.5], [1.0, -0.5]], 4: CENTROIDS}


def _model_sql(k: int) -> str:
    d = [f"((z1 - ({a})) * (z1 - ({a})) + (z2 - ({b})) * (z2 - ({b})))" for a, b in MODELS[k]]
    least = f"least({', '.join(d)})"
    label = "CASE " + " ".join(f"WHEN {x} = {least} THEN {i}" for i, x in enumerate(d)) + " END"
    parts = [f"(WITH {_silhouette_sql(label, e)})" for e in (_SQUARE, f"sqrt({_SQUARE})")]
    return (f"SELECT CAST({k} AS INTEGER) AS k, (SELECT round(sum({least}), 6) FROM f) AS inertia, "
            f"{parts[0]} AS silhouette, {parts[1]} AS silhouette_euclidean")


@query("cluster_metrics_fixed", f"WITH {_CUST_SQL}\n" + "\nUNION ALL ".join(_model_sql(k) for k in MODELS))
def q_cluster_metrics_fixed(spark, sf):
    """The elbow's figures for fixed centroids of every k, with both distances."""
    feat = cluster_features(_customers(spark, sf), _CUST)
    plain = metrics_of_models(feat, MODELS, "euclidean").select("k", F.round("silhouette", 8).alias("silhouette_euclidean"))
    both = metrics_of_models(feat, MODELS).join(plain, "k")  # one row a k
    return both.select("k", F.round("inertia", 6).alias("inertia"), F.round("silhouette", 8).alias("silhouette"), "silhouette_euclidean")


_STARTS_SQL = """WITH v AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_discount, l_tax FROM lineitem))
SELECT CAST(start AS INTEGER) AS start, CAST(least(n, 8) AS BIGINT) AS points, TRUE AS best_not_above_uniform
FROM v, (SELECT unnest(range(0, 10)) AS start)"""


@query("kmeans_parallel_starts", _STARTS_SQL)
def q_kmeans_starts(spark, sf):
    """k-means|| starts on columns of few distinct values: each holds k
    different points, and the best costs no more than the best uniform draw."""
    feat = cluster_features(table(spark, sf, "lineitem").select("l_discount", "l_tax"), ["l_discount", "l_tax"])
    found = start_costs(feat, 8)
    best = min(x["cost"] for x in found) <= min(x["uniform_cost"] for x in found)
    return spark.createDataFrame([(x["start"], x["points"], best) for x in found], "start int, points long, best_not_above_uniform boolean")


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
_CORR = ", ".join(f"corr({a}, {b}) AS r{i}_{j}" for i, a in enumerate(_WIDE) for j, b in enumerate(_WIDE))
_CELLS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, r{i}_{j} AS r FROM c" for i in range(len(_WIDE)) for j in range(len(_WIDE)))


@query("pca_project_wide", f"""WITH c AS (SELECT {_CORR}, count(*) AS n FROM lineitem), m AS ({_CELLS})
SELECT (SELECT n FROM c) AS n, CAST(6 AS BIGINT) AS components, TRUE AS falling, TRUE AS uncorrelated,
  (SELECT round(sum(r), 6) FROM m WHERE i = j) AS total, (SELECT round(sum(r * r), 6) FROM m) AS squares,
  (SELECT round(sum(a.r * b.r * d.r), 6) FROM m a JOIN m b ON a.j = b.i JOIN m d ON b.j = d.i AND d.j = a.i) AS cubes""")
def q_pca_wide(spark, sf):
    """all components of six columns.  The scores are uncorrelated, their
    variances fall, and the sums of the variances' first three powers are those
    of the correlation matrix (its trace, its square's and its cube's)."""
    feat = cluster_features(table(spark, sf, "lineitem").select(*_WIDE), _WIDE)
    names = pca_names(len(_WIDE))
    scores = pca_project(feat, len(_WIDE))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    m = scores.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(a).alias(f"v{i}") for i, a in enumerate(names)],
                   *[F.abs(F.corr(a, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    v = [F.col(f"v{i}") for i in range(len(names))]
    falling = F.lit(True)
    for a, b in zip(v, v[1:]):
        falling &= a >= b - 1e-12
    power = lambda p: F.round(sum(F.pow(x, F.lit(float(p))) for x in v), 6)
    return m.select("n", F.lit(len(names)).cast("long").alias("components"), falling.alias("falling"),
                    (F.greatest(*[F.col(f"r{i}") for i in range(len(pairs))]) < 1e-6).alias("uncorrelated"),
                    power(1).alias("total"), power(2).alias("squares"), power(3).alias("cubes"))
