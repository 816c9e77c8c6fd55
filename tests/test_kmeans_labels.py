from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablelens.operators.cluster import cluster_features
from tablelens.plans import cluster_queries as q

SF = "/root/testdata/sf0.001"


def test_labels_are_a_fixed_point_of_lloyds_rule(spark):
    label = {r.c_custkey: r.label for r in q.q_kmeans_labels(spark, SF).collect()}
    assert len(label) == q._customers(spark, SF).count()
    feat = cluster_features(q._customers(spark, SF), q._CUST)
    rows = feat.df.select("c_custkey", *feat.zcols).collect()
    x, names = np.array([r[1:] for r in rows], float), np.array([str(label[r[0]]) for r in rows])
    assert len(set(names)) == 4 and "None" not in names
    means = {n: x[names == n].mean(axis=0) for n in set(names)}
    away = {n: np.sqrt(((x - m) ** 2).sum(axis=1)) for n, m in means.items()}
    own = np.array([away[n][i] for i, n in enumerate(names)])
    assert (own <= np.min(list(away.values()), axis=0) + 0.05).all()
