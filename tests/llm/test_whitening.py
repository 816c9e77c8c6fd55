from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tablelens.llm import whitening as wh
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Ids, x-vectors, deviations and numpy's own eigenvectors of the exact covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return kept, xs, n, sums, deviation, values[::-1], vectors[:, ::-1]


def check(out, rows, components=16):
    kept, xs, n, sums, deviation, values, vectors = brute(rows)
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(out) == k * len(kept)
    assert {r.n for r in out} == {n} and all(r.identity_error <= 1e-6 for r in out) and len({r.identity_error for r in out}) == 1
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in xs])
    want = y @ vectors[:, :k] / np.sqrt(values[:k])
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    explained = values / values.sum()
    sign = {}
    for (i, _), d, w in zip(kept, deviation, want):
        for c in range(k):
            r = got[i][c + 1][0]
            assert int(r.deviation) == d and abs(r.explained - explained[c]) <= 1e-9 * explained[c]
            if abs(w[c]) > 1e-3:
                sign.setdefault(c, round(math.copysign(1, r.whitened * w[c])))
            assert abs(r.whitened - sign.get(c, 1) * w[c]) < 1e-6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_numpy(spark, sf):
    sf_dir = SF.replace("sf0.001", sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    q = QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(q.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                              "explained": "double", "identity_error": "double"}
    check(q.collect(), rows)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(3, 0.2), rng.gauss(-1, 5)]) for i in range(80)]
    rows += [(100 + i, rows[7][1]) for i in range(40)]  # one very common vector counts once
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    out = wh.whiten(table_of(spark, rows)).collect()
    check(out, rows)
    assert sum(r.vec_id is None for r in out) == 3


def test_repeated_ids_and_short_vectors(spark):
    rows = [(1, [0.1, 2.0]), (1, [0.1, 2.0]), (1, [3.0, 1.0]), (2, [1.0]), (3, []), (4, [-2.0, 5.0])]
    out = wh.whiten(table_of(spark, rows)).collect()
    full = [(i, [*v, 0.0, 0.0][:2]) for i, v in rows]
    assert sorted((str(r.vec_id), r.component, int(r.deviation)) for r in out) == sorted(
        (str(i), c, d) for (i, _), d in zip(full, brute(full)[4]) for c in (1, 2))
    assert max(r.identity_error for r in out) < 1e-12


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert wh.whiten(table_of(spark, rows)).collect() == []


def test_directions_without_spread_have_no_component(spark):
    rng = random.Random(6)
    rows = [(i, [a, a, rng.gauss(0, 2), 7.0]) for i in range(60) for a in [float(rng.randint(-9, 9))]]
    out = wh.whiten(table_of(spark, rows)).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-10
    check(out, rows)


def test_extreme_entries_and_deviations_beyond_a_long(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1e12, 2.0]), (4, [5.0, 5.0])]
    out = wh.whiten(table_of(spark, rows)).collect()
    assert {r.vec_id for r in out} == {1, 2, 3, 4} and all(math.isfinite(r.whitened) for r in out)
    n = 4
    x = [[max(-(1 << 62), min(1 << 62, math.floor(64 * c))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    want = {i: (e if e < 10**38 else None) for (i, _), e in zip(rows, exact)}
    assert {r.vec_id: None if r.deviation is None else int(r.deviation) for r in out} == want


def test_other_columns(spark):
    df = table_of(spark, [(i, [float(i), float(i * i)]) for i in range(5)])
    more = df.selectExpr("*", "vec_id as n", "'a' as component", "vec_id as __id", "embedding as __v", "1 as `x.y`")
    assert sorted(wh.whiten(more).collect(), key=str) == sorted(wh.whiten(df).collect(), key=str)


def test_factor_and_rotations():
    rng = np.random.default_rng(7)
    for d, rank in ((1, 1), (5, 5), (8, 3), (33, 33)):
        half = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 3, size=rank)
        a = half @ half.T
        factor = wh.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, rtol=1e-10, atol=1e-10 * np.abs(a).max())
        values, vectors = wh.eigen(a)
        want = np.linalg.eigvalsh(a)[::-1]
        assert np.allclose(values, want[:len(values)], rtol=1e-9, atol=1e-12 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
