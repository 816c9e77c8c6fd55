from __future__ import annotations

import numpy as np
import pytest

from tablelens.llm import knn
from tablelens.llm.knn import part_of


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 10, 25, 50])
def test_queries_with_a_common_divisor_spread_over_all_parts(parts):
    ids = np.arange(-100_000, 100_000) * 50
    share = np.bincount(part_of(ids, parts), minlength=parts) / len(ids)
    assert len(share) == parts and abs(share * parts - 1).max() < 0.1


def test_queries_are_dealt_within_groups(spark, monkeypatch):
    """With parts of few queries, groups far from all queries keep one copy, and results stay."""
    rng = np.random.default_rng(12)
    v = rng.integers(-40, 41, (900, 6))
    v[:300] += 400  # near the queries below
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], "id long, v array<bigint>")
    queries = df.where("id < 240 AND id % 2 = 0")
    monkeypatch.setattr(knn, "LEAST_BLOCK", 32)
    monkeypatch.setattr(knn, "QUERIES_AT_ONCE", 10**9)
    want = sorted(tuple(r) for r in knn.top_k(df, queries, pivots=24).collect())
    scores = v[:240:2] @ v.T
    scores[np.arange(120), np.arange(0, 240, 2)] = -(10**15)
    best = np.array([np.lexsort((np.arange(900), -s))[:5] for s in scores])
    assert want == sorted((2 * q, k + 1, int(best[q, k]), int(scores[q, best[q, k]])) for q in range(120) for k in range(5))
    monkeypatch.setattr(knn, "QUERIES_AT_ONCE", 7)
    assert sorted(tuple(r) for r in knn.top_k(df, queries, pivots=24).collect()) == want
