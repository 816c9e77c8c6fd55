"""Start centroids by k-means|| over weighted points.

A start begins with one point, drawn by weight.  Each round adds the
``2 k`` points that win a race in which a point's time is exponential with rate
weight x squared distance to the start's candidates: a draw without
replacement by that product, in one pass and without knowing its total.  A
point already chosen has rate 0, so after ``ROUNDS`` rounds a start holds
``1 + 10 k`` different points, or all there are.  Candidates then get the
weight of the points nearest to them, and k-means++ on these few rows picks the
``k`` centroids of every model.

All starts share each pass.  Tasks send their ``2 k`` best a start; random
numbers are hashes of (seed, start, round, point), so the result depends on the
data alone, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 5
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


def _names(x: np.ndarray) -> np.ndarray:
    """A hash of each row's values."""
    out = np.full(len(x), 0x9E3779B97F4A7C15, np.uint64)
    for column in np.ascontiguousarray((x + 0.0).T):  # + 0.0: -0.0 is 0.0
        out = _mixed(out * np.uint64(3) + column.view(np.uint64))
    return out


def _times(names: np.ndarray, salt: int, rate: np.ndarray) -> np.ndarray:
    """Exponential times of the given rates (infinite at rate 0)."""
    bits = _mixed(names ^ _mixed(np.array([salt], np.uint64)))
    waits = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    return np.divide(waits, rate, out=np.full(len(rate), np.inf), where=rate > 0)


def _race(table: DataFrame, blocks: Callable, zcols: list[str], rates: Callable, salts: list[int], most: int) -> list[np.ndarray]:
    """For each start the at most ``most`` points of least time; ``rates(x, w)`` gives points x starts."""

    def run(batches):
        best = [(np.zeros(0), np.zeros((0, len(zcols)))) for _ in salts]
        for x, w in blocks(batches):
            names, rate = _names(x), rates(x, w)
            for s, salt in enumerate(salts):
                time = np.concatenate([best[s][0], _times(names, salt, rate[:, s])])
                points = np.concatenate([best[s][1], x])
                order = np.argsort(time, kind="stable")[:most]
                order = order[np.isfinite(time[order])]
                best[s] = time[order], points[order]
        start = np.repeat(np.arange(len(salts)), [len(t) for t, _ in best])
        points = np.concatenate([p for _, p in best])
        yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(np.concatenate([t for t, _ in best])), *(pa.array(c) for c in np.ascontiguousarray(points.T))],
                                         names=["start", "time", *zcols])

    sent = table.mapInArrow(run, "start long, time double, " + ", ".join(f"{z} double" for z in zcols))
    first = Window.partitionBy("start").orderBy("time", *zcols)
    rows = sent.withColumn("__tl_nth", F.row_number().over(first)).where(F.col("__tl_nth") <= most).orderBy("start", "__tl_nth").collect()
    return [np.array([[r[z] for z in zcols] for r in rows if r["start"] == s], float).reshape(-1, len(zcols)) for s in range(len(salts))]


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, seed: int, distances: Callable) -> np.ndarray:
    """k-means++ on weighted points; all different unless there are fewer than ``k``."""
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(len(points), p=weight / weight.sum())]
    near = distances(points, points[chosen])[:, 0]
    near[chosen] = 0.0
    while len(chosen) < k:
        rate = near * weight
        if rate.sum() > 0:
            at = rng.choice(len(points), p=rate / rate.sum())
        else:  # the rest is nearer than rounding tells; points first chosen last
            at = next((i for i in range(len(points)) if i not in chosen), rng.integers(len(points)))
        chosen.append(at)
        near = np.minimum(near, distances(points, points[[at]])[:, 0])
        near[chosen] = 0.0
    return points[chosen]


def uniform_starts(table: DataFrame, blocks: Callable, zcols: list[str], k: int, starts: int, seed: int) -> list[np.ndarray]:
    """``starts`` draws of ``k`` different points by weight alone (what k-means|| is measured against)."""
    salts = [(seed + s) * 64 + 63 for s in range(starts)]
    return _race(table, blocks, zcols, lambda x, w: np.repeat(w[:, None], starts, axis=1), salts, k)


def parallel_starts(table: DataFrame, blocks: Callable, counts: Callable, distances: Callable, zcols: list[str],
                    ks: list[int], starts: int, seed: int, rounds: int = ROUNDS) -> dict[tuple[int, int], np.ndarray]:
    """Start centroids of every model ``(k, start)``.

    ``blocks`` yields (points, weights) of a task's batches, ``counts`` gives
    the weight nearest to each centroid of several models in one pass.
    """
    most = 2 * max(ks)
    salt = lambda s, turn: (seed + s) * 64 + turn
    sets = _race(table, blocks, zcols, lambda x, w: np.repeat(w[:, None], starts, axis=1), [salt(s, 0) for s in range(starts)], 1)
    for turn in range(1, rounds + 1):
        ends = np.cumsum([0] + [len(c) for c in sets])
        every = np.concatenate(sets)

        def rates(x, w, every=every, ends=ends):
            square = distances(x, every)
            near = np.stack([square[:, lo:hi].min(axis=1) for lo, hi in zip(ends, ends[1:])], axis=1)
            return near * w[:, None]

        more = _race(table, blocks, zcols, rates, [salt(s, turn) for s in range(starts)], most)
        if not any(map(len, more)):
            break
        sets = [np.unique(np.concatenate([c, m]), axis=0) for c, m in zip(sets, more)]
    weights = counts(sets)
    return {(k, s): _plus_plus(sets[s], np.maximum(weights[s], 1e-9), k, seed + s, distances) for k in ks for s in range(starts)}
