"""Mean silhouette with plain Euclidean distances.

A sum of distances does not decompose into sums per cluster.  Equal points of
equal labels are one row with a weight.  From ``TREE_BLOCKS`` blocks of rows on,
points of at most two columns go by the tree of cells of
:mod:`tablelens.operators.distance_sums`, whose sums have a relative error of at
most 1e-11 and whose work grows about as the points do.

Fewer points, or points of three columns and more, are measured pair by pair:
rows are dealt by a hash of their number into blocks of about
``BLOCK_ROWS``; a task gets one pair of blocks (i <= j), so the pairs form a
triangle and each distance is computed once.  What leaves a task is one row a
point: its summed distances to every cluster among the other block.  No pair
leaves a task, and a task holds two blocks and a slice of distances, whatever
the number of rows, clusters or equal points.  Several labellings of the same
points (an elbow's) share the distances.

That work grows with the square of the number of distinct points; for tables
of three columns and some millions of them take the squared form of
:mod:`tablelens.operators.cluster`, which needs one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.distance_sums import LEAF_ROWS, distance_sums
from tablelens.session import materialize
from tablelens.sources.schema import quote

BLOCK_ROWS = 8192
SLICE_ROWS = 256
TREE_BLOCKS = 4  # from so many blocks on, points of two columns go by the tree


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances from differences: near points keep all their digits."""
    square = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        square += (a[:, None] - b[None, :]) ** 2
    return np.sqrt(square)


def _block_sums(x: np.ndarray, y: np.ndarray, x_of: np.ndarray, y_of: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed distances of each x to the clusters of y and of each y to those of x (``same``: x is y, only the first).

    ``x_of``, ``y_of``: points x clusters, the weight where a point belongs to the cluster.
    """
    left, right = np.zeros((len(x), y_of.shape[1])), np.zeros((len(y), x_of.shape[1]))
    for at in range(0, len(x), SLICE_ROWS):
        part = slice(at, at + SLICE_ROWS)
        d = _distances(x[part], y)
        left[part] = d @ y_of
        if not same:
            right += d.T @ x_of[part]
    return left, right


def _scores(sums: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouette of each point from its summed distances to the clusters of one labelling."""
    row = np.arange(len(sums))
    inner = sums[row, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes[None, :]
    means[row, own] = np.inf
    other = means.min(axis=1)
    most = np.maximum(inner, other)
    score = np.divide(other - inner, most, out=np.zeros(len(sums)), where=most > 0)
    return np.where(sizes[own] > 1, score, 0.0)


def _near_sums(x: np.ndarray, y: np.ndarray, y_of: np.ndarray) -> np.ndarray:
    return _block_sums(x, y, np.zeros((len(x), 0)), y_of, True)[0]


def _by_blocks(coded: DataFrame, xs: list[str], names: list[str], sums: list[str], blocks: int) -> DataFrame:
    """Each point's summed distances to every cluster, from all pairs of blocks."""
    total = len(sums)
    copies = coded.withColumn("__tl_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).withColumns(
        {"__tl_i": F.least("__tl_block", "__tl_other"), "__tl_j": F.greatest("__tl_block", "__tl_other")})

    def measure(key, table):
        table = table.combine_chunks()
        x = np.column_stack([table.column(c).to_numpy() for c in xs])
        codes = np.column_stack([table.column(n).to_numpy() for n in names])
        of = np.zeros((len(x), total))
        of[np.arange(len(x))[:, None], codes] = table.column("__tl_weight").to_numpy()[:, None]
        first = table.column("__tl_block").to_numpy() == key[0].as_py()
        out = np.zeros((len(x), total))
        if key[0] == key[1]:
            out, _ = _block_sums(x, x, of, of, True)
        else:
            out[first], out[~first] = _block_sums(x[first], x[~first], of[first], of[~first], False)
        kept = [table.column(c) for c in ("__tl_id", "__tl_weight", *names)]
        return pa.table([*kept, *(pa.array(c) for c in np.ascontiguousarray(out.T))], names=["__tl_id", "__tl_weight", *names, *sums])

    fields = ["__tl_id long", "__tl_weight double", *(f"{n} int" for n in names), *(f"{s} double" for s in sums)]
    apart = copies.groupBy("__tl_i", "__tl_j").applyInArrow(measure, ", ".join(fields))
    if blocks > 1:
        apart = apart.groupBy("__tl_id").agg(*[F.first(c).alias(c) for c in ("__tl_weight", *names)], *[F.sum(s).alias(s) for s in sums])
    return apart


def _square_of(rows: DataFrame, xs: list[str]) -> tuple[list[float], float]:
    """The least coordinates and the side of the square that holds the points (not finite: NaN)."""
    ends = rows.agg(*[f(x).alias(f"{n}{x}") for x in xs for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = ([float(ends[f"{n}{x}"]) for x in xs] for n in ("lo", "hi"))
    side = max(h - lo for h, lo in zip(high, low))
    return low, side if np.isfinite([*low, *high, side]).all() else float("nan")


def euclidean_silhouettes(points: DataFrame, zcols: list[str], labels: list[str], weight: str | None = None,
                          block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> list[float | None]:
    """Mean silhouette of each labelling of the points (None: fewer than two clusters).

    A row counts ``weight`` times (once without).  Rows with a missing label
    are a cluster of their own; the only point of a cluster scores 0.
    """
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    names = [f"__tl_l{i}" for i in range(len(labels))]
    merged = points.groupBy(*[F.col(z).alias(f"__tl_x{i}") for i, z in enumerate(zcols)], *[F.col(quote(c)).alias(n) for c, n in zip(labels, names)])
    rows = materialize(merged.agg(w.cast("double").alias("__tl_weight")).withColumn("__tl_id", F.monotonically_increasing_id()))
    clusters = [rows.groupBy(n).agg(F.sum("__tl_weight")).orderBy(n).collect() for n in names]  # one row a cluster
    ends = np.cumsum([0] + [len(c) for c in clusters])
    total, sizes = int(ends[-1]), [np.array([r[1] for r in c], float) for c in clusters]
    blocks = max(1, -(-rows.count() // block_rows))

    def code(i):  # the cluster's number among those of all labellings
        e = F.lit(None).cast("int")
        for at, r in enumerate(clusters[i]):
            e = F.when(F.col(names[i]).eqNullSafe(F.lit(r[0])), F.lit(int(ends[i]) + at)).otherwise(e)
        return e.alias(names[i])

    xs = [f"__tl_x{i}" for i in range(len(zcols))]
    coded = rows.select("__tl_id", "__tl_weight", *xs, *[code(i) for i in range(len(names))], F.pmod(F.xxhash64("__tl_id"), F.lit(blocks)).alias("__tl_block"))
    sums = [f"s{c}" for c in range(total)]
    low, side = _square_of(rows, xs) if blocks >= TREE_BLOCKS and len(xs) <= 2 else ([], float("nan"))
    if side > 0:
        apart = distance_sums(coded.drop("__tl_block"), xs, "__tl_weight", names, total, low, side, _near_sums, leaf_rows)
        apart = apart.join(coded.select("__tl_id", "__tl_weight", *names), "__tl_id")
    else:
        apart = _by_blocks(coded, xs, names, sums, blocks)

    def score(batches):
        found = np.zeros(len(names))
        for batch in batches:
            of_row, many = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]) for cols in (sums, ["__tl_weight"]))
            for i, n in enumerate(names):
                if len(sizes[i]) > 1:
                    own = batch.column(n).to_numpy(zero_copy_only=False) - ends[i]
                    found[i] += (_scores(of_row[:, ends[i]:ends[i + 1]], own, sizes[i]) * many[:, 0]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(found)], names=["labelling", "total"])

    got = apart.mapInArrow(score, "labelling long, total double").groupBy("labelling").agg(F.sum("total").alias("total")).collect()
    got = {r["labelling"]: r["total"] for r in got}
    return [float(got[i] / s.sum()) if len(s) > 1 else None for i, s in enumerate(sizes)]
