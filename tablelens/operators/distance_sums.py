"""Sums of plain distances from every point to every cluster, by a tree of cells.

The points' square is halved into cells until each leaf holds at most
``LEAF_ROWS`` points.  Pairs of cells are taken apart from the root down, a
Spark join a level: two cells with a gap of at least the larger side are
``far``, two touching leaves are ``near``.  Near leaves are measured point by
point.  For far cells the distance is a smooth function of both ends, so the
clusters' weights are moved to ``NODES`` Chebyshev nodes a dimension of the
source cell, measured against the nodes of the target cell, and read off at its
points by interpolation.

Every distance, and so every sum, has a relative error of at most 1e-11 (6e-12
at the smallest gap allowed); a silhouette is off by at most twice that.  No
point is left out or capped, and labels are arbitrary.  A cell has a bounded
number of far and near partners, so the work grows with the points times the
tree's depth, not with their square.  Cells are shuffled rows; a group is one
leaf, or a few partners of a cell.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import checked_broadcast, materialize

LEAF_ROWS = 2048
NODES = 16       # a dimension
DEPTH = 48       # halvings at most: cells as narrow as a double's digits
LEVELS_AT_ONCE = 3
NEAR_AT_ONCE = 16
FAR_AT_ONCE = 64


def _key(level, cells: list[Column]) -> Column:
    return F.concat_ws("/", F.lit(level).cast("string"), *[c.cast("string") for c in cells])


def _at(level: int, d: int, deepest: int = DEPTH) -> list[Column]:
    return [F.shiftright(f"__tl_c{i}", deepest - level) for i in range(d)]


def _tree(rows: DataFrame, d: int, leaf_rows: int) -> tuple[DataFrame, list[int]]:
    """(parent, key, leaf, width, low0..) of the first halves and every cell whose parent holds more than
    ``leaf_rows`` points, a leaf once more as its own child; and the levels that have leaves."""
    cells, levels, active, top = [], [], rows, 0
    names = [f"__tl_c{i}" for i in range(d)]
    while True:
        deep = min(top + LEVELS_AT_ONCE, DEPTH)
        fine = materialize(active.groupBy(*[c.alias(n) for c, n in zip(_at(deep, d), names)]).agg(F.count(F.lit(1)).alias("n")))
        for level in range(top + 1, deep + 1):
            at = fine.groupBy(*[c.alias(n) for c, n in zip(_at(level, d, deep), names)]).agg(F.sum("n").alias("n"))
            parents = [F.shiftright(n, 1) for n in names]
            at = at.withColumn("__tl_of_parent", F.sum("n").over(Window.partitionBy(*parents))).where((F.col("__tl_of_parent") > leaf_rows) | F.lit(level == 1))
            cells.append(at.select(
                _key(level - 1, parents).alias("parent"), _key(level, [F.col(n) for n in names]).alias("key"),
                (F.lit(level == DEPTH) | (F.col("n") <= leaf_rows)).alias("leaf"), F.lit(level).alias("level"), F.lit(1 << (DEPTH - level)).cast("long").alias("width"),
                *[F.shiftleft(n, DEPTH - level).alias(f"low{i}") for i, n in enumerate(names)]))
        heavy, _ = checked_broadcast(fine.where(F.col("n") > leaf_rows).select(*[F.col(n).alias(f"__tl_h{i}") for i, n in enumerate(names)]))
        if deep == DEPTH or heavy.isEmpty():
            break
        on = [c == F.col(f"__tl_h{i}") for i, c in enumerate(_at(deep, d))]
        active, top = rows.join(heavy, on, "left_semi"), deep
    found = materialize(functools.reduce(DataFrame.unionAll, cells))
    levels = [r[0] for r in found.where("leaf").select("level").distinct().collect()]  # at most DEPTH
    return found.unionAll(found.where("leaf").withColumn("parent", F.col("key"))).drop("level"), levels


def _pairs(kids: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of far cells and of near leaves, both ways round."""
    kids, _ = checked_broadcast(kids)
    fields = ["parent", "key", "leaf", "width", *(f"low{i}" for i in range(d))]
    left, right = (kids.select(*[F.col(f).alias(f"{side}_{f}") for f in fields]) for side in "ab")
    gap = F.greatest(*[F.greatest(F.col(f"a_low{i}") - F.col(f"b_low{i}") - F.col("b_width"), F.col(f"b_low{i}") - F.col(f"a_low{i}") - F.col("a_width"))
                       for i in range(d)], F.lit(0).cast("long"))
    far, near, root = [], [], "/".join(["0"] * (d + 1))
    todo = kids.sparkSession.range(1).select(F.lit(root).alias("a"), F.lit(root).alias("b"))
    while True:
        made = todo.join(left, F.col("a") == F.col("a_parent")).join(right, F.col("b") == F.col("b_parent"))
        made = materialize(made.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), (gap >= F.greatest("a_width", "b_width")).alias("apart"),
                                       (F.col("a_leaf") & F.col("b_leaf")).alias("leaves")))
        far.append(made.where("apart").select("a", "b"))
        near.append(made.where("NOT apart AND leaves").select("a", "b"))
        todo = made.where("NOT apart AND NOT leaves").select("a", "b")
        if todo.isEmpty():
            return functools.reduce(DataFrame.unionAll, far), functools.reduce(DataFrame.unionAll, near)


def _in_pieces(pairs: DataFrame, at_once: int) -> DataFrame:
    """``pairs`` with a number that deals the partners of ``a`` into groups of about ``at_once``."""
    many = F.count(F.lit(1)).over(Window.partitionBy("a"))
    return pairs.withColumn("piece", F.pmod(F.xxhash64("b"), F.ceil(many / at_once)))


@functools.cache
def _nodes(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev nodes of [-1, 1]^d, and the matrix that turns Chebyshev polynomials of one dimension into weights of its nodes."""
    t = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    weights = chebvander(t, NODES - 1) * (2 / NODES)
    weights[:, 0] /= 2
    return np.stack(np.meshgrid(*[t] * d, indexing="ij"), -1).reshape(-1, d), weights


def _basis(x: np.ndarray) -> np.ndarray:
    """Points of [-1, 1]^d x nodes: the interpolation weights."""
    out = np.ones((len(x), 1))
    for column in x.T:
        one = chebvander(np.clip(column, -1, 1), NODES - 1) @ _nodes(x.shape[1])[1].T
        out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
    return out


def _box(key: str, low: np.ndarray, side: float) -> tuple[np.ndarray, float]:
    """Middle and half the side of a cell."""
    level, *cell = map(int, key.split("/"))
    half = side * 0.5 ** (level + 1)
    return low + half * (2 * np.array(cell, float) + 1), half


def _ancestors(key: str) -> list[str]:
    """The cell and those above it that can be far from another (level 2 on)."""
    level, *cell = map(int, key.split("/"))
    return ["/".join(map(str, (at, *(c >> (level - at) for c in cell)))) for at in range(2, level + 1)]


def _sum_nodes(parts: DataFrame, sums: list[str]) -> DataFrame:
    """(key, packed): the node values of each cell added up, as bytes of a nodes x clusters matrix."""
    def pack(table):
        table = table.combine_chunks().sort_by("node")
        values = np.column_stack([table.column(s).to_numpy() for s in sums])
        return pa.table([table.column("key")[:1], pa.array([values.tobytes()], pa.binary())], names=["key", "packed"])

    return parts.groupBy("key", "node").agg(*[F.sum(s).alias(s) for s in sums]).groupBy("key").applyInArrow(pack, "key string, packed binary")


def _node_rows(keys: list[str], values: list[np.ndarray], sums: list[str]) -> pa.Table:
    count = [len(v) for v in values]
    every = np.concatenate(values) if values else np.zeros((0, len(sums)))
    node = np.concatenate([np.arange(n) for n in count]) if count else np.zeros(0, int)
    return pa.table([pa.array(np.repeat(np.array(keys, object), count).tolist(), pa.string()), pa.array(node, pa.int32()),
                     *(pa.array(c) for c in np.ascontiguousarray(every.T))], names=["key", "node", *sums])


def distance_sums(rows: DataFrame, xs: list[str], weight: str, labels: list[str], clusters: int, low: list[float], side: float,
                  near_sums, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(__tl_id, s0..): each point's summed distances to every cluster.

    ``rows``: different points with ``__tl_id``, coordinates, a weight and one
    cluster number a labelling, all within ``side`` of ``low``.
    ``near_sums(x, y, y_of)`` measures points directly.
    """
    d, sums, origin = len(xs), [f"s{c}" for c in range(clusters)], np.array(low)
    cell = [F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit(side) * F.lit(float(1 << DEPTH))), F.lit((1 << DEPTH) - 1)).cast("long") for x, lo in zip(xs, low)]
    rows = materialize(rows.withColumns({f"__tl_c{i}": c for i, c in enumerate(cell)}))
    kids, levels = _tree(rows, d, leaf_rows)
    leaves, _ = checked_broadcast(kids.where("leaf").select(F.col("key").alias("leaf")).distinct())
    keys = F.explode(F.array(*[_key(level, _at(level, d)) for level in levels]))
    placed = materialize(rows.select("__tl_id", weight, *xs, *labels, keys.alias("leaf")).join(leaves, "leaf"))
    far, near = _pairs(kids, d)

    def points(table):
        x = np.column_stack([table.column(c).to_numpy() for c in xs])
        of = np.zeros((len(x), clusters))
        codes = np.column_stack([table.column(n).to_numpy() for n in labels])
        of[np.arange(len(x))[:, None], codes] = table.column(weight).to_numpy()[:, None]
        return x, of

    def sources(key, table):
        x, of = points(table.combine_chunks())
        cells = _ancestors(key[0].as_py())
        values = []
        for c in cells:
            middle, half = _box(c, origin, side)
            values.append(_basis((x - middle) / half).T @ of)
        return _node_rows(cells, values, sums)

    node_rows = "key string, node int, " + ", ".join(f"{s} double" for s in sums)
    moments = _sum_nodes(placed.groupBy("leaf").applyInArrow(sources, node_rows), sums)

    def across(key, table):
        target, total = key[0].as_py(), 0.0
        middle, half = _box(target, origin, side)
        grid, _ = _nodes(d)
        for b, packed in zip(table.column("b").to_pylist(), table.column("packed").to_pylist()):
            other, wide = _box(b, origin, side)
            apart = np.zeros((len(grid), len(grid)))
            for m, o, t in zip(middle, other, grid.T):
                apart += ((m - o) + half * t[:, None] - wide * t[None, :]) ** 2
            total = total + np.sqrt(apart) @ np.frombuffer(packed).reshape(len(grid), clusters)
        return _node_rows([target], [total], sums)

    met = _in_pieces(far, FAR_AT_ONCE).join(moments.withColumnRenamed("key", "b"), "b").select("a", "piece", "b", "packed")
    fields = _sum_nodes(met.groupBy("a", "piece").applyInArrow(across, node_rows), sums)

    def read_off(rows_of, cells_of):
        x, _ = points(rows_of.combine_chunks())
        total = np.zeros((len(x), clusters))
        for c, packed in zip(cells_of.column("key").to_pylist(), cells_of.column("packed").to_pylist()):
            middle, half = _box(c, origin, side)
            total += _basis((x - middle) / half) @ np.frombuffer(packed).reshape(-1, clusters)
        return pa.table([rows_of.column("__tl_id"), *(pa.array(c) for c in np.ascontiguousarray(total.T))], names=["__tl_id", *sums])

    above = F.udf(lambda key: _ancestors(key), "array<string>")
    wanted = leaves.select("leaf", F.explode(above("leaf")).alias("key")).join(fields, "key")
    result = "__tl_id long, " + ", ".join(f"{s} double" for s in sums)
    from_far = placed.groupBy("leaf").cogroup(wanted.groupBy("leaf")).applyInArrow(read_off, result)

    columns = ["__tl_id", weight, *xs, *labels]
    packs = materialize(placed.groupBy("leaf").agg(F.collect_list(F.struct(*columns)).alias("held")))
    pieces = _in_pieces(near, NEAR_AT_ONCE)
    pieces = pieces.withColumn("own", F.lit(False)).unionAll(
        pieces.select("a", F.col("a").alias("b"), "piece").distinct().withColumn("own", F.lit(True)).select("a", "b", "piece", "own"))

    def beside(key, table):
        mine, others = (pa.Table.from_struct_array(table.filter(chosen).column("held").combine_chunks().flatten())
                        for chosen in (table.column("own"), pc.invert(table.column("own"))))
        (x, _), (y, of) = points(mine), points(others)
        total = near_sums(x, y, of)
        return pa.table([mine.column("__tl_id"), *(pa.array(c) for c in np.ascontiguousarray(total.T))], names=["__tl_id", *sums])

    beside_rows = pieces.join(packs.withColumnRenamed("leaf", "b"), "b").select("a", "piece", "own", "held")
    from_near = beside_rows.groupBy("a", "piece").applyInArrow(beside, result)
    return from_far.unionAll(from_near).groupBy("__tl_id").agg(*[F.sum(s).alias(s) for s in sums])
