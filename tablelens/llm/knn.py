"""Exact top-k inner-product search as a Voronoi kNN join.

Inner product is turned into distance: with M the largest norm, data x become
(x, sqrt(M^2 - |x|^2)) and queries (q, 0), so the nearest point has the largest
product.  Then

1. pivots: the vectors with the least hash of their components;
2. every vector joins the cell of its nearest pivot; a cell's summary is its
   size, its least and greatest distance to the pivot and the k+1 least ones;
3. summaries bound each query's k-th distance from above
   (|q p| + |p x| over all summarised x), and each cell's distances from below
   (|q p| minus the cell's radius);
4. neighbouring cells form groups, a group of many rows is cut into blocks,
   and a query goes only to the groups that the bounds cannot exclude;
5. the queries of a group are dealt into parts, as many as their number calls
   for, and a block is copied once for each part of its own group; each (block,
   part) is solved by one exact integer product, and the blocks' best k are
   merged.

Of equal vectors only the k+1 smallest ids can be among a query's best, so
the rest never leave the window that finds them.  The driver holds pivots and
their summaries only: the square root of the rows, at least ``PIVOTS`` and at
most ``MOST_PIVOTS``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import materialize

PIVOTS, MOST_PIVOTS = 256, 4096
LEAST_BLOCK, MOST_BLOCK = 512, 16_384
QUERIES_AT_ONCE = 16_384


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id long, v array<long>) with ``floor(scale * x)`` components.

    Null ids and vectors that are null or hold a null or non-finite component
    are left out.  Repeated rows count once; an id with several vectors keeps
    the least of them.
    """
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return rows.select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows x dim int64; shorter vectors are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


class _Space:
    """Augmented Euclidean space of the data and of the queries."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most = most
        self.pivots = self.augmented(pivots)

    def augmented(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return np.concatenate([x, last[:, None]], axis=1)

    def to_pivots(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        y = self.augmented(x, query)
        square = (y * y).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def _summaries(data: DataFrame, space: _Space, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per cell: rows, least and greatest distance, and the k+1 least ones (inf where there are fewer)."""

    def summarise(batches):
        for batch in batches:
            distance = space.to_pivots(_matrix(batch.column("v"), dim))
            cell = distance.argmin(axis=1)
            own = distance[np.arange(len(cell)), cell]
            order = np.lexsort((own, cell))
            cell, own = cell[order], own[order]
            first = np.searchsorted(cell, cell, "left")
            place = np.arange(len(cell)) - first
            after = np.searchsorted(cell, cell, "right")
            keep = place <= k
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[keep], pa.int32()), pa.array(own[keep]), pa.array(own[after - 1][keep]),
                 pa.array(np.where(place == 0, after - first, 0)[keep])], names=["cell", "near", "far", "n"])

    kept = materialize(data.mapInArrow(summarise, "cell int, near double, far double, n long"))
    nearest = Window.partitionBy("cell").orderBy("near")
    rows = (
        kept.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
        .groupBy("cell").agg(F.array_sort(F.collect_list("near")).alias("near"))
        .join(kept.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")), "cell").collect()
    )
    size = np.zeros(len(space.pivots), np.int64)
    least, greatest = np.full(len(size), np.inf), np.full(len(size), -np.inf)
    near = np.full((len(size), k + 1), np.inf)
    for r in rows:
        size[r["cell"]], greatest[r["cell"]], least[r["cell"]] = r["n"], r["far"], r["near"][0]
        near[r["cell"], :len(r["near"])] = r["near"]
    return size, least, greatest, near


def _groups(space: _Space, size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each cell (neighbours along the pivots' main axis, about ``rows`` rows each), and blocks of each group."""
    centred = space.pivots - space.pivots.mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    group, held, number = np.zeros(len(size), np.int64), 0, 0
    for cell in np.argsort(centred @ axis, kind="stable"):
        if held and held + size[cell] > rows:
            number, held = number + 1, 0
        group[cell] = number
        held += size[cell]
    total = np.bincount(group, weights=size, minlength=number + 1)
    return group, np.maximum(1, np.ceil(total / rows)).astype(np.int64)


def part_of(ids: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """Part of each query (of ``parts``, a number or one a query), by a mixed hash of its id, so ids with a common divisor spread too."""
    x = ids.astype(np.int64).view(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return ((x >> np.uint64(32)) % np.asarray(parts, np.uint64)).astype(np.int64)


def _best(data_ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, id, score) of each query's best k in this block; ties to the smaller id."""
    order = np.argsort(data_ids)
    data_ids, data = data_ids[order], data[order]
    bound = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, data.shape[1])
    kind = np.float64 if bound < 2**53 else np.int64  # both exact
    data_t = data.astype(kind).T
    for at in range(0, len(queries), 512):
        ids = query_ids[at:at + 512]
        score = queries[at:at + 512].astype(kind) @ data_t
        score = score.astype(np.int64)
        own = ids[:, None] == data_ids[None, :]
        score[own] = np.iinfo(np.int64).min
        n = min(k, score.shape[1])
        edge = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        row, column = np.nonzero((score >= edge[:, None]) & ~own)
        value = score[row, column]
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < n
        yield ids[row[keep]], data_ids[column[keep]], value[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None) -> DataFrame:
    """For each query its ``k`` largest integer inner products with the rows
    of ``vectors`` of another id: query_id, rank (from 1), vec_id, score.

    Both inputs: (id long, v array<long>), as :func:`quantized` gives them.
    Ties go to the smaller id; a query with fewer candidates gets them all; a
    shorter vector counts as padded with zeros.  Empty inputs give no rows.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    data = materialize(vectors.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n_data, dim, most = data.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    asked = materialize(queries.select("id", "v"))
    n_queries, query_dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n_data or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, query_dim)
    pivots = pivots or int(np.clip(np.sqrt(n_data), PIVOTS, MOST_PIVOTS))
    chosen = data.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    space = _Space(np.array([r["v"] + [0] * (dim - len(r["v"])) for r in chosen], np.int64).reshape(len(chosen), dim), float(most))
    size, least, greatest, near = _summaries(data, space, dim, k)
    rows = int(np.clip(n_data // 128, LEAST_BLOCK, MOST_BLOCK))
    group, blocks = _groups(space, size, rows)
    slack = 1e-6 * (1 + np.sqrt(most))  # of floating point, in distances

    def reached(batches):
        """(batch of at most 1,024 queries, query number, group) for every group that the bounds cannot exclude."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                distance = space.to_pivots(_matrix(piece.column("v"), dim), query=True)
                bounds = (distance[:, :, None] + near[None, :, :]).reshape(len(distance), -1)
                kth = min(k, bounds.shape[1] - 1)
                limit = np.partition(bounds, kth, axis=1)[:, kth] + slack  # of the k+1 nearest, one may be the query itself
                gap = np.maximum(distance - greatest[None, :], least[None, :] - distance)
                row, cell = np.nonzero((gap <= limit[:, None]) & (size > 0)[None, :])
                yield piece, *np.unique(np.stack([row, group[cell]]), axis=1)

    def count(batches):
        total = np.zeros(len(blocks), np.int64)
        for _, _, g in reached(batches):
            total += np.bincount(g, minlength=len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(total)], names=["g", "n"])

    parts = np.ones(len(blocks), np.int64)  # of each group's queries
    for r in asked.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        parts[r["g"]] = max(1, -(-r["n"] // QUERIES_AT_ONCE))

    def deal_data(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            cells = space.to_pivots(_matrix(batch.column("v"), dim)).argmin(axis=1)
            g = group[cells]
            block = ids % blocks[g]
            again = np.repeat(np.arange(len(ids)), parts[g])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[g]) - parts[g], parts[g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[again]), pa.array(block[again]), pa.array(part), *(batch.column(c).take(pa.array(again)) for c in ("id", "v"))],
                names=["g", "b", "p", "id", "v"])

    def deal_queries(batches):
        for piece, row, g in reached(batches):
            again = np.repeat(np.arange(len(row)), blocks[g])
            block = np.arange(len(again)) - np.repeat(np.cumsum(blocks[g]) - blocks[g], blocks[g])
            row, g = row[again], g[again]
            ids = piece.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(block), pa.array(part_of(ids[row], parts[g])),
                 *(piece.column(c).take(pa.array(row)) for c in ("id", "v"))], names=["g", "b", "p", "id", "v"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = list(_best(left.column("id").to_numpy(), _matrix(left.column("v"), dim),
                               right.column("id").to_numpy(), _matrix(right.column("v"), dim), k))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])

    dealt = "g long, b long, p long, id long, v array<long>"
    partial = (
        data.mapInArrow(deal_data, dealt).groupBy("g", "b", "p")
        .cogroup(asked.mapInArrow(deal_queries, dealt).groupBy("g", "b", "p"))
        .applyInArrow(solve, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
