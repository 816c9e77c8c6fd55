"""Binning a numeric column into a group column.

Edges come from one small aggregate job (min/max, exact quantiles by
segmented scan or, with an ``accuracy``, quantiles of a sketch) and are
injected as literals; assigning a row to a bin is then a pure expression (no
join, no shuffle).  Bins are right-closed with
the lowest edge included, like interval labels ``(a, b]``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.constants import BIN_COLUMN_PREFIX
from tablelens.operators.scan import group_quantiles, rank_error, sketched_quantiles
from tablelens.sources.schema import drop_derived, num


def equal_width_edges(lo: float, hi: float, k: int) -> list[float]:
    """``k`` equal intervals over [lo, hi]; first edge lowered by 0.1 %
    of the range (a constant column is widened by 0.1 % on both sides)."""
    if lo == hi:
        lo = lo - 0.001 * abs(lo) if lo != 0 else lo - 0.001
        hi = hi + 0.001 * abs(hi) if hi != 0 else hi + 0.001
        return [float(v) for v in np.linspace(lo, hi, k + 1)]
    edges = np.linspace(lo, hi, k + 1)
    edges[0] -= (hi - lo) * 0.001
    return [float(v) for v in edges]


def dedupe_edges(edges) -> list[float]:
    """D3: equal neighbouring edges merge (fewer bins)."""
    out: list[float] = []
    for e in edges:
        if not out or e != out[-1]:
            out.append(float(e))
    return out


def _shown(x: float, places: int) -> float:
    """``x`` to ``places`` decimals, halves away from zero as in SQL's round; below 1 in size, to ``places`` significant digits."""
    if abs(x) < 1:
        return float(format(x, f".{places}g"))
    scaled = abs(x) * 10.0**places
    return math.copysign(math.floor(scaled + 0.5) / 10.0**places, x) if scaled < 2**52 else float(x)  # beyond: no such digits


def interval_labels(edges: list[float], precision: int = 3) -> list[str]:
    """``"(a, b]"`` labels.

    Edges are shown with the fewest places, from ``precision`` on, that keep
    them all distinct; the first one is moved down by one unit of the last
    place, as the lowest value belongs to the first bin.
    """
    for places in range(precision, 21):
        shown = [_shown(e, places) for e in edges]
        if len(set(shown)) == len(edges):
            break
    else:
        return interval_labels_of([float(e) for e in edges])
    shown[:1] = [e - 10**-places for e in shown[:1]]
    return interval_labels_of(shown)


def interval_labels_of(edges: list[float]) -> list[str]:
    return [f"({a!r}, {b!r}]" for a, b in zip(edges, edges[1:])]


def bin_ordinal(x: Column, edges: list[float]) -> Column:
    """1-based right-closed bin of ``x`` (NULL outside ``[e0, e_last]``)."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    idx = F.lit(1)
    for e in edges[1:-1]:
        idx = idx + (x > F.lit(e)).cast("int")
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, idx)


def bin_label(x: Column, edges: list[float], labels: list[str]) -> Column:
    if not labels:
        return F.lit(None).cast("string")
    # A CASE chain over at most 20 labels.  (element_at(array, idx) with a
    # NULL idx at run time was seen to return the previous row's element in
    # generated code, so it is not used here.)
    o = bin_ordinal(x, edges)
    out = F.when(o == F.lit(1), F.lit(labels[0]))
    for i, s in enumerate(labels[1:], start=2):
        out = out.when(o == F.lit(i), F.lit(s))
    return out


def compute_edges(df: DataFrame, column: str, k: int, method: str = "count", accuracy: int | None = None) -> list[float]:
    """Edges for ``k`` bins of ``column`` (deduplicated), from one small job.

    Equal-count edges are exact, or with an ``accuracy`` values whose ranks are
    off by at most 1 / ``accuracy`` of the rows.
    """
    x = num(column)
    if method == "width":
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        if r["lo"] is None:
            return []
        return dedupe_edges(equal_width_edges(float(r["lo"]), float(r["hi"]), k))
    if method == "count":
        probs = [i / k for i in range(k + 1)]
        values = df.select(x.alias("__tl_x"))
        found = sketched_quantiles(values, [], "__tl_x", probs, accuracy=accuracy) if accuracy else group_quantiles(values, [], "__tl_x", probs)
        q = found.first()
        if q is None:
            return []
        return dedupe_edges([q[f"q{i}"] for i in range(k + 1)])
    raise ValueError(f"unknown binning method {method!r}")


def bin_column(
    df: DataFrame,
    column: str,
    k: int = 5,
    method: str = "count",
    labels: str = "interval",
    out: str | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """D1/D2 (+D4/D5): add ``Группа({column})`` holding each row's bin.

    ``labels="interval"`` gives ``(a, b]`` text; ``"index"`` the 1-based bin
    ordinal as text.  Earlier bin columns of any source are dropped first.
    Missing input -> missing bin.  ``accuracy`` makes equal-count edges
    approximate (:func:`compute_edges`).
    """
    if column not in df.columns or k is None or int(k) < 2:
        return df
    k = int(k)
    base = drop_derived(df, "bins")
    edges = compute_edges(base, column, k, method, accuracy)
    name = out or f"{BIN_COLUMN_PREFIX}{column})"
    x = num(column)
    if labels == "index":
        expr = bin_ordinal(x, edges).cast("string")
    else:
        expr = bin_label(x, edges, interval_labels(edges))
    return base.withColumn(name, expr)


def edge_rank_errors(df: DataFrame, column: str, edges: list[float], probs: list[float]) -> DataFrame:
    """(edge, value, rank_error): how far each edge's true rank is from ``probs[edge]``, as a share of the values.

    One aggregate pass, two counts an edge.
    """
    x = num(column)
    counts = df.agg(F.count(x).alias("n"), *[F.count(F.when(x < F.lit(e), 1)).alias(f"b{i}") for i, e in enumerate(edges)],
                    *[F.count(F.when(x <= F.lit(e), 1)).alias(f"u{i}") for i, e in enumerate(edges)])
    cells = [F.struct(F.lit(i).alias("edge"), F.lit(float(e)).alias("value"), rank_error(F.col(f"b{i}"), F.col(f"u{i}"), F.col("n"), p).alias("rank_error"))
             for i, (e, p) in enumerate(zip(edges, probs))]
    return counts.where("n > 0").select(F.inline(F.array(*cells)))
