"""Registered queries: binning (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators.binning import bin_column, compute_edges, edge_rank_errors
from tablelens.plans.catalog import query, table


def _width_sql(tbl, key_cols, x, k):
    edges = " + ".join(f"CASE WHEN {x} > lo + {i} * ((hi - lo) / {k}) THEN 1 ELSE 0 END" for i in range(1, k))
    keys = ", ".join(key_cols)
    return f"""SELECT {keys}, CAST(1 + {edges} AS VARCHAR) AS bin
FROM {tbl}, (SELECT min({x}) AS lo, max({x}) AS hi FROM {tbl})"""


def _count_sql(tbl, key_cols, x, k):
    probs = ", ".join(f"{i}/{k}" for i in range(k + 1))
    keys = ", ".join(key_cols)
    return f"""WITH e AS (SELECT list_sort(list_distinct(quantile_cont({x}, [{probs}]))) AS ed FROM {tbl})
SELECT {keys},
  CASE WHEN len(ed) < 2 THEN NULL
       ELSE CAST(1 + len(list_filter(ed[2:len(ed) - 1], lambda v: {x} > v)) AS VARCHAR) END AS bin
FROM {tbl}, e"""


def _spark(tbl, key_cols, x, k, method):
    def fn(spark, sf):
        df = table(spark, sf, tbl).select(*key_cols, x)
        out = bin_column(df, x, k, method=method, labels="index")
        return out.select(*key_cols, F.col(f"`Группа({x})`").alias("bin"))

    return fn


_LI_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey"]

for _name, _tbl, _keys, _x, _k, _m, _doc in [
    ("bin_equal_width", "lineitem", _LI_KEYS, "l_extendedprice", 5, "width", "D1: equal-width bins, right-closed."),
    ("bin_equal_count", "orders", ["o_orderkey"], "o_totalprice", 5, "count", "D2: equal-count (quantile) bins."),
    ("bin_dedupe_edges", "lineitem", _LI_KEYS, "l_discount", 20, "count", "D3: repeated quantile edges merge."),
    ("bin_index_labels", "lineitem", _LI_KEYS, "l_quantity", 7, "width", "D5: bins labelled by ordinal."),
]:
    _sql = (_width_sql if _m == "width" else _count_sql)(_tbl, _keys, _x, _k)
    _fn = _spark(_tbl, _keys, _x, _k, _m)
    _fn.__doc__ = _doc
    query(_name, _sql)(_fn)


def _label(i, k):
    low = "round(e[1], 3) - 0.001" if i == 1 else f"round(e[{i}], 3)"
    return f"'(' || CAST({low} AS VARCHAR) || ', ' || CAST(round(e[{i + 1}], 3) AS VARCHAR) || ']'"


@query("bin_interval_labels", f"""
WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= e[2] THEN {_label(1, 4)} WHEN o_totalprice <= e[3] THEN {_label(2, 4)}
  WHEN o_totalprice <= e[4] THEN {_label(3, 4)} ELSE {_label(4, 4)} END AS "Группа(o_totalprice)"
FROM orders, q
""")
def q_bin_interval_labels(spark, sf):
    """Interval text labels of equal-count bins of the order total."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return bin_column(o, "o_totalprice", 4, method="count")


@query("bin_equal_count_approx", """
SELECT CAST(i AS INTEGER) AS edge, CASE WHEN i = 0 THEN lo WHEN i = 10 THEN hi END AS "end", TRUE AS within
FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, unnest(range(11)) AS i FROM orders)
""")
def q_bin_equal_count_approx(spark, sf):
    """D2 from a sketch: ten bins, the true rank of every edge within 1 / 1000
    of the rows, the outer edges exact."""
    o = table(spark, sf, "orders").select("o_totalprice")
    edges = compute_edges(o, "o_totalprice", 10, "count", accuracy=1000)
    found = edge_rank_errors(o, "o_totalprice", edges, [i / 10 for i in range(11)])
    return found.select("edge", F.when(F.col("edge").isin(0, 10), F.col("value")).alias("end"), (F.col("rank_error") <= 0.001).alias("within"))
