"""Registered queries: correlation (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators.corr import chart_correlation, correlation_columns, correlation_matrix, correlation_with_target
from tablelens.plans.catalog import query, table

_COLS = ["l_quantity", "l_extendedprice", "d", "l_tax", "one"]
_SRC = """b AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.05) AS d, l_tax, 1.0 AS one FROM lineitem)"""


def _base(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.05)).alias("d"), "l_tax",
        F.lit(1.0).alias("one"), "l_returnflag",
    )


def _r(a, b):
    # "+ 0.0" turns a rounded -0.0 into 0.0 (Spark's round never gives -0.0).
    return f"(round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 2) + 0.0)"


_pairs = [(a, b) for a in _COLS for b in _COLS]


@query("correlation_matrix", f"WITH {_SRC}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_r(a, b)} AS r FROM b" for a, b in _pairs))
def q_corr_matrix(spark, sf):
    """G1: pairwise-complete Pearson matrix with a constant column and nulls."""
    df = _base(spark, sf)
    return correlation_matrix(df, correlation_columns(df, _COLS))


_targets = [c for c in _COLS if c != "l_extendedprice"]


@query("correlation_with_target", f"WITH {_SRC}, t AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {_r('l_extendedprice', c)} AS r FROM b" for c in _targets
) + """)
SELECT "column", r, CAST(row_number() OVER (ORDER BY r DESC NULLS LAST, "column") - 1 AS INTEGER) AS position FROM t""")
def q_corr_target(spark, sf):
    """Correlations with the price column, largest first."""
    df = _base(spark, sf)
    return correlation_with_target(df, "l_extendedprice", _COLS)


@query("chart_correlation", f"WITH {_SRC}, m AS (\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_r(a, b)} AS r FROM b" for a, b in _pairs) + """)
SELECT 'matrix' AS part, col_a, col_b, r, CAST(NULL AS INTEGER) AS position FROM m
UNION ALL
SELECT 'bar', col_a, col_b, r,
       CAST(row_number() OVER (PARTITION BY col_a ORDER BY r DESC NULLS LAST, col_b) - 1 AS INTEGER)
FROM m WHERE col_a IN ('l_quantity', 'l_tax') AND col_a <> col_b""")
def q_chart_correlation(spark, sf):
    """The matrix and the bars of correlations with X and Y, computed once."""
    matrix, bars = chart_correlation(_base(spark, sf), _COLS, "l_quantity", "l_tax")
    bars = bars.select(F.lit("bar").alias("part"), F.col("target").alias("col_a"), F.col("column").alias("col_b"), "r", "position")
    return matrix.select(F.lit("matrix").alias("part"), "col_a", "col_b", "r", F.lit(None).cast("int").alias("position")).unionByName(bars)


@query("correlation_constant", """
SELECT a AS col_a, b AS col_b, CASE WHEN a = 'l_tax' AND b = 'l_tax' THEN CAST(1 AS DOUBLE) END AS r
FROM (SELECT unnest(['l_tax', 'tenth']) AS a), (SELECT unnest(['l_tax', 'tenth']) AS b)
WHERE (SELECT count(*) FROM lineitem) > 0
""")
def q_corr_constant(spark, sf):
    """G1: a constant that binary fractions cannot hold still has no correlation."""
    return correlation_matrix(table(spark, sf, "lineitem").select("l_tax", F.lit(0.1).alias("tenth")))
