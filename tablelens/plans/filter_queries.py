"""Registered queries: filters (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.predicates import equals_predicate, isin_predicate, range_predicate
from tablelens.operators.filters import (
    FilterSpec,
    apply_filters,
    drop_missing_all,
    drop_missing_any,
    filter_domain_range,
    filter_domain_values,
    filter_isin_long,
)
from tablelens.plans.catalog import query, table

_LI = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"]
SHIPDATES = ["1995-03-15", "1996-01-01", "1997-07-04", "1998-12-01", "2000-04-04"]


@query("filter_range", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag
FROM lineitem WHERE l_quantity BETWEEN 10 AND 20
""")
def q_filter_range(spark, sf):
    """B1: inclusive numeric range."""
    li = table(spark, sf, "lineitem")
    return li.filter(range_predicate(F.col("l_quantity"), 10, 20)).select(*_LI)


@query("filter_range_open", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag
FROM lineitem WHERE l_quantity >= 45
""")
def q_filter_range_open(spark, sf):
    """B1 with an open upper end."""
    li = table(spark, sf, "lineitem")
    return li.filter(range_predicate(F.col("l_quantity"), 45, None)).select(*_LI)


@query("filter_range_no_ends", """
SELECT l_orderkey, l_linenumber, l_suppkey, nullif(l_discount, 0.05) AS d FROM lineitem
""")
def q_filter_range_no_ends(spark, sf):
    """B1 without ends keeps every row, those with a missing value too."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.nullif("l_discount", F.lit(0.05)).alias("d"))
    return li.filter(range_predicate(F.col("d"), None, None))


@query("filter_isin", f"""
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag
FROM lineitem
WHERE l_returnflag IN ('A', 'R')
  AND l_shipdate IN ({", ".join(f"TIMESTAMP '{d}'" for d in SHIPDATES)})
""")
def q_filter_isin(spark, sf):
    """B2: value lists, including ISO strings on a datetime column."""
    li = table(spark, sf, "lineitem")
    pred = isin_predicate(F.col("l_returnflag"), ["A", "R"]) & isin_predicate(
        F.col("l_shipdate"), SHIPDATES, li.schema["l_shipdate"].dataType
    )
    return li.filter(pred).select(*_LI)


@query("filter_equals", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem WHERE l_linestatus = 'F'
""")
def q_filter_equals(spark, sf):
    """Equality with a scalar."""
    li = table(spark, sf, "lineitem")
    return li.filter(equals_predicate(F.col("l_linestatus"), "F")).select(*_LI)


@query("apply_filters", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag
FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus IN ('O')
""")
def q_apply_filters(spark, sf):
    """Specs folded into one pushed-down predicate; empty specs skipped."""
    li = table(spark, sf, "lineitem")
    specs = [
        FilterSpec("l_quantity", [10, 20]),
        FilterSpec("l_returnflag", ["A", "R"]),
        FilterSpec("l_linestatus", "O"),
        FilterSpec("l_tax", None),
        FilterSpec("no_such_column", ["x"]),
        FilterSpec("", [1, 2]),
    ]
    return apply_filters(li, specs).select(*_LI)


@query("filter_domain_range", """
SELECT min(l_extendedprice) AS "min", max(l_extendedprice) AS "max" FROM lineitem
""")
def q_filter_domain_range(spark, sf):
    """Slider limits of a numeric column."""
    return filter_domain_range(table(spark, sf, "lineitem"), "l_extendedprice")


@query("filter_domain_values", """
SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL
""")
def q_filter_domain_values(spark, sf):
    """Distinct non-missing values of a text column."""
    return filter_domain_values(table(spark, sf, "orders"), "o_orderpriority")


@query("drop_missing_any", """
SELECT l_orderkey, l_linenumber, l_suppkey, d, t FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey, nullif(l_discount, 0.05) AS d, nullif(l_tax, 0.0) AS t FROM lineitem)
WHERE d IS NOT NULL AND t IS NOT NULL
""")
def q_drop_missing_any(spark, sf):
    """Drop rows with any chosen column missing."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.nullif("l_discount", F.lit(0.05)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"),
    )
    return drop_missing_any(li, ["d", "t"])


@query("drop_missing_all", """
SELECT l_orderkey, l_linenumber, l_suppkey, d, t FROM (
  SELECT l_orderkey, l_linenumber, l_suppkey, nullif(l_discount, 0.05) AS d, nullif(l_tax, 0.0) AS t FROM lineitem)
WHERE d IS NOT NULL OR t IS NOT NULL
""")
def q_drop_missing_all(spark, sf):
    """Drop rows whose chosen columns are all missing."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.nullif("l_discount", F.lit(0.05)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("t"),
    )
    return drop_missing_all(li, ["d", "t"])


@query("filter_isin_long", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 250000)
""")
def q_filter_isin_long(spark, sf):
    """B2 with a table of keys (most orders): one semi join behind the keys' range."""
    keys = table(spark, sf, "orders").where("o_totalprice < 250000").select("o_orderkey")
    return filter_isin_long(table(spark, sf, "lineitem"), "l_orderkey", keys).select(*_LI)


@query("apply_filters_long", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity BETWEEN 5 AND 30 AND l_returnflag IN ('A', 'N')
  AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_shipdate IN (SELECT DISTINCT o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def q_apply_filters_long(spark, sf):
    """B4 where two of the filters are tables of keys: one pushed predicate, then semi joins."""
    parts = table(spark, sf, "part").where("p_size > 20").select("p_partkey")
    days = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderdate")
    specs = [FilterSpec("l_quantity", [5, 30]), FilterSpec("l_returnflag", ["A", "N"]), FilterSpec("l_partkey", parts), FilterSpec("l_shipdate", days)]
    return apply_filters(table(spark, sf, "lineitem"), specs).select(*_LI)
