"""Registered queries: orderings (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators.charts import chart_pie_categorical
from tablelens.operators.order import (
    order_categories,
    order_counts_desc,
    order_facets,
    order_legend_alpha,
    order_legend_custom,
    order_legend_original,
)
from tablelens.plans.catalog import query, table


def _cat_sql(stat_sql: str, desc: bool) -> str:
    key = "-metric" if desc else "metric"
    return f"""WITH g AS (SELECT p_brand, {stat_sql} AS metric FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand)
SELECT p_brand, round(metric, 6) AS metric,
       CAST(row_number() OVER (ORDER BY metric IS NULL, {key}, p_brand) - 1 AS BIGINT) AS position FROM g"""


for _name, _how, _sql, _desc in [
    ("order_categories", "total ascending", "sum(p_retailprice)", False),
    ("order_categories_median_desc", "median descending", "median(p_retailprice)", True),
    ("order_categories_geomean", "geometric mean ascending", "exp(avg(ln(CASE WHEN p_retailprice > 0 THEN p_retailprice END)))", False),
    ("order_categories_max_desc", "max descending", "max(p_retailprice)", True),
]:
    def _fn(spark, sf, _how=_how):
        r = order_categories(table(spark, sf, "part"), "p_brand", "p_retailprice", how=_how)
        return r.select("p_brand", F.round("metric", 6).alias("metric"), "position")

    _fn.__doc__ = f"I1: brands ordered by '{_how}' of retail price."
    query(_name, _cat_sql(_sql, _desc))(_fn)


@query("order_categories_desc", """
SELECT DISTINCT p_type, CAST(NULL AS DOUBLE) AS metric,
       CAST(dense_rank() OVER (ORDER BY p_type DESC) - 1 AS BIGINT) AS position FROM part
""")
def q_cat_desc(spark, sf):
    """Category descending."""
    return order_categories(table(spark, sf, "part"), "p_type", how="category descending")


@query("order_categories_trace", """
WITH g AS (SELECT event_type, min(event_id) AS metric FROM events GROUP BY 1)
SELECT event_type, metric, CAST(row_number() OVER (ORDER BY metric, event_type) - 1 AS BIGINT) AS position FROM g
""")
def q_cat_trace(spark, sf):
    """I1 'trace': data order (first appearance by event id)."""
    return order_categories(table(spark, sf, "events"), "event_type", how="trace", order_by="event_id")


@query("order_legend_alpha", """
WITH g AS (SELECT DISTINCT nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)
SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment IS NULL, lower(c_mktsegment), c_mktsegment) - 1 AS BIGINT) AS position FROM g
""")
def q_legend_alpha(spark, sf):
    """Series alphabetically, the unnamed series last."""
    c = table(spark, sf, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return order_legend_alpha(c, "c_mktsegment")


@query("order_legend_original", """
WITH g AS (SELECT o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1)
SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY f, o_orderpriority) - 1 AS BIGINT) AS position FROM g
""")
def q_legend_original(spark, sf):
    """I4: series in order of first appearance."""
    return order_legend_original(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query("order_legend_custom", """
WITH g AS (SELECT DISTINCT c_mktsegment FROM customer)
SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment IS NULL,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END,
  lower(c_mktsegment), c_mktsegment) - 1 AS BIGINT) AS position FROM g
""")
def q_legend_custom(spark, sf):
    """A custom list first, the rest alphabetically."""
    return order_legend_custom(table(spark, sf, "customer"), "c_mktsegment", " MACHINERY, AUTOMOBILE ,, NOPE")


@query("order_facets", """
WITH g AS (SELECT DISTINCT o_orderstatus FROM orders)
SELECT o_orderstatus, CAST(row_number() OVER (ORDER BY o_orderstatus IS NULL,
  CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, lower(o_orderstatus), o_orderstatus) - 1 AS BIGINT) AS position FROM g
""")
def q_facets(spark, sf):
    """Facet order from the first filter's value list."""
    filters = {"f1": {"column": "o_orderstatus", "value": ["P", "F"]}, "f2": {"column": "o_orderpriority", "value": ["1-URGENT"]}}
    return order_facets(table(spark, sf, "orders"), "o_orderstatus", filters)


@query("order_counts_desc", """
WITH g AS (SELECT nullif(o_orderpriority, '5-LOW') AS o_orderpriority, count(*) AS counts FROM orders GROUP BY 1)
SELECT o_orderpriority, counts, CAST(row_number() OVER (ORDER BY counts DESC, o_orderpriority IS NULL, o_orderpriority) - 1 AS BIGINT) AS position FROM g
""")
def q_counts_desc(spark, sf):
    """Slice counts largest first."""
    o = table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return order_counts_desc(chart_pie_categorical(o, "o_orderpriority"), "o_orderpriority", "counts")


@query("order_categories_trace_text", """
WITH g AS (SELECT o_orderpriority, min(o_orderstatus) AS metric FROM orders GROUP BY 1)
SELECT o_orderpriority, metric, CAST(row_number() OVER (ORDER BY metric, o_orderpriority) - 1 AS BIGINT) AS position FROM g
""")
def q_cat_trace_text(spark, sf):
    """I1 'trace' where the row order is a text column."""
    return order_categories(table(spark, sf, "orders"), "o_orderpriority", how="trace", order_by="o_orderstatus")


@query("order_facets_numeric", """
WITH g AS (SELECT DISTINCT l_quantity FROM lineitem)
SELECT l_quantity, CAST(row_number() OVER (ORDER BY CASE l_quantity WHEN 10 THEN 0 WHEN 2 THEN 1 ELSE 3 END, l_quantity) - 1 AS BIGINT) AS position FROM g
""")
def q_facets_numeric(spark, sf):
    """I6 on numbers: "10", 2 and a value that is no number; the rest by value."""
    return order_facets(table(spark, sf, "lineitem"), "l_quantity", {"f1": {"column": "l_quantity", "value": ["10", 2, "many"]}})
