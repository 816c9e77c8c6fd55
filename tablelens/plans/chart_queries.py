"""Registered queries: chart datasets (H)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tablelens.operators import charts as C
from tablelens.operators.filters import FilterSpec, apply_filters
from tablelens.operators.scan import rank_error
from tablelens.plans.catalog import query, table


def flagship(spark, sf):
    """Filter lineitem (quantity 10-20, return flag A or R), then the bar
    dataset: revenue per return flag, coloured by line status."""
    li = table(spark, sf, "lineitem")
    f = apply_filters(li, [FilterSpec("l_quantity", [10, 20]), FilterSpec("l_returnflag", ["A", "R"])])
    bars = C.chart_bar(f, "l_returnflag", "l_extendedprice", color="l_linestatus")
    return bars.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


query("chart_bar", """
SELECT l_linestatus, l_returnflag, round(coalesce(sum(l_extendedprice), 0.0), 2) AS l_extendedprice
FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')
GROUP BY l_linestatus, l_returnflag
""")(flagship)


@query("chart_bar_count_facets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL
""")
def q_bar_count(spark, sf):
    """H4 without y (row count) and H19 facet row as an extra key."""
    return C.chart_bar(table(spark, sf, "orders"), "o_orderpriority", facet_row="o_orderstatus", color="Нет")


@query("chart_scatter", """
SELECT l_quantity, l_extendedprice, l_returnflag, l_discount FROM lineitem
""")
def q_scatter(spark, sf):
    """H1: plotted columns per row (colour, bubble size)."""
    return C.chart_scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                           color="l_returnflag", size="l_discount", bubble=True)


@query("chart_scatter3d", """
SELECT l_quantity, l_extendedprice, l_discount, l_linestatus FROM lineitem
""")
def q_scatter3d(spark, sf):
    """H2: x, y, z and colour."""
    return C.chart_scatter3d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount",
                             color="l_linestatus")


@query("chart_ternary", """
SELECT l_quantity, l_discount, l_tax,
  round(l_quantity / nullif(l_quantity + l_discount + l_tax, 0), 8) AS l_quantity_share,
  round(l_discount / nullif(l_quantity + l_discount + l_tax, 0), 8) AS l_discount_share,
  round(l_tax / nullif(l_quantity + l_discount + l_tax, 0), 8) AS l_tax_share
FROM lineitem
""")
def q_ternary(spark, sf):
    """H3: ternary positions as shares of the sum."""
    t = C.chart_ternary(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_tax")
    return t.select("l_quantity", "l_discount", "l_tax",
                    *[F.round(c, 8).alias(c) for c in ("l_quantity_share", "l_discount_share", "l_tax_share")])


@query("chart_line", "SELECT event_type, event_id, value FROM events")
def q_line(spark, sf):
    """H5: one series per event type in event order."""
    return C.chart_line(table(spark, sf, "events"), "event_id", "value", order_by=["event_id"], color="event_type")


@query("chart_histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_end, count(*) AS count
FROM (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi FROM lineitem, s)
GROUP BY bin, lo, hi
""")
def q_histogram(spark, sf):
    """H6: 20 equal-width bins of a numeric column."""
    return _edges(C.chart_histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20))


def _edges(h):
    return h.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("chart_histogram_datetime", """
WITH x AS (SELECT epoch_us(ts) AS v, event_type FROM events),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
SELECT event_type, bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS count
FROM (SELECT event_type, CAST(least(floor((v - lo) / ((hi - lo) / 10.0)), 9) AS INTEGER) AS bin,
             CAST(lo AS DOUBLE) AS lo, (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) / 10 AS w FROM x, s)
GROUP BY event_type, bin, lo, w
""")
def q_histogram_dt(spark, sf):
    """H6 on timestamps, one series per event type."""
    return C.chart_histogram(table(spark, sf, "events"), "ts", 10, color="event_type")


@query("chart_histogram_text", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def q_histogram_text(spark, sf):
    """H6 on a text axis: count per value."""
    return C.chart_histogram(table(spark, sf, "orders"), "o_orderpriority")


def _box_sql(tbl, key, val):
    def at(h):
        lo = f"max(CASE WHEN rn = floor({h}) + 1 THEN v END)"
        hi = f"max(CASE WHEN rn = ceil({h}) + 1 THEN v END)"
        return f"{lo} + ({hi} - {lo}) * (max({h}) - floor(max({h})))"

    return f"""WITH r0 AS (
  SELECT {key}, {val} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {val}) AS rn,
         count(*) OVER (PARTITION BY {key}) AS n
  FROM {tbl} WHERE {val} IS NOT NULL),
r AS (SELECT *, least(greatest(n * 0.25 - 0.5, 0.0), n - 1) AS h1, least(greatest(n * 0.5 - 0.5, 0.0), n - 1) AS h2,
             least(greatest(n * 0.75 - 0.5, 0.0), n - 1) AS h3 FROM r0),
q AS (SELECT {key}, max(n) AS n, min(v) AS mn, max(v) AS mx,
        {at("h1")} AS q1, {at("h2")} AS med, {at("h3")} AS q3
      FROM r GROUP BY {key}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
SELECT f.{key}, f.n, round(f.mn, 4) AS "min", round(f.q1, 4) AS q1, round(f.med, 4) AS median,
       round(f.q3, 4) AS q3, round(f.mx, 4) AS "max",
       round(min(CASE WHEN r.v BETWEEN lf AND hf THEN r.v END), 4) AS lower_whisker,
       round(max(CASE WHEN r.v BETWEEN lf AND hf THEN r.v END), 4) AS upper_whisker,
       count(CASE WHEN NOT (r.v BETWEEN lf AND hf) THEN 1 END) AS outliers
FROM f JOIN r ON f.{key} = r.{key}
GROUP BY f.{key}, f.n, f.mn, f.q1, f.med, f.q3, f.mx"""


_BOX_ROUND = ["min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker"]


@query("chart_box", _box_sql("orders", "o_orderpriority", "o_totalprice"))
def q_box(spark, sf):
    """H7: exact box statistics of the order total per priority."""
    b = C.chart_box(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return b.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in _BOX_ROUND], "outliers")


@query("chart_box_events", _box_sql("events", "event_type", "value"))
def q_box_events(spark, sf):
    """H7 on event values per event type."""
    b = C.chart_box(table(spark, sf, "events"), "event_type", "value")
    return b.select("event_type", "n", *[F.round(c, 4).alias(c) for c in _BOX_ROUND], "outliers")


def _kde_sql(tbl, key, val, points=100):
    key_sel = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    grp = f"GROUP BY {key}" if key else ""
    on = f"s.{key} = d.{key}" if key else "TRUE"
    where = f"WHERE {val} IS NOT NULL" + (f" AND {key} IS NOT NULL" if key else "")
    return f"""WITH d AS (SELECT {key_sel}{val} AS v FROM {tbl} {where}),
s0 AS (SELECT {key_sel}count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
         (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 AS iq FROM d {grp}),
s1 AS (SELECT *, CASE WHEN coalesce(sd, 0) > 0 AND iq > 0 THEN least(sd, iq)
                      WHEN coalesce(sd, 0) > 0 THEN sd WHEN iq > 0 THEN iq ELSE 1.0 END AS m FROM s0),
s AS (SELECT *, 1.059 * m * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM s1),
g AS (SELECT *, lo - 2.0 * bw AS glo, (hi - lo + 4.0 * bw) / {points - 1} AS gstep FROM s),
p AS (SELECT {"s." + key + ", " if key else ""}d.v, s.glo, s.gstep, s.n, s.bw,
             CAST(unnest(range({points})) AS INTEGER) AS point
      FROM g AS s JOIN d ON {on})
SELECT {key_sel}point, round(glo + point * gstep, 6) AS value,
       round(sum(exp(-0.5 * ((glo + point * gstep - v) / bw) * ((glo + point * gstep - v) / bw)))
             / (n * bw * {math.sqrt(2 * math.pi)!r}), 12) AS density
FROM p
GROUP BY {key_sel}point, glo, gstep, n, bw"""


@query("chart_violin", _kde_sql("events", "event_type", "value"))
def q_violin(spark, sf):
    """H8: Gaussian kernel density of event value per event type."""
    v = C.chart_violin(table(spark, sf, "events"), "event_type", "value")
    return v.select("event_type", "point", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"))


@query("chart_ridge", _kde_sql("orders", "o_orderstatus", "o_totalprice"))
def q_ridge(spark, sf):
    """H9: one density curve of the order total per order status."""
    v = C.chart_ridge(table(spark, sf, "orders"), "o_totalprice", color="o_orderstatus")
    return v.select("o_orderstatus", "point", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"))


@query("chart_pie_categorical", """
SELECT nullif(o_orderpriority, '5-LOW') AS o_orderpriority, count(*) AS counts FROM orders GROUP BY 1
""")
def q_pie_cat(spark, sf):
    """Slice per value with the missing value as its own slice."""
    o = table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return C.chart_pie(o, "o_orderpriority")


@query("chart_pie_binned", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT 1 + """ + " + ".join(
    f"CASE WHEN l_extendedprice > lo + {i} * ((hi - lo) / 10) THEN 1 ELSE 0 END" for i in range(1, 10)
) + """ AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT b.bin, '(' || CAST(round(lo + (b.bin - 1) * ((hi - lo) / 10) - CASE WHEN b.bin = 1 THEN (hi - lo) * 0.001 ELSE 0 END, 3)
                          - CASE WHEN b.bin = 1 THEN 0.001 ELSE 0 END AS VARCHAR) || ', '
       || CAST(round(lo + b.bin * ((hi - lo) / 10), 3) AS VARCHAR) || ']' AS l_extendedprice,
       CAST(coalesce(c.n, 0) AS BIGINT) AS counts
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 11)) b CROSS JOIN s LEFT JOIN c ON b.bin = c.bin
""")
def q_pie_binned(spark, sf):
    """Ten equal-width right-closed bins, empty bins kept."""
    return C.chart_pie(table(spark, sf, "lineitem"), "l_extendedprice")


@query("chart_hierarchy", """
WITH j AS (SELECT r_name, n_name, c_mktsegment, c_acctbal FROM customer
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM (
  SELECT r_name, n_name, c_mktsegment, round(coalesce(sum(c_acctbal), 0.0), 2) AS value,
         CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS level
  FROM j GROUP BY ROLLUP (r_name, n_name, c_mktsegment)) WHERE level >= 1
""")
def q_hierarchy(spark, sf):
    """Region -> nation -> segment prefixes with summed balances."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    h = C.chart_hierarchy(j, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")
    return h.withColumn("value", F.round("value", 2))


def _density_sql(color=None):
    key = f"{color}, " if color else ""
    return f"""WITH s AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1,
                    min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
SELECT {key}CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19) AS INTEGER) AS xbin,
       CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19) AS INTEGER) AS ybin,
       count(*) AS count
FROM lineitem, s GROUP BY ALL"""


@query("chart_density_heatmap", _density_sql())
def q_density_heat(spark, sf):
    """20 x 20 two-dimensional counts."""
    return C.chart_density_heatmap(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("chart_density_contour", _density_sql("l_returnflag"))
def q_density_contour(spark, sf):
    """The same per colour (return flag)."""
    return C.chart_density_contour(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", color="l_returnflag")


@query("chart_scatter_matrix", "SELECT p_size, p_retailprice, p_partkey, p_type FROM part")
def q_scatter_matrix(spark, sf):
    """The chosen numeric dimensions (others are left out) and the colour."""
    return C.chart_scatter_matrix(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_size", "p_name", "p_partkey"], color="p_type")


@query("chart_scatter_matrix_long", """
SELECT 'p_size' AS dim_a, CAST(p_size AS DOUBLE) AS a, 'p_retailprice' AS dim_b, p_retailprice AS b, p_type FROM part
""")
def q_scatter_matrix_long(spark, sf):
    """H12, long form: one row per row and pair of dimensions."""
    return C.chart_scatter_matrix(table(spark, sf, "part"), ["p_size", "p_retailprice"], color="p_type", long_form=True)


@query("chart_parallel_coordinates", """
SELECT p_size, p_retailprice, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS color_value FROM part
""")
def q_parallel(spark, sf):
    """Numeric dimensions with a text colour turned into dense codes."""
    return C.chart_parallel_coordinates(table(spark, sf, "part"), ["p_size", "p_retailprice"], color="p_type")


@query("count_points", """
SELECT l_returnflag, CAST(count(l_quantity) + count(nullif(l_discount, 0.05)) AS BIGINT) AS points
FROM lineitem GROUP BY 1
""")
def q_count_points(spark, sf):
    """Plotted x plus y values per series."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", F.nullif("l_discount", F.lit(0.05)).alias("d"))
    return C.count_points(li, "l_quantity", "d", color="l_returnflag")


@query("chart_parallel_missing_color", """
WITH p AS (SELECT p_size, p_retailprice, nullif(p_type, 'PROMO') AS p_type FROM part)
SELECT p_size, p_retailprice, p_type, CAST(dense_rank() OVER (ORDER BY p_type NULLS FIRST) - 1 AS BIGINT) AS color_value FROM p
""")
def q_parallel_missing(spark, sf):
    """A missing colour has a code like any other."""
    p = table(spark, sf, "part").select("p_size", "p_retailprice", F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    return C.chart_parallel_coordinates(p, ["p_size", "p_retailprice"], color="p_type")


@query("chart_bar_horizontal", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1
""")
def q_bar_horizontal(spark, sf):
    """H4 on its side: a number X is summed per text Y."""
    return C.chart_bar(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("chart_box_horizontal", _box_sql("orders", "o_orderstatus", "o_totalprice"))
def q_box_horizontal(spark, sf):
    """H7 on its side: boxes of a number X per text Y."""
    b = C.chart_box(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")
    return b.select("o_orderstatus", "n", *[F.round(c, 4).alias(c) for c in _BOX_ROUND], "outliers")


@query("chart_violin_horizontal", _kde_sql("orders", "o_orderpriority", "o_totalprice"))
def q_violin_horizontal(spark, sf):
    """H8 on its side: curves of a number X per text Y."""
    v = C.chart_violin(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return v.select("o_orderpriority", "point", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"))


@query("chart_ridge_by_y", f"""WITH orders AS (SELECT o_totalprice, o_orderstatus || '/' || o_orderpriority AS k FROM orders),
z AS ({_kde_sql("orders", "k", "o_totalprice")})
SELECT split_part(k, '/', 1) AS o_orderstatus, split_part(k, '/', 2) AS o_orderpriority, point, value, density FROM z""")
def q_ridge_by_y(spark, sf):
    """H9 with a Y: one curve per colour and position."""
    v = C.chart_ridge(table(spark, sf, "orders"), "o_totalprice", y="o_orderpriority", color="o_orderstatus")
    return v.select("o_orderstatus", "o_orderpriority", "point", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"))


@query("chart_ternary_bubble", """
SELECT l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice, l_linestatus, l_orderkey,
  round(l_quantity / nullif(l_quantity + l_discount + l_tax, 0), 8) AS l_quantity_share,
  round(l_discount / nullif(l_quantity + l_discount + l_tax, 0), 8) AS l_discount_share,
  round(l_tax / nullif(l_quantity + l_discount + l_tax, 0), 8) AS l_tax_share
FROM lineitem
""")
def q_ternary_bubble(spark, sf):
    """H3 with colour, bubble size, text and hover columns."""
    t = C.chart_ternary(table(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_tax", color="l_returnflag",
                        size="l_extendedprice", text="l_linestatus", hover=["l_orderkey", "no_such"], bubble=True)
    return t.withColumns({c: F.round(c, 8) for c in ("l_quantity_share", "l_discount_share", "l_tax_share")})


def _binned_sql(tbl, key, val, points, cells):
    return f"""WITH d AS (SELECT {key}, {val} AS v FROM {tbl} WHERE {val} IS NOT NULL),
s0 AS (SELECT {key}, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {cells} AS h FROM d GROUP BY {key}),
c AS (SELECT d.{key}, (v - lo) / h AS pos, CAST(least(floor((v - lo) / h), {cells - 1}) AS INTEGER) AS cell FROM d JOIN s0 ON s0.{key} = d.{key}),
w AS (SELECT {key}, node, sum(w) AS w FROM (SELECT {key}, cell AS node, 1 - (pos - cell) AS w FROM c
      UNION ALL SELECT {key}, cell + 1, pos - cell FROM c) GROUP BY {key}, node),
u AS (SELECT *, sum(w) OVER (PARTITION BY {key} ORDER BY node) AS upto FROM w),
i AS (SELECT u.{key}, (min(CASE WHEN upto >= n * 0.75 * (1 - 1e-9) THEN node END) - min(CASE WHEN upto >= n * 0.25 * (1 - 1e-9) THEN node END))
             * h / 1.349 AS iq FROM u JOIN s0 ON s0.{key} = u.{key} GROUP BY u.{key}, h),
s AS (SELECT s0.*, 1.059 * CASE WHEN sd > 0 AND iq > 0 THEN least(sd, iq) WHEN sd > 0 THEN sd WHEN iq > 0 THEN iq ELSE 1.0 END
             * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM s0 JOIN i ON i.{key} = s0.{key}),
g AS (SELECT *, lo - 2.0 * bw AS glo, (hi - lo + 4.0 * bw) / {points - 1} AS gstep FROM s),
p AS (SELECT g.*, CAST(unnest(range({points})) AS INTEGER) AS point FROM g)
SELECT p.{key}, point, round(glo + point * gstep, 6) AS value,
       round(sum(w * exp(-0.5 * pow((glo + point * gstep - (lo + node * h)) / bw, 2))) / (n * bw * {math.sqrt(2 * math.pi)!r}), 12) AS density,
       round(h * h / ({8 * math.sqrt(2 * math.pi)!r} * pow(bw, 3)), 14) AS error_bound
FROM p JOIN w ON w.{key} = p.{key} GROUP BY p.{key}, point, glo, gstep, n, bw, h"""


@query("chart_violin_binned", _binned_sql("events", "event_type", "value", 100, 1024))
def q_violin_binned(spark, sf):
    """H8 from 1,024 cells a group: two weights a row instead of 100 exponentials."""
    v = C.chart_violin(table(spark, sf, "events"), "event_type", "value", cells=1024)
    return v.select("event_type", "point", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"),
                    F.round("error_bound", 14).alias("error_bound"))


@query("chart_ridge_binned", _binned_sql("orders", "o_orderstatus", "o_totalprice", 100, 512))
def q_ridge_binned(spark, sf):
    """H9 from 512 cells a curve."""
    v = C.chart_ridge(table(spark, sf, "orders"), "o_totalprice", color="o_orderstatus", cells=512)
    return v.select("o_orderstatus", "point", F.round("value", 6).alias("value"), F.round("density", 12).alias("density"),
                    F.round("error_bound", 14).alias("error_bound"))


_LINE = ["l_orderkey", "l_linenumber", "l_suppkey"]


def _capped_sql(cols, series, cap):
    part = f"PARTITION BY {series} " if series else ""
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in _LINE)  # a few lines share a key: then by value
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER ({part}ORDER BY md5({key}), {cols}) AS nth FROM lineitem) WHERE nth <= {cap}"""


@query("chart_scatter_capped", _capped_sql("l_quantity, l_extendedprice, l_returnflag", "l_returnflag", 500))
def q_scatter_capped(spark, sf):
    """H1: at most 500 points a colour, those of least md5 of the row's key."""
    return C.chart_scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", color="l_returnflag", cap=500, cap_by=_LINE)


@query("chart_scatter3d_capped", _capped_sql("l_quantity, l_extendedprice, l_discount", None, 1000))
def q_scatter3d_capped(spark, sf):
    """H2: at most 1,000 points of the whole table."""
    return C.chart_scatter3d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", cap=1000, cap_by=_LINE)


@query("chart_scatter_matrix_capped", _capped_sql("l_quantity, l_discount, l_tax, l_linestatus", "l_linestatus", 300))
def q_scatter_matrix_capped(spark, sf):
    """At most 300 rows a colour."""
    return C.chart_scatter_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], color="l_linestatus", cap=300, cap_by=_LINE)


_UNITS = ("day", "week", "month")
_CALENDAR = " UNION ALL ".join(
    f"""SELECT '{u}' AS unit, k.event_type, CAST(b.s AS TIMESTAMP) AS bin_start, CAST(b.s + INTERVAL 1 {u} AS TIMESTAMP) AS bin_end, coalesce(n, 0) AS count
FROM (SELECT DISTINCT event_type FROM e) k
CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 {u})) AS s FROM (SELECT date_trunc('{u}', min(ts)) AS lo, date_trunc('{u}', max(ts)) AS hi FROM e)) b
LEFT JOIN (SELECT event_type, date_trunc('{u}', ts) AS s, count(*) AS n FROM e GROUP BY 1, 2) c ON c.event_type = k.event_type AND c.s = b.s"""
    for u in _UNITS)


@query("chart_histogram_calendar", f"WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM events WHERE event_id % 3 <> 0 OR event_type <> 'click') {_CALENDAR}")
def q_histogram_calendar(spark, sf):
    """H6 by calendar: events by day, week and month per type, empty buckets as 0."""
    e = table(spark, sf, "events").where("event_id % 3 <> 0 OR event_type <> 'click'")
    parts = [C.chart_histogram_calendar(e, "ts", u, color="event_type").withColumn("unit", F.lit(u)) for u in _UNITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("chart_box_approx", """
SELECT o_orderpriority, count(o_totalprice) AS n, min(o_totalprice) AS "min", max(o_totalprice) AS "max", TRUE AS ranks_within, TRUE AS ordered
FROM orders GROUP BY 1""")
def q_box_approx(spark, sf):
    """H7 from sketches: each quartile's true rank is within 1 / 1000 of the
    group, and the figures lie in order."""
    o = table(spark, sf, "orders")
    b = C.chart_box(o, "o_orderpriority", "o_totalprice", accuracy=1000)
    j = o.select("o_orderpriority", "o_totalprice").join(F.broadcast(b), "o_orderpriority")  # one row a priority
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    v = F.col("o_totalprice")
    ranks = j.groupBy("o_orderpriority", "n", "min", "max", *probs, "lower_whisker", "upper_whisker").agg(
        *[F.count(F.when(v < F.col(c), 1)).alias(f"{c}_b") for c in probs], *[F.count(F.when(v <= F.col(c), 1)).alias(f"{c}_u") for c in probs])
    worst = F.greatest(*[rank_error(F.col(f"{c}_b"), F.col(f"{c}_u"), F.col("n"), p) for c, p in probs.items()])
    ladder = [F.col(c) for c in ("min", "lower_whisker", "q1", "median", "q3", "upper_whisker", "max")]
    ordered = F.lit(True)
    for a, b2 in zip(ladder, ladder[1:]):
        ordered &= a <= b2
    return ranks.select("o_orderpriority", "n", "min", "max", (worst <= 0.001).alias("ranks_within"), ordered.alias("ordered"))
