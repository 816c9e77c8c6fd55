"""Registered queries: group aggregates attached to every row (E).

Inputs follow FIXTURES.md: lineitem by (nullif(l_returnflag,'A'),
l_linestatus) with measures l_quantity (q), l_tax (t, real zeros) and
nullif(l_discount, 0.05) (d, nulls and zeros).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators.groupagg import group_aggregate
from tablelens.operators.scan import rank_error
from tablelens.plans.catalog import query, table

KEYS = ["rf", "l_linestatus"]
ROW = ["l_orderkey", "l_linenumber", "l_suppkey"]
BASE_SQL = """b AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, nullif(l_returnflag, 'A') AS rf, l_linestatus,
         l_quantity AS q, l_tax AS t, nullif(l_discount, 0.05) AS d
  FROM lineitem)"""


def _base(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        *ROW,
        F.nullif("l_returnflag", F.lit("A")).alias("rf"),
        "l_linestatus",
        F.col("l_quantity").alias("q"),
        F.col("l_tax").alias("t"),
        F.nullif("l_discount", F.lit(0.05)).alias("d"),
    )


def _x_sql(c: str, empty: bool, zeros: bool) -> str:
    x = c if empty else f"coalesce({c}, 0.0)"
    return f"nullif({x}, 0.0)" if zeros else x


def _window_sql(cols, metric: str, empty=True, zeros=False) -> str:
    fn = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "median": "median"}
    outs = []
    for c in cols:
        x = _x_sql(c, empty, zeros)
        if metric == "count":
            e = f"count({x}) OVER w" if empty else "count(*) OVER w"
            outs.append(f"{e} AS {c}_count")
            continue
        e = f"{fn[metric]}({x}) OVER w"
        if metric == "sum":
            e = f"coalesce({e}, 0.0)"
        outs.append(f"round({e}, 6) AS {c}_{metric}")
    cols_sql = ", ".join(ROW + KEYS + list(dict.fromkeys(cols)))
    return f"""WITH {BASE_SQL}
SELECT {cols_sql}, {", ".join(outs)}
FROM b WINDOW w AS (PARTITION BY rf, l_linestatus)"""


def _spark_metric(spark, sf, cols, metric, empty=True, zeros=False, digits=6):
    b = _base(spark, sf)
    r = group_aggregate(b, KEYS, cols, [metric], exclude_empty=empty, exclude_zeros=zeros)
    out = r.df.select(*ROW, *KEYS, *cols, *[
        F.round(c, digits).alias(c) if metric not in ("count", "nunique", "mode") else F.col(c) for c in r.added
    ])
    return out


def _register_window(name: str, cols, metric: str, empty=True, zeros=False, doc=""):
    def fn(spark, sf):
        return _spark_metric(spark, sf, cols, metric, empty, zeros)

    fn.__doc__ = doc
    query(name, _window_sql(cols, metric, empty, zeros))(fn)


_register_window("group_mean", ["q", "d"], "mean", doc="E1: group mean on every row.")
_register_window("group_median", ["q", "d"], "median", doc="E2: exact group median on every row.")
_register_window("group_sum", ["q", "d", "t"], "sum", doc="E3: group sum; all-missing group gives 0.")
_register_window("group_min", ["d", "t"], "min", doc="E4: group minimum.")
_register_window("group_max", ["d", "t"], "max", doc="E5: group maximum.")
_register_window("group_std", ["q", "d"], "std", doc="E6: sample standard deviation.")
_register_window("group_count", ["d", "t"], "count", zeros=True, doc="E7: non-missing, non-zero count.")
_register_window("group_count_size", ["d"], "count", empty=False, zeros=True,
                 doc="E7: with empty values kept, the group size.")
_register_window("group_mean_switches", ["d", "t"], "mean", empty=False, zeros=True,
                 doc="E1 with missing filled by 0 and zeros excluded.")
_register_window("group_median_zeros", ["t"], "median", zeros=True, doc="E2 with zeros excluded.")


# --- distinct counts and modes -------------------------------------------------

def _join_sql(src_cte: str, row_cols, keys, side_sql: str, out_cols) -> str:
    on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM g.{k}" for k in keys)
    sel = ", ".join([f"b.{c}" for c in row_cols] + [f"g.{c}" for c in out_cols])
    return f"WITH {src_cte}, g AS ({side_sql})\nSELECT {sel} FROM b LEFT JOIN g ON {on}"


def _nunique_side(keys, x, is_num, empty, zeros, out):
    gone = f"({x} IS NULL" + (f" OR {x} = 0" if is_num and zeros else "") + ")"
    extra = "" if empty else f" + max(CASE WHEN {gone} THEN 1 ELSE 0 END)"
    ks = ", ".join(keys)
    return f"SELECT {ks}, CAST(count(DISTINCT CASE WHEN NOT {gone} THEN {x} END){extra} AS BIGINT) AS {out} FROM b GROUP BY {ks}"


def _mode_side(keys, x, is_num, empty, zeros, out):
    ks = ", ".join(keys)
    v = x
    if is_num and zeros:
        v = f"CASE WHEN {x} <> 0 THEN {x} END"
    sentinel = (not empty) and not (is_num and zeros)
    if sentinel:
        if is_num:
            order = "(v IS NULL) ASC, v ASC"
        else:
            order = "coalesce(v, '<EMPTY>') ASC"
        vv = "coalesce(CAST(v AS VARCHAR), '<EMPTY>')"
        inner = f"SELECT {ks}, {v} AS v, count(*) AS cnt FROM b GROUP BY ALL"
    else:
        order = "v ASC"
        vv = "v"
        inner = f"SELECT {ks}, {v} AS v, count(*) AS cnt FROM b WHERE {v} IS NOT NULL GROUP BY ALL"
    return (f"SELECT {ks}, {vv} AS {out} FROM (SELECT *, row_number() OVER (PARTITION BY {ks} "
            f"ORDER BY cnt DESC, {order}) AS rn FROM ({inner})) WHERE rn = 1")


def _register_side(name, metric, col, empty, zeros, doc):
    side = (_nunique_side if metric == "nunique" else _mode_side)(KEYS, col, True, empty, zeros, f"{col}_{metric}")
    sql = _join_sql(BASE_SQL, ROW + KEYS + [col], KEYS, side, [f"{col}_{metric}"])

    def fn(spark, sf):
        return _spark_metric(spark, sf, [col], metric, empty, zeros)

    fn.__doc__ = doc
    query(name, sql)(fn)


for _m in ("nunique", "mode"):
    for _e, _z, _sfx in ((True, False, ""), (True, True, "_zeros"), (False, False, "_empty"), (False, True, "_empty_zeros")):
        _register_side(f"group_{_m}{_sfx}", _m, "d", _e, _z,
                       f"E{8 if _m == 'nunique' else 9}: {_m} with exclude_empty={_e}, exclude_zeros={_z}.")


_ORD_CTE = """b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)"""


@query("group_text_nunique_mode", _join_sql(
    _ORD_CTE, ["o_orderkey", "o_orderstatus", "o_orderpriority"], ["o_orderstatus"],
    f"""SELECT n.o_orderstatus, n.o_orderpriority_nunique, m.o_orderpriority_mode FROM
       ({_nunique_side(["o_orderstatus"], "o_orderpriority", False, True, False, "o_orderpriority_nunique")}) n
       JOIN ({_mode_side(["o_orderstatus"], "o_orderpriority", False, True, False, "o_orderpriority_mode")}) m
       ON n.o_orderstatus IS NOT DISTINCT FROM m.o_orderstatus""",
    ["o_orderpriority_nunique", "o_orderpriority_mode"]))
def q_group_text(spark, sf):
    """E8/E9 on a text column: distinct count and mode per order status."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return group_aggregate(o, ["o_orderstatus"], ["o_orderpriority"], ["nunique", "mode"]).df


_EV_CTE = """b AS (SELECT event_id, user_id, event_type FROM events)"""


@query("group_text_mode_empty", _join_sql(
    _EV_CTE, ["event_id", "user_id", "event_type"], ["user_id"],
    _mode_side(["user_id"], "event_type", False, False, False, "event_type_mode"), ["event_type_mode"]))
def q_group_text_mode_empty(spark, sf):
    """E9 on text with missing values competing as <EMPTY>: event type per user."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return group_aggregate(e, ["user_id"], ["event_type"], ["mode"], exclude_empty=False).df


@query("group_cumsum", """
SELECT event_id, k, value,
       CASE WHEN k IS NULL THEN NULL ELSE round(sum(coalesce(value, 0.0)) OVER (
         PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) END AS value_cumsum
FROM (SELECT event_id, nullif(user_id, 8) AS k, value FROM events)
""")
def q_group_cumsum(spark, sf):
    """Running sum per user in event order; a missing key gives missing."""
    e = table(spark, sf, "events").select("event_id", F.nullif("user_id", F.lit(8)).alias("k"), "value")
    r = group_aggregate(e, ["k"], ["value"], ["cumsum"], order_by=["event_id"])
    return r.df.withColumn("value_cumsum", F.round("value_cumsum", 6))


@query("group_cumsum_supplier", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity,
       round(sum(l_quantity) OVER (PARTITION BY l_suppkey
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS l_quantity_cumsum
FROM lineitem
""")
def q_group_cumsum_supplier(spark, sf):
    """E10 over the whole lineitem table: running quantity per supplier in ship order."""
    li = table(spark, sf, "lineitem")
    r = group_aggregate(
        li, ["l_suppkey"], ["l_quantity"], ["cumsum"],
        order_by=["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
    )
    return r.df.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity",
                       F.round("l_quantity_cumsum", 6).alias("l_quantity_cumsum"))


@query("group_aggregate", f"""WITH {BASE_SQL}
SELECT l_orderkey, l_linenumber, l_suppkey, rf, l_linestatus, q, d,
  round(avg(nullif(coalesce(q, 0.0), 0.0)) OVER w, 6) AS q_mean,
  round(median(nullif(coalesce(q, 0.0), 0.0)) OVER w, 6) AS q_median,
  round(coalesce(sum(nullif(coalesce(q, 0.0), 0.0)) OVER w, 0.0), 6) AS q_sum,
  count(*) OVER w AS q_count,
  round(stddev_samp(nullif(coalesce(q, 0.0), 0.0)) OVER w, 6) AS q_std,
  round(avg(nullif(coalesce(d, 0.0), 0.0)) OVER w, 6) AS d_mean,
  round(median(nullif(coalesce(d, 0.0), 0.0)) OVER w, 6) AS d_median,
  round(coalesce(sum(nullif(coalesce(d, 0.0), 0.0)) OVER w, 0.0), 6) AS d_sum,
  count(*) OVER w AS d_count,
  round(stddev_samp(nullif(coalesce(d, 0.0), 0.0)) OVER w, 6) AS d_std,
  count(*) OVER w AS l_linestatus_count
FROM b WINDOW w AS (PARTITION BY rf, l_linestatus)""")
def q_group_aggregate(spark, sf):
    """Several columns x metrics (Russian and English aliases) in
    one call, missing filled by 0 and zeros excluded; text-only pairs skipped."""
    b = _base(spark, sf)
    r = group_aggregate(
        b, ["rf", " L_LineStatus "], ["q", "d", "l_linestatus"],
        ["среднее", "Медиана", "sum", "Количество", "stdev", "avg"],
        exclude_empty=False, exclude_zeros=True,
    )
    assert ("l_linestatus", "mean") in r.skipped
    num = [c for c in r.added if not c.endswith("_count")]
    cnt = [c for c in r.added if c.endswith("_count")]
    return r.df.select(*ROW, *KEYS, "q", "d", *[F.round(c, 6).alias(c) for c in num], *cnt)


_SKEW_SQL = """k AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity,
                CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 AND l_linenumber = 1 THEN -1 ELSE l_orderkey * 10 + l_linenumber END AS k FROM lineitem)"""


@query("group_mean_skewed", f"""WITH {_SKEW_SQL}
SELECT *, round(avg(l_quantity) OVER w, 6) AS l_quantity_mean, count(l_quantity) OVER w AS l_quantity_count
FROM k WINDOW w AS (PARTITION BY k)""")
def q_group_mean_skewed(spark, sf):
    """E1/E7 with as many groups as rows, a third of all rows in one (missing)
    key and nothing small enough to broadcast."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    k = F.when(o % 3 == 0, F.lit(None)).when((o % 3 == 1) & (n == 1), F.lit(-1)).otherwise(o * 10 + n)
    rows = table(spark, sf, "lineitem").select(*ROW, "l_quantity", k.alias("k"))
    out = group_aggregate(rows, ["k"], ["l_quantity"], ["mean", "count"], broadcast_max_rows=0).df
    return out.withColumn("l_quantity_mean", F.round("l_quantity_mean", 6))


@query("group_median_approx", f"""WITH {BASE_SQL}
SELECT rf, l_linestatus, count(d) AS n, TRUE AS within, count(*) AS n_rows FROM b GROUP BY 1, 2""")
def q_group_median_approx(spark, sf):
    """E2 from sketches: the true rank of each group's median, attached to its
    rows, is within 1 / 1000 of the group."""
    out = group_aggregate(_base(spark, sf), KEYS, ["d"], ["median"], accuracy=1000).df
    ranks = out.groupBy(*KEYS).agg(F.count("d").alias("n"), F.count(F.when(F.col("d") < F.col("d_median"), 1)).alias("b"),
                                   F.count(F.when(F.col("d") <= F.col("d_median"), 1)).alias("u"), F.count(F.lit(1)).alias("n_rows"))
    return ranks.select(*KEYS, "n", (rank_error(F.col("b"), F.col("u"), F.col("n"), 0.5) <= 0.001).alias("within"), "n_rows")
