"""Registered queries: row-wise functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.scalar import (
    empty_sentinel,
    fill_zero,
    round2,
    strip_text,
    text_copy,
    zero_to_null,
)
from tablelens.operators.scan import dense_codes
from tablelens.operators.groupagg import attach_group_values
from tablelens.plans.catalog import query, table


@query("text_copy", """
SELECT o_orderkey, o_totalprice, o_orderpriority,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice_txt, o_orderpriority AS o_orderpriority_txt,
       CAST(o_orderkey AS VARCHAR) AS o_orderkey_txt
FROM orders
""")
def q_text_copy(spark, sf):
    """Text copies of a number, a text and an id column (names matched
    loosely; unknown names reported, not fatal)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out, created, missing = text_copy(o, ["O_TotalPrice", "o_orderpriority", " o_orderkey", "nope"], suffix="txt")
    assert missing == ["nope"], missing
    return out


@query("strip_text", """
SELECT p_partkey, p_name, trim(p_name, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS p_name_txt FROM (
  SELECT p_partkey, chr(9) || ' ' || p_name || chr(160) || chr(10) AS p_name FROM part)
""")
def q_strip_text(spark, sf):
    """Text copy of padded names with all Unicode whitespace stripped."""
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \n")).alias("p_name")
    )
    return text_copy(p, ["p_name"], strip=True)[0]


@query("strip_text_only", """
SELECT p_partkey, trim(p_type, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS p_type FROM (SELECT p_partkey, '  ' || p_type || chr(9) AS p_type FROM part)
""")
def q_strip_only(spark, sf):
    """C2 on its own."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.col("p_type"), F.lit("\t")).alias("p_type"))
    return p.select("p_partkey", strip_text(F.col("p_type")).alias("p_type"))


@query("missing_switches", """
SELECT l_orderkey, l_linenumber, l_suppkey,
       coalesce(nullif(l_discount, 0.05), 0) AS filled,
       nullif(l_tax, 0.0) AS zero_dropped,
       coalesce(CAST(nullif(l_returnflag, 'A') AS VARCHAR), '<EMPTY>') AS sentinel
FROM lineitem
""")
def q_missing_switches(spark, sf):
    """Missing -> 0, 0 -> missing, missing -> <EMPTY>."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        fill_zero(F.nullif("l_discount", F.lit(0.05))).alias("filled"),
        zero_to_null(F.col("l_tax")).alias("zero_dropped"),
        empty_sentinel(F.nullif("l_returnflag", F.lit("A"))).alias("sentinel"),
    )


@query("factorize", """
WITH f AS (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY 1),
c AS (SELECT p_type, CAST(row_number() OVER (ORDER BY first, p_type) - 1 AS BIGINT) AS code FROM f)
SELECT p_partkey, part.p_type, c.code FROM part LEFT JOIN c ON part.p_type = c.p_type
""")
def q_factorize(spark, sf):
    """Text -> dense 0-based code by first appearance (order by part key)."""
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    codes = dense_codes(p, "p_type", order_by="p_partkey")
    return attach_group_values(p, codes, ["p_type"])


@query("round2", """
SELECT o_orderkey, round(o_totalprice / 7.0, 2) AS r FROM orders
""")
def q_round2(spark, sf):
    """Two decimals."""
    return table(spark, sf, "orders").select("o_orderkey", round2(F.col("o_totalprice") / F.lit(7.0)).alias("r"))
