"""Registered queries: schema facts.

Each states what the operator says of a table's columns, next to the number
of present values of each column it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.corr import correlation_columns
from tablelens.operators.filters import check_box_columns
from tablelens.operators.order import order_axis_choice, order_categories
from tablelens.plans.catalog import query, table
from tablelens.sources.schema import (
    as_text_axis,
    classify_columns,
    col,
    dataset_meta,
    drop_derived,
    eligible_columns,
    is_categorical_by_name,
    resolve_columns,
    unique_column_name,
)


def _present(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n): present values of each column, from one aggregate."""
    columns = columns if columns is not None else df.columns
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*cells)))


def _facts(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` (about columns; few) with the number of present values of each ``column``."""
    facts = df.sparkSession.createDataFrame(rows, schema)
    return _present(df).join(F.broadcast(facts), "column")


def _present_sql(t: str) -> str:
    return f'(SELECT "column", n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME "column" VALUE n))'


def _class_sql(t: str) -> str:
    return f"""(SELECT column_name AS "column", CAST(row_number() OVER () - 1 AS INTEGER) AS position,
  CASE WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'datetime'
       WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'BOOLEAN') THEN 'numeric' ELSE 'categorical' END AS class
  FROM (DESCRIBE {t}))"""


@query("classify_columns", f"SELECT class, \"column\", n FROM {_class_sql('events')} JOIN {_present_sql('events')} USING (\"column\")")
def q_classify(spark, sf):
    """A3: numeric, categorical and datetime columns of the events."""
    e = table(spark, sf, "events")
    classes = classify_columns(e)
    return _facts(e, [(c, classes.class_of(c)) for c in classes.columns], "column string, class string").select("class", "column", "n")


@query("dataset_meta", f"SELECT position, \"column\", class, n FROM {_class_sql('lineitem')} JOIN {_present_sql('lineitem')} USING (\"column\")")
def q_meta(spark, sf):
    """A4: position, name and class of every column."""
    li = table(spark, sf, "lineitem")
    return _present(li).join(F.broadcast(dataset_meta(spark, li)), "column").select("position", "column", "class", "n")


_ROLES = {"x": None, "size": ("numeric",), "color": ("categorical", "numeric"), "filter": ("categorical", "numeric", "datetime")}


def _role_sql(role: str, classes) -> str:
    if classes is None:
        return f"SELECT '{role}' AS role, \"column\", position FROM c"
    rank = "CASE class " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(classes)) + " END"
    return (f"SELECT '{role}' AS role, \"column\", CAST(row_number() OVER (ORDER BY {rank}, position) - 1 AS INTEGER) AS position "
            f"FROM c WHERE {rank} IS NOT NULL")


@query("eligible_columns", f"WITH c AS {_class_sql('events')}, r AS (" + " UNION ALL ".join(_role_sql(r, k) for r, k in _ROLES.items())
       + f") SELECT role, position, \"column\", n FROM r JOIN {_present_sql('events')} USING (\"column\")")
def q_eligible(spark, sf):
    """A5: which columns may play a role, in the order in which they are offered."""
    e = table(spark, sf, "events")
    rows = [(role, i, c) for role in _ROLES for i, c in enumerate(eligible_columns(e, role))]
    return _facts(e, rows, "role string, position int, column string").select("role", "position", "column", "n")


@query("resolve_columns", """
SELECT CAST(0 AS INTEGER) AS position, 'l_tax' AS "column", count(l_tax) AS n, 'nope' AS missing FROM lineitem
UNION ALL SELECT 1, 'l_quantity', count(l_quantity), 'nope' FROM lineitem
""")
def q_resolve(spark, sf):
    """Names in another case and spacing, a repeated one and an unknown one."""
    li = table(spark, sf, "lineitem")
    found, missing = resolve_columns(li, [" L_TAX", "l_quantity", "nope", "L_ Quantity"])
    rows = _facts(li, [(c, i) for i, c in enumerate(found)], "column string, position int")
    return rows.select("position", "column", "n", F.lit(",".join(missing)).alias("missing"))


@query("unique_column_name", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_tax, l_tax * 2 AS l_tax_2, l_tax * 3 AS "L_TAX_3" FROM lineitem
""")
def q_unique_name(spark, sf):
    """A derived column never takes a name that is there, whatever its case."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_tax")
    li = li.withColumn(unique_column_name(li, "l_tax"), F.col("l_tax") * 2)
    return li.withColumn(unique_column_name(li, "L_TAX"), F.col("l_tax") * 3)


@query("drop_derived", """SELECT p_partkey, p_size, p_size * 2 AS "PCA3" FROM part""")
def q_drop_derived(spark, sf):
    """Earlier bins and cluster outputs go, other columns stay."""
    p = table(spark, sf, "part").select("p_partkey", "p_size").withColumns({
        "Группа(p_size)": F.lit("a"), "Кластеры": F.lit("b"), "PCA1": F.lit(1.0), "PCA2": F.lit(1.0), "PCA3": F.col("p_size") * 2})
    return drop_derived(drop_derived(p, "bins"), "clusters")


@query("check_box_columns", """
SELECT 'o_totalprice' AS y, count(o_totalprice) > 0 AS ok FROM orders
UNION ALL SELECT 'o_orderpriority', FALSE FROM orders HAVING count(*) >= 0
UNION ALL SELECT 'empty', count(CAST(NULL AS DOUBLE)) > 0 FROM orders
""")
def q_check_box(spark, sf):
    """A box needs a number with a value."""
    o = table(spark, sf, "orders").withColumn("empty", F.lit(None).cast("double"))
    checks = [(y, check_box_columns(o, "o_custkey", y)[0]) for y in ("o_totalprice", "o_orderpriority", "empty")]
    return spark.createDataFrame(checks, "y string, ok boolean")


@query("as_text_axis", "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, ts, value FROM events")
def q_as_text_axis(spark, sf):
    """Text on X stays; a number on X becomes text only when forced; a date stays."""
    e = table(spark, sf, "events").select("event_type", "user_id", "ts", "value")
    for x, force in (("event_type", False), ("user_id", True), ("ts", False), ("value", False)):
        e = as_text_axis(e, x, force)
    return e


@query("is_categorical_by_name", """
SELECT 'Well id' AS "column", TRUE AS categorical, count(s_suppkey) AS n FROM supplier
UNION ALL SELECT 'Номер КУСТА', TRUE, count(s_nationkey) FROM supplier
UNION ALL SELECT 's_acctbal', FALSE, count(s_acctbal) FROM supplier
""")
def q_categorical_by_name(spark, sf):
    """Names that mark an identifier."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Well id"), F.col("s_nationkey").alias("Номер КУСТА"), "s_acctbal")
    return _facts(s, [(c, is_categorical_by_name(c)) for c in s.columns], "column string, categorical boolean").select("column", "categorical", "n")


@query("correlation_columns", """
SELECT 'chosen' AS kind, CAST(0 AS INTEGER) AS position, 'l_tax' AS "column", count(l_tax) AS n FROM lineitem
UNION ALL SELECT 'chosen', 1, 'l_orderkey', count(l_orderkey) FROM lineitem
UNION ALL SELECT 'axes', 0, 'l_discount', count(l_discount) FROM lineitem
""" + "".join(f"UNION ALL SELECT 'axes', {i}, '{c}', count({c}) FROM lineitem\n" for i, c in enumerate(
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"], 1)))
def q_correlation_columns(spark, sf):
    """One chosen number is topped up to two; without a choice X leads all numbers."""
    li = table(spark, sf, "lineitem")
    rows = [("chosen", i, c) for i, c in enumerate(correlation_columns(li, ["l_tax", "l_returnflag", "no_such"]))]
    rows += [("axes", i, c) for i, c in enumerate(correlation_columns(li, None, "l_discount", "l_shipdate"))]
    return _facts(li, rows, "kind string, position int, column string").select("kind", "position", "column", "n")


@query("order_axis_choice", """
WITH g AS (SELECT o_orderpriority AS category, sum(o_totalprice) AS metric FROM orders GROUP BY 1)
SELECT 'x' AS axis, category, CAST(row_number() OVER (ORDER BY metric DESC, category) - 1 AS BIGINT) AS position FROM g
""")
def q_axis_choice(spark, sf):
    """A text X is ordered, a number Y is not."""
    o = table(spark, sf, "orders")
    axes = {"x": "o_orderpriority", "y": "o_totalprice"}
    (axis,) = order_axis_choice(o, axes["x"], axes["y"])
    ranked = order_categories(o, axes[axis], "o_totalprice", "total descending")
    return ranked.select(F.lit(axis).alias("axis"), col(axes[axis]).alias("category"), "position")
