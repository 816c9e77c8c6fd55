"""Registered queries: sources and schema handling (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablelens.functions.scalar import coerce_datetime, coerce_numeric
from tablelens.plans.catalog import query, table
from tablelens.session import ensure_checkpoint_dir
from tablelens.sources.io import dataset_info, export_dataset, export_files, list_tables, load_named_table, load_table, read_export
from tablelens.sources.schema import force_text_by_pattern, select_existing


@query("load_table", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders
""")
def q_load_table(spark, sf):
    """A1: load a Parquet table by path (format from the extension)."""
    df = load_table(spark, f"{sf}/orders.parquet")
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("load_named_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_load_named_table(spark, sf):
    """A2: pick one table by name from a folder holding several."""
    return load_named_table(spark, sf, "customer")


@query("load_catalog_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_load_catalog_table(spark, sf):
    """A2: a table that the session's catalog knows by name."""
    table(spark, sf, "supplier").createOrReplaceTempView("tablelens_supplier")
    assert "tablelens_supplier" in list_tables(spark)
    return load_named_table(spark, name="tablelens_supplier")


@query("dataset_info", """
SELECT count(*) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS n_columns,
       'lineitem' AS source, 'lineitem' AS table_name
FROM lineitem
""")
def q_dataset_info(spark, sf):
    """Row and column counts with source and table name."""
    return dataset_info(table(spark, sf, "lineitem"), "lineitem", "lineitem")


@query("coerce_datetime", """
SELECT o_orderkey,
       strftime(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'), '%Y-%m-%d %H:%M:%S') AS o_date
FROM orders
""")
def q_coerce_datetime(spark, sf):
    """Day-first text dates parsed back to timestamps."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_date"))
    return coerce_datetime(o, ["o_date"]).select(
        "o_orderkey", F.date_format("o_date", "yyyy-MM-dd HH:mm:ss").alias("o_date")
    )


@query("coerce_numeric", """
SELECT p_partkey, TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS size_num,
       TRY_CAST(p_brand AS DOUBLE) AS brand_num
FROM part
""")
def q_coerce_numeric(spark, sf):
    """Text to number; unparseable text becomes missing."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        coerce_numeric(F.col("p_size").cast("string")).alias("size_num"),
        coerce_numeric(F.col("p_brand")).alias("brand_num"),
    )


@query("select_existing", "SELECT o_totalprice, o_orderkey FROM orders")
def q_select_existing(spark, sf):
    """A10: requested columns that exist, in requested order."""
    return select_existing(table(spark, sf, "orders"), ["o_totalprice", "no_such_column", "o_orderkey"])


@query("force_text_by_pattern", """
SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders
""")
def q_force_text(spark, sf):
    """Columns whose name holds a pattern become text."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return force_text_by_pattern(o, ["PRICE"])


@query("export_dataset", """
SELECT o_orderstatus, count(*) AS n_rows, min(o_orderkey) AS least, max(o_orderkey) AS greatest, round(sum(o_totalprice), 2) AS total,
       TRUE AS files_bounded, TRUE AS files_disjoint
FROM orders GROUP BY 1
""")
def q_export(spark, sf):
    """Orders written in ranges of the key, at most 5,000 rows a file, read
    back, counted and hashed against the table; no file is larger, and the
    files' key ranges do not overlap."""
    folder = f"{ensure_checkpoint_dir(spark)}/exports-{uuid.uuid4().hex}"
    path = export_dataset(table(spark, sf, "orders"), folder, "orders", sort_by=["o_orderkey"], rows_per_file=5_000, verify=True)
    files = export_files(spark, path, "o_orderkey").agg(
        (F.max("n_rows") <= 5_000).alias("files_bounded"),
        F.array_sort(F.collect_list(F.struct("least", "greatest"))).alias("spans"))  # a row a file
    follow = F.transform(F.sequence(F.lit(0), F.size("spans") - 2), lambda i: F.get("spans", i)["greatest"] < F.get("spans", i + 1)["least"])
    files = files.select("files_bounded", F.when(F.size("spans") < 2, F.lit(True)).otherwise(F.forall(follow, lambda x: x)).alias("files_disjoint"))
    found = read_export(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("greatest"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return found.withColumn("one", F.lit(1)).join(F.broadcast(files.withColumn("one", F.lit(1))), "one").drop("one")  # one row
