"""Gapless ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SALT = 500_000
LEAST_SALTS = 64


def gapless_rank(df: DataFrame, keys: list[str], salt: Column, order: list[Column], n_rows: int, out: str,
                 rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``keys``.

    A group is cut by a hash of ``salt`` into pieces of about ``rows_per_salt``
    rows at most, so that a group with a third of all rows is ranked by many
    tasks; each piece starts where the ones before it end.  ``df`` is read
    twice and should be materialised.  ``n_rows``: its number of rows.
    """
    salts = max(LEAST_SALTS, -(-n_rows // rows_per_salt))
    cut = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    by = [*keys, "__salt"]
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*by).agg(F.count("*").alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    )
    ranked = cut.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return (
        ranked.join(starts, by)
        .withColumn(out, (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__salt", "__start", "__at")
    )
