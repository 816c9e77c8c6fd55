"""Registry of named queries: each pairs a Spark plan built with this
library with the same question stated in plain SQL (for an independent
engine to check).  Queries read the given tables in full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablelens.sources.io import load_table

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None  # None: not expressible in SQL; rows-only check
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None):
    """Decorator registering ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name!r}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, (fn.__doc__ or "").strip())
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from tablelens.plans import (  # noqa: F401
        binning_queries,
        chart_queries,
        cluster_queries,
        corr_queries,
        filter_queries,
        groupagg_queries,
        order_queries,
        scalar_queries,
        schema_queries,
        source_queries,
    )

    return REGISTRY
