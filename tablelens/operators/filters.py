"""Row filters.

All specs fold into one predicate, so the plan has a single ``Filter`` that
Catalyst pushes into the Parquet scan (``PushedFilters``).  Value lists beyond
``LONG_LIST`` become a table of keys: a left semi join, broadcast only if the
keys' exact size allows it, behind a range predicate (least to greatest key)
that the scan can use.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.predicates import isin_predicate, range_predicate
from tablelens.session import BROADCAST_MAX_ROWS, checked_broadcast
from tablelens.sources.schema import class_of_type, col, quote

LONG_LIST = 1000
KEY = "__tl_key"


@dataclass(frozen=True)
class FilterSpec:
    column: str | None
    value: Any


def _is_empty(v) -> bool:
    return v is None or (isinstance(v, (list, tuple, str)) and len(v) == 0)


def is_long(value) -> bool:
    """A table of keys, or a list longer than ``LONG_LIST``."""
    return isinstance(value, DataFrame) or (isinstance(value, (list, tuple, set, frozenset)) and len(value) > LONG_LIST)


def _is_join(df: DataFrame, column: str, value) -> bool:
    """A spec that is a semi join: a table of keys, or a long list on a column that takes lists."""
    return isinstance(value, DataFrame) or (is_long(value) and class_of_type(df.schema[column].dataType) != "numeric")


def filter_isin_long(df: DataFrame, column: str, values, broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """B2 for very many values: rows whose ``column`` is among ``values``.

    ``values`` is a list, or a one-column frame of any size.  Keys take the
    column's type (text that is none is no key), each once; NULL never
    matches, and a NaN key matches nothing.
    """
    kind = df.schema[column].dataType
    if isinstance(values, DataFrame):
        raw = values.select(F.col(quote(values.columns[0])).alias(KEY))
    else:
        plain = [str(v) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else v for v in values if v is not None]
        if isinstance(kind, T.NumericType):  # numbers of one kind; text among them is read as a number
            plain = [str(v) for v in plain]
        elif isinstance(kind, T.StringType):
            plain = [v for v in plain if isinstance(v, str)]
        raw = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(plain)], f"{KEY} {'boolean' if isinstance(kind, T.BooleanType) else 'string'}")
    key = F.col(KEY).try_cast(kind.simpleString())
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        key = F.when(~F.isnan(key), key)
    elif isinstance(kind, T.IntegralType) and isinstance(raw.schema[KEY].dataType, T.StringType):
        number = F.col(KEY).try_cast("decimal(38,10)")
        key = F.when(number == F.floor(number), number.try_cast(kind.simpleString()))  # 3.0 is a key, 3.5 is none
    keys, _ = checked_broadcast(raw.select(key.alias(KEY)).where(F.col(KEY).isNotNull()).distinct(), broadcast_max_rows)
    moment = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    shown = [f(KEY).cast("string") if moment else f(KEY) for f in (F.min, F.max)]
    least, most = keys.agg(*shown).first()
    if least is None:
        return df.where(F.lit(False))
    c = col(column)
    near = df.where((c >= F.lit(least).cast(kind)) & (c <= F.lit(most).cast(kind)))
    return near.join(keys, c == F.col(KEY), "left_semi")


def build_predicate(source: DataFrame, specs):
    """One Column AND-ing every usable spec, or None when none applies.

    A spec is skipped when its column is empty/unknown or its value is
    None, ``[]`` or ``''`` (or keys that make a semi join).  A numeric column (class taken from ``source``,
    the unfiltered frame) needs ``[lo, hi]``; others take a value list.
    """
    preds = []
    for spec in specs or []:
        if isinstance(spec, dict):
            spec = FilterSpec(spec.get("column"), spec.get("value"))
        c, v = spec.column, spec.value
        if not c or c not in source.columns or _is_empty(v) or _is_join(source, c, v):
            continue
        dtype = source.schema[c].dataType
        if class_of_type(dtype) == "numeric":
            if not isinstance(v, (list, tuple)) or len(v) != 2:
                raise ValueError(f"numeric filter on {c!r} needs [lo, hi], got {v!r}")
            preds.append(range_predicate(col(c), v[0], v[1], dtype))
        else:
            preds.append(isin_predicate(col(c), v, dtype))
    if not preds:
        return None
    return reduce(lambda a, b: a & b, preds)


def apply_filters(df: DataFrame, specs) -> DataFrame:
    """Keep rows passing every spec (AND); lists beyond ``LONG_LIST`` and
    frames of keys by semi joins after the one predicate."""
    pred = build_predicate(df, specs)
    out = df if pred is None else df.filter(pred)
    for spec in specs or []:
        c, v = (spec.get("column"), spec.get("value")) if isinstance(spec, dict) else (spec.column, spec.value)
        if c and c in df.columns and _is_join(df, c, v):
            out = filter_isin_long(out, c, v)
    return out


def filter_domain_range(df: DataFrame, column: str) -> DataFrame:
    """Slider limits: one row ``(min, max)``."""
    return df.agg(F.min(col(column)).alias("min"), F.max(col(column)).alias("max"))


def filter_domain_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-missing values, ordered by value."""
    return df.select(col(column)).where(col(column).isNotNull()).distinct().orderBy(col(column))


def check_box_columns(df: DataFrame, x: str | None, y: str | None) -> tuple[bool, str]:
    """Box chart precondition: numeric Y with a value, else numeric X alone.

    Schema first; then one aggregate job counts non-missing values.
    """
    def numeric_with_values(c):
        if not c or c not in df.columns or class_of_type(df.schema[c].dataType) != "numeric":
            return False
        return (df.agg(F.count(col(c)).alias("n")).first()["n"] or 0) > 0

    if y:
        if numeric_with_values(y):
            return True, ""
        return False, f"Y column {y!r} has no numeric values"
    if numeric_with_values(x):
        return True, ""
    return False, f"X column {x!r} has no numeric values"


def drop_missing_any(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a missing value in any chosen column."""
    return df.dropna(how="any", subset=[c for c in cols if c in df.columns])


def drop_missing_all(df: DataFrame, cols) -> DataFrame:
    """Drop rows whose chosen columns are all missing."""
    return df.dropna(how="all", subset=[c for c in cols if c in df.columns])


__all__ = [
    "FilterSpec", "build_predicate", "apply_filters", "filter_isin_long", "is_long", "filter_domain_range", "filter_domain_values",
    "check_box_columns", "drop_missing_any", "drop_missing_all", "quote",
]
