"""Row predicates (B1-B3): built as Spark Columns so Catalyst can push them
into the scan."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lit_for(value, dtype: T.DataType | None) -> Column:
    if dtype is not None and isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, str):
            return F.lit(value).cast(dtype)
    return F.lit(value)


def range_predicate(c: Column, lo=None, hi=None, dtype: T.DataType | None = None) -> Column:
    """B1: ``lo <= c <= hi``, both ends inclusive, either may be None.

    Missing values never pass a given end (a NULL comparison drops the row);
    without any end nothing is asked and every row passes.
    """
    if lo is None and hi is None:
        return F.lit(True)
    if lo is not None and hi is not None:
        return c.between(_lit_for(lo, dtype), _lit_for(hi, dtype))
    if lo is not None:
        return (c >= _lit_for(lo, dtype)) & ~F.isnan(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c >= _lit_for(lo, dtype)
    return c <= _lit_for(hi, dtype)


def isin_predicate(c: Column, values, dtype: T.DataType | None = None) -> Column:
    """B2: ``c`` in a list; a scalar counts as a list of one; NULL never matches.

    On a datetime column, ISO strings are cast to the column's type.
    """
    if isinstance(values, (str, int, float, bool, _dt.date)) or not isinstance(values, Iterable):
        values = [values]
    lits = [_lit_for(v, dtype) for v in values if v is not None]
    if not lits:
        return F.lit(False)
    return c.isin(*lits)


def equals_predicate(c: Column, value, dtype: T.DataType | None = None) -> Column:
    """Plain equality with a scalar."""
    return c == _lit_for(value, dtype)
