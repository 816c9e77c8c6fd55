"""Schema facts and column-name handling (no Spark job runs here).

Column classes follow one rule: timestamps and dates are *datetime*,
numbers and booleans are *numeric*, everything else is *categorical*.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.constants import BIN_COLUMN_PREFIX, CATEGORICAL_NAME_WORDS, CLUSTER_COLUMN, PCA_COLUMNS

_DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class ColumnClasses:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def class_of(self, name: str) -> str | None:
        for cls in ("numeric", "categorical", "datetime"):
            if name in getattr(self, cls):
                return cls
        return None


def class_of_type(dt: T.DataType) -> str:
    if isinstance(dt, _DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return "numeric"
    return "categorical"


def classify_columns(df: DataFrame) -> ColumnClasses:
    """A3: numeric / categorical / datetime, in column order."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": []}
    for f in df.schema.fields:
        out[class_of_type(f.dataType)].append(f.name)
    return ColumnClasses(columns=list(df.columns), **out)


def is_numeric(df: DataFrame, name: str) -> bool:
    return class_of_type(df.schema[name].dataType) == "numeric"


def is_plain_number(df: DataFrame, name: str) -> bool:
    """Numeric but not boolean (what correlation and clustering accept)."""
    dt = df.schema[name].dataType
    return isinstance(dt, T.NumericType)


def dataset_meta(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A4: one row per column: (position, column, class)."""
    rows = [(i, f.name, class_of_type(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, class string")


_ROLE_ALL = {"x", "y", "z", "hover", "text", "agg_keys", "agg_cols", "text_copy"}
_ROLE_NUMERIC = {"size", "corr", "bin", "cluster"}


def eligible_columns(df: DataFrame, role: str, none_choice: str | None = None) -> list[str]:
    """A5: the columns that may play ``role`` (schema only).

    ``color``: categorical then numeric, never datetime; ``facet``: all.
    Both are preceded by ``none_choice`` when given.  ``filter``:
    categorical, numeric, datetime in that order.
    """
    cc = classify_columns(df)
    if role in _ROLE_ALL:
        return list(cc.columns)
    if role in _ROLE_NUMERIC:
        return list(cc.numeric)
    if role == "color":
        head = [none_choice] if none_choice else []
        return head + cc.categorical + cc.numeric
    if role == "facet":
        head = [none_choice] if none_choice else []
        return head + list(cc.columns)
    if role == "filter":
        return cc.categorical + cc.numeric + cc.datetime
    raise ValueError(f"unknown role {role!r}")


def squashed(name: object) -> str:
    """A name as it is compared loosely: lower case, no white space of any kind."""
    return "".join(str(name).split()).lower()


def resolve_columns(df: DataFrame, names, exact_first: bool = True) -> tuple[list[str], list[str]]:
    """Requested names as real ones, and those that match nothing.

    A name stands for the column of that name or, failing that (or with
    ``exact_first`` off), for the last column that is spelt alike apart from
    case and white space.  Requests keep their order; a column is listed once.
    """
    loose = {squashed(c): c for c in df.columns}
    exact = {c: c for c in df.columns} if exact_first else {}
    asked = [(n, exact.get(n) or loose.get(squashed(n))) for n in names or []]
    return list(dict.fromkeys(c for _, c in asked if c)), [n for n, c in asked if not c]


def select_existing(df: DataFrame, cols) -> DataFrame:
    """A10: keep requested columns that exist, in requested order."""
    kept = [c for c in dict.fromkeys(cols or []) if c in df.columns]
    return df.select(*[quote(c) for c in kept])


def unique_column_name(df_or_cols, base: str) -> str:
    """The first of ``base``, ``base_2``, ``base_3``, ... that no column has, whatever its case."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else df_or_cols
    taken = set(map(str.lower, cols))
    names = itertools.chain([base], (f"{base}_{i}" for i in itertools.count(2)))
    return next(n for n in names if n.lower() not in taken)


def drop_derived(df: DataFrame, kind: str) -> DataFrame:
    """Remove earlier outputs of a derive step before recomputing it."""
    if kind == "bins":
        names = [c for c in df.columns if c.startswith(BIN_COLUMN_PREFIX) and c.endswith(")")]
    elif kind == "clusters":
        names = [c for c in df.columns if c in (*PCA_COLUMNS, CLUSTER_COLUMN)]
    else:
        raise ValueError(f"unknown derived kind {kind!r}")
    return df.drop(*names) if names else df


def force_text_by_pattern(df: DataFrame, patterns) -> DataFrame:
    """Cast to text every column whose lower-cased name holds a pattern."""
    pats = [p.lower() for p in patterns or []]
    targets = {c: F.col(quote(c)).cast("string") for c in df.columns if any(p in c.lower() for p in pats)}
    return df.withColumns(targets) if targets else df


def quote(name: str) -> str:
    """Backtick-quote a column name so dots, brackets and spaces are literal."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def needs_text_axis(df: DataFrame, x: str, force: bool = False) -> bool:
    """X is drawn as text unless it is datetime or numeric (or forced)."""
    if force:
        return True
    return class_of_type(df.schema[x].dataType) == "categorical"


def as_text_axis(df: DataFrame, x: str, force: bool = False) -> DataFrame:
    """``df`` with X as text where it is drawn as text."""
    if needs_text_axis(df, x, force) and not isinstance(df.schema[x].dataType, T.StringType):
        return df.withColumn(x, col(x).cast("string"))
    return df


def is_categorical_by_name(name: str, words=CATEGORICAL_NAME_WORDS) -> bool:
    """Identifier-like names (well, cluster pad ...) are categories."""
    low = str(name).lower()
    return any(w in low for w in words)


def num(name: str) -> Column:
    """Numeric value of a column as double, NaN read as missing.

    NaN handling sits here, where values are consumed, not in a projection
    at load time: a projection over the scan would stop range filters from
    reaching Parquet (no ``PushedFilters``).
    """
    # try_cast: text that is not a number reads as missing (never raises
    # under ANSI), as a coercing to-number conversion does.
    return F.nanvl(col(name).try_cast("double"), F.lit(None).cast("double"))


def value_col(df: DataFrame, name: str) -> Column:
    """A column as is, except that NaN in a float column reads as missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(col(name), F.lit(None).cast(df.schema[name].dataType))
    return col(name)
