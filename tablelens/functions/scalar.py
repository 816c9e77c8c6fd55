"""Row-wise column builders.

All return Spark ``Column`` expressions (or add them to a DataFrame), so
they run inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.constants import CLUSTER_LABEL_PREFIX, DEFAULT_TEXT_SUFFIX, EMPTY_SENTINEL
from tablelens.sources.schema import col, num, quote, resolve_columns, unique_column_name

# --- missing-value switches ------------------------------------------------


def fill_zero(c: Column) -> Column:
    """Missing -> 0."""
    return F.coalesce(c, F.lit(0))


def zero_to_null(c: Column) -> Column:
    """C4: 0 -> missing."""
    return F.nullif(c, F.lit(0))


def empty_sentinel(c: Column) -> Column:
    """Missing -> the text ``<EMPTY>`` so that it counts as a value."""
    return F.coalesce(c.cast("string"), F.lit(EMPTY_SENTINEL))


# --- coercion ---------------------------------------------------------------


def coerce_numeric(c: Column) -> Column:
    """To double; unparseable text and NaN become missing (never raises)."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


# Local (non-ISO) date forms: separator, then time part.  Each is tried only
# on text of its exact shape (a regex test), so no row pays for failed parses.
_LOCAL_SEPARATORS = ("/", ".", "-")
_TIME_PARTS = ((r" \d{1,2}:\d{2}:\d{2}", " H:mm:ss"), (r" \d{1,2}:\d{2}", " H:mm"), ("", ""))


def coerce_datetime_col(c: Column, dtype: T.DataType, dayfirst: bool = True) -> Column:
    """A7 for one column: text -> timestamp; unparseable -> missing.

    ISO forms (``2024-01-02``, ``2024-01-02 10:00:00``, ``T`` separator)
    first, then local forms ``d/M/yyyy``, ``d.M.yyyy``, ``d-M-yyyy`` with an
    optional time, day first (``03/04/2024`` = 3 April) unless ``dayfirst``
    is False, then ``yyyy/M/d``.
    """
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp")
    s = F.trim(c.cast("string"))
    tries = [F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"), F.try_to_timestamp(s))]
    first, second = ("d", "M") if dayfirst else ("M", "d")
    for sep in _LOCAL_SEPARATORS:
        esc = "\\" + sep
        for t_re, t_fmt in _TIME_PARTS:
            shape = rf"^\d{{1,2}}{esc}\d{{1,2}}{esc}\d{{4}}{t_re}$"
            fmt = f"{first}{sep}{second}{sep}yyyy{t_fmt}"
            tries.append(F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))))
    tries.append(F.when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(s, F.lit("yyyy/M/d"))))
    return F.coalesce(*tries)


def coerce_datetime(df: DataFrame, cols, dayfirst: bool = True) -> DataFrame:
    """Parse named columns to timestamps."""
    found, _ = resolve_columns(df, cols)
    return df.withColumns({c: coerce_datetime_col(col(c), df.schema[c].dataType, dayfirst) for c in found})


# --- text copies ------------------------------------------------------------


def strip_text(c: Column) -> Column:
    """Trim all Unicode whitespace (tab, newline, NBSP ...), not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _py_float_text(c: Column) -> Column:
    """Double as text in the plain form users expect (``1e10 -> 10000000000.0``).

    Spark prints ``1.0E10``; between 1e-4 and 1e16 the mantissa/exponent form
    is rewritten as a plain decimal, outside that range as ``1e+16`` style.
    """
    s = c.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(s, "^-", "")
    mant = F.regexp_extract(body, r"^([0-9.]+)E(-?[0-9]+)$", 1)
    exp = F.regexp_extract(body, r"^([0-9.]+)E(-?[0-9]+)$", 2).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mant, r"\.", ""), r"0+$", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    nd = F.length(digits)
    big = F.when(
        nd <= exp + 1, F.concat(digits, F.repeat(F.lit("0"), exp + 1 - nd), F.lit(".0"))
    ).otherwise(F.concat(F.substr(digits, F.lit(1), exp + 1), F.lit("."), F.substr(digits, exp + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    m_short = F.regexp_replace(mant, r"\.0$", "")
    e_abs = F.abs(exp)
    e_txt = F.concat(F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(e_abs.cast("string"), 2, "0"))
    sci = F.concat(m_short, F.lit("e"), e_txt)
    plain = F.when((exp >= 0) & (exp < 16), big).when((exp < 0) & (exp >= -4), small).otherwise(sci)
    return F.when(F.length(mant) == 0, s).otherwise(F.concat(sign, plain))


def text_form(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as a user sees it (§7.4 point 6): booleans ``True``/
    ``False``, timestamps ``yyyy-MM-dd HH:mm:ss``, plain-form doubles."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _py_float_text(F.nanvl(c.cast("double"), F.lit(None).cast("double")))
    return c.cast("string")


def normalize_suffix(suffix: str | None) -> str:
    s = (suffix or "").strip()
    if not s:
        return DEFAULT_TEXT_SUFFIX
    return s if s.startswith("_") else "_" + s


def text_copy(df: DataFrame, cols, suffix: str | None = DEFAULT_TEXT_SUFFIX, strip: bool = True):
    """Add ``{col}{suffix}`` as text for each chosen column.

    Returns ``(df, created, missing)``; unknown names are reported, not
    fatal.  Names resolve without the exact-match step (the last of two
    alike-normalising columns wins), and new names are made unique.
    """
    found, missing = resolve_columns(df, cols, exact_first=False)
    sfx = normalize_suffix(suffix)
    created: list[str] = []
    out = df
    for c in found:
        name = unique_column_name(out, f"{c}{sfx}")
        expr = text_form(col(c), df.schema[c].dataType)
        if strip:
            expr = strip_text(expr)
        out = out.withColumn(name, expr)
        created.append(name)
    return out, created, missing


# --- numeric helpers ----------------------------------------------------------


def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """``(x - mean) / std_pop``; a zero-variance column is divided by 1.

    One aggregate job fetches the 2 * len(cols) moments; the result is a lazy
    projection with literal constants.
    """
    if not cols:
        return df
    stats = df.agg(
        *[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(num(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    adds = {}
    for i, c in enumerate(cols):
        m = stats[f"m{i}"]
        s = stats[f"s{i}"]
        if m is None:
            adds[c + suffix] = F.lit(None).cast("double")
            continue
        s = s if (s is not None and s > 0 and not math.isnan(s)) else 1.0
        adds[c + suffix] = (num(c) - F.lit(float(m))) / F.lit(float(s))
    return df.withColumns(adds)


def round2(c: Column) -> Column:
    """Two decimals."""
    return F.round(c, 2)


def ternary_shares(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """C11: shares of a + b + c; NULL when the sum is 0."""
    tot = a + b + c
    return F.try_divide(a, tot), F.try_divide(b, tot), F.try_divide(c, tot)


def label_cluster(i: Column) -> Column:
    """``Кластер {i}``."""
    return F.concat(F.lit(CLUSTER_LABEL_PREFIX), i.cast("string"))


__all__ = [
    "fill_zero", "zero_to_null", "empty_sentinel", "coerce_numeric", "coerce_datetime",
    "coerce_datetime_col", "strip_text", "text_form", "text_copy", "normalize_suffix",
    "standardize", "round2", "ternary_shares", "label_cluster", "quote",
]
