"""Skew-safe ordered scans within groups.

A window ``partitionBy(keys)`` sends a whole group to one task, so one key
holding a third of the rows means one task doing a third of the work.  Here
rows are cut by the *full* ``(keys, order)`` tuple into as many ranges as
there are shuffle partitions, at the quantiles of a random sample of
``SAMPLE_PER_RANGE`` rows a range; a hot key spans several ranges, whatever
its values look like.  A row finds its range by binary search in a literal
array of boundary tuples (or, where there are few, by comparing with each of
them in generated code), so the number is a function of the row alone and the
rows shuffle once, by ``(range, keys)``.  Windows run per segment, and a
key that spans several ranges is corrected with the sums of its other
segments.  A boundary splits at most one key, so there are fewer than two
corrections per range.

Quantiles do not rank rows at all: equal values are counted first
(``groupBy(keys, value).count()``, partially aggregated), and the running
sums go over distinct values weighted by their counts.  A value that most
rows share is one row by then.

The plan is the same for inputs of every size.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.session import default_parallelism, materialize
from tablelens.sources.schema import quote

RANGE = "__tl_range"
SAMPLE_PER_RANGE = 64
SAMPLED_FOR_ONE = 8
FEW_BOUNDARIES = 64


def _sql_literal(value, kind: T.DataType) -> str:
    """``value`` as an SQL literal of the type ``kind`` (one expression is far quicker to build than hundreds of columns)."""
    if value is None:
        return f"CAST(NULL AS {kind.simpleString()})"
    if isinstance(kind, T.ArrayType):
        return f"CAST(array({', '.join(_sql_literal(v, kind.elementType) for v in value)}) AS {kind.simpleString()})"
    if isinstance(kind, T.StructType):
        fields = ", ".join(f"'f{i}', {_sql_literal(v, f.dataType)}" for i, (v, f) in enumerate(zip(value, kind.fields)))
        return f"CAST(named_struct({fields}) AS {kind.simpleString()})"
    data = bytes(value) if isinstance(kind, T.BinaryType) else str(value).encode()
    text = f"X'{data.hex()}'"
    return text if isinstance(kind, T.BinaryType) else f"CAST(CAST({text} AS STRING) AS {kind.simpleString()})"


def range_number(df: DataFrame, cols: list[str], ranges: int) -> Column:
    """0 to ``ranges - 1``, never decreasing along ``cols`` (nulls first, NaN
    last): the number of sampled boundaries below the row.  Rows are sampled
    where they lie, about ``SAMPLE_PER_RANGE`` a range; one task sorts them, in
    Spark's own order, and every ``SAMPLED_FOR_ONE``-th goes to the driver."""
    if ranges <= 1 or not cols:
        return F.lit(0)
    plain = [F.col(quote(c)).alias(f"c{i}") for i, c in enumerate(cols)]
    share = SAMPLE_PER_RANGE * ranges / max(1, df.count())
    sample = df.select(*plain).where(F.rand(42) < share) if share < 1 else df.select(*plain)
    types = [df.schema[c].dataType for c in cols]
    moment = (T.DateType, T.TimestampType, T.TimestampNTZType)  # to the driver and back as text, whatever its time zone
    ordered = sample.repartition(1).sortWithinPartitions(*[F.col(f"c{i}").asc_nulls_first() for i in range(len(cols))])
    rows = ordered.withColumn("at", F.monotonically_increasing_id()).where(F.col("at") % SAMPLED_FOR_ONE == 0).select(
        *[F.col(f"c{i}").cast("string") if isinstance(t, moment) else F.col(f"c{i}") for i, t in enumerate(types)]).collect()
    picks = list(dict.fromkeys(rows[len(rows) * i // ranges] for i in range(1, ranges) if rows))
    if not picks:
        return F.lit(0)
    bound = lambda r: "named_struct(" + ", ".join(f"'c{i}', {_sql_literal(v, t)}" for i, (v, t) in enumerate(zip(r, types))) + ")"
    row = F.struct(*plain)
    if len(picks) <= FEW_BOUNDARIES:
        this = "named_struct(" + ", ".join(f"'c{i}', {quote(c)}" for i, c in enumerate(cols)) + ")"
        return F.expr(" + ".join(f"CAST({bound(r)} < {this} AS INT)" for r in picks))
    bounds = F.expr(f"array({', '.join(map(bound, picks))})")
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(len(picks).bit_length()))])
    fits = lambda n: (n <= len(picks)) & (F.element_at(bounds, F.least(n, F.lit(len(picks)))) < row)
    return F.aggregate(strides, F.lit(0), lambda n, stride: F.when(fits(n + stride), n + stride).otherwise(n))


def segmented_scan(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    measures: dict[str, Column],
    running: bool = True,
    totals: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Per-group running sums (in ``order_by`` order) and/or group totals.

    For each ``name -> expr`` in ``measures`` adds ``{name}_run`` (inclusive
    running sum within the group, rows ordered by ``order_by``, nulls first
    and NaN last; the order must be unique within a group for a
    deterministic result) and/or ``{name}_tot`` (sum over the whole group).
    Null keys form a group.  The result keeps every input row and column.
    """
    keys, order_by = list(keys), list(order_by)
    ranges = ranges or default_parallelism(df.sparkSession)
    names = {f"__tl_m{i}": name for i, name in enumerate(measures)}
    key_cols = [F.col(quote(k)) for k in keys]
    order = [F.col(quote(c)).asc_nulls_first() for c in order_by]
    rows = df.withColumns({m: measures[name] for m, name in names.items()})
    cut = rows.withColumn(RANGE, range_number(df, keys + order_by, ranges))

    by_range = Window.partitionBy(*key_cols).orderBy(RANGE)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    segments = cut.groupBy(RANGE, *key_cols).agg(*[F.sum(m).alias(m) for m in names])
    fixes = segments.select(  # without keys: one row per range, in one task
        F.col(RANGE).alias("__tl_at"), *[k.alias(f"__tl_k{i}") for i, k in enumerate(key_cols)],
        *[F.sum(m).over(before).alias(f"{m}_before") for m in names],
        *[F.sum(m).over(whole).alias(f"{m}_whole") for m in names],
        F.count(F.lit(1)).over(whole).alias("__tl_segments"),
    ).where(F.col("__tl_segments") > 1).drop("__tl_segments")

    segment = Window.partitionBy(RANGE, *key_cols)
    upto = segment.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {f"{m}_run": F.sum(m).over(upto) for m in names if running} | {f"{m}_tot": F.sum(m).over(segment) for m in names if totals}
    on = F.col(RANGE) == F.col("__tl_at")
    for i, k in enumerate(key_cols):
        on &= k.eqNullSafe(F.col(f"__tl_k{i}"))
    joined = cut.withColumns(own).join(F.broadcast(fixes), on, "left")  # fewer than two rows per range
    out = {}
    for m, name in names.items():
        if running:
            earlier = F.col(f"{m}_before")
            out[f"{name}_run"] = F.when(earlier.isNull(), F.col(f"{m}_run")).otherwise(
                earlier + F.coalesce(F.col(f"{m}_run"), F.lit(0)))
        if totals:
            out[f"{name}_tot"] = F.coalesce(F.col(f"{m}_whole"), F.col(f"{m}_tot"))
    return joined.select(*[F.col(quote(c)) for c in df.columns], *[e.alias(n) for n, e in out.items()])


def _position(n: Column, p, method: str) -> Column:
    """0-based fractional position of the ``p`` quantile in ``n`` sorted values."""
    p = p if isinstance(p, Column) else F.lit(p)
    if method == "linear":  # pandas / Spark percentile: (n - 1) p
        return (n - 1) * p
    if method == "midpoint_rank":  # rank n p + 0.5 (1-based), clamped to the ends
        return F.least(F.greatest(n * p - F.lit(0.5), F.lit(0.0)), (n - 1).cast("double"))
    raise ValueError(f"unknown quantile method {method!r}")


def value_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct non-missing values per group: keys, ``x``, ``w`` (its rows),
    ``before`` (rows with a smaller value) and ``n`` (rows of the group)."""
    key_cols = [F.col(quote(k)) for k in keys]
    counts = materialize(  # the only read of the rows; what follows reads distinct values
        df.where(F.col(quote(value)).isNotNull()).groupBy(*key_cols, F.col(quote(value)).alias("x"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    s = segmented_scan(counts, keys, ["x"], {"__tl_w": F.col("w")}, running=True, totals=True)
    return s.select(*key_cols, "x", "w", (F.col("__tl_w_run") - F.col("w")).alias("before"), F.col("__tl_w_tot").alias("n"))


def quantiles_of(hist: DataFrame, keys: list[str], probs: list[float], names: list[str], method: str = "linear") -> DataFrame:
    """Exact quantiles per group of a :func:`value_histogram`, plus ``n``.

    A distinct value holds the positions ``before`` to ``before + w - 1``; the
    at most ``2 * len(probs)`` values per group that hold a needed position
    are kept and interpolated linearly.
    """
    n, first, last = F.col("n"), F.col("before"), F.col("before") + F.col("w") - 1
    at = [_position(n, float(p), method) for p in probs]
    holds = lambda h: (first <= h) & (h <= last)
    held = functools.reduce(operator.or_, [holds(F.floor(h)) | holds(F.ceil(h)) for h in at])
    # The partition's number keeps the condition above the columns it reads: pushed below, it would hold each of
    # their expressions dozens of times and make a method too long to be compiled.
    kept = hist.withColumn("__tl_part", F.spark_partition_id()).where(held & (F.col("__tl_part") >= 0))
    key_cols = [F.col(quote(k)) for k in keys]
    ends = [F.max(F.when(holds(side(h)), F.col("x"))).alias(f"__tl_{name}{i}") for i, h in enumerate(at) for name, side in (("lo", F.floor), ("hi", F.ceil))]
    per = kept.groupBy(*key_cols).agg(F.max("n").alias("n"), *ends)
    between = [F.col(f"__tl_lo{i}") + (F.col(f"__tl_hi{i}") - F.col(f"__tl_lo{i}")) * (h - F.floor(h)) for i, h in enumerate(at)]
    return per.where("n IS NOT NULL").select(*key_cols, "n", *[q.alias(name) for q, name in zip(between, names)])


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str] | None = None,
                    method: str = "linear") -> DataFrame:
    """Exact quantiles of ``value`` per group, one row per group, with ``n``
    (its non-missing count).  A group without values is absent."""
    names = names or [f"q{i}" for i in range(len(probs))]
    return quantiles_of(value_histogram(df, list(keys), value), list(keys), probs, names, method)


SKETCH_ACCURACY = 10_000


def sketched_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str] | None = None,
                       accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Quantiles of ``value`` per group within a stated rank error, one row per
    group, with ``n`` (its non-missing count).

    One aggregate of mergeable sketches: tasks send a few thousand numbers a
    group, whatever its rows.  Each result is a value of the group whose rank
    is off by at most ``n / accuracy`` (see :func:`rank_error`; the sketch is
    twice as fine, for the rounding to whole ranks); the quantiles 0 and 1 are
    the least and greatest value.  A group without values is absent.
    """
    names = names or [f"q{i}" for i in range(len(probs))]
    v = F.col(quote(value))
    found = df.where(v.isNotNull()).groupBy(*[F.col(quote(k)) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(v.cast("double"), F.array(*[F.lit(float(p)) for p in probs]), F.lit(2 * int(accuracy))).alias("__tl_q"))
    if not keys:
        found = found.where("n > 0")
    return found.select(*[F.col(quote(k)) for k in keys], "n", *[F.col("__tl_q")[i].alias(c) for i, c in enumerate(names)])


def rank_error(below: Column, upto: Column, n: Column, p: float) -> Column:
    """How far, as a share of ``n``, the rank ``n p`` lies from a value that
    has ``below`` smaller values and ``upto`` that are no greater."""
    rank = n * F.lit(float(p))
    return F.greatest(F.lit(0.0), (below - rank) / n, (rank - upto) / n)


def dense_codes(df: DataFrame, value: str, order_by: str | None = None, out: str = "code") -> DataFrame:
    """Distinct non-null ``value``s with a dense 0-based code.

    Codes follow ``min(order_by)`` per value (first appearance) when given,
    else the value itself.  Computed over the distinct values with a
    segmented scan, so no single task ranks the whole domain.
    """
    v = F.col(quote(value))
    base = df.where(v.isNotNull())
    if order_by:
        domain, order = base.groupBy(v).agg(F.min(F.col(quote(order_by))).alias("__tl_first")), ["__tl_first", value]
    else:
        domain, order = base.select(v).distinct(), [value]
    s = segmented_scan(domain, [], order, {"__tl_one": F.lit(1)}, running=True)
    return s.select(v, (F.col("__tl_one_run") - 1).cast("long").alias(out))
