"""Group aggregates attached to every row.

Plan shape, chosen for skew: each metric is computed once per group with
partial (map-side) aggregation, so a group holding a third of the rows
costs no single task more than its share.  The small per-group table is
materialized, its row count checked, and joined back to the rows by a
broadcast when bounded.  Beyond that, keys with more than a partition's share
of the rows are counted exactly; there are fewer of them than partitions, so
their group rows are broadcast and their rows never move, while the other rows
take a shuffle join.  Medians come from counted distinct values (or, with an
``accuracy``, from mergeable sketches), running sums from a segmented scan, so
no metric gathers a whole group into one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.constants import EMPTY_SENTINEL, METRIC_ALIASES, NUMERIC_ONLY_METRICS
from tablelens.operators.scan import group_quantiles, segmented_scan, sketched_quantiles
from tablelens.session import BROADCAST_MAX_ROWS, checked_broadcast, default_parallelism, materialize
from tablelens.sources.schema import (
    class_of_type,
    col,
    num,
    quote,
    resolve_columns,
    squashed,
    unique_column_name,
    value_col,
)

ALL_METRICS = ("mean", "median", "sum", "min", "max", "std", "count", "nunique", "mode", "cumsum")


def normalize_metric(name) -> str:
    """Alias (EN/RU, any case/spacing) -> metric name; unknown kept."""
    token = squashed(name)
    return METRIC_ALIASES.get(token, token)


def normalize_metrics(names) -> list[str]:
    return list(dict.fromkeys(m for m in (normalize_metric(n) for n in names or []) if m))


@dataclass
class AggResult:
    df: DataFrame
    added: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def _x_value(df: DataFrame, c: str, exclude_empty: bool, exclude_zeros: bool) -> Column:
    """Numeric value after the switches: empty off fills 0, zeros on drops 0."""
    dt = df.schema[c].dataType
    x = col(c).cast("int").cast("double") if isinstance(dt, T.BooleanType) else num(c)
    if not exclude_empty:
        x = F.coalesce(x, F.lit(0.0))
    if exclude_zeros:
        x = F.nullif(x, F.lit(0.0))
    return x


def _sort_key_numeric_text(v: Column) -> Column:
    """Order for mixed numeric/sentinel values: by number, sentinel last."""
    return F.struct((v == F.lit(EMPTY_SENTINEL)).alias("s"), v.try_cast("double").alias("n"), v.alias("t"))


def group_aggregate(
    df: DataFrame,
    keys,
    cols,
    metrics,
    exclude_empty: bool = True,
    exclude_zeros: bool = False,
    order_by: list[str] | None = None,
    broadcast_max_rows: int = BROADCAST_MAX_ROWS,
    accuracy: int | None = None,
) -> AggResult:
    """Keys x cols x metrics as new columns; row count never changes.

    ``order_by`` (unique within a group) defines row order for ``cumsum``.
    Medians are exact, or with an ``accuracy`` a value whose rank is off by at
    most 1 / ``accuracy`` of its group.
    Returns the frame, the added names, skipped ``(col, metric)`` pairs and
    unknown names.  Nothing chosen or nothing found -> frame unchanged.
    """
    keys_f, miss_k = resolve_columns(df, keys)
    cols_f, miss_c = resolve_columns(df, cols)
    mets = normalize_metrics(metrics)
    res = AggResult(df=df, missing=miss_k + miss_c)
    if not keys_f or not cols_f or not mets:
        return res

    kcols = [col(k) for k in keys_f]
    agg_exprs: list[Column] = []      # aggregates over plain groups
    side_tables: list[DataFrame] = []  # per-group tables from extra aggregations
    names_taken = list(df.columns)
    cumsums: list[tuple[str, str]] = []
    plan: list[str] = []  # output names in order of creation

    def new_name(base: str) -> str:
        n = unique_column_name(names_taken, base)
        names_taken.append(n)
        plan.append(n)
        return n

    for c in cols_f:
        dt = df.schema[c].dataType
        is_num = class_of_type(dt) == "numeric"
        for m in mets:
            if m not in ALL_METRICS or (m in NUMERIC_ONLY_METRICS and not is_num):
                res.skipped.append((c, m))
                continue
            if m == "cumsum":
                if not order_by:
                    raise ValueError("cumsum needs order_by: Spark rows have no implicit order")
                cumsums.append((c, new_name(f"{c}_cumsum")))
                continue
            out = new_name(f"{c}_{m}")
            if m in ("mean", "sum", "min", "max", "std"):
                x = _x_value(df, c, exclude_empty, exclude_zeros)
                fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[m]
                e = fn(x)
                if m == "sum":
                    e = F.coalesce(e, F.lit(0.0))
                agg_exprs.append(e.alias(out))
            elif m == "count":
                if exclude_empty:
                    x = _x_value(df, c, True, exclude_zeros) if is_num else col(c)
                    agg_exprs.append(F.count(x).alias(out))
                else:
                    agg_exprs.append(F.count(F.lit(1)).alias(out))
            elif m == "median":
                x = _x_value(df, c, exclude_empty, exclude_zeros)
                values = df.select(*kcols, x.alias("__tl_v"))
                q = (sketched_quantiles(values, keys_f, "__tl_v", [0.5], [out], accuracy) if accuracy
                     else group_quantiles(values, keys_f, "__tl_v", [0.5], names=[out]))
                side_tables.append(q.drop("n"))
            elif m == "nunique":
                side_tables.append(_nunique_table(df, keys_f, c, is_num, exclude_empty, exclude_zeros, out))
            elif m == "mode":
                side_tables.append(_mode_table(df, keys_f, c, is_num, exclude_empty, exclude_zeros, out))

    out_df = df
    if cumsums:
        measures = {name: F.coalesce(num(c), F.lit(0.0)) for c, name in cumsums}
        out_df = segmented_scan(out_df, keys_f, list(order_by), measures, running=True)
        any_null_key = None
        for k in keys_f:
            t = col(k).isNull()
            any_null_key = t if any_null_key is None else (any_null_key | t)
        out_df = out_df.withColumns({
            name: F.when(any_null_key, F.lit(None).cast("double")).otherwise(F.col(f"{quote(name + '_run')}"))
            for _, name in cumsums
        }).drop(*[name + "_run" for _, name in cumsums])

    if agg_exprs or side_tables:
        g = df.groupBy(*kcols).agg(*agg_exprs) if agg_exprs else None
        for t in side_tables:
            g = t if g is None else _join_groups(g, t, keys_f)
        out_df = attach_group_values(out_df, g, keys_f, broadcast_max_rows)

    res.df = out_df.select(*[col(c) for c in df.columns], *[col(n) for n in plan])
    res.added = plan
    return res


def _rename_keys(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.withColumnsRenamed({k: f"__tl_g{i}" for i, k in enumerate(keys)})


def _key_cond(keys: list[str]) -> Column:
    cond = None
    for i, k in enumerate(keys):
        c = col(k).eqNullSafe(F.col(f"__tl_g{i}"))
        cond = c if cond is None else cond & c
    return cond


def _join_groups(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two per-group tables on null-safe keys."""
    b2 = _rename_keys(b, keys)
    j = a.join(b2, _key_cond(keys), "full")
    return j.withColumns({k: F.coalesce(col(k), F.col(f"__tl_g{i}")) for i, k in enumerate(keys)}).drop(
        *[f"__tl_g{i}" for i in range(len(keys))]
    )


def heavy_keys(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The keys (columns ``__tl_g0``, ...) of more rows than one of ``parts``
    equal shares, counted exactly; fewer than ``parts`` rows by construction."""
    parts = parts or default_parallelism(df.sparkSession)
    counts = materialize(df.groupBy(*[col(k).alias(f"__tl_g{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__tl_n")))
    total = counts.agg(F.sum("__tl_n")).first()[0] or 0
    return counts.where(F.col("__tl_n") * parts > total).drop("__tl_n")


def attach_group_values(df: DataFrame, groups: DataFrame, keys: list[str], broadcast_max_rows: int = BROADCAST_MAX_ROWS,
                        ready: bool = False) -> DataFrame:
    """Left-join a per-group table onto every row (null key matches null key).

    The group table is materialized first, unless it is (``ready``); it is broadcast only when its
    exact row count is within ``broadcast_max_rows``.  Else rows of heavy keys
    (:func:`heavy_keys`) meet their broadcast group rows where they lie, and
    the others, none of which is heavy, shuffle.  No row moves by a salt, so a
    task that runs again gives the same rows.
    """
    if not keys:  # one global row: equi-join on a constant key, not a cross join
        g, _ = checked_broadcast(groups.withColumn("__tl_g0", F.lit(0)), broadcast_max_rows, ready=ready)
        return df.withColumn("__tl_c0", F.lit(0)).join(g, F.col("__tl_c0") == F.col("__tl_g0"), "left").drop(
            "__tl_c0", "__tl_g0"
        )
    names = [f"__tl_g{i}" for i in range(len(keys))]
    g, small = checked_broadcast(_rename_keys(groups, keys), broadcast_max_rows, ready=ready)
    if small:
        return df.join(g, _key_cond(keys), "left").drop(*names)
    heavy = materialize(heavy_keys(df, keys))  # fewer rows than there are partitions
    if heavy.isEmpty():
        return df.join(g, _key_cond(keys), "left").drop(*names)
    same = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"{n}_heavy"))
        same = c if same is None else same & c
    known = heavy.withColumnsRenamed({n: f"{n}_heavy" for n in names})
    theirs = known.join(g, same, "left").drop(*names).withColumnsRenamed({f"{n}_heavy": n for n in names})
    stay = df.join(F.broadcast(theirs), _key_cond(keys), "inner").drop(*names)
    move = df.join(F.broadcast(heavy), _key_cond(keys), "left_anti").join(g, _key_cond(keys), "left").drop(*names)
    return stay.unionByName(move)


def _nunique_table(df, keys, c, is_num, exclude_empty, exclude_zeros, out) -> DataFrame:
    """Distinct values per group via two partial aggregations.

    Missing (and, for numbers with zeros excluded, zero) values are one
    extra value exactly when ``exclude_empty`` is off.
    """
    kcols = [col(k) for k in keys]
    v = value_col(df, c)
    gone = v.isNull()
    if is_num and exclude_zeros:
        gone = gone | (v.cast("double") == F.lit(0.0))
    return df.groupBy(*kcols).agg(
        (
            F.count_distinct(F.when(~gone, v))
            + (F.lit(0) if exclude_empty else F.max(gone.cast("int")))
        ).cast("long").alias(out)
    )


def _mode_table(df, keys, c, is_num, exclude_empty, exclude_zeros, out) -> DataFrame:
    """Most frequent value per group, ties to the smallest.

    ``groupBy(keys, value).count`` is partially aggregated, then the winner
    per group is ``min(struct(-count, order, value))``: constant-size state,
    no group gathered into one task.
    """
    kcols = [col(k) for k in keys]
    v = value_col(df, c)
    sentinel = (not exclude_empty) and not (is_num and exclude_zeros)
    if is_num and exclude_zeros:
        v = F.when(v.cast("double") != F.lit(0.0), v)
    if sentinel:
        v = F.coalesce(v.cast("string"), F.lit(EMPTY_SENTINEL))
        order = _sort_key_numeric_text(v) if is_num else v
    else:
        order = v
    counts = (
        df.select(*kcols, v.alias("__tl_v"), order.alias("__tl_o"))
        .where(F.col("__tl_v").isNotNull())
        .groupBy(*kcols, "__tl_v", "__tl_o")
        .agg(F.count(F.lit(1)).alias("__tl_n"))
    )
    best = counts.groupBy(*kcols).agg(
        F.min(F.struct((-F.col("__tl_n")).alias("n"), F.col("__tl_o").alias("o"), F.col("__tl_v").alias("v"))).alias("__tl_w")
    )
    # Groups without any value get no row here; the left join back gives NULL.
    return best.select(*kcols, F.col("__tl_w.v").alias(out))
