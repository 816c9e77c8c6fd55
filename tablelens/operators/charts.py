"""Chart datasets (H1-H20): each chart is the aggregate that feeds it.

Row-level charts (scatter, line, 3-D, ternary, matrix, parallel) are
projections that select only the needed columns (pruned at the scan), with a
reproducible cap on the rows of a series where a plot needs one; everything a plotting library would compute in the browser (bar heights, histogram
counts, quartiles, densities, hierarchy sums) is a Spark aggregate here,
partially aggregated before any shuffle.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.constants import NONE_CHOICE, PIE_BINS
from tablelens.operators.binning import bin_ordinal, equal_width_edges, interval_labels
from tablelens.operators.groupagg import attach_group_values
from tablelens.functions.scalar import ternary_shares
from tablelens.operators.scan import dense_codes, quantiles_of, sketched_quantiles, value_histogram
from tablelens.session import materialize
from tablelens.sources.schema import class_of_type, col, is_plain_number, num, quote


def _valid(df: DataFrame, c: str | None) -> str | None:
    return c if (c and c != NONE_CHOICE and c in df.columns) else None


def facet_split(df: DataFrame, facet_row: str | None = None, facet_col: str | None = None) -> list[str]:
    """The facet columns that are valid (missing / "Нет" -> no facet)."""
    return [c for c in (_valid(df, facet_row), _valid(df, facet_col)) if c]


def _series_keys(df, color=None, facet_row=None, facet_col=None) -> list[str]:
    keys = facet_split(df, facet_row, facet_col)
    c = _valid(df, color)
    if c and c not in keys:
        keys.append(c)
    return keys


def _require(df: DataFrame, c: str | None, what: str) -> str:
    if not c or c not in df.columns:
        raise ValueError(f"{what} column missing or unknown: {c!r}")
    return c


def _numeric_x(df: DataFrame, c: str) -> Column:
    """Numbers as double; datetimes as microseconds since the epoch (wall clock)."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c)).cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(col(c)).cast("double")
    if isinstance(dt, T.DateType):
        return (F.unix_date(col(c)).cast("double") * F.lit(86_400_000_000.0))
    if isinstance(dt, T.BooleanType):
        return col(c).cast("int").cast("double")
    return num(c)


# --- row-level charts ---------------------------------------------------------


def _columns(df, *names) -> list[str]:
    """Those of ``names`` that are columns, each once, in order."""
    return [c for c in dict.fromkeys(names) if c and c in df.columns]


def cap_rows(df: DataFrame, series: list[str], key: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each series: those of least md5 of ``key``.

    The text that is hashed is the key columns' text joined by ``|``, a missing
    one as nothing; rows of equal keys go by their own values.  The same rows
    always give the same sample, whatever their order or partitions, and a
    larger cap adds rows to it.

    The rows of a series are counted first.  Of a hash spread evenly, the
    ``cap`` least lie below ``cap / n`` with room for eight standard deviations,
    so only such rows are ranked, and those of series that come out short all
    the same (keys that many rows share) are ranked in full.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    columns, names = [col(c) for c in df.columns], [f"__tl_g{i}" for i in range(len(series))]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key]).cast("binary"))
    hashed = df.withColumn("__tl_md5", digest).withColumn("__tl_share", F.conv(F.substring("__tl_md5", 1, 12), 16, 10).cast("double") / float(1 << 48))
    sizes = materialize(df.groupBy(*[col(c) for c in series]).agg(F.count(F.lit(1)).alias("__tl_n")))
    room = (F.lit(float(cap)) + 8 * math.sqrt(cap) + 16) / F.col("__tl_n")
    sized = attach_group_values(hashed, sizes, series, ready=True)
    near = sized.where(F.col("__tl_share") < room)
    found = materialize(near.groupBy(*[col(c).alias(n) for c, n in zip(series, names)], "__tl_n").agg(F.count(F.lit(1)).alias("__tl_found")))
    full = found.where(F.col("__tl_found") >= F.least(F.lit(cap), F.col("__tl_n"))).select(*names, F.lit(True).alias("__tl_full"))
    ranked = near
    if full.count() < sizes.count():
        ranked = attach_group_values(sized, full.withColumnsRenamed(dict(zip(names, series))), series).where(
            F.col("__tl_full").isNull() | (F.col("__tl_share") < room))
    order = Window.partitionBy(*[col(c) for c in series]).orderBy("__tl_md5", *columns)
    return ranked.withColumn("__tl_nth", F.row_number().over(order)).where(F.col("__tl_nth") <= cap).select(*columns)


def _capped(df, use: list[str], series: list[str], cap: int | None, cap_by) -> DataFrame:
    """The columns ``use``, of all rows or of at most ``cap`` rows a series (by ``cap_by``, else by the columns themselves)."""
    if not cap:
        return df.select(*map(col, use))
    key = _columns(df, *(cap_by or use))
    return cap_rows(df.select(*map(col, dict.fromkeys([*use, *series, *key]))), series, key, cap).select(*map(col, use))


def chart_scatter(df, x, y=None, color=None, size=None, text=None, hover=None,
                  facet_row=None, facet_col=None, bubble=False, cap=None, cap_by=None):
    """H1: the plotted columns of every source row, or of at most ``cap`` rows
    a series, sampled by the hash of ``cap_by`` (:func:`cap_rows`)."""
    x = _require(df, x, "X")
    use = _columns(df, x, y, _valid(df, color), size if bubble else None, _valid(df, text), *(hover or []),
                   *facet_split(df, facet_row, facet_col))
    return _capped(df, use, _series_keys(df, color, facet_row, facet_col), cap, cap_by)


def chart_scatter3d(df, x, y, z, color=None, size=None, text=None, hover=None, bubble=False, cap=None, cap_by=None):
    """H2: x, y, z (+ colour, size, text, hover); Z is required, no facets; ``cap`` as in :func:`chart_scatter`."""
    _require(df, x, "X")
    _require(df, z, "Z")
    use = _columns(df, x, y, z, _valid(df, color), size if bubble else None, _valid(df, text), *(hover or []))
    return _capped(df, use, _series_keys(df, color), cap, cap_by)


def chart_ternary(df, a, b, c, color=None, size=None, text=None, hover=None, bubble=False):
    """H3: a, b, c and their shares of a + b + c (NULL when the sum is 0),
    with colour, bubble size, text and hover columns."""
    for n in (a, b, c):
        _require(df, n, "ternary")
    shares = ternary_shares(num(a), num(b), num(c))
    extra = _columns(df, _valid(df, color), size if bubble else None, _valid(df, text), *(hover or []))
    return df.select(*map(col, dict.fromkeys([a, b, c, *extra])), *[s.alias(f"{n}_share") for n, s in zip((a, b, c), shares)])


def chart_line(df, x, y, order_by: list[str], color=None, facet_row=None, facet_col=None):
    """H5: (x, y) per series in row order (``order_by`` gives the order)."""
    keys = _series_keys(df, color, facet_row, facet_col)
    cols = list(dict.fromkeys(keys + [x, y] + list(order_by)))
    return df.select(*[col(c) for c in cols]).orderBy(*[col(c) for c in keys + list(order_by)])


def chart_scatter_matrix(df, dims, color=None, long_form=False, cap=None, cap_by=None):
    """Numeric dimensions (deduplicated, >= 2) + colour.

    The plotted columns as they are; ``long_form`` gives ``(dim_a, a, dim_b, b)``
    per row and unordered pair of dimensions, without diagonal and mirrors;
    ``cap`` as in :func:`chart_scatter`.
    """
    use = [d for d in _columns(df, *dims) if is_plain_number(df, d)]
    if len(use) < 2:
        raise ValueError("scatter matrix needs at least 2 numeric columns")
    c = _columns(df, _valid(df, color))
    base = _capped(df, list(dict.fromkeys(use + c)), c, cap, cap_by)
    if not long_form:
        return base
    cells = F.array(*[F.struct(F.lit(a).alias("dim_a"), num(a).alias("a"), F.lit(b).alias("dim_b"), num(b).alias("b"))
                      for a, b in itertools.combinations(use, 2)])
    return base.select(*map(col, c), F.inline(cells))


def chart_parallel_coordinates(df, dims, color=None, color_order_by=None):
    """Numeric dimensions; a colour that is not a number becomes dense
    codes of its text (C8), in which a missing colour is a value too."""
    use = [d for d in _columns(df, *dims) if is_plain_number(df, d)]
    if len(use) < 2:
        raise ValueError("parallel coordinates need at least 2 numeric columns")
    c = _valid(df, color)
    base = df.select(*map(col, dict.fromkeys(use + ([c] if c else []))))
    if not c:
        return base
    if class_of_type(df.schema[c].dataType) == "numeric":
        return base.withColumn("color_value", num(c))
    # A missing colour has no text; the empty mark cannot be any colour's text, as those get a sign in front.
    shown = F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit(""))
    codes = dense_codes(df.withColumn("__tl_color", shown), "__tl_color", order_by=color_order_by, out="color_value")
    coded = attach_group_values(base.withColumn("__tl_color", shown), codes, ["__tl_color"])
    return coded.withColumn(c, col(c).cast("string")).drop("__tl_color")


# --- aggregated charts ----------------------------------------------------------


def _orientation(df, x, y) -> tuple[str | None, str | None]:
    """(category axis, measured axis).  Y is measured, unless it is text and
    X a number: then the chart lies on its side and X is measured."""
    if not y or y not in df.columns:
        return None, x
    if x and x in df.columns and class_of_type(df.schema[y].dataType) == "categorical" \
            and class_of_type(df.schema[x].dataType) == "numeric":
        return y, x
    return x if x and x in df.columns else None, y


def chart_bar(df, x, y=None, color=None, facet_row=None, facet_col=None):
    """H4: bar length per (facets, colour, category): the sum of the measured
    axis, or the row count where nothing is measured (no Y, or neither axis
    is a number: then both are keys).  A number X with a text Y lies on its
    side (:func:`_orientation`)."""
    x = _require(df, x, "X")
    category, measured = _orientation(df, x, y)
    keys = _series_keys(df, color, facet_row, facet_col)
    if category is None:
        keys, measured = [*keys, x], None
    elif class_of_type(df.schema[measured].dataType) != "numeric":
        keys, measured = [*keys, category, measured], None
    else:
        keys = [*keys, category]
    if measured:
        length = F.coalesce(F.sum(num(measured)), F.lit(0.0)).alias(measured)
    else:
        length = F.count(F.lit(1)).alias("count")
    return df.groupBy(*map(col, dict.fromkeys(keys))).agg(length)


def histogram_edges(df, x: str, nbins: int) -> tuple[float, float] | None:
    r = df.agg(F.min(_numeric_x(df, x)).alias("lo"), F.max(_numeric_x(df, x)).alias("hi")).first()
    if r["lo"] is None:
        return None
    return float(r["lo"]), float(r["hi"])


def chart_histogram(df, x, nbins: int = 20, color=None, facet_row=None, facet_col=None):
    """H6: count per equal-width bin of x (numeric or datetime) per series.

    Bins are left-closed ``[start, end)`` with the last one closed, over
    [min, max] of x (datetimes in microseconds).  A text x counts values.
    """
    x = _require(df, x, "X")
    keys = _series_keys(df, color, facet_row, facet_col)
    if class_of_type(df.schema[x].dataType) == "categorical":
        return df.groupBy(*[col(c) for c in dict.fromkeys(keys + [x])]).agg(F.count(F.lit(1)).alias("count"))
    span = histogram_edges(df, x, nbins)
    xv = _numeric_x(df, x)
    if span is None:
        lo, width = 0.0, 1.0
    else:
        lo, hi = span
        width = (hi - lo) / nbins if hi > lo else 1.0
    b = F.least(F.floor((xv - F.lit(lo)) / F.lit(width)), F.lit(nbins - 1)).cast("int")
    g = (
        df.where(xv.isNotNull())
        .groupBy(*[col(c) for c in keys], b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return g.select(
        *[col(c) for c in keys], "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        "count",
    )


CALENDAR_UNITS = ("hour", "day", "week", "month", "quarter", "year")


def chart_histogram_calendar(df, x, unit: str = "day", color=None, facet_row=None, facet_col=None):
    """H6 on a datetime axis by calendar: (series, bin_start, bin_end, count).

    Buckets are calendar units of unequal length (weeks start on Monday), left
    closed; every bucket from the first to the last of the whole axis is there
    for each series, with 0 where it has no row.  Rows without x don't count.
    Only counted buckets move: gaps are filled from a sequence per series.
    """
    x = _require(df, x, "X")
    if unit not in CALENDAR_UNITS:
        raise ValueError(f"unknown calendar unit {unit!r}")
    kind = df.schema[x].dataType
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{x!r} is no datetime column")
    keys = _series_keys(df, color, facet_row, facet_col)
    names = [f"__tl_g{i}" for i in range(len(keys))]
    moment = T.TimestampType() if isinstance(kind, T.DateType) and unit == "hour" else kind
    start = F.date_trunc(unit, col(x).cast("timestamp")).cast(moment)
    counts = materialize(df.where(col(x).isNotNull()).groupBy(*[col(k).alias(n) for k, n in zip(keys, names)], start.alias("__tl_start"))
                         .agg(F.count(F.lit(1)).alias("__tl_count")))
    step = F.expr({"quarter": "INTERVAL 3 MONTH", "week": "INTERVAL 7 DAY"}.get(unit, f"INTERVAL 1 {unit.upper()}"))
    span = counts.agg(F.min("__tl_start").cast("string").alias("lo"), F.max("__tl_start").cast("string").alias("hi")).first()
    buckets = F.explode(F.sequence(F.lit(span["lo"]).cast(moment), F.lit(span["hi"]).cast(moment), step))
    every = counts.select(*names).distinct() if keys else counts.limit(1).select()
    grid = every.select(*names, buckets.alias("bin_start"))
    on = F.col("bin_start") == F.col("__tl_start")
    for n in names:
        on &= F.col(n).eqNullSafe(F.col(f"{n}_seen"))
    seen = counts.withColumnsRenamed({n: f"{n}_seen" for n in names})
    return grid.join(seen, on, "left").select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], "bin_start", (F.col("bin_start") + step).cast(moment).alias("bin_end"),
        F.coalesce("__tl_count", F.lit(0)).cast("long").alias("count"))


def _measured_groups(df, x, y, color, facet_row, facet_col) -> tuple[list[str], str]:
    """Keys and measured column of a distribution chart (:func:`_orientation`)."""
    keys = _series_keys(df, color, facet_row, facet_col)
    category, measured = _orientation(df, x, y)
    return list(dict.fromkeys(keys + ([category] if category else []))), _require(df, measured, "X")


def _histogram_of(df, keys: list[str], value: str) -> DataFrame:
    """Counted distinct values per group, computed once."""
    d = df.select(*map(col, keys), num(value).alias("__tl_v"))
    return materialize(value_histogram(d, keys, "__tl_v"))


def _box_figures(j: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Box figures of values (x, counted ``weight`` times) that carry their group's quartiles and n."""
    lo, hi = (F.col(a) + F.lit(s * 1.5) * (F.col("q3") - F.col("q1")) for a, s in (("q1", -1), ("q3", 1)))
    v, inside = F.col("x"), (F.col("x") >= lo) & (F.col("x") <= hi)
    return j.groupBy(*map(col, keys)).agg(
        F.max("n").alias("n"),
        F.min(v).alias("min"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max(v).alias("max"),
        F.min(F.when(inside, v)).alias("lower_whisker"),
        F.max(F.when(inside, v)).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, weight)), F.lit(0)).cast("long").alias("outliers"),
    )


def chart_box(df, x=None, y=None, color=None, facet_row=None, facet_col=None, method="midpoint_rank", accuracy=None):
    """H7: box statistics per (facets, colour, category) group.

    n, min, q1, median, q3, max, whiskers (most extreme values inside
    1.5 * IQR fences) and the outlier count.  Without y, one box of x per
    series; a number X with a text Y lies on its side.  Quartiles are exact;
    the default rule is rank ``n p + 0.5`` interpolated.  All figures come
    from one histogram of distinct values.

    With an ``accuracy`` the quartiles are values of the group whose ranks are
    off by at most ``n / accuracy`` (one aggregate of sketches), and the other
    figures, exact for these quartiles, take one more pass over the rows;
    nothing is ranked and no distinct value is counted.
    """
    keys, measured = _measured_groups(df, x, y, color, facet_row, facet_col)
    probs, names = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    if accuracy:
        rows = df.select(*map(col, keys), num(measured).alias("x")).where(F.col("x").isNotNull())
        q = sketched_quantiles(rows, keys, "x", probs, names, accuracy)
        return _box_figures(attach_group_values(rows, q, keys), keys, F.lit(1))
    hist = _histogram_of(df, keys, measured)
    q = quantiles_of(hist, keys, probs, names, method).drop("n")
    return _box_figures(attach_group_values(hist, q, keys), keys, F.col("w"))


POINTS_PER_PASS = 50


def _spread(sd: Column, iqr: Column) -> Column:
    """The smaller of both, the other where one is 0, else 1."""
    return F.when((sd > 0) & (iqr > 0), F.least(sd, iqr)).when(sd > 0, sd).when(iqr > 0, iqr).otherwise(F.lit(1.0))


def kde_curves(df, keys: list[str], value: str, points: int = 100, span_bw: float = 2.0):
    """Gaussian kernel density per group on a regular grid (H8/H9 core).

    Bandwidth ``1.059 * min(std, IQR / 1.349) * n ** -0.2`` (falls back to
    std, then 1, when that is 0); grid ``points`` values over
    [min - 2 bw, max + 2 bw].  Exact: every distinct value, weighted by its
    count, contributes to every grid point.  The points are sums of one
    partial aggregate per ``POINTS_PER_PASS`` of them; no row is multiplied.
    """
    hist = _histogram_of(df, keys, value)
    x, w = F.col("x"), F.col("w")
    q = quantiles_of(hist, keys, [0.25, 0.75], ["__tl_q1", "__tl_q3"]).drop("n")
    total = hist.groupBy(*map(col, keys)).agg(
        F.max("n").alias("n"), (F.sum(x * w) / F.sum(w)).alias("__tl_mean"), F.min(x).alias("__tl_lo"), F.max(x).alias("__tl_hi"))
    spread = attach_group_values(hist.drop("n"), total, keys).groupBy(*map(col, keys)).agg(
        *[F.first(c).alias(c) for c in ("n", "__tl_lo", "__tl_hi")],
        F.sum(w * (x - F.col("__tl_mean")) * (x - F.col("__tl_mean"))).alias("__tl_ss"))
    st = attach_group_values(spread, q, keys)
    iqr = (F.col("__tl_q3") - F.col("__tl_q1")) / F.lit(1.349)
    sd = F.coalesce(F.sqrt(F.try_divide(F.col("__tl_ss"), F.col("n") - 1)), F.lit(0.0))
    st = st.withColumn("bw", F.lit(1.059) * _spread(sd, iqr) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = st.select(*map(col, keys), "n", "bw", (F.col("__tl_lo") - F.lit(span_bw) * F.col("bw")).alias("grid_lo"), (
        (F.col("__tl_hi") - F.col("__tl_lo") + F.lit(2 * span_bw) * F.col("bw")) / F.lit(points - 1)).alias("grid_step"))
    j = attach_group_values(hist.select(*map(col, keys), "x", "w"), st, keys)
    j = materialize(j.select(*map(col, keys), "n", "bw", "grid_lo", "grid_step", "w", (
        (F.col("grid_lo") - x) / F.col("bw")).alias("u0"), (F.col("grid_step") / F.col("bw")).alias("du")))
    return _curve_sums(j, keys, points)


def _curve_sums(j: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Density at each grid point from weighted values: ``points`` sums of a partial aggregate, ``POINTS_PER_PASS`` a pass.

    ``j`` holds n, bw, grid_lo, grid_step, w and, in units of the bandwidth,
    the first grid point's distance from the value (u0) and the step (du).
    """
    norm = F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))
    carried, parts = ["n", "bw", "grid_lo", "grid_step"], []
    for low in range(0, points, POINTS_PER_PASS):
        at = range(low, min(points, low + POINTS_PER_PASS))
        u = [f"(u0 + {float(i)}D * du)" for i in at]
        sums = j.groupBy(*map(col, keys)).agg(  # text, as hundreds of column objects take longer to build than to compute
            *[F.first(c).alias(c) for c in carried], *[F.expr(f"sum(w * exp(-0.5D * {x} * {x}))").alias(f"s{i}") for i, x in zip(at, u)])
        cells = ", ".join(f"named_struct('point', {i}, 's', s{i})" for i in at)
        parts.append(sums.select(*map(col, keys), *carried, F.expr(f"inline(array({cells}))")))
    return functools.reduce(DataFrame.unionByName, parts).select(
        *map(col, keys), "point", (F.col("grid_lo") + F.col("point") * F.col("grid_step")).alias("value"),
        (F.col("s") / norm).alias("density"))


def binned_curves(df, keys: list[str], value: str, points: int = 100, cells: int = 1024, span_bw: float = 2.0):
    """The densities of :func:`kde_curves` from pre-binned weights, with ``error_bound``.

    [min, max] of a group is cut into ``cells`` equal cells; a value gives its
    two neighbouring nodes weights that add up to 1 (linear binning), and the
    curve is the sum over at most ``cells + 1`` nodes.  A row costs two weights
    instead of ``points`` exponentials, and two passes over the rows (figures,
    weights) of partial aggregates are all that grows with the table.

    The interquartile range is that of the nodes' weights, the bandwidth rule
    the exact curve's.  For the bandwidth used, a point is off by at most
    ``error_bound`` = h^2 / (8 sqrt(2 pi) bw^3), h being the cell's width.
    """
    rows = df.select(*map(col, keys), num(value).alias("x")).where(F.col("x").isNotNull())
    by = [col(k) for k in keys]
    figures = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("__tl_lo"), F.max("x").alias("__tl_hi"),
                                    F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("__tl_sd"))
    figures = materialize(figures.withColumn("__tl_h", (F.col("__tl_hi") - F.col("__tl_lo")) / F.lit(cells)))
    j = attach_group_values(rows, figures.select(*by, "__tl_lo", "__tl_h"), keys, ready=True)
    place = F.when(F.col("__tl_h") > 0, (F.col("x") - F.col("__tl_lo")) / F.col("__tl_h")).otherwise(F.lit(0.0))
    j = j.select(*by, place.alias("__tl_at")).withColumn("__tl_cell", F.least(F.floor("__tl_at"), F.lit(cells - 1)).cast("int"))
    part = F.col("__tl_at") - F.col("__tl_cell")
    shares = j.groupBy(*by, "__tl_cell").agg(F.sum(1 - part).alias("a"), F.sum(part).alias("b"))
    ends = F.array(F.struct(F.col("__tl_cell").alias("node"), F.col("a").alias("w")), F.struct((F.col("__tl_cell") + 1).alias("node"), F.col("b").alias("w")))
    nodes = materialize(shares.select(*by, F.inline(ends)).groupBy(*by, "node").agg(F.sum("w").alias("w")))
    nodes = attach_group_values(nodes, figures, keys, ready=True)
    upto = F.sum("w").over(Window.partitionBy(*by).orderBy("node"))  # at most cells + 1 rows a group
    q = lambda p: F.min(F.when(F.col("__tl_upto") >= F.col("n") * F.lit(p * (1 - 1e-9)), F.col("node")))
    st = nodes.withColumn("__tl_upto", upto).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("n", "__tl_lo", "__tl_hi", "__tl_sd", "__tl_h")], ((q(0.75) - q(0.25)) * F.first("__tl_h") / F.lit(1.349)).alias("__tl_iqr"))
    st = st.withColumn("bw", F.lit(1.059) * _spread(F.col("__tl_sd"), F.col("__tl_iqr")) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = materialize(st.select(*by, "n", "bw", "__tl_lo", "__tl_h", (F.col("__tl_lo") - F.lit(span_bw) * F.col("bw")).alias("grid_lo"), (
        (F.col("__tl_hi") - F.col("__tl_lo") + F.lit(2 * span_bw) * F.col("bw")) / F.lit(points - 1)).alias("grid_step")))
    j = attach_group_values(nodes.where("w > 0").select(*by, "node", "w"), st, keys, ready=True)
    x = F.col("__tl_lo") + F.col("node") * F.col("__tl_h")
    j = j.select(*by, "n", "bw", "grid_lo", "grid_step", "w", ((F.col("grid_lo") - x) / F.col("bw")).alias("u0"), (F.col("grid_step") / F.col("bw")).alias("du"))
    bound = st.select(*by, (F.col("__tl_h") * F.col("__tl_h") / (F.lit(8 * math.sqrt(2 * math.pi)) * F.pow("bw", F.lit(3.0)))).alias("error_bound"))
    return attach_group_values(_curve_sums(materialize(j), keys, points), bound, keys, ready=True)


def chart_violin(df, x=None, y=None, color=None, facet_row=None, facet_col=None, points=100, cells=None):
    """H8: density curve per (facets, colour, category) group; a number X with
    a text Y lies on its side.  Exact, or with ``cells`` from pre-binned
    weights (:func:`binned_curves`)."""
    keys, measured = _measured_groups(df, x, y, color, facet_row, facet_col)
    return binned_curves(df, keys, measured, points, cells) if cells else kde_curves(df, keys, measured, points)


def chart_ridge(df, x, y=None, color=None, points=100, cells=None):
    """H9: one density curve of x per non-missing colour value (one curve when
    colour is unset or "Нет"), and at each position Y if there is a Y; ``cells``
    as in :func:`chart_violin`."""
    x = _require(df, x, "X")
    c = _valid(df, color)
    keys = _columns(df, c, y)
    rows = df.where(col(c).isNotNull()) if c else df
    return binned_curves(rows, keys, x, points, cells) if cells else kde_curves(rows, keys, x, points)


def chart_pie_categorical(df, x):
    """Count per value, missing kept as its own slice, largest first."""
    x = _require(df, x, "X")
    return df.groupBy(col(x)).agg(F.count(F.lit(1)).alias("counts")).orderBy(
        F.col("counts").desc(), col(x).asc_nulls_last()
    )


def chart_pie_binned(df, x, bins: int = PIE_BINS):
    """Non-text x in ``bins`` equal-width right-closed bins; missing
    dropped, empty bins kept with 0, largest first."""
    x = _require(df, x, "X")
    xv = _numeric_x(df, x)
    r = df.agg(F.min(xv).alias("lo"), F.max(xv).alias("hi")).first()
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], f"bin int, {quote(x)} string, counts long")
    edges = equal_width_edges(float(r["lo"]), float(r["hi"]), bins)
    labels = interval_labels(edges)
    counts = df.where(xv.isNotNull()).groupBy(bin_ordinal(xv, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = spark.createDataFrame([(i + 1, s) for i, s in enumerate(labels)], f"bin int, {quote(x)} string")
    out = F.broadcast(all_bins).join(counts, "bin", "left")  # <= bins rows on the build side
    return out.select("bin", col(x), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("counts")).orderBy(
        F.col("counts").desc(), F.col("bin")
    )


def chart_pie(df, x, bins: int = PIE_BINS):
    """Pie dataset: text x by value (H10), any other x binned."""
    if isinstance(df.schema[x].dataType, T.StringType):
        return chart_pie_categorical(df, x)
    return chart_pie_binned(df, x, bins)


def chart_hierarchy(df, path_cols, y=None):
    """Every path prefix (sunburst / treemap) with sum(y) for numeric y,
    else the row count.  ``level`` is the prefix length; a real missing
    value in a level stays distinct from "rolled up" via ``grouping_id``.
    """
    path = [c for c in dict.fromkeys(path_cols) if c and c in df.columns]
    if not path:
        raise ValueError("hierarchy needs at least one path column")
    if y and y in df.columns and is_plain_number(df, y):
        val = F.coalesce(F.sum(num(y)), F.lit(0.0)).alias("value")
    else:
        val = F.count(F.lit(1)).cast("double").alias("value")
    g = df.rollup(*[col(c) for c in path]).agg(val, F.grouping_id().alias("__tl_gid"))
    n = len(path)
    # grouping_id bit i (from the left, high bit first) set = level rolled up.
    level = F.lit(0)
    for i in range(n):
        bit = F.shiftright(F.col("__tl_gid"), n - 1 - i).bitwiseAND(F.lit(1))
        level = level + (F.lit(1) - bit)
    return g.withColumn("level", level.cast("int")).where(F.col("level") >= 1).drop("__tl_gid")


def _bins_expr(xv: Column, lo: float, hi: float, nb: int) -> Column:
    width = (hi - lo) / nb if hi > lo else 1.0
    return F.least(F.floor((xv - F.lit(lo)) / F.lit(width)), F.lit(nb - 1)).cast("int")


def chart_density_heatmap(df, x, y, nbinsx=20, nbinsy=20, color=None, facet_row=None, facet_col=None):
    """H15 (H16 with ``color``): count per (x bin, y bin) per series."""
    x = _require(df, x, "X")
    y = _require(df, y, "Y")
    if class_of_type(df.schema[x].dataType) != "numeric" or class_of_type(df.schema[y].dataType) != "numeric":
        raise ValueError("2-D density needs numeric X and Y")
    keys = _series_keys(df, color, facet_row, facet_col)
    xv, yv = num(x), num(y)
    r = df.agg(F.min(xv).alias("x0"), F.max(xv).alias("x1"), F.min(yv).alias("y0"), F.max(yv).alias("y1")).first()
    if r["x0"] is None or r["y0"] is None:
        r = {"x0": 0.0, "x1": 0.0, "y0": 0.0, "y1": 0.0}  # no row passes below; the columns are the same
    return (
        df.where(xv.isNotNull() & yv.isNotNull())
        .groupBy(*[col(k) for k in keys],
                 _bins_expr(xv, r["x0"], r["x1"], nbinsx).alias("xbin"),
                 _bins_expr(yv, r["y0"], r["y1"], nbinsy).alias("ybin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def chart_density_contour(df, x, y, color=None, nbinsx=20, nbinsy=20, facet_row=None, facet_col=None):
    """The 2-D density per colour."""
    return chart_density_heatmap(df, x, y, nbinsx, nbinsy, color, facet_row, facet_col)


def count_points(df, x, y=None, color=None):
    """Number of plotted x plus y values, per series."""
    keys = _series_keys(df, color)
    e = F.count(col(x)) + (F.count(col(y)) if y and y in df.columns else F.lit(0))
    return df.groupBy(*[col(k) for k in keys]).agg(e.cast("long").alias("points"))
