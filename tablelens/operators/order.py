"""Category, legend and facet orderings.

Each ordering is a small aggregate (one row per category) plus a dense
``position``.  Positions are assigned by a segmented scan, so even an axis
with millions of categories is never ranked in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablelens.constants import CATEGORY_ORDERS, MAX_CORR_COLUMNS
from tablelens.operators.scan import group_quantiles, segmented_scan, sketched_quantiles
from tablelens.sources.schema import col, is_categorical_by_name, needs_text_axis, num

def rank_rows(df: DataFrame, sort_cols: list[str], out: str = "position") -> DataFrame:
    """0-based dense row position in ascending ``sort_cols`` order (nulls
    first); ``sort_cols`` must be unique per row."""
    s = segmented_scan(df, [], list(sort_cols), {"__tl_one": F.lit(1)}, running=True)
    return s.withColumn(out, (F.col("__tl_one_run") - 1).cast("long")).drop("__tl_one_run")


def order_categories(df: DataFrame, category: str, value: str | None = None, how: str = "total ascending",
                     order_by: str | None = None, accuracy: int | None = None) -> DataFrame:
    """Categories of ``category`` ordered by ``how``.

    ``trace``: first appearance (``min(order_by)``, in that column's own type
    and order); ``category asc/desc``:
    by value; otherwise the named statistic of ``value`` per category
    (total = sum; geometric mean over positive values only), ties by
    category.  With an ``accuracy`` a median is a value whose rank is off by at
    most 1 / ``accuracy`` of its category.  Missing statistics sort last.  Returns
    ``(category, metric, position)``.
    """
    if how not in CATEGORY_ORDERS:
        raise ValueError(f"unknown category order {how!r}")
    c = col(category)
    base = df.where(c.isNotNull())
    if how == "trace":
        if not order_by:
            raise ValueError("'trace' order needs order_by: Spark rows have no implicit order")
        g = base.groupBy(c).agg(F.min(col(order_by)).alias("metric"))
        ranked = rank_rows(g, ["metric", category])
        return ranked
    if how.startswith("category"):
        g = base.select(c).distinct().withColumn("metric", F.lit(None).cast("double"))
        if how.endswith("ascending"):
            return rank_rows(g, [category])
        return _reverse(rank_rows(g, [category], out="__tl_asc"), category)
    stat, direction = how.rsplit(" ", 1)
    if not value:
        raise ValueError(f"{how!r} needs a value column")
    v = num(value)
    if stat == "median":
        values = base.select(c, v.alias("__tl_v"))
        g = (sketched_quantiles(values, [category], "__tl_v", [0.5], ["metric"], accuracy) if accuracy
             else group_quantiles(values, [category], "__tl_v", [0.5], names=["metric"])).drop("n")
        cats = base.select(c).distinct()
        g = cats.join(g, category, "left")
    else:
        e = {
            "total": F.sum(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v),
            "geometric mean": F.exp(F.avg(F.log(F.when(v > 0, v)))),
        }[stat]
        g = base.groupBy(c).agg(e.alias("metric"))
    # ascending: missing last; descending: negate, missing last
    key = F.col("metric") if direction == "ascending" else -F.col("metric")
    g = g.withColumns({"__tl_null": F.col("metric").isNull(), "__tl_key": key})
    return rank_rows(g, ["__tl_null", "__tl_key", category]).drop("__tl_null", "__tl_key")


def _reverse(ranked_asc: DataFrame, category: str) -> DataFrame:
    """Turn an ascending ``__tl_asc`` position into a descending one."""
    top = ranked_asc.agg(F.max("__tl_asc")).first()[0]  # one number to the driver
    top = -1 if top is None else int(top)
    return ranked_asc.select(col(category), "metric", (F.lit(top) - F.col("__tl_asc")).cast("long").alias("position"))


def order_axis_choice(df: DataFrame, x: str, y: str | None, choice: str = "auto") -> list[str]:
    """Axes the category order applies to.  A text x always; a y whose
    name marks an identifier always; ``"y"`` also applies it to any other y."""
    axes = []
    x_text = x in df.columns and needs_text_axis(df, x)
    if x_text:
        axes.append("x")
    y_cat = bool(y) and y in df.columns and is_categorical_by_name(y)
    if y_cat or (choice == "y" and y):
        axes.append("y")
    return axes


def _series_names(df: DataFrame, series: str) -> DataFrame:
    return df.select(col(series).cast("string").alias(series)).distinct()


def order_legend_alpha(df: DataFrame, series: str) -> DataFrame:
    """Series by lower-cased name; the unnamed (missing) series last."""
    s = _series_names(df, series).withColumns({
        "__tl_null": col(series).isNull(), "__tl_low": F.lower(col(series)),
    })
    return rank_rows(s, ["__tl_null", "__tl_low", series]).drop("__tl_null", "__tl_low")


def order_legend_original(df: DataFrame, series: str, order_by: str) -> DataFrame:
    """I4: series in order of first appearance (``min(order_by)``)."""
    g = df.groupBy(col(series).cast("string").alias(series)).agg(F.min(col(order_by)).alias("__tl_first"))
    return rank_rows(g, ["__tl_first", series]).drop("__tl_first")


def order_legend_custom(df: DataFrame, series: str, custom: str | list[str] | None) -> DataFrame:
    """Names from a comma-separated list first, in list order; the rest
    alphabetically (lower-cased); the unnamed series last."""
    items = [s.strip() for s in (custom.split(",") if isinstance(custom, str) else (custom or [])) if s and s.strip()]
    items = list(dict.fromkeys(items))
    pos = F.array_position(F.array(*[F.lit(s) for s in items]), col(series)) if items else F.lit(0)
    s = _series_names(df, series).withColumns({
        "__tl_null": col(series).isNull(),
        "__tl_p": F.coalesce(F.nullif(pos, F.lit(0)), F.lit(len(items) + 1)).cast("int"),
        "__tl_low": F.lower(col(series)),
    })
    return rank_rows(s, ["__tl_null", "__tl_p", "__tl_low", series]).drop("__tl_null", "__tl_p", "__tl_low")


def order_facets(df: DataFrame, facet: str, filters) -> DataFrame:
    """Facet values; those that the leading filter lists come first, in
    list order, if it filters the facet column; the others by value, the
    missing one last.

    ``filters`` is ``{id: {"column": c, "value": v}}``; the leading filter has
    the least id.  Listed values are read in the facet column's own type, so
    that 10, 10.0 and "10" all mean the number 10; one that cannot be is
    ignored.
    """
    lead = filters[min(filters)] if isinstance(filters, dict) and filters else {}
    listed = lead.get("value") if lead.get("column") == facet else None
    listed = [] if listed is None else listed if isinstance(listed, list) else [listed]
    kind = df.schema[facet].dataType
    place = F.lit(len(listed))
    for i, v in reversed(list(enumerate(listed))):
        place = F.when(col(facet) == F.lit(v).try_cast(kind), F.lit(i)).otherwise(place)
    values = df.select(col(facet)).distinct().withColumns({"__tl_null": col(facet).isNull(), "__tl_place": place})
    by_name = F.lower(col(facet)) if isinstance(kind, StringType) else col(facet)
    values = values.withColumn("__tl_name", by_name)
    return rank_rows(values, ["__tl_null", "__tl_place", "__tl_name", facet]).drop("__tl_null", "__tl_place", "__tl_name")


def order_counts_desc(counts: DataFrame, label: str, count_col: str = "count") -> DataFrame:
    """Counts largest first (ties by label, missing label last)."""
    g = counts.withColumns({"__tl_neg": -col(count_col), "__tl_null": col(label).isNull()})
    return rank_rows(g, ["__tl_neg", "__tl_null", label]).drop("__tl_neg", "__tl_null")


def cap_columns(cols, limit: int = MAX_CORR_COLUMNS) -> list[str]:
    """I8: at most ``limit`` columns."""
    return list(cols)[:limit]


__all__ = [
    "CATEGORY_ORDERS", "rank_rows", "order_categories", "order_axis_choice", "order_legend_alpha",
    "order_legend_original", "order_legend_custom", "order_facets", "order_counts_desc", "cap_columns",
]
