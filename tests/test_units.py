"""Unit tests with hand-sized inputs and literal expected values (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts as C
from tablelens.operators.binning import bin_column, equal_width_edges, interval_labels
from tablelens.operators.cluster import cluster_features, kmeans_cluster, pca_loadings, silhouette_sq
from tablelens.operators.corr import correlation_columns, correlation_matrix
from tablelens.operators.filters import FilterSpec, apply_filters, check_box_columns
from tablelens.operators.groupagg import group_aggregate, normalize_metrics
from tablelens.operators.order import cap_columns, order_axis_choice, order_categories
from tablelens.operators.scan import group_quantiles, range_number, segmented_scan, value_histogram
from tablelens.functions.scalar import coerce_datetime, text_copy, text_form
from tablelens.sources.io import export_dataset, export_name, load_table, nan_to_null
from tablelens.sources.schema import (
    classify_columns,
    drop_derived,
    eligible_columns,
    is_categorical_by_name,
    num,
    resolve_columns,
    unique_column_name,
)


# --- A: schema ---------------------------------------------------------------

def test_classify_columns(spark):
    df = spark.createDataFrame([], "b boolean, d date, t timestamp, s string, a array<int>, i int, x double")
    cc = classify_columns(df)
    assert cc.numeric == ["b", "i", "x"]
    assert cc.datetime == ["d", "t"]
    assert cc.categorical == ["s", "a"]


def test_eligible_columns(spark):
    df = spark.createDataFrame([], "t timestamp, s string, i int")
    assert eligible_columns(df, "color", "Нет") == ["Нет", "s", "i"]
    assert eligible_columns(df, "filter") == ["s", "i", "t"]
    assert eligible_columns(df, "size") == ["i"]
    assert eligible_columns(df, "facet", "Нет") == ["Нет", "t", "s", "i"]


def test_resolve_and_unique_names(spark):
    df = spark.createDataFrame([], "`Дебит жидкости` double, A double, A_mean double")
    assert resolve_columns(df, ["дебитжидкости", "Дебит жидкости", "zz"]) == (["Дебит жидкости"], ["zz"])
    assert unique_column_name(df, "A_mean") == "A_mean_2"
    assert unique_column_name(df, "B") == "B"


def test_drop_derived(spark):
    df = spark.createDataFrame([], "`Группа(x)` string, `Группа(y)` string, PCA1 double, `Кластеры` string, z int")
    assert drop_derived(df, "bins").columns == ["PCA1", "Кластеры", "z"]
    assert drop_derived(df, "clusters").columns == ["Группа(x)", "Группа(y)", "z"]


def test_categorical_by_name():
    assert is_categorical_by_name("Номер СКВАЖИНА")
    assert is_categorical_by_name("well_id")
    assert not is_categorical_by_name("Дебит")


def test_export_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tl-export-", dir="/tmp")
    df = spark.range(5)
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert export_name("a<b>", "S|1", ts) == "a_b__S_1_filtered_20240102_030405"
    p = export_dataset(df, d, "data", ts=ts)
    assert os.path.basename(p) == "data_filtered_20240102_030405.parquet"
    assert load_table(spark, p).count() == 5
    with pytest.raises(Exception):
        export_dataset(df, d, "data", ts=ts)  # never overwrites
    with pytest.raises(ValueError):
        export_dataset(None, d, "x")


def test_nan_is_missing_and_filters_push_down(spark):
    d = tempfile.mkdtemp(prefix="tl-load-", dir="/tmp")
    spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (5.0, "b")], "x double, k string").write.parquet(d + "/t.parquet")
    t = load_table(spark, d + "/t.parquet")
    assert sorted(r.x for r in nan_to_null(t).collect() if r.x is not None) == [1.0, 5.0]
    f = apply_filters(t, [FilterSpec("x", [0.5, None])])
    assert sorted(r.x for r in f.collect()) == [1.0, 5.0]  # NaN does not pass ">= 0.5"
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), GreaterThanOrEqual(x,0.5)]" in plan
    g = group_aggregate(t, ["k"], ["x"], ["mean", "nunique"]).df
    assert {(r.k, r.x_mean, r.x_nunique) for r in g.collect()} == {("a", 1.0, 1), ("b", 5.0, 1)}
    with pytest.raises(ValueError):
        load_table(spark, d + "/t.xlsx")


def test_sources_formats_and_named_tables(spark):
    from tablelens.sources.io import dataset_info, list_tables, load_named_table
    from tablelens.sources.schema import dataset_meta

    d = tempfile.mkdtemp(prefix="tl-src-", dir="/tmp")
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "i int, s string, x double")
    df.write.option("header", "true").csv(d + "/one.csv")
    df.write.json(d + "/two.json")
    assert list_tables(spark, d) == list_tables(spark, "file://" + d) == ["one", "two"]
    typed = load_table(spark, d + "/one.csv", schema="i long, s string, x float")
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "string", "float"] and typed.count() == 2
    assert load_named_table(spark, "file://" + d, "one").count() == 2
    df.createOrReplaceTempView("tl_units_three")
    assert load_named_table(spark, name="tl_units_three").count() == 2
    c = load_table(spark, d + "/one.csv")
    assert c.count() == 2 and [f.name for f in c.schema] == ["i", "s", "x"]
    assert load_named_table(spark, d, "two").count() == 2
    with pytest.raises(ValueError):
        load_named_table(spark, d)  # two tables and no name
    with pytest.raises(ValueError):
        load_named_table(spark, d, "three")
    info = dataset_info(c, "one.csv", "one").first()
    assert (info.n_rows, info.n_columns, info.source, info.table_name) == (2, 3, "one.csv", "one")
    meta = [(r.position, r.column, r["class"]) for r in dataset_meta(spark, df).collect()]
    assert meta == [(0, "i", "numeric"), (1, "s", "categorical"), (2, "x", "numeric")]


# --- B: filters --------------------------------------------------------------

def test_apply_filters_skips_and_raises(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (None, "c")], "x int, s string")
    assert apply_filters(df, [FilterSpec("x", [None, 4])]).count() == 1
    assert apply_filters(df, [FilterSpec("s", "b"), FilterSpec("x", [])]).count() == 1
    assert apply_filters(df, [FilterSpec("nope", [1])]).count() == 3
    with pytest.raises(ValueError):
        apply_filters(df, [FilterSpec("x", 3)])


def test_check_box_columns(spark):
    df = spark.createDataFrame([(None, "a", 1.0)], "y double, s string, x double")
    assert check_box_columns(df, "x", "y")[0] is False
    assert check_box_columns(df, "x", None)[0] is True
    assert check_box_columns(df, "s", None)[0] is False


# --- C: text and dates -------------------------------------------------------

def test_text_form(spark):
    df = spark.createDataFrame([(1 / 3, True), (2.0, False), (1e10, None), (None, True), (1e16, True), (0.0001, True),
                                (1.5e-05, True), (-12345678.9, True)], "x double, b boolean")
    rows = df.select(text_form(F.col("x"), df.schema["x"].dataType).alias("t"),
                     text_form(F.col("b"), df.schema["b"].dataType).alias("u")).collect()
    assert [r.t for r in rows] == ["0.3333333333333333", "2.0", "10000000000.0", None, "1e+16", "0.0001", "1.5e-05",
                                   "-12345678.9"]
    assert [r.u for r in rows][:3] == ["True", "False", None]


def test_text_copy_suffix_and_strip(spark):
    df = spark.createDataFrame([(" a\t ",)], "s string")
    out, created, missing = text_copy(df, ["s"], suffix="  ")
    assert created == ["s_txt"] and out.first()["s_txt"] == "a"
    out2, created2, _ = text_copy(out, ["s"], suffix="txt")
    assert created2 == ["s_txt_2"]


def test_coerce_datetime_dayfirst(spark):
    df = spark.createDataFrame([("03/04/2024",), ("2024-01-02",), ("zz",)], "d string")
    got = [r.d for r in coerce_datetime(df, ["d"]).collect()]
    assert got == [dt.datetime(2024, 4, 3), dt.datetime(2024, 1, 2), None]
    more = spark.createDataFrame([("3.4.2024 10:15",), (" 2024-01-02T03:04:05 ",), ("2024/01/31",), ("31/02/2024",),
                                  ("03-04-2024 01:02:03",)], "d string")
    got = [r.d for r in coerce_datetime(more, ["d"]).collect()]
    assert got == [dt.datetime(2024, 4, 3, 10, 15), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 31), None,
                   dt.datetime(2024, 4, 3, 1, 2, 3)]
    us = [r.d for r in coerce_datetime(df, ["d"], dayfirst=False).collect()]
    assert us[0] == dt.datetime(2024, 3, 4)


# --- D: binning ----------------------------------------------------------------

def _labels(spark, vals, k, method):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)], "i int, x double")
    out = bin_column(df, "x", k, method=method).orderBy("i")
    return [r["Группа(x)"] for r in out.collect()]


def test_bins_equal_width(spark):
    assert _labels(spark, [1, 2, 2, 3, 10, None, 0], 3, "width") == (
        ["(-0.011, 3.333]"] * 4 + ["(6.667, 10.0]", None, "(-0.011, 3.333]"])


def test_bins_equal_count(spark):
    assert _labels(spark, [1, 2, 2, 3, 10, None, 0], 4, "count") == [
        "(-0.001, 1.25]", "(1.25, 2.0]", "(1.25, 2.0]", "(2.75, 10.0]", "(2.75, 10.0]", None, "(-0.001, 1.25]"]


def test_bins_collapsing_edges(spark):
    assert _labels(spark, [1, 1, 1, 1, 2, 3], 4, "count") == ["(0.999, 1.75]"] * 4 + ["(1.75, 3.0]"] * 2


def test_text_input_reads_as_missing(spark):
    df = spark.createDataFrame([(0, "1"), (1, "2.5"), (2, "n/a"), (3, None), (4, "10")], "i int, x string")
    labels = [r["Группа(x)"] for r in bin_column(df, "x", 3, method="width").orderBy("i").collect()]
    assert labels == ["(0.99, 4.0]", "(0.99, 4.0]", None, None, "(7.0, 10.0]"]  # edges 0.991, 4, 7, 10
    bars = {(r.x, r["count"]) for r in C.chart_bar(df.withColumn("g", F.lit("a")), "g", "x").collect()}
    assert len(bars) == 5  # non-numeric y: rows counted per (x, y)


def test_bins_constant(spark):
    assert _labels(spark, [5, 5], 2, "width") == ["(4.994, 5.0]"] * 2
    assert _labels(spark, [5, 5], 2, "count") == [None, None]


def test_interval_labels_direct():
    assert interval_labels(equal_width_edges(0.0, 10.0, 3)) == ["(-0.011, 3.333]", "(3.333, 6.667]", "(6.667, 10.0]"]


def test_interval_labels_round_halves_away_from_zero():
    """An edge halfway between two labels goes where SQL's round puts it, though its double lies a little below."""
    assert interval_labels([902.36, 124760.2175, 249125.76]) == ["(902.359, 124760.218]", "(124760.218, 249125.76]"]
    assert interval_labels([-7.5, -1.0005, 1.0005, 1e300]) == ["(-7.501, -1.001]", "(-1.001, 1.001]", "(1.001, 1e+300]"]


def test_pie_binned_keeps_empty_bins(spark):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [1, 2, 2, 3, 10, None, 0]], "x double")
    rows = C.chart_pie_binned(df, "x", bins=3).collect()
    assert [(r.x, r.counts) for r in rows] == [("(-0.011, 3.333]", 5), ("(6.667, 10.0]", 1), ("(3.333, 6.667]", 0)]


# --- E: group aggregates ----------------------------------------------------------

def test_group_aggregate_edge_table(spark):
    rows = [(0, "a", None), (1, "a", None), (2, None, 1.0), (3, None, 2.0), (4, "b", 3.0)]
    df = spark.createDataFrame(rows, "i int, k string, x double")
    r = group_aggregate(df, ["k"], ["x"], ["sum", "mean", "min", "std", "median", "count", "cumsum"], order_by=["i"])
    got = {row.i: row for row in r.df.collect()}
    assert [got[i].x_sum for i in range(5)] == [0.0, 0.0, 3.0, 3.0, 3.0]
    assert [got[i].x_mean for i in range(5)] == [None, None, 1.5, 1.5, 3.0]
    assert [got[i].x_min for i in range(5)] == [None, None, 1.0, 1.0, 3.0]
    assert got[2].x_std == pytest.approx(math.sqrt(0.5)) and got[4].x_std is None and got[0].x_std is None
    assert [got[i].x_median for i in range(5)] == [None, None, 1.5, 1.5, 3.0]
    assert [got[i].x_count for i in range(5)] == [0, 0, 2, 2, 1]
    assert [got[i].x_cumsum for i in range(5)] == [0.0, 0.0, None, None, 3.0]


@pytest.mark.parametrize("empty,zeros,nunique,mode", [
    (True, True, 2, 1.0), (True, False, 3, 0.0), (False, True, 3, 1.0), (False, False, 4, "0.0"),
])
def test_nunique_mode_switches(spark, empty, zeros, nunique, mode):
    vals = [0, None, 1, 1, 2, 2, None, 0]
    df = spark.createDataFrame([(i, "g", None if v is None else float(v)) for i, v in enumerate(vals)], "i int, k string, x double")
    r = group_aggregate(df, ["k"], ["x"], ["nunique", "mode"], exclude_empty=empty, exclude_zeros=zeros)
    row = r.df.first()
    assert row.x_nunique == nunique
    assert row.x_mode == mode


def test_group_aggregate_shuffle_path_matches_broadcast(spark):
    # One key holds most rows; broadcast_max_rows=0 forces the shuffle join.
    rows = [("hot" if i % 5 else f"k{i % 50}", None if i % 7 == 0 else float(i % 13), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double, i int")
    mets = ["mean", "median", "count", "nunique", "mode", "cumsum"]
    a = group_aggregate(df, ["k"], ["x"], mets, order_by=["i"]).df
    b = group_aggregate(df, ["k"], ["x"], mets, order_by=["i"], broadcast_max_rows=0).df
    assert a.count() == b.count() == 2000
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    pdf = df.toPandas().sort_values("i")
    hot = pdf[pdf.k == "hot"]
    got = {r.i: r for r in a.where(F.col("k") == "hot").collect()}
    assert got[int(hot.i.iloc[-1])].x_cumsum == pytest.approx(hot.x.fillna(0).sum())
    assert got[int(hot.i.iloc[0])].x_median == pytest.approx(hot.x.median())


def test_metric_aliases_and_skips(spark):
    assert normalize_metrics(["Среднее", "avg", "Накопительная сумма", "СТАНДАРТНОЕ ОТКЛОНЕНИЕ", "уникальных"]) == [
        "mean", "cumsum", "std", "nunique"]
    df = spark.createDataFrame([("a", "x", 1.0)], "k string, s string, v double")
    r = group_aggregate(df, ["k"], ["s", "v"], ["mean", "bogus", "count"])
    assert ("s", "mean") in r.skipped and ("v", "bogus") in r.skipped
    assert r.added == ["s_count", "v_mean", "v_count"]
    assert r.df.count() == 1
    assert group_aggregate(df, [], ["v"], ["mean"]).df is df


def _shares(df, cols, ranges):
    """Rows of each range, relative to an even share."""
    n = df.withColumn("r", range_number(df, cols, ranges)).groupBy("r").count().toPandas()["count"]
    return n / (n.sum() / ranges)


def test_segmented_scan_hot_key_split(spark):
    # One key holds most rows; it spans several ranges whatever their number.
    rows = [(("hot" if i % 10 else f"k{i}"), i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    for ranges in (1, 16, 50):
        s = segmented_scan(df, ["k"], ["o"], {"v": F.col("v")}, running=True, totals=True, ranges=ranges)
        pdf = s.toPandas().sort_values(["k", "o"])
        assert (abs(pdf["v_run"] - pdf.groupby("k")["v"].cumsum()) < 1e-9).all()
        assert (abs(pdf["v_tot"] - pdf.groupby("k")["v"].transform("sum")) < 1e-9).all()
    assert _shares(df, ["k", "o"], 16).max() < 2


@pytest.mark.parametrize("case", ["log-normal", "one NaN", "shared prefix", "one date"])
def test_ranges_are_even_for_odd_orders(spark, case):
    rng = np.random.default_rng(1)
    n, ranges = 8000, 16
    if case == "log-normal":
        rows = [("hot", float(x), i) for i, x in enumerate(np.exp(rng.normal(0, 4, n)))]
    elif case == "one NaN":
        rows = [("hot", float(i) if i else float("nan"), i) for i in range(n)]
    elif case == "one date":
        rows = [("hot", 1.0, i) for i in range(n)]
    else:
        rows = [(f"Customer#{i:012d}", 0.0, i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, x double, i int").withColumn("t", F.timestamp_seconds(F.col("i")).cast("timestamp_ntz"))
    cols = ["k", "x", "t"] if case == "one date" else ["k", "x", "i"]
    assert _shares(df, cols, ranges).max() < 2
    s = segmented_scan(df, ["k"], cols[1:], {"one": F.lit(1)}, ranges=ranges)
    if case != "shared prefix":
        assert sorted(r.one_run for r in s.select("one_run").collect()) == list(range(1, n + 1))


def test_quantiles_of_a_value_that_most_rows_share(spark):
    x = [0.0] * 1900 + [float(i) for i in range(1, 101)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(num("x").alias("x"))
    assert value_histogram(df, [], "x").count() == 101  # 95 % of the rows are one row
    q = group_quantiles(df, [], "x", [0.5, 0.95, 0.999]).first()
    assert (q.n, q.q0) == (2000, 0.0)
    assert [q.q1, q.q2] == pytest.approx(list(np.quantile([v for v in x[:2000]], [0.95, 0.999])))


def test_segmented_scan_plan_shape(spark):
    # Full rows shuffle once, by range and key; the corrections are a broadcast.
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    s = segmented_scan(li, ["l_suppkey"], ["l_shipdate", "l_orderkey"], {"q": F.col("l_quantity")}, ranges=8)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.split("BroadcastExchange")[0].count("Exchange hashpartitioning") == 1


def test_group_quantiles_linear_and_midpoint(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, 10.0]], "x double")
    q = group_quantiles(df, [], "x", [0.25, 0.5, 0.75]).first()
    assert (q.q0, q.q1, q.q2) == (2.0, 3.0, 4.0)
    m = group_quantiles(df, [], "x", [0.25, 0.75], method="midpoint_rank").first()
    assert (m.q0, m.q1) == (1.75, 5.5)  # ranks 1.75 and 4.25 (1-based)


# --- G: correlation -------------------------------------------------------------

def test_correlation_edge(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (3.0, 5.0, 2.0)], "a double, c double, d double")
    m = {(r.col_a, r.col_b): r.r for r in correlation_matrix(df).collect()}
    assert m[("a", "d")] == 1.0 and m[("d", "a")] == 1.0
    assert m[("a", "c")] is None and m[("c", "c")] is None and m[("a", "a")] == 1.0


def test_correlation_many_columns_in_batches(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    data = rng.normal(size=(200, 20))
    data[rng.random((200, 20)) < 0.1] = np.nan  # pairwise-complete rows differ per pair
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(20)])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in data],
                               ", ".join(f"c{i} double" for i in range(20)))
    got = {(r.col_a, r.col_b): r.r for r in correlation_matrix(df, digits=None).collect()}
    assert len(got) == 400  # 210 pairs in two batches, mirrored
    exp = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            assert got[(a, b)] == pytest.approx(exp.loc[a, b], abs=1e-9)


def test_correlation_columns(spark):
    df = spark.createDataFrame([], "a double, b boolean, c int, s string")
    assert correlation_columns(df, ["s"], None, None) == ["a", "c"]
    assert correlation_columns(df, None, "c", None) == ["c", "a"]


# --- H / I: charts and ordering ------------------------------------------------------

def test_hierarchy_totals(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", None, 4.0)], "p string, q string, v double")
    rows = {(r.level, r.p, r.q): r.value for r in C.chart_hierarchy(df, ["p", "q"], "v").collect()}
    assert rows[(1, "a", None)] == 3.0 and rows[(1, "b", None)] == 4.0
    assert rows[(2, "b", None)] == 4.0  # a real missing leaf stays distinct from the rolled-up level
    assert len(rows) == 5


def test_box_whiskers(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, 100.0]], "y double")
    r = C.chart_box(df, x="y").first()
    assert (r.n, r.min, r.max, r.outliers, r.upper_whisker) == (5, 1.0, 100.0, 1, 4.0)


def test_order_axis_and_cap(spark):
    df = spark.createDataFrame([], "s string, well_no int, v double")
    assert order_axis_choice(df, "s", "v") == ["x"]
    assert order_axis_choice(df, "v", "well_no") == ["y"]
    assert order_axis_choice(df, "v", "s", "y") == ["y"]
    assert cap_columns(range(60)) == list(range(50))


def test_order_categories_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "c string, v double")
    got = [(r.c, r.position) for r in order_categories(df, "c", "v", "sum descending").orderBy("position").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2)]


# --- F: clustering --------------------------------------------------------------

def test_kmeans_and_pca(spark):
    pts = [(float(i % 3) * 10 + (i % 2) * 0.1, float(i % 3) * 10 - (i % 2) * 0.1) for i in range(30)] + [(None, 1.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    out = kmeans_cluster(df, ["x", "y"], k=3, starts=2)
    rows = out.collect()
    assert len(rows) == 31
    labs = {r["Кластеры"] for r in rows if r.x is not None}
    assert labs == {"Кластер 0", "Кластер 1", "Кластер 2"}
    assert [r["Кластеры"] for r in rows if r.x is None] == [None]
    feat = cluster_features(df, ["x", "y"])
    load = pca_loadings(feat)
    assert load[0][0] == pytest.approx(1 / math.sqrt(2), abs=1e-6) and load[0][1] == pytest.approx(1 / math.sqrt(2), abs=1e-6)


def test_silhouette_matches_pairwise(spark):
    pts =[(0.0, 0.0, 0), (0.0, 1.0, 0), (5.0, 5.0, 1), (6.0, 5.0, 1), (5.0, 7.0, 1), (9.0, 0.0, 2)]
    df = spark.createDataFrame(pts, "a double, b double, lab int")
    got = silhouette_sq(df, ["a", "b"], "lab")
    s = []
    for i, (xa, xb, la) in enumerate(pts):
        d = {}
        for j, (ya, yb, lb) in enumerate(pts):
            if i != j:
                d.setdefault(lb, []).append((xa - ya) ** 2 + (xb - yb) ** 2)
        own = d.get(la, [])
        if not own:
            s.append(0.0)
            continue
        a = sum(own) / len(own)
        b = min(sum(v) / len(v) for k, v in d.items() if k != la)
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(sum(s) / len(s))


def test_density_of_missing_values_keeps_its_columns(spark):
    df = spark.createDataFrame([(None, 1.0, "a", "f")], "x double, y double, c string, f string")
    d = C.chart_density_heatmap(df, "x", "y", color="c", facet_row="f")
    assert d.columns == ["f", "c", "xbin", "ybin", "count"] and d.count() == 0


def test_checked_broadcast_counts_bytes(spark):
    from tablelens.session import checked_broadcast

    df = spark.createDataFrame([("x" * 500, [1, 2, 3]), (None, None)], "s string, a array<int>")
    assert checked_broadcast(df)[1]
    assert not checked_broadcast(df, max_bytes=400)[1]
    assert not checked_broadcast(df, max_rows=1)[1]


def test_correlation_takes_every_column(spark):
    df = spark.range(20).select(*[(F.col("id") * (i + 1) + i).cast("double").alias(f"c{i}") for i in range(60)])
    assert len(correlation_columns(df)) == 60
    assert correlation_matrix(df).count() == 3600
    assert len(cap_columns(correlation_columns(df))) == 50
