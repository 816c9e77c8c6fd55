"""Sketched quantiles, binned densities, capped rows, calendar bins, long lists, heavy keys and exports on small fixtures."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts as C
from tablelens.operators.binning import bin_column, compute_edges, edge_rank_errors
from tablelens.operators.filters import LONG_LIST, FilterSpec, apply_filters, filter_isin_long
from tablelens.operators.groupagg import attach_group_values, group_aggregate, heavy_keys
from tablelens.operators.order import order_categories
from tablelens.operators.scan import sketched_quantiles
from tablelens.sources import io


def off(values, x, p):
    """Distance of the rank p n from the ranks that x holds, as a share of n."""
    n, below, upto = len(values), sum(v < x for v in values), sum(v <= x for v in values)
    return max(0.0, (below - p * n) / n, (p * n - upto) / n)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(31)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.lognormvariate(0, 2), i) for i in range(20_000)]
    rows += [("a", 1.0, -i) for i in range(5000)] + [("c", 4.0, 1), ("d", None, 2), ("e", float("nan"), 3)]
    return rows, spark.createDataFrame(rows, "k string, x double, i long").repartition(9).cache()


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_sketches_keep_their_bound(skewed, accuracy):
    rows, df = skewed
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    real = df.where(~F.isnan("x"))
    got = {r.k: r for r in sketched_quantiles(real, ["k"], "x", probs, accuracy=accuracy).collect()}
    groups = defaultdict(list)
    for k, x, _ in rows:
        if x is not None and not math.isnan(x):
            groups[k].append(x)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values) and got[k].q0 == min(values) and got[k].q4 == max(values)
        assert all(off(values, got[k][f"q{i}"], p) <= 1 / accuracy for i, p in enumerate(probs))


def test_approximate_bins_and_their_errors(skewed):
    rows, df = skewed
    values = [x for _, x, _ in rows if x is not None and not math.isnan(x)]
    edges = compute_edges(df, "x", 8, "count", accuracy=200)
    probs = [sum(v < e for v in values) / len(values) for e in edges]
    errors = {r.edge: r for r in edge_rank_errors(df, "x", edges, probs).collect()}
    assert all(r.rank_error < 1e-12 and r.value == edges[i] for i, r in errors.items())
    bins = Counter(r[0] for r in bin_column(df, "x", 8, labels="index", accuracy=200).select("`Группа(x)`").collect())
    assert bins[None] == 2 and sum(bins.values()) == len(rows)
    exact = compute_edges(df, "x", 8, "count")
    assert len(exact) == len(edges) and edges[0] == exact[0] and edges[-1] == exact[-1]
    assert compute_edges(df.where("false"), "x", 4, "count", accuracy=10) == []
    assert edge_rank_errors(df.where("false"), "x", [1.0], [0.5]).collect() == []


def test_approximate_medians_and_boxes(skewed):
    rows, df = skewed
    out = group_aggregate(df, ["k"], ["x"], ["median", "count"], accuracy=100).df
    medians = {r.k: r.x_median for r in out.select("k", "x_median").distinct().collect()}
    boxes = {r.k: r for r in C.chart_box(df, "k", "x", accuracy=100).collect()}
    exact = {r.k: r for r in C.chart_box(df, "k", "x").collect()}
    groups = defaultdict(list)
    for k, x, _ in rows:
        if x is not None and not math.isnan(x):
            groups[k].append(x)
    assert medians["d"] is None and set(boxes) == set(groups) == set(exact)
    for k, v in groups.items():
        assert off(v, medians[k], 0.5) <= 0.01
        b = boxes[k]
        assert (b.n, b.min, b.max) == (len(v), min(v), max(v)) == (exact[k].n, exact[k].min, exact[k].max)
        lo, hi = b.q1 - 1.5 * (b.q3 - b.q1), b.q3 + 1.5 * (b.q3 - b.q1)
        inside = [x for x in v if lo <= x <= hi]
        assert (b.lower_whisker, b.upper_whisker, b.outliers) == (min(inside), max(inside), len(v) - len(inside))


def test_categories_by_approximate_medians(spark):
    rows = [(f"c{k}", float(10 * k + i % 9), i) for k in range(6) for i in range(500)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    for how in ("median ascending", "median descending"):
        exact, near = ([r.k for r in order_categories(df, "k", "x", how, accuracy=a).orderBy("position").collect()] for a in (None, 100))
        assert exact == near and near[-1] == "none"


@pytest.mark.parametrize("cells", [64, 1024])
def test_binned_density_is_within_its_bound(skewed, cells):
    """Against the exact sum over all values for the bandwidth used."""
    rows, df = skewed
    curves = defaultdict(list)
    for r in C.chart_violin(df.where("x < 50 or x is null"), "k", "x", points=25, cells=cells).collect():
        curves[r.k].append(r)
    groups = defaultdict(list)
    for k, x, _ in rows:
        if x is not None and x < 50:
            groups[k].append(x)
    assert set(curves) == set(groups)
    for k, v in groups.items():
        v, points = np.array(v), sorted(curves[k], key=lambda r: r.point)
        assert [p.point for p in points] == list(range(25))
        bw = (v.min() - points[0].value) / 2
        for p in points:
            exact = np.exp(-0.5 * ((p.value - v) / bw) ** 2).sum() / (len(v) * bw * math.sqrt(2 * math.pi))
            assert abs(p.density - exact) <= p.error_bound + 1e-9
    assert C.chart_ridge(df.where("false"), "x", color="k", cells=16).collect() == []


def wanted(rows, cap, series):
    by = defaultdict(list)
    for r in rows:
        by[series(r)].append(r)
    return {s: sorted(sorted(rs, key=lambda r: (hashlib.md5(str(r[2]).encode()).hexdigest(), str(r)))[:cap], key=str) for s, rs in by.items()}


@pytest.mark.parametrize("cap", [1, 7, 300, 100_000])
def test_capped_rows_are_those_of_least_hash(skewed, cap):
    rows, df = skewed
    rows = [r for r in rows if r[1] is None or not math.isnan(r[1])]
    df = df.where("not coalesce(isnan(x), false)")
    got = defaultdict(list)
    for r in C.cap_rows(df, ["k"], ["i"], cap).collect():
        got[r.k].append(tuple(r))
    want = wanted(rows, cap, lambda r: r[0])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert {k: sorted(r[2] for r in v) for k, v in got.items()} == {k: sorted(r[2] for r in v) for k, v in want.items()}
    whole = C.chart_scatter3d(df, "x", "x", "i", cap=cap, cap_by=["i"])
    assert whole.columns == ["x", "i"] and whole.count() == min(cap, len(rows))


def test_cap_of_rows_that_share_their_key(spark):
    """A key that most rows share lies wholly near or wholly far: the cap is met all the same."""
    for shared in ("x", "y", "z", "q", "far", "near"):
        df = spark.createDataFrame([("s", shared, i) for i in range(3000)] + [("t", str(i), i) for i in range(10)], "c string, id string, i long")
        out = C.chart_scatter(df, "i", "i", color="c", cap=100, cap_by=["id"]).groupBy("c").count().collect()
        assert {r.c: r["count"] for r in out} == {"s": 100, "t": 10}
    assert C.chart_scatter(df.where("false"), "i", color="c", cap=3).collect() == []
    with pytest.raises(ValueError):
        C.cap_rows(df, [], ["i"], 0)


def test_calendar_bins(spark):
    days = [dt.datetime(2023, 12, 30, 5), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 2, 29, 12), dt.datetime(2024, 3, 31, 1, 30)]
    rows = [("a", d) for d in days] + [("b", days[0]), (None, days[3]), ("c", None)]
    for kind in ("timestamp_ntz", "timestamp", "date"):
        df = spark.createDataFrame(rows, "k string, t timestamp_ntz").withColumn("t", F.col("t").cast(kind))
        month = C.chart_histogram_calendar(df, "t", "month", color="k")
        assert dict(month.dtypes)["bin_start"] == kind
        got = {(r.k, str(r.bin_start)[:10]): (str(r.bin_end)[:10], r["count"]) for r in month.collect()}
        months = ["2023-12-01", "2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
        counts = {"a": [1, 2, 1, 1], "b": [1, 0, 0, 0], None: [0, 0, 1, 0]}
        assert got == {(k, m): (e, c[i]) for k, c in counts.items() for i, (m, e) in enumerate(zip(months, months[1:]))}
        weeks = C.chart_histogram_calendar(df, "t", "week").collect()
        assert len(weeks) == 14 and sum(r["count"] for r in weeks) == 7 and all(r.bin_start.weekday() == 0 for r in weeks)
        assert C.chart_histogram_calendar(df, "t", "quarter").count() == 2 and C.chart_histogram_calendar(df, "t", "year").count() == 2
        assert C.chart_histogram_calendar(df, "t", "day").agg(F.count("*"), F.sum("count")).first()[:] == (93, 7)
        assert C.chart_histogram_calendar(df.where("t is null"), "t", "day", color="k").collect() == []
    with pytest.raises(ValueError):
        C.chart_histogram_calendar(df, "t", "decade")
    with pytest.raises(ValueError):
        C.chart_histogram_calendar(df, "k", "day")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_long_lists_are_one_semi_join(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "id * 2.0D as x", "concat('t', id) as t", "date_add(DATE'2020-01-01', cast(id % 900 as int)) as d").write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    keys = list(range(500, 60_500, 2)) + [None, 7_000_000]
    out = filter_isin_long(df, "id", keys)
    text = plan(out)
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "GreaterThanOrEqual(id,500)" in text and "In(id" not in text and " IN (" not in text
    assert out.agg(F.count("*"), F.min("id"), F.max("id")).first()[:] == (30_000, 500, 60_498)
    assert filter_isin_long(df, "id", keys, broadcast_max_rows=0).count() == 30_000
    assert filter_isin_long(df, "x", [4.0, "8", float("nan"), 5]).count() == 2
    assert filter_isin_long(df, "id", ["12", "13.0", "13.5", "x"]).count() == 2
    assert filter_isin_long(df, "t", [f"t{i}" for i in range(5000)] + [5]).count() == 5000
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(0, 4000, 3)]
    assert filter_isin_long(df, "d", days).count() == filter_isin_long(df, "d", [str(d) for d in days]).count() == df.where("datediff(d, DATE'2020-01-01') % 3 = 0").count()
    assert filter_isin_long(df, "id", [None]).count() == 0 and filter_isin_long(df, "id", df.where("false").select("id")).count() == 0
    frame = df.where("id % 10 = 0").selectExpr("id as other", "x")
    specs = [FilterSpec("x", [0, 400]), {"column": "t", "value": [f"t{i}" for i in range(2 * LONG_LIST)]}, FilterSpec("id", frame.select("other"))]
    assert sorted(r.id for r in apply_filters(df, specs).collect()) == list(range(0, 201, 10))
    with pytest.raises(ValueError):
        apply_filters(df, [FilterSpec("x", list(range(5000)))])


def test_heavy_keys_do_not_move(spark):
    """One key has a third of the rows, one half of what is left: no shuffle partition gets either."""
    rows = [(None if i % 3 == 0 else -1 if i % 3 == 1 else i, float(i % 7)) for i in range(9000)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(8)
    heavy = {r[0] for r in heavy_keys(df, ["k"]).collect()}
    assert heavy == {None, -1}
    groups = df.groupBy("k").agg(F.avg("x").alias("m"))
    out = attach_group_values(df, groups, ["k"], broadcast_max_rows=0)
    want = defaultdict(list)
    for k, x in rows:
        want[k].append(x)
    got = Counter((r.k, r.x, round(r.m, 9)) for r in out.collect())
    assert got == Counter((k, x, round(sum(want[k]) / len(want[k]), 9)) for k, x in rows)
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 2 * len(rows) / 8
    even = spark.range(1000).selectExpr("id as k")
    assert heavy_keys(even, ["k"]).isEmpty() and attach_group_values(even, even.selectExpr("k", "k * 2 as v"), ["k"], 0).where("v = 2 * k").count() == 1000


def test_exports_have_bounded_files_and_read_back(spark, tmp_path):
    df = spark.range(10_000).selectExpr("id", "id % 10 = 0 as b", "cast(id % 37 as double) as x", "CASE WHEN id % 5 > 0 THEN concat('n,\"', id) END as s")
    ts = dt.datetime(2024, 5, 6)
    for fmt in ("parquet", "csv", "json"):
        path = io.export_dataset(df.repartition(3), str(tmp_path), "data", ts=ts, fmt=fmt, rows_per_file=900, verify=True)
        files = io.export_files(spark, path).collect()
        assert sum(r.n_rows for r in files) == 10_000 and max(r.n_rows for r in files) <= 900
        with pytest.raises(Exception):
            io.export_dataset(df, str(tmp_path), "data", ts=ts, fmt=fmt)
    path = io.export_dataset(df, str(tmp_path), "sorted", ts=ts, sort_by=["x", "id"], rows_per_file=1500, verify=True)
    spans = sorted((r.least, r.greatest) for r in io.export_files(spark, path, "x").collect())
    assert len(spans) >= 7 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert io.content_mark(df) == io.content_mark(df.orderBy(F.desc("id")).repartition(5)) != io.content_mark(df.where("id > 0"))
    path = io.export_dataset(df.where("false"), str(tmp_path), "none", ts=ts, sort_by=["id"], verify=True)
    assert io.read_export(spark, path, df.schema).count() == 0
    with pytest.raises(ValueError):
        io.export_dataset(df, str(tmp_path), "x", rows_per_file=0)
