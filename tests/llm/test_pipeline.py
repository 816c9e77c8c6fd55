from __future__ import annotations

import zlib

import corpus_pipeline as cp
from test_near_dedup import brute as brute_classes
from test_line_dedup import brute as brute_lines

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append(docs)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(o.columns == source.columns for o in outs[:4])
    rows = [[(r.doc_id, r.text) for r in o.collect()] for o in [source, *outs[:4]]]
    # quality: no good document goes, and the learned labels are met
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in rows[1]}
    assert all(i in kept for i, q in quality.items() if q)
    assert not any(i in kept for i, q in quality.items() if not q and zlib.crc32(str(i).encode()) % 5)
    # line dedup
    want = {i: t.decode() for i, t in brute_lines(rows[1]).items()}
    texts = dict(rows[1])
    assert dict(rows[2]) == {i: t for i, t in want.items() if t or not texts[i]}
    # near dedup
    classes = brute_classes(sorted(rows[2]))
    assert {i for i, _ in rows[3]} == set(classes.values())
    # decontamination: a plain search for each ten-word window
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    bad = lambda t: any(tuple(t[i:i + n]) in windows for n in sizes for i in range(len(t) - n + 1))
    assert {i for i, _ in rows[4]} == {i for i, t in rows[3] if not bad(split(t))}
    # packing
    packed = outs[4]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in rows[4]}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_clashing_columns_nulls_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(-1, None, None, None, None), (None, "some words", "en", "s", 10), (-2, "", "en", "s", 0),
                                 (-3, "x " * 60_000, "en", "s", 120_000)], docs.schema)
    docs = docs.unionByName(odd).unionByName(odd).withColumn("score", F.lit(1)).withColumn("removed_lines", F.lit(2)).withColumn("node", F.lit(3))
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == before.columns
        docs.count()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
