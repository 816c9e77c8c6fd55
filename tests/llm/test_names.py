"""Extra columns of any name pass through the filtering operators with their values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablelens.llm.decontam import decontaminate, drop_contaminated
from tablelens.llm.line_dedup import remove_repeated_chunks
from tablelens.llm.near_dedup import drop_near_copies

NAMES = ["__id", "__h", "__ID", "__gone_id", "__gone_h", "__spans", "__hit_id", "__hit_h", "a.b", "node", "first", "hash", "c", "root", "x`y"]
WORDS = " ".join(f"word{i}" for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [f"{WORDS}\nline two of it", f"{WORDS}\nline two of it\nmore", "something quite different\nin two lines", "one"]
    rows = [(i, t, *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    for n in NAMES:
        if n != "__ID":  # the same column as __id to Spark
            df = df.withColumn(n, F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")))
    return df


def passed(out, columns):
    """Ids left; every other value as it was."""
    assert out.columns[:len(columns)] == columns
    rows = out.collect()
    for r in rows:
        for n, v in zip(columns[2:], r[2:len(columns)]):
            assert v == f"{n}-{r[0]}"
    return {r[0] for r in rows}


def test_line_dedup(docs):
    out = remove_repeated_chunks(docs)
    assert passed(out, docs.columns) == {0, 1, 2, 3}
    assert {r[0]: r.text for r in out.collect()}[1] == "more"


def test_near_dedup(spark, docs):
    more = docs.unionByName(docs.where("doc_id = 3"))
    out = drop_near_copies(more)
    assert passed(out, docs.columns) == {0, 2, 3} and out.count() == 3


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([("b", "x word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"), ("s", "one")], "item_id string, text string")
    assert passed(drop_contaminated(docs, bench), docs.columns) == {2}


def test_dotted_id_and_text(spark):
    rows = [(1, "a b c\nd e f"), (2, "a b c\nd e f"), (3, "z")]
    df = spark.createDataFrame(rows, "i long, t string").toDF("my.id", "my.text")
    assert {r[0]: r[1] for r in remove_repeated_chunks(df, "my.id", "my.text").collect()} == {1: "a b c\nd e f", 2: "", 3: "z"}
    assert {r[0] for r in drop_near_copies(df, "my.id", "my.text").collect()} == {1, 3}
    bench = spark.createDataFrame([("q", "z")], "item_id string, text string")
    assert {r[0] for r in drop_contaminated(df, bench, "my.id", "my.text").collect()} == {1, 2}


def test_null_items_count(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "alpha beta"), ("b", "beta gamma"), (None, "gamma")], "item_id string, text string")
    for bound in (100, 0):
        got = {r.doc_id: r for r in decontaminate(docs, bench, broadcast_windows=bound).collect()}
        assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (3, 2, True)
        assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (1, 1, True)
        sha = {r[0] for r in spark.sql("select sha2('b', 256) union all select sha2('', 256)").collect()}
        assert {got[1].items_sha256, got[2].items_sha256} == sha


def test_pipeline_stages(spark, docs):
    """Every stage of the pipeline hands on columns of any name, with their values."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    own = docs.withColumn("score", F.concat(F.lit("score-"), "doc_id")).withColumn("Removed_Lines", F.concat(F.lit("Removed_Lines-"), "doc_id"))
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in cp.STAGES[:-1]:
        if name == "quality classifier":  # these few documents have no labels of their own
            out = stage(spark, own.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id > 100"), True), sf)
            out = out.where("doc_id < 4")
        else:
            out = stage(spark, own, sf)
        assert out.columns == own.columns
        for r in out.collect():
            assert all(v == f"{n}-{r[0]}" for n, v in zip(own.columns[2:-1], r[2:-1])) and r[-1] == len(r[1])
    assert cp.pack_sequences(spark, own, sf).select("doc_id").distinct().count() == 4
