from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from test_line_runs import plain

from tablelens.llm.line_dedup import remove_repeated_chunks
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Kept text of each (id, text) by the plain search for repeated runs."""
    return {i: kept for i, (kept, _) in plain(rows).items()}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in QUERIES["op2_line_dedup"](spark, SF).collect()}
    assert set(got) == set(want)
    for i, kept in want.items():
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert got[i].kept_bytes == len(kept)
    assert sum(r.removed_chunks for r in got.values()) > 0


def test_documents_too_many_to_broadcast(spark, monkeypatch):
    """Beyond the bounds of a broadcast the ids are broadcast, or the documents shuffle, with the same result."""
    import tablelens.llm.line_dedup as m

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__gone_id", F.col("doc_id"))
    docs = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    want = sorted(map(str, remove_repeated_chunks(docs).collect()))
    real = m.checked_broadcast
    for bound in (lambda x: 0, lambda x: 0 if any(t.startswith("array") for _, t in x.dtypes) else 10_000):
        monkeypatch.setattr(m, "checked_broadcast", lambda x, bound=bound: real(x, bound(x)))
        assert sorted(map(str, remove_repeated_chunks(docs).collect())) == want


def test_edge_cases(spark):
    two = "a first line\na second line"
    rows = [(1, two, 5), (2, two, 6), (2, two, 6), (3, None, 7), (4, "", 8), (5, "one line", 9), (6, "one line", 9),
            (7, two + "\n" + "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int").withColumn("chunk", F.lit("clash"))
    got = sorted((r.doc_id, r.text, r.hash, r.removed_lines) for r in remove_repeated_chunks(df).collect() if r.text is not None)
    assert (1, two, 5, 0) in got
    assert got.count((2, "", 6, 2)) == 2
    assert (5, "one line", 9, 0) in got and (6, "one line", 9, 0) in got and (4, "", 8, 0) in got
    assert remove_repeated_chunks(df.limit(0)).count() == 0
    assert remove_repeated_chunks(df).count() == len(rows)


def test_hash_clash_is_told_apart_by_bytes(spark, monkeypatch):
    import tablelens.llm.line_dedup as m

    real = m._chunks

    def same_hash(*a):
        return real(*a).withColumn("hash", F.lit(b"0" * 16))

    monkeypatch.setattr(m, "_chunks", same_hash)
    df = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_chunks(df).collect()} == {1: "a\nb", 2: "c\nd", 3: ""}
