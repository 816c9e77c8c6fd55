"""Line dedup against a plain search for repeated runs of lines."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tablelens.llm.line_dedup import remove_repeated_chunks
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Kept text, removed lines of each (id, text): of every run of two lines or more that stands
    somewhere before (without overlap), the lines go."""
    seen, out = {}, {}
    for n, (i, text) in enumerate(sorted(rows)):
        lines = (text or "").encode().split(b"\n")
        gone = set()
        for at in range(len(lines) - 1):
            for m, k in seen.get((lines[at], lines[at + 1]), []):
                if m < n or k + 2 <= at:
                    gone |= {at, at + 1}
            seen.setdefault((lines[at], lines[at + 1]), []).append((n, at))
        out[i] = b"\n".join(x for at, x in enumerate(lines) if at not in gone), len(gone)
    return out


def planted(seed=7):
    """Passages of 2 to 5 lines, each in four documents between lines of their own, at the start, in the middle and at the end."""
    rng, rows, passages = random.Random(seed), [], []
    for p in range(40):
        passage = [f"passage {p} line {k} " + "word " * 15 for k in range(2 + p % 4)]
        passages.append(passage)
        for copy in range(4):
            own = [f"own {p} {copy} {k} {rng.random()}" for k in range(1 + rng.randrange(6))]
            at = [0, len(own), rng.randrange(len(own) + 1), rng.randrange(len(own) + 1)][copy]
            rows.append((len(rows), "\n".join(own[:at] + passage + own[at:])))
    return rows, passages


def test_query_against_plain_search(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows)
    got = {r.doc_id: r for r in QUERIES["op2_line_dedup"](spark, SF).collect()}
    assert set(got) == set(want)
    for i, (kept, gone) in want.items():
        assert (got[i].kept_sha256, got[i].kept_bytes) == (hashlib.sha256(kept).hexdigest(), len(kept))
        assert got[i].removed_lines == gone


def test_short_passages_go_in_any_surroundings(spark):
    rows, passages = planted()
    got = {r.doc_id: r for r in remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        passage = passages[i // 4]
        own = [x for x in text.split("\n") if x not in passage]
        assert got[i].text == (text if i % 4 == 0 else "\n".join(own))
        assert (got[i].removed_lines, got[i].removed_chunks) == ((0, 0) if i % 4 == 0 else (len(passage), 1))


def test_overlap_repeats_and_clashes(spark, monkeypatch):
    import tablelens.llm.line_dedup as m

    rows = [(1, "x\nx\nx"), (2, "y\ny\ny\ny\ny"), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "b\nc\nd\na\nb"), (5, "a\nb\n"), (None, "q\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: "x\nx\nx", 2: "y\ny", 3: "", 4: "d", 5: ""}
    got = {r.doc_id: r.text for r in remove_repeated_chunks(df).collect()}
    # The null id comes first, so b, c stand there.
    assert got == {**want, None: "q\nb\nc", 3: "a"}
    real = m._chunks
    monkeypatch.setattr(m, "_chunks", lambda *a: real(*a).withColumn("hash", F.lit(b"0" * 16)))
    assert {r.doc_id: r.text for r in remove_repeated_chunks(df).collect()} == got
