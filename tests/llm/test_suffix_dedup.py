from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablelens.llm import suffix_dedup as sd
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """(removed bytes, spans, kept) of each (id, bytes), by a set of all strings."""
    seen, out = set(), {}
    for i, data in sorted(rows):
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[i] = (sum(gone), spans, kept)
    return out


def got(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return {r["__id"]: (r.n_removed, len(r.spans), bytes(r.kept)) for r in sd.remove_repeats(df).collect()}


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    found = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    assert set(found) == set(want)
    for i, data in docs:
        r, (gone, spans, kept) = found[i], want[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), gone, spans, hashlib.sha256(kept).hexdigest())
    assert sum(w[0] for w in want.values()) > 0


@pytest.mark.parametrize("hot,step", [(0.003, 1_000_000), (10.0, 1_000_000), (0.003, 700)])
def test_planted_repeats(spark, monkeypatch, hot, step):
    """Copies, passages in many documents, self-repeats, constant runs; hot and cold seeds; texts cut into pieces."""
    monkeypatch.setattr(sd, "HOT_SHARE", hot)
    monkeypatch.setattr(sd, "STEP_BYTES", step)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, other = prose(40), prose(25)
    rows = []
    for i in range(60):
        text = prose(rng.randrange(0, 80))
        if i % 2:
            text += " " + common + " " + prose(5)
        if i % 5 == 0:
            text += other[: rng.randrange(len(other))]
        if i % 11 == 0:
            text += "x" * 400
        if i % 13 == 0:
            text = rows[-1][1] if rows else text
        rows.append((i * 7 % 61, text))
    rows.append((100, common * 3))
    want = {i: w for i, w in brute([(i, t.encode()) for i, t in rows]).items() if w[0]}
    assert got(spark, rows) == want


def test_edge_cases(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text), (2, None), (3, ""), (4, "short"), (5, text[1000:1099]), (6, text[1000:1100]), (6, text[1000:1100]),
            (None, text[2000:2100]), (7, text[:50] + "!" + text[50:100])]
    found = got(spark, rows)
    assert set(found) == {1, 6}
    assert found[6] == (100, 1, b"")
    assert found[1] == (100, 1, (text[:2000] + text[2100:]).encode())  # the null id comes first
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sd.remove_repeats(df.withColumn("spans", F.lit(1)).limit(0)).count() == 0
