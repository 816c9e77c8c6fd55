"""The pipeline's line-dedup stage against a plain search for repeated runs of lines."""

from __future__ import annotations

import corpus_pipeline as cp
from test_line_runs import plain, planted

SF = "/root/testdata/sf0.001"


def test_stage_takes_planted_passages_of_two_to_five_lines(spark):
    rows, passages = planted(11)
    rows += [(len(rows) + p, "\n".join(passage)) for p, passage in enumerate(passages)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.drop_repeated_lines(spark, df, SF).collect()}
    want = {i: t.decode() for i, (t, _) in plain(rows).items()}
    assert got == {i: (t, len(t)) for i, t in want.items() if t}
    assert sum(t[0].count("passage") for t in got.values()) == sum(map(len, passages))


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: t.decode() for i, (t, _) in plain(texts.items()).items()}
    got = {r.doc_id: r.text for r in cp.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {i: t for i, t in want.items() if t or not texts[i]}
