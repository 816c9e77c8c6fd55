"""The byte bound of the training samples leaves out what does not fit, not what comes after it."""

from __future__ import annotations

import zlib

import numpy as np

from tablelens.llm import language, quality
from tablelens.llm.sampling import within_bytes

IDS = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5][:120]


def first_met(ids):
    return sorted(ids)[np.random.default_rng(1).permutation(len(ids))[0]]


def test_quality_learns_both_labels_beside_a_very_long_text(spark):
    giant = first_met(IDS)
    words = {1: "clear careful useful sentence about rivers", 0: "zzz qqq spam click xxl"}
    label = {i: n % 2 for n, i in enumerate(IDS)}
    docs = spark.createDataFrame([(i, words[label[i]] * (20_000 if i == giant else 1)) for i in IDS], "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    model = quality.fit(docs, labels, train_bytes=100_000)
    good, bad = model.score([words[1], words[0]])
    assert good > 0.7 and bad < 0.3


def test_a_rare_language_stays_beside_a_very_long_text(spark):
    ids = [str(i) for i in IDS]
    giant = first_met(ids)
    words = {"aa": "the river runs along the hill", "bb": "der fluss zieht durch das tal", "cc": "la rivière coule vers la mer"}
    lang = {i: "cc" if n in (5, 50, 90) and i != giant else ("aa", "bb")[n % 2] for n, i in enumerate(ids)}
    rows = [(i, words[lang[i]] * (20_000 if i == giant else 3), lang[i]) for i in ids]
    model = language.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"), train_bytes=100_000)
    assert model.predict([words[x] for x in words])[0] == list(words)


def test_bytes_are_dealt_by_class(spark):
    rows = [(i, "x" * 100, "often") for i in range(500)] + [(1000, "y" * 100, "rare"), (2000, "z" * 90_000, "long"), (2001, "z" * 80_000, "long")]
    df = spark.createDataFrame(rows, "id long, text string, c string")
    assert within_bytes(df, "c", "id", "text", 10**6).count() == len(rows)
    got = within_bytes(df, "c", "id", "text", 30_100).collect()
    assert {r.id for r in got if r.c != "often"} == {1000, 2001}
    assert sum(len(r.text) for r in got if r.c == "often") == 15_000


def test_an_id_of_very_many_texts_stays_bounded(spark):
    from tablelens.llm.sampling import within_bytes

    rows = spark.range(400).selectExpr("1L as id", "concat('text ', id) as text", "cast(id % 2 = 0 as int) as label")
    rows = rows.unionByName(rows.limit(0)).unionByName(spark.createDataFrame([(2, "other", 7)], "id long, text string, label int"))
    kept = within_bytes(rows, "label", "id", "text", 10**9, most_texts=30).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in kept} == {0: 30, 1: 30, 7: 1}
    assert within_bytes(rows, "label", "id", "text", 10**9, most_texts=200).count() == 401
    again = [sorted(r.text for r in within_bytes(x, "label", "id", "text", 10**9, 30).collect()) for x in (rows, rows.repartition(5))]
    assert again[0] == again[1]
