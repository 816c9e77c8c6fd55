from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tablelens.llm import near_dedup as nd
from tablelens.llm.features import buffers
from tablelens.llm.queries import QUERIES
from tablelens.llm.shingles import counted, shingles

SF = "/root/testdata/sf0.001"


def bag(text, n=5):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def brute(rows, threshold=0.8):
    """Class of each row number by all pairs and union."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            equal = (rows[i][1] or "") == (rows[j][1] or "")
            if equal or (bags[i] and bags[j] and similar(bags[i], bags[j]) >= threshold):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(rows)}


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["__id"]: r.class_id for r in nd.near_classes(df).collect()}


def test_registers_agree_as_often_as_the_weighted_similarity():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    a = [rng.choice(words) for _ in range(300)] + ["x"] * 40
    b = a[:250] + [rng.choice(words) for _ in range(50)] + ["x"] * 15
    texts = [" ".join(a), " ".join(b)]
    (_, data, starts, ends), = buffers(texts)
    found = counted(*shingles(data, starts, ends))
    times = nd.bag_times(*found, 2, registers=20_000)
    want = similar(bag(texts[0]), bag(texts[1]))
    assert abs((times[0] == times[1]).mean() - want) < 0.015
    assert abs(nd.overlaps(texts[:1], texts[1:])[0] - want) < 1e-12
    assert np.isfinite(times).all()


def test_documents_against_all_pairs(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op5_near_dedup_bagminhash"](spark, SF).collect()}
    want = brute(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert sum(r.kept for r in got.values()) == len(set(want.values()))


def test_chains_and_open_buckets(spark):
    """Near copies of several strengths: some link only through others, some not at all."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    chain = list(rows[5][1].split())
    for i in range(60, 70):  # a drifting chain
        at = 18 * (i - 60)
        chain[at:at + 3] = [rng.choice(words) for _ in range(3)]
        rows.append((i, " ".join(chain)))
    assert classes(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "!!!"), (5, "two words"), (6, "Two, words"), (7, "two word"),
            (8, "a b c d e f g"), (8, "a b c d e f g"), (9, "lorem " * 30_000), (10, "lorem " * 29_000)]
    got = classes(spark, rows)
    assert got[1] == got[2] == 1 and got[3] == got[4] == 3
    assert got[5] == got[6] == 5 and got[7] == 7 and got[9] == got[10] == 9
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    left = nd.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 7, 8, 9]
    assert nd.near_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4])
def test_small_blocks_give_the_same_classes(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    test_chains_and_open_buckets(spark)


def test_rows_go_only_to_blocks_with_odd_rows(spark):
    """One odd row in a bucket of 5,000: every member is copied once, not once a block."""
    rows = spark.range(5000).selectExpr("1 as band", "7L as hash", "id = 77 as odd", "id % 5 as block")
    copies = nd._copies(rows)
    assert copies.count() == 5000 and {r.mine for r in copies.select("mine").distinct().collect()} == {77 % 5}
    three = rows.withColumn("odd", rows.odd | (rows.block > 2))
    assert nd._copies(three).count() == 3 * 5000
    assert nd._copies(rows.withColumn("odd", rows.block < 0)).count() == 0
