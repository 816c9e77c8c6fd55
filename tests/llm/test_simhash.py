from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tablelens.llm import simhash as sh
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    """(id, fingerprint, least id reachable) by all pairs of fingerprints."""
    prints = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[find(p)] = min(least.get(find(p), doc), doc)
    return sorted(((doc, f"{p:016x}", least.get(find(p))) for (doc, _), p in zip(rows, prints)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in sh.near_components(df, **kw).collect()), key=str)


def brute_links(values):
    return {(min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[:i] if a != b and (a ^ b).bit_count() <= 2}


def joined(pairs, values):
    """Classes that links make, as a set of frozensets."""
    group = {v: {v} for v in values}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    return {frozenset(g) for g in group.values()}


def test_code_is_perfect_and_neighbours_share_an_index():
    low, high, errors, many = sh._code()
    assert sorted(set(many.tolist())) == [1, 6] and int((many == 1).sum()) == 277
    rng = random.Random(1)
    for _ in range(300):
        v = rng.getrandbits(23)
        w = v ^ sum(1 << b for b in rng.sample(range(23), rng.randint(0, 2)))
        row, index = sh.codewords(np.array([v, w]))
        assert set(index[row == 0].tolist()) & set(index[row == 1].tolist())


def test_no_link_lacks_a_key():
    rng = random.Random(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, 2)))
        row, key = sh.keys(np.array([a, b], np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@pytest.mark.parametrize("crowd", [2, 5, 64])
def test_links_of_dense_groups(spark, crowd):
    """Small and crowded buckets give the same classes as all pairs."""
    rng = random.Random(3)
    values = set()
    for _ in range(6):
        a = rng.getrandbits(64)
        values |= {a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)}
        values |= {a ^ rng.getrandbits(6) for _ in range(30)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in sh.links(df, crowd).collect()}
    want = brute_links(sorted(values))
    assert {(min(p), max(p)) for p in found} <= want
    assert joined(found, values) == joined(want, values)
    if crowd == 64:
        assert len(found) == len({(min(p), max(p)) for p in found})


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "One"), (5, "one"), (6, "Two words"), (7, "a b"), (8, "a  b\n"), (9, "a b c"),
            (9, "a b c"), (10, "A B c d"), (None, "a b c"), (None, "lonely words here stand"), (11, long), (12, long + " w0"), (13, "ÄÖ ä 　x"), (-4, "one")]
    assert run(spark, rows) == brute(rows)


def test_pieces_of_long_texts_do_not_show(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab \nC") for _ in range(3000))
    whole = brute_fingerprint(text)
    for step in (1, 7, 100):
        monkeypatch.setattr(sh, "STEP_BYTES", step)
        assert sh.fingerprint(text) == whole


def test_empty_table_and_other_columns(spark):
    assert sh.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "x y z", "p", 5), (2, "x y z", "q", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long").withColumnRenamed("fp", "a.b")
    out = sh.near_components(df.withColumn("root", df.doc_id).withColumn("__id", df.doc_id).withColumn("fp", df.doc_id))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and {r.component_id for r in out.collect()} == {1}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    sf_dir = SF.replace("sf0.001", sf)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = sorted((tuple(r) for r in QUERIES["op13_simhash_golay"](spark, sf_dir).collect()), key=str)
    assert out == brute(rows)
