"""Queries that SQL cannot state (3, 4, 6, 9) against plain loops over every row."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

from tablelens.llm import features, language, packing, quality, token_counts
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1
BASE, MIX = int(features._BASE), int(features._MIX)


def buckets(data, bits, orders, words):
    """Every feature of one text, hashed with plain numbers."""
    out = []
    for n in orders:
        for at in range(len(data) - n + 1):
            h = (int.from_bytes(data[at:at + n], "little") + n) * 0x9E3779B1 & M32
            h = (h ^ h >> 15) * 0x85EBCA77 & M32
            out.append(h >> 32 - bits)
    if words:
        names = [sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(w)) & M64 for w in split(data)]
        for kind, every in ((7, names), (11, [b - a & M64 for a, b in zip(names, names[1:])])):
            for name in every:
                h = (name + kind) * MIX & M64
                out.append(((h ^ h >> 32) * MIX & M64) >> 64 - bits)
    return out


def split(data):
    word, out = bytearray(), []
    for b in data + b" ":
        if b > 32:
            word.append(b)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out


def means(text, hasher, weights):
    found = buckets((text or "").encode(), **hasher)
    return [sum(float(weights[b][m]) for b in found) / max(1, len(found)) for m in range(len(weights[0]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_scores(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, SF).collect()}
    logits = [[x] for x in model.logits.tolist()]
    for d in docs.collect():
        z = max(-30.0, min(30.0, means(d.text, quality._HASHER, logits)[0] + model.bias))
        r = got.pop(d.doc_id)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)
    assert not got


def test_languages(spark, docs):
    model = language.fit(docs)
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    weights, split_by = model.weights.tolist(), len(model.families) if len(model.families) > 1 else 0
    for d in docs.collect():
        r = got.pop(d.doc_id)
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = [max(-30.0, min(30.0, m + b)) for m, b in zip(means(d.text.lower(), language._HASHER, weights), model.bias.tolist())]
        p = [1 / (1 + math.exp(-2 * x)) for x in z]
        family = max(range(split_by), key=lambda f: (z[f], -f)) if split_by else 0
        names, score = model.families[family], p[family] if split_by else 1.0
        votes, total = Counter(), Counter()
        for m, (a, b) in enumerate(model.pairs, split_by):
            if a in names and b in names:
                votes[a if p[m] >= 0.5 else b] += 1
                total[a] += p[m]
                total[b] += 1 - p[m]
        best = max(names, key=lambda n: (votes[n], total[n], -names.index(n)))
        assert r.lang_pred == best
        assert r.score == pytest.approx(score * (total[best] / (len(names) - 1) if len(names) > 1 else 1.0), abs=1e-9)
    assert not got


def test_token_counts(spark, docs):
    encoding = token_counts._encoding(token_counts.default_vocabulary())
    lengths = [len(encoding.encode_ordinary(d.text or "")) for d in docs.collect()]
    rows = QUERIES["op9_token_counts"](spark, SF).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        n = r.n_tokens
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.docs_at_most == sum(x <= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n) and r.tokens_if_truncated == sum(min(x, n) for x in lengths)


def plain_best_fit(lengths, caps, weights=(1.0, 0.01, 0.01)):
    """Remainders of the sequences when each piece, longest first, goes where the least weighted norm is left."""
    left = []
    for n in sorted(lengths, reverse=True):
        piece = (n, 1, n * n)
        after = lambda s: [r - p for r, p in zip(s, piece)]
        fits = [i for i, s in enumerate(left) if min(after(s)) >= 0]
        if fits:
            i = min(fits, key=lambda i: (sum(w * (r / c) ** 2 for w, r, c in zip(weights, after(left[i]), caps)), left[i]))
        else:
            i = len(left)
            left.append(list(caps))
        left[i] = after(left[i])
    return left


def test_packing_against_plain_best_fit(spark):
    rows = QUERIES["op4_pack_best_fit"](spark, SF).collect()
    loads, places = Counter(), {}
    for r in rows:
        loads[r.sequence_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():  # gapless from 0
        assert all(at == sum(n for _, n in sorted(held)[:i]) for i, (at, _) in enumerate(sorted(held)))
    want = plain_best_fit([r.length for r in rows], (2048, 2048, 2048 * 2048))
    assert len(loads) == len(want) and sorted(loads.values()) == sorted(2048 - s[0] for s in want)


def test_histogram_best_fit_where_other_capacities_bind():
    import random

    rng = random.Random(9)
    for caps in ((100, 3, 10_000), (100, 100, 2_000), (60, 5, 1_500)):
        lengths = [rng.choice([rng.randint(1, 30), 7, 20]) for _ in range(150)]
        n, intervals = packing.best_fit(Counter(lengths), caps)
        assert sum(end - rank for _, rank, end, _, _, _ in intervals) == len(lengths)
        assert abs(n - len(plain_best_fit(lengths, caps))) <= 1
