"""Brute force, edge cases and held-out accuracy of the corpus operators
(suffix, line and near dedup and the pipeline have files of their own)."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import decontam, knn, language, packing, quality, sharding, token_counts
from tablelens.llm.queries import QUERIES, SQL

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "x" * 30_000 + " " + "y " * 40_000), (4, "Same text, twice."), (4, "Same text, twice."),
       (5, "Same text, twice."), (6, "Ünï çødé ΣΑΣ 你好 😀 don't"), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = ["id", "__id", "words", "length", "rank", "shard", "score", "hash", "n", "n_tokens", "lang"]
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in clash])


# --- op8 ----------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search(docs, items, n=10):
    wins = {(i, tuple(w[s:s + n])) for i, t in items if (w := words(t)) for s in range(max(1, len(w) - n + 1))}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination_against_search(spark, odd, broadcast):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)] + ["É", "ß9", "THE"]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, say(rng.choice([1, 2, 9, 10, 11, 30]))) for i in range(15)] + [(15, None), (16, ""), (17, "..."), (3, say(12)), (2, "the the the")]
    docs = [(i, say(60) + ". " + rng.choice(items)[1:][0].__str__().upper() + "! " + say(5)) for i in range(30)]
    docs += [(i, t) for i, t in ODD] + [(50, "the, THE\nthe the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("n_hit", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit("clash"))
    got = decontam.decontaminate(df, bench, broadcast_windows=broadcast).collect()
    assert sorted([tuple(r) for r in got], key=repr) == search(docs, items)
    left = decontam.drop_contaminated(df, bench, broadcast_windows=broadcast)
    assert left.columns == df.columns
    assert sorted([r.doc_id for r in left.collect()], key=repr) == sorted([r[0] for r in search(docs, items) if not r[5]], key=repr)
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


# --- op10 -----------------------------------------------------------------------

def test_best_fit_decreasing_against_a_plain_list():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(0, 80))]
        bins, placed = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = min(((r, b) for b, r in enumerate(bins) if r >= sizes[i]), default=None)
            if fit is None:
                bins.append(60)
                fit = (60, len(bins) - 1)
            bins[fit[1]] -= sizes[i]
            placed[i] = fit[1]
        assert sharding.best_fit_decreasing(sizes, 60) == placed


def test_shards(spark, odd):
    got = sharding.shard_documents(odd, n_shards=3).collect()
    assert len(got) == len(ODD)
    texts = {}
    for r in got:
        texts.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(odd.limit(0), n_shards=3).count() == 0
    few = sharding.shard_documents(odd, capacity=200_000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(few) == 1 and few[0].n <= 200_000
    with pytest.raises(ValueError):
        sharding.shard_documents(odd, capacity=1000)


def test_shard_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = QUERIES["op10_shard_best_fit_decreasing"](spark, SF2).toPandas()
    assert len(got) == len(docs) and set(got.shard) == set(range(8)) and set(got.law) == {"bytes"}

    assert all(len(docs[d]) + 1 == s and zlib.crc32(docs[d]) == c for d, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    total = got.groupby("shard")["size"].sum()
    assert total.max() - total.min() < 0.001 * total.mean()


# --- op9 ------------------------------------------------------------------------

def test_token_histogram(spark, odd):
    enc = token_counts._encoding(token_counts.default_vocabulary())
    lengths = [len(enc.encode_ordinary(t or "")) for _, t in ODD]
    s = token_counts.with_suffix_sums(token_counts.length_histogram(odd))
    rows = {r.n_tokens: r for r in s.collect()}
    assert {n: r.n_docs for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.docs_at_most == sum(x <= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.tokens_if_truncated == sum(min(x, n) for x in lengths)
    assert token_counts.truncated_totals(s, [0, 3, 10**6]) == {x: sum(min(n, x) for n in lengths) for x in (0, 3, 10**6)}
    assert token_counts.quantiles(s, [0.0, 0.5, 1.0]) == {0.0: 0, 0.5: sorted(lengths)[3], 1.0: max(lengths)}
    empty = token_counts.with_suffix_sums(token_counts.length_histogram(odd.limit(0)))
    assert empty.count() == 0 and token_counts.quantiles(empty, [0.5]) == {0.5: None}


# --- op4 ------------------------------------------------------------------------

def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_word_encoder_gives_the_tokenizers_ids():
    encode = packing.WordEncoder(packing.default_tokenizer())
    odd = ["don't İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ é é x½y _a_ 's 'll <|endoftext|> hi", "áb c\x1cd  e f 123abc,.;! ...,a \x00 b\tc\r\nd 你好世界 😀👍 ﬁ ŉ ǰ",
           " ", "\n\n", "ʼn!!", "Ⅷ ² ½,", "naïve, naïve,", "don’t ’s ‘tis", "A" * 5000, "ǅ ẞ ﬀ. é, á. Å", ",", "..", "İ i̇"]
    for text in odd * 2:
        assert encode(text) == np.array(plain_ids(text), "<u4").tobytes(), text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rng = random.Random(6)
    for caps in [(100, 100, 10_000), (100, 4, 10_000), (100, 100, 5_000)]:
        histogram = Counter(rng.randrange(1, 71) for _ in range(500))
        n, intervals = packing.best_fit(histogram, caps, rule=rule)
        load, seen = {}, Counter()
        for length, a, b, first, per, offset in intervals:
            for r in range(a, b):
                seq = load.setdefault(first + (r - a) // per, [])
                seq.append((offset + (r - a) % per * length, length))
                seen[length] += 1
        assert seen == histogram and len(load) == n
        for seq in load.values():
            seq.sort()
            assert [o for o, _ in seq] == [sum(x for _, x in seq[:i]) for i in range(len(seq))]
            assert sum(x for _, x in seq) <= caps[0] and len(seq) <= caps[1] and sum(x * x for _, x in seq) <= caps[2]
    assert packing.best_fit({}, (10, 10, 100)) == (0, [])
    with pytest.raises(ValueError):
        packing.best_fit({11: 1}, (10, 10, 100))


def test_packed_ids_round_trip(spark, odd):
    packed = packing.pack(odd, capacity=64, with_ids=True)
    pieces = packed.orderBy("doc_id", "piece").collect()
    for doc, text in ODD:
        own = [p for p in pieces if p.doc_id == doc]
        want = np.array([*plain_ids(text), 0])
        ids = [i for p in own for i in p.ids]
        assert ids == list(want) or doc == 4 and sorted(ids) == sorted(list(want) * 2)
        for p in own:
            assert zlib.crc32(want[p.start:p.start + p.length].astype("<u4").tobytes()) == p.ids_crc32
    full = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for p in pieces:
        assert full[p.sequence_id][p.offset:p.offset + p.length] == p.ids
    assert all(len(x) <= 64 for x in full.values()) and sum(map(len, full.values())) == sum(p.length for p in pieces)
    assert packing.pack(odd.limit(0)).count() == 0


def test_pack_query(spark):
    got = QUERIES["op4_pack_best_fit"](spark, SF2).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.01
    for doc in spark.read.parquet(f"{SF2}/documents.parquet").where("doc_id % 37 = 0").collect():
        own, want = got[got.doc_id == doc.doc_id].sort_values("piece"), [*plain_ids(doc.text), 0]
        assert own.length.sum() == len(want) and list(own.length[:-1]) == [2048] * (len(own) - 1)
        assert list(own.ids_crc32) == [zlib.crc32(np.array(want[s:s + 2048], "<u4").tobytes()) for s in range(0, len(want), 2048)]


# --- op7 ------------------------------------------------------------------------

def test_knn_ties_copies_and_odd_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, -0.3]) for _ in range(4)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)] + [(500, None), (550, [0.1, None]), (600, [float("nan")] * 4), (650, [float("inf")] * 4),
                                                                  (None, [1.0] * 4), (700, [0.5]), (750, []), (0, [9.0] * 4), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    vectors = knn.quantized(df)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(vectors, vectors.where("id % 50 = 0"), pivots=16).collect()}
    data = {r.id: r.v for r in vectors.collect()}
    assert set(data) == set(range(420)) | {700, 750}
    want = {}
    for q in (i for i in data if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(data[q], v)), i) for i, v in data.items() if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores, 1)}
    assert got == want
    assert knn.top_k(vectors.limit(0), vectors).count() == 0
    alone = vectors.where("id = 0")
    assert knn.top_k(alone, alone).count() == 0


# --- op3, op6 -----------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, odd):
    got = QUERIES["op3_quality_classifier"](spark, SF2).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, known)
    scored = quality.add_scores(odd, model, out="quality").collect()
    assert len(scored) == len(ODD) and all(0 <= r.quality <= 1 for r in scored)
    assert len({r.quality for r in scored if r.text == "Same text, twice."}) == 1
    assert quality.add_scores(odd.limit(0), model, out="quality").count() == 0
    assert {r.quality for r in quality.add_scores(odd, quality.fit(docs, known.limit(0)), out="quality").collect()} == {0.5}
    one = quality.add_scores(odd, quality.fit(docs, known.where("quality = 1")), out="quality").agg(F.min("quality")).first()[0]
    assert one > 0.99
    with pytest.raises(ValueError):
        quality.add_scores(odd, model)  # "score" is taken


def test_language_on_held_out_rows(spark, odd):
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SF2).collect()}
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = docs.collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    model = language.fit(docs)
    assert sorted(x for f in model.families for x in f) == ["de", "en", "es", "fr"] and len(model.families) == 2
    named = language.add_languages(odd.drop("score"), model).collect()
    assert len(named) == len(ODD) and all(0 <= r.score <= 1 for r in named)
    assert all((r.lang_pred == "und") == (not r.text) for r in named)
    digits = spark.createDataFrame([(1, "12 34 !?")], "doc_id long, text string")
    assert language.add_languages(digits, model).first().lang_pred == "und"
    assert language.add_languages(odd.drop("score").limit(0), model).count() == 0
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.add_languages(odd.drop("score"), none).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'fr'"))
    assert language.add_languages(docs.limit(3), one, score="s").first().lang_pred == "fr"


# --- queries with SQL ---------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].values.tolist()), key=repr) == sorted(map(tuple, want[cols].values.tolist()), key=repr)


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
