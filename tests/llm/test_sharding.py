"""Best-fit decreasing on a size histogram against one group at a time."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tablelens.llm import sharding as sh
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(sizes, capacity):
    """Loads and shard of each size: largest first, into the tightest shard that holds it."""
    left, placed = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, s) for s, r in enumerate(left) if r >= sizes[i]]
        if fits:
            shard = min(fits)[1]
        else:
            shard = len(left)
            left.append(capacity)
        left[shard] -= sizes[i]
        placed[i] = shard
    return [capacity - r for r in left], [placed[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(30))
def test_histogram_gives_the_plain_placement(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 60), 7, 13, 1]) for _ in range(rng.randint(1, 200))]
    capacity = rng.randint(60, 150)
    loads, placed = plain(sizes, capacity)
    found = sh.best_fit_decreasing(sizes, capacity)
    got = Counter()
    for s, shard in zip(sizes, found):
        got[shard] += s
    assert found == placed and [got[i] for i in range(len(loads))] == loads
    assert sh.best_fit_decreasing(sizes, capacity, len(loads)) == placed and sh.best_fit_decreasing(sizes, capacity, len(loads) - 1) is None
    assert sh.best_fit_decreasing(sizes, max(sizes) - 1) is None


def test_work_grows_with_the_sizes_not_with_the_groups():
    intervals = sh.best_fit_intervals({3: 10**9, 5: 10**8 + 1, 1000: 7}, 10**7)
    assert len(intervals) < 20
    held = Counter()
    for size, rank, end, _, _ in intervals:
        held[size] += end - rank
    assert held == {3: 10**9, 5: 10**8 + 1, 1000: 7}


def test_query_packs_every_group_by_its_size(spark):
    """The query's loads are those of plain best fit at the capacity it found; equal texts share a shard."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op10_shard_best_fit_decreasing"](spark, SF).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    groups, shards, slots, loads = Counter(), defaultdict(set), defaultdict(list), Counter()
    for d in docs:
        data, r = (d.text or "").encode(), got[d.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        groups[data] += len(data) + 1
        shards[data].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in shards.values()) and set(shards[b""] | {0}) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = list(groups.values())
    capacity, _ = sh.least_capacity(Counter(sizes), 8)
    want, _ = plain(sizes, capacity)
    assert sorted(loads.values()) == sorted(want) and max(loads.values()) - min(loads.values()) < 0.001 * capacity


def test_groups_beyond_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(200)] + [(i, "hot") for i in range(200, 400)], "doc_id long, text string")
    want = sorted(tuple(r) for r in sh.shard_documents(df, n_shards=3).collect())
    real = sh.checked_broadcast
    monkeypatch.setattr(sh, "checked_broadcast", lambda x: real(x, 0))
    assert sorted(tuple(r) for r in sh.shard_documents(df, n_shards=3).collect()) == want
