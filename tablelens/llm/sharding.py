"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form one group, which stays whole.  Groups, largest
first, enter the shard with the tightest remaining capacity that still holds
them; remaining capacities are kept in a balanced tree.

Scale: groups of one size are interchangeable, so best fit runs on the exact
histogram of group sizes.  A shard takes as many groups of a size as fit before
the next one is looked at (what is left only gets tighter), so a size costs a
few steps, not one a group.  D different sizes add up to at least D * D / 2
bytes, so the driver holds at most the square root of twice the input's bytes,
in practice some ten thousand.  What leaves it is a list of intervals ("groups
of this size with rank a to b go to these shards"); Spark sums the groups,
ranks those of each size and looks each rank up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.names import plain
from tablelens.llm.ranks import gapless_rank
from tablelens.session import checked_broadcast, materialize

Interval = tuple[int, int, int, int, int]  # size, first rank, end rank, first shard, groups a shard


class _Node:
    __slots__ = ("key", "priority", "left", "right")

    def __init__(self, key, priority):
        self.key, self.priority, self.left, self.right = key, priority, None, None


class RemainingTree:
    """A treap of ``(remaining, shard)`` keys: insert, and take the least key not below a bound."""

    def __init__(self):
        self._root = None

    @staticmethod
    def _priority(key) -> bytes:
        return hashlib.blake2b(repr(key).encode(), digest_size=8).digest()

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, key) -> None:
        below, above = self._split(self._root, key)
        self._root = self._merge(self._merge(below, _Node(key, self._priority(key))), above)

    def take_tightest(self, size):
        """Remove and return the least ``(remaining, shard)`` with remaining >= size, or None."""
        below, above = self._split(self._root, (size, -1))
        if above is None:
            self._root = below
            return None
        parent, node = None, above
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            above = node.right
        else:
            parent.left = node.right
        self._root = self._merge(below, above)
        return node.key


def best_fit_intervals(histogram: dict[int, int], capacity: int, most: int | None = None) -> list[Interval] | None:
    """Best-fit decreasing of ``histogram`` (group size -> groups): rank r of a
    size goes to shard ``first + (r - first_rank) // per``.

    Of equally tight shards the lowest number is filled first.  None if more
    than ``most`` shards would be needed or a size exceeds the capacity.
    """
    tree, alike, shards, out = RemainingTree(), {}, 0, []

    def put(remaining, first, number):
        if remaining and number:
            alike[remaining, first] = number
            tree.insert((remaining, first))

    for size in sorted(histogram, reverse=True):
        count, rank = histogram[size], 0
        if size > capacity:
            return None
        while count:
            found = tree.take_tightest(size)
            if found is None:
                number = -(-count // (capacity // size))
                if most is not None and shards + number > most:
                    return None
                found, shards = (capacity, shards), shards + number
            else:
                number = alike.pop(found)
            remaining, first = found
            per = remaining // size
            for each, n in ((per, min(number, count // per)), (count % per, 1)):
                if not n or not each or not number or not count or (each < per and count >= per):
                    continue
                out.append((size, rank, rank + each * n, first, each))
                put(remaining - each * size, first, n)
                rank, count, first, number = rank + each * n, count - each * n, first + n, number - n
            put(remaining, first, number)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Shard number of each size; every shard holds at most ``capacity``.  Equal sizes are dealt in the given order."""
    places: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        places.setdefault(size, []).append(i)
    found = best_fit_intervals({s: len(p) for s, p in places.items()}, capacity, most)
    if found is None:
        return None
    placed = [0] * len(sizes)
    for size, rank, end, first, per in found:
        for r in range(rank, end):
            placed[places[size][r]] = first + (r - rank) // per
    return placed


def least_capacity(histogram: dict[int, int], shards: int) -> tuple[int, list[Interval]]:
    """The smallest capacity found by bisection at which ``shards`` shards suffice, with the placement."""
    if not histogram:
        return 0, []
    low = max(-(-sum(s * n for s, n in histogram.items()) // shards), max(histogram))
    high = low
    while (placed := best_fit_intervals(histogram, high, shards)) is None:
        high += max(1, (high - low) or low // 1000)
    best, low = (high, placed), low - 1
    while high - low > 1 and high - low > high // 1_000_000:
        middle = (low + high) // 2
        if (placed := best_fit_intervals(histogram, middle, shards)) is None:
            low = middle
        else:
            high, best = middle, (middle, placed)
    return best


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(plain(text_col), F.lit(""))
    return docs.select(
        plain(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def _placed(groups: DataFrame, intervals: list[Interval], n_groups: int) -> DataFrame:
    """(digest, shard) of every group: its rank among the groups of its size, looked up."""
    table = np.array(sorted(intervals), np.int64).reshape(-1, 5)
    sizes = np.unique(table[:, 0])
    low, high = np.searchsorted(table[:, 0], sizes), np.searchsorted(table[:, 0], sizes, "right")
    most = int(table[:, 2].max(initial=0)) + 1

    def place(batches):
        for batch in batches:
            size, rank = batch.column("bytes").to_numpy(), batch.column("rank").to_numpy()
            nth = np.searchsorted(sizes, size)
            if (high - low).max(initial=0) > 1:  # sizes in several intervals: by (number of the size, rank)
                edges = np.repeat(np.arange(len(sizes)), high - low) * most + table[:, 1]
                row = table[np.searchsorted(edges, nth * most + rank, "right") - 1]
            else:
                row = table[low[nth]]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array((row[:, 3] + (rank - row[:, 1]) // row[:, 4]).astype(np.int32))], names=["digest", "shard"])

    ranked = gapless_rank(groups, ["bytes"], F.col("digest"), [F.col("digest")], n_groups, "rank")
    return ranked.select("digest", "bytes", "rank").mapInArrow(place, "digest binary, shard int")


def shard_documents(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows into shards: ``id_col``, size, text_crc32, shard, slot (gapless from 0 in a shard).

    Give ``capacity`` (bytes) for as few shards of that capacity as best-fit
    decreasing finds, or ``n_shards`` for that many shards of the smallest
    capacity that suffices, so that their bytes are nearly equal.  A row's
    size is the UTF-8 length of its text plus 1.  Equal texts share a shard;
    null and empty texts count as equal.  Repeated rows each get a slot; ties
    are ordered by id.  An empty table gives no rows.  Other columns are
    ignored.  A group larger than ``capacity`` raises ValueError; with
    ``n_shards`` the largest group sets the least capacity.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    rows = materialize(_sized(docs, id_col, text_col))
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    found = groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()  # a row a size, see the bound above
    histogram = {r["bytes"]: r["n"] for r in found}
    if n_shards:
        intervals = least_capacity(histogram, n_shards)[1]
    elif (intervals := best_fit_intervals(histogram, capacity)) is None:
        raise ValueError("a group of equal texts is larger than the capacity")
    placed, _ = checked_broadcast(_placed(groups, intervals, sum(histogram.values())))
    dealt = rows.join(placed, "digest").select("id", "size", "text_crc32", "shard")
    n_rows = rows.count()
    salt = F.struct("id", "text_crc32")
    ranked = gapless_rank(dealt, ["shard"], salt, [F.col("id"), F.col("text_crc32")], n_rows, "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
