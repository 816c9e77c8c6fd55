"""Near-duplicate classes: BagMinHash signatures, banding, exact multiset overlap.

Similarity is the weighted Jaccard index of the multisets of five-word
shingles, sum(min counts) / sum(max counts).

*Signatures.*  Each shingle owns, for every dyadic block [0,1), [1,2), [2,4),
[4,8), ... of its discretised weight, a Poisson process of points whose rate
is the block's size; a point has a time, a register and a level inside the
block, all drawn from a hash.  A text with ``w`` copies of the shingle sees the
points whose level lies below ``w``.  A register holds the earliest time it
sees, so two texts agree there with probability equal to their similarity.
Points come in order of time and are drawn only up to a limit at which all
registers are almost surely filled (a text with an empty register is drawn
again with twice the limit); so a text costs its distinct shingles plus a
number of points that does not depend on its length.

*Classes.*  Texts with the same word sequence are one node.  Nodes that share
a band form a bucket.  First every member is verified against its bucket's
first member (one link joins it to the class; the other pairs of a class are
redundant).  Buckets whose members are still in several classes are open:
there, members outside the first class are compared with all members of other
classes, block by block, by signature and then exactly; only links leave the
task.  So no link between nodes of one bucket is lost, and a group of near
copies costs one verification a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.components import components
from tablelens.llm.features import buffers
from tablelens.llm.names import fresh, plain
from tablelens.llm.shingles import WORDS, counted, mixed, shingles, words_digest
from tablelens.llm.worker import free, slices
from tablelens.session import checked_broadcast, materialize

THRESHOLD = 0.8
BANDS, ROWS = 20, 4  # a pair at 0.8 shares no band with probability 3e-5
REGISTERS = 160  # the first BANDS * ROWS are banded; all of them estimate
DEVIATIONS = 4.5  # margin of the estimate, in standard deviations at the threshold
BLOCK = 1024
DRAWN_AT_ONCE = 500_000  # points
BROADCAST_ROWS = 1_000_000  # of 24 bytes and an id each


def bag_times(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest time in every register: texts x registers (inf for a text without shingles)."""
    weight = np.bincount(text, weights=count, minlength=texts)
    out = np.full((texts, registers), np.inf)
    limit = np.where(weight > 0, (np.log(registers) + 8) / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        mine = todo[text]
        _draw(out, text[mine], shingle[mine], count[mine], limit)
        todo &= ~np.isfinite(out).all(axis=1)
        limit *= 2
    return out


def _draw(out: np.ndarray, text: np.ndarray, shingle: np.ndarray, count: np.ndarray, limit: np.ndarray) -> None:
    registers = out.shape[1]
    blocks = np.where(count > 1, 1 + np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64), 1)
    again = np.repeat(np.arange(len(text)), blocks)
    block = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    text, weight = text[again], count[again].astype(np.float64)
    start = np.where(block > 0, 2.0 ** (block - 1), 0.0)
    size = np.maximum(start, 1.0)
    name = mixed(shingle[again] + np.uint64(0x632BE59BD9B4E019) * block.astype(np.uint64))
    time, drawn, flat = np.zeros(len(text)), 0, out.reshape(-1)
    while len(text):
        step = min(32, max(2, drawn), max(1, DRAWN_AT_ONCE // len(text)))
        number = np.arange(drawn, drawn + step, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        random = mixed(name[:, None] + number[None, :])
        wait = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * size)[:, None]
        wait[:, 0] += time
        at = np.cumsum(wait, axis=1)
        row, column = np.nonzero(at <= limit[text][:, None])
        point = mixed(random[row, column] + np.uint64(0x8CB92BA72F3D8DD7))
        level = start[row] + (point & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size[row]
        seen = level < weight[row]
        register = ((point >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, (text[row] * registers + register)[seen], at[row, column][seen])
        go_on = at[:, -1] <= limit[text]
        time, drawn = at[go_on, -1], drawn + step
        text, name, size, start, weight = text[go_on], name[go_on], size[go_on], start[go_on], weight[go_on]


def signatures(times: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (int64) and one byte of every register."""
    bits = mixed(times.view(np.uint64))
    hashes = np.zeros((len(times), bands), np.uint64)
    for j in range(rows):
        hashes = mixed(hashes * np.uint64(3) + bits[:, j:bands * rows:rows])
    return hashes.view(np.int64), (bits & np.uint64(255)).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures that are one byte a register."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def least_estimate(threshold: float) -> float:
    return threshold - DEVIATIONS * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Exact weighted Jaccard index of each pair of texts."""
    sides = []
    for texts in (left, right):
        parts = []
        for first, data, starts, ends in buffers(texts):
            text, shingle, count = counted(*shingles(data, starts, ends))
            parts.append((text + first, shingle, count))
        sides.append([np.concatenate(x) for x in zip(*parts)])
    total = sum(np.bincount(s[0], weights=s[2], minlength=len(left)) for s in sides)
    text, shingle, count = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((shingle, text))
    text, shingle, count = text[order], shingle[order], count[order]
    twin = np.flatnonzero((text[1:] == text[:-1]) & (shingle[1:] == shingle[:-1]))
    common = np.bincount(text[twin], weights=np.minimum(count[twin], count[twin + 1]), minlength=len(left))
    return common / np.maximum(total - common, 1)


def _signed(base: DataFrame) -> DataFrame:
    id_type = base.schema["__id"].dataType.simpleString()

    def sign(batches):
        free()
        for batch in slices(batches):
            column = batch.column("__text")
            nodes, weights, bands, bytes_ = [], [], [], []
            for _, data, starts, ends in buffers(column.to_pylist()):
                text, shingle, count = counted(*shingles(data, starts, ends))
                hashes, small = signatures(bag_times(text, shingle, count, len(starts)))
                weights.append(np.bincount(text, weights=count, minlength=len(starts)).astype(np.int64))
                nodes += [words_digest(data, s, e) for s, e in zip(starts, ends)]
                bands.append(hashes)
                bytes_ += [row.tobytes() for row in small]
            flat = np.concatenate(bands).reshape(-1) if bands else np.zeros(0, np.int64)
            offsets = np.arange(0, len(nodes) * BANDS + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__h"), pa.array(nodes, pa.binary()),
                 pa.array(np.concatenate(weights) if weights else np.zeros(0, np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bytes_, pa.binary())],
                names=["__id", "__h", "node", "weight", "bands", "sig"])

    return base.mapInArrow(sign, f"__id {id_type}, __h long, node binary, weight long, bands array<long>, sig binary")


def _may_reach(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("weight").alias(f"{x}w"), F.col("sig").alias(f"{x}s"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    joined = joined.where(F.least("aw", "bw") >= F.lit(threshold) * F.greatest("aw", "bw"))
    least = least_estimate(threshold)

    def keep(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("as", "bs"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b) >= least))

    return joined.select("a", "b", "as", "bs").mapInArrow(keep, "a binary, b binary")


def _texts_of(named: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """(node, __text) of the named nodes.  Few enough of them are broadcast, so that no other text moves."""
    wanted, _ = checked_broadcast(named.join(nodes.select("node", "rep"), "node").select(
        "node", F.col("rep.__id").alias("__rep_id"), F.col("rep.__h").alias("__rep_h")), BROADCAST_ROWS)
    texts = base.join(wanted, F.col("__id").eqNullSafe(F.col("__rep_id")) & (F.col("__h") == F.col("__rep_h")))
    return materialize(texts.select("node", "__text").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, nodes: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold exactly."""
    pairs = materialize(pairs)
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, base)
    side = lambda x: texts.select(F.col("node").alias(x), F.col("__text").alias(f"{x}t"))

    def check(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                found = overlaps(piece.column("at").to_pylist(), piece.column("bt").to_pylist())
                yield piece.select(["a", "b"]).filter(pa.array(found >= threshold - 1e-12))

    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "at", "bt")
                       .mapInArrow(check, "a binary, b binary"))


def _candidates(left: dict, right: dict, threshold: float, least: float):
    """(i, partners) for every row of ``left``: rows of ``right`` in another
    class that may reach the threshold, met here for the first time."""
    for i in range(len(left["node"])):
        low, high = np.minimum(right["weight"], left["weight"][i]), np.maximum(right["weight"], left["weight"][i])
        fits = (low >= threshold * high) & (right["root"] != left["root"][i])
        fits &= ~right["odd"] | (right["node"] > left["node"][i])  # two such rows meet from both sides
        j = np.flatnonzero(fits)
        j = j[(right["bands"][j] == left["bands"][i]).argmax(axis=1) == left["band"]]  # in the first band they share
        j = j[estimate(right["sig"][j], left["sig"][i]) >= least]
        if len(j):
            yield i, j


def _side(table: pa.Table) -> dict:
    n = table.num_rows
    out = {c: np.array(table.column(c).to_pylist(), object) for c in ("node", "root")}
    out |= {c: table.column(c).to_numpy() for c in ("weight", "odd")}
    out["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, REGISTERS)
    out["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, BANDS)
    return out | {"band": table.column("band")[0].as_py()}


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, shingles (sorted in each text) and counts of all texts."""
    parts = [(counted(*shingles(d, s, e)), first) for first, d, s, e in buffers(texts)]
    text, shingle, count = (np.concatenate([p[i] + (first if i == 0 else 0) for p, first in parts]) for i in range(3))
    return np.searchsorted(text, np.arange(len(texts) + 1)), shingle, count


def _copies(rows: DataFrame) -> DataFrame:
    """Every row once for each block (``mine``) of its bucket that holds an odd row, with its own block as ``other``."""
    seekers = rows.where("odd").groupBy("band", "hash").agg(F.collect_set("block").alias("seekers"))  # n / BLOCK numbers at most
    return rows.join(seekers, ["band", "hash"]).withColumn("other", F.col("block")).withColumn("mine", F.explode("seekers"))


def _across_classes(shared: DataFrame, roots: DataFrame, nodes: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    """Verified links between different classes that share a bucket.

    In an open bucket, rows outside its leader's class meet all rows, block
    by block.  A first round compares signatures and names the rows that have
    a possible partner there; the second brings these rows' texts to the same
    blocks and compares exactly.  Pairs that fail never leave their task.
    """
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first_root = roots.select(F.col("node").alias("leader"), F.col("root").alias("main"))
    state = (
        placed.groupBy("band", "hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"),
                                           F.first("leader").alias("leader"))
        .where(F.col("lo") != F.col("hi")).join(first_root, "leader", "left")
        .select("band", "hash", "n", F.coalesce("main", "leader").alias("main"))
    )
    rows = placed.drop("leader").join(state, ["band", "hash"]).join(nodes.select("node", "weight", "bands", "sig"), "node")
    rows = materialize(rows.select(
        *rows.columns, (F.col("root") != F.col("main")).alias("odd"),
        F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK).cast("long")).alias("block")).drop("main"))
    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK).cast("long") - 1)
    keys, detail = ["band", "hash", "mine", "other"], ["node", "root", "weight", "bands", "sig", "odd"]
    odd = rows.where("odd").withColumn("mine", F.col("block")).withColumn("other", F.explode(blocks)).select(*keys, *detail)
    every = _copies(rows).select(*[F.col(c).alias(c) for c in (*keys, *detail)])  # columns of their own
    least = least_estimate(threshold)

    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, others = [], np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            for i, j in _candidates(_side(left), _side(right), threshold, least):
                mine.append(i)
                others[j] = True
        parts = [(left, np.array(mine, np.int64), True), (right, np.flatnonzero(others), False)]
        return pa.concat_tables([t.select([*keys, *detail]).take(pa.array(at)).append_column("left", pa.array([side] * len(at), pa.bool_()))
                                 for t, at, side in parts])

    fields = {f.name: f.dataType.simpleString() for f in odd.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in [*keys, *detail]) + ", left boolean"
    named = materialize(odd.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(name, schema))
    texts = _texts_of(named.select("node").distinct(), nodes, base)
    full = named.join(texts, "node").select(*keys, *detail, "left", F.col("__text").alias("text"))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        a_out, b_out = [], []
        if left.num_rows and right.num_rows:
            a, b = _side(left), _side(right)
            start_a, shingle_a, count_a = _bags(left.column("text").to_pylist())
            start_b, shingle_b, count_b = _bags(right.column("text").to_pylist())
            for i, j in _candidates(a, b, threshold, least):
                own, times = shingle_a[start_a[i]:start_a[i + 1]], count_a[start_a[i]:start_a[i + 1]]
                for at in range(0, len(j), 256):
                    some = j[at:at + 256]
                    size = start_b[some + 1] - start_b[some]
                    flat = np.arange(size.sum()) + np.repeat(start_b[some] - np.cumsum(size) + size, size)
                    place = np.minimum(np.searchsorted(own, shingle_b[flat]), len(own) - 1)
                    both = np.where(own[place] == shingle_b[flat], np.minimum(times[place], count_b[flat]), 0)
                    common = np.bincount(np.repeat(np.arange(len(some)), size), weights=both, minlength=len(some))
                    linked = some[common >= (threshold - 1e-12) * (a["weight"][i] + b["weight"][some] - common)]
                    a_out += [a["node"][i]] * len(linked)
                    b_out += list(b["node"][linked])
        return pa.table([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], names=["a", "b"])

    one, two = ([F.col(c).alias(c) for c in [*keys, *detail, "text"]] for _ in range(2))  # columns of their own on each side
    lefts, rights = full.where("left").select(*one), full.where(~F.col("left")).select(*two)
    return materialize(lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(verify, "a binary, b binary"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``__id``, ``__h`` (hash of the text), class_id,
    class_size (rows) and kept (the least id of the class; ties by text hash).

    ``class_id`` is the least id of all rows that are joined by links of at
    least ``threshold``.  Texts with equal word sequences, and equal texts
    without words, are always in one class; null and empty texts count as
    equal.  Texts of fewer than five words have one shingle.  Repeated rows
    are all in one class (rows that repeat id and text are all ``kept`` or
    none is).  An empty table gives no rows.  Other columns are ignored.
    """
    base = docs.select(plain(id_col).alias("__id"), F.xxhash64(plain(text_col)).alias("__h"),
                       F.coalesce(plain(text_col), F.lit("")).alias("__text"))
    rows = materialize(_signed(base))
    nodes = materialize(rows.groupBy("node").agg(
        F.min(F.struct("__id", "__h")).alias("rep"), F.count("*").alias("copies"),
        F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    members = nodes.where(F.col("weight") > 0).select("node", "rep", F.posexplode("bands").alias("band", "hash"))
    leaders = (
        members.groupBy("band", "hash").agg(F.min(F.struct("rep", "node")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1).select("band", "hash", F.col("first.node").alias("leader"))
    )
    shared = materialize(members.join(leaders, ["band", "hash"]).select("node", "band", "hash", "leader"))
    stars = shared.where(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = _verified(_may_reach(stars, nodes, threshold), nodes, base, threshold)
    roots = materialize(components(links))
    more = _across_classes(shared, roots, nodes, base, threshold)
    if more.limit(1).count():
        roots = materialize(components(links.unionByName(more)))
    classed = nodes.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = materialize(classed)
    classes = classed.groupBy("root").agg(F.min("rep").alias("first"), F.sum("copies").alias("class_size"))
    of_node = classed.select("node", "root").join(classes, "root").drop("root")
    return rows.select("__id", "__h", "node").join(of_node, "node").select(
        "__id", "__h", F.col("first.__id").alias("class_id"), "class_size",
        (F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__h") == F.col("first.__h"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, with one row of each class left: its
    least id.  Of rows that repeat its id and text, any one stays."""
    classes = materialize(near_classes(docs, id_col, text_col, threshold).select("__id", "__h", "kept"))
    of_id, of_h, gone_id, gone_h = fresh(docs, "__id", "__h", "__gone_id", "__gone_h")
    gone = classes.where(~F.col("kept")).select(F.col("__id").alias(gone_id), F.col("__h").alias(gone_h)).distinct()
    gone, _ = checked_broadcast(gone, BROADCAST_ROWS)
    keyed = docs.withColumn(of_h, F.xxhash64(plain(text_col))).withColumn(of_id, plain(id_col))
    left = keyed.join(gone, F.col(of_id).eqNullSafe(F.col(gone_id)) & (F.col(of_h) == F.col(gone_h)), "left_anti")
    if classes.where("kept").groupBy("__id", "__h").agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count():
        left = left.dropDuplicates([of_id, of_h])
    return left.select(*map(plain, docs.columns))
