"""Exact substring dedup: sparse distributed prefix doubling.

A byte goes if it lies in a ``length``-byte string that also starts earlier
(smaller id, or the same document and an earlier start).  Suffix-array
prefix doubling would sort (rank, rank at offset h) pairs for *every* byte,
for h = 1, 2, 4, ...; here only sampled positions are sorted, and a position
leaves the race as soon as its rank is unique or its prefix reaches
``length``:

1. *Seeds.*  Every ``length``-byte window is represented by the ``seed``-byte
   string in it with the least hash (its minimizer; equal windows have equal
   minimizers at the same place).  Consecutive windows with the same minimizer
   form one run.  A run's first rank is its seed.
2. *Doubling.*  The second rank of a run is the pair of its seed and its whole
   string (``length`` to 2 * ``length`` - ``seed`` bytes around the seed).
   Spark deals runs by seed and sorts them by rank pair and position.  A run
   with the same pair as an earlier one is repeated entirely.  A run whose
   seed rank is unique is done: none of its windows occurs twice.
3. *Past the threshold.*  The first runs of different pairs that share a seed
   are ranked once more, window by window, at exactly ``length`` bytes, again
   dealt by seed and sorted.  Only these runs' bytes are shuffled.
4. Removed windows are united to byte ranges per document.

Ranks are named by 64-bit hashes (a pair by 114 bits), so that equal strings
get equal names in every task.  Seeds that a sample of documents shows to be
hot are dealt by pair in step 2 and by window in step 3, and each task first
collapses equal pairs and windows, so a string that a third of all documents
share is a few rows a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.features import prefix_sums, run_hashes
from tablelens.llm.shingles import mixed
from tablelens.llm.worker import free
from tablelens.session import materialize

LENGTH = 100
SEED = 32
STEP_BYTES = 1_000_000
SAMPLE_ROWS = 10_000
HOT_SHARE = 0.003
BROADCAST_ROWS = 1_000_000  # of an id and a hash each

_GEOMETRY = np.uint64(14)  # low bits of a packed seed: 7 for the seed's offset in the run, 7 for the run's windows


def _names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed(run_hashes(sums, start, end))


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of windows with one minimizer: (text number, first window, windows, packed seed, name)."""
    span = length - seed + 1
    count = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data)
    at = np.arange(len(data) - seed + 1)
    seeds = _names(sums, at, at + seed)
    least = (seeds & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties: leftmost
    wide = 1
    while wide * 2 <= span:
        least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
    rest = span - wide
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.flatnonzero(ends - starts >= length)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[text]] += 1
    edge[ends[text] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(edge)[:count])
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    mine = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    low, high = window[first], window[np.append(first[1:] - 1, len(window) - 1)]
    place, windows = mine[first], high - low + 1
    packed = (seeds[place] >> _GEOMETRY << _GEOMETRY) | ((place - low) << 7 | (windows - 1)).astype(np.uint64)
    owner = np.searchsorted(starts, low, "right") - 1
    return owner, low - starts[owner], windows, packed, _names(sums, low, high + length)


def _pieces(values: list[bytes], length: int):
    """(row numbers, byte offsets, joined bytes, starts, ends): texts in buffers of
    about STEP_BYTES, a longer text in pieces that overlap by ``length`` - 1 bytes."""
    rows, offsets, parts, total = [], [], [], 0

    def joined():
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        return np.array(rows), np.array(offsets), np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts, starts + sizes

    for i, value in enumerate(values):
        for at in range(0, max(1, len(value) - length + 1), STEP_BYTES):
            part = value[at:at + STEP_BYTES + length - 1]
            if parts and total + len(part) > STEP_BYTES:
                yield joined()
                rows, offsets, parts, total = [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            total += len(part) + 1
    if parts:
        yield joined()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("__text").cast(pa.binary()).to_pylist()


def _order(batch: pa.RecordBatch) -> np.ndarray:
    """Rank of each row of a batch by (id, text hash)."""
    table = pa.table({"id": batch.column("__id"), "h": batch.column("__h")})
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("h", "ascending")], null_placement="at_start")
    out = np.empty(batch.num_rows, np.int64)
    out[order.to_numpy()] = np.arange(batch.num_rows)
    return out


def _first_of(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each item is the first, by ``order``, of those with equal ``keys``."""
    sort = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.ones(len(sort), bool)
    if len(sort):
        new[1:] = np.logical_or.reduce([k[sort][1:] != k[sort][:-1] for k in keys])
    out = np.empty(len(sort), bool)
    out[sort] = new
    return out


def _batch_runs(batch: pa.RecordBatch, length: int):
    """All runs of a batch of documents: (row, start, windows, packed, name)."""
    found = []
    for rows, offsets, data, starts, ends in _pieces(_texts(batch), length):
        owner, start, windows, packed, name = runs_of(data, starts, ends, length)
        found.append((rows[owner], start + offsets[owner], windows, packed, name))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def _one_row_each(base: DataFrame) -> tuple[DataFrame, int]:
    """Documents without rows that repeat id and text, and their number."""
    rows, most = base.groupBy("__id", "__h").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    return (base if (most or 1) == 1 else base.dropDuplicates(["__id", "__h"])), rows


def _hot_seeds(base: DataFrame, rows: int, length: int) -> np.ndarray:
    """Packed seeds (without geometry) that occur in many documents of a bounded sample; sorted."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = base.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def seeds(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, _, _, packed, _ = _batch_runs(batch, length)
            both = np.unique(np.stack([row.astype(np.uint64), packed >> _GEOMETRY << _GEOMETRY]), axis=1)
            found, count = np.unique(both[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count)], names=["seed", "n"])

    least = max(4, int(HOT_SHARE * share * rows))  # a seed is counted once a document, so this bounds the list
    hot = sample.mapInArrow(seeds, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["seed"] for r in hot.select("seed").collect()], np.int64).view(np.uint64))


def _is_hot(packed: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(packed), bool)
    seed = packed >> _GEOMETRY << _GEOMETRY
    return hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed


def _ranked_runs(base: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """Step 2: per run that is repeated (``kind`` 0: bytes start to end go) or
    must be ranked by window (``kind`` 1: a run of its seed), one row."""
    id_type = base.schema["__id"].dataType.simpleString()

    def cut(batches):
        free()
        for batch in batches:
            if not batch.num_rows:
                continue
            row, start, windows, packed, name = _batch_runs(batch, length)
            order = _order(batch)[row]
            first = _first_of((packed, name), (order, start))
            # A run that repeats an earlier one of this batch needs no rank from others: its deal number says so.
            deal = mixed(packed >> _GEOMETRY)
            hot_run = _is_hot(packed, hot)
            deal[hot_run] = mixed(deal[hot_run] ^ name[hot_run])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(first, deal, mixed(order.astype(np.uint64))).view(np.int64)),
                 pa.array(packed.view(np.int64)), pa.array(name.view(np.int64)),
                 batch.column("__id").take(pa.array(row)), batch.column("__h").take(pa.array(row)),
                 pa.array(start.astype(np.int32)), pa.array(first)],
                names=["deal", "packed", "name", "__id", "__h", "start", "first"])

    def rank(batches):
        last = None  # (seed, packed, name, told, several) of the last run, and its row if it waits
        for batch in batches:
            local = batch.filter(pc.invert(batch.column("first")))
            if local.num_rows:
                yield _told(local, np.zeros(local.num_rows, np.int32))
            batch = batch.filter(batch.column("first"))
            if not batch.num_rows:
                continue
            told = np.zeros(batch.num_rows, bool)
            several_before = False
            if last is not None:
                batch = pa.Table.from_batches([last[0], batch]).combine_chunks().to_batches()[0]
                told = np.concatenate([[last[1]], told])
                several_before = last[2]
            packed = batch.column("packed").to_numpy().view(np.uint64)
            name = batch.column("name").to_numpy()
            seed = packed >> _GEOMETRY
            new_seed = np.ones(len(seed), bool)
            new_seed[1:] = seed[1:] != seed[:-1]
            new_pair = new_seed.copy()
            new_pair[1:] |= (packed[1:] != packed[:-1]) | (name[1:] != name[:-1])
            group = np.cumsum(new_seed) - 1
            several = np.bincount(group, weights=new_pair) > 1
            several[0] |= several_before
            several_of = several[group] | _is_hot(packed, hot)
            out = np.where(~new_pair, 0, np.where(several_of, 1, -1))
            out[told] = -1
            ends = len(out) - 1
            keep = ends if several_of[ends] else np.flatnonzero(new_pair)[-1]  # a lone pair waits for a second one
            emit = np.flatnonzero(out >= 0)
            if len(emit):
                yield _told(batch.take(pa.array(emit)), out[emit].astype(np.int32))
            last = (batch.slice(int(keep), 1), bool(several_of[ends]), bool(several[group[ends]]))

    def _told(batch, kind):
        packed = batch.column("packed").to_numpy().view(np.uint64)
        start = batch.column("start").to_numpy()
        windows = (packed & np.uint64(127)).astype(np.int32) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(kind), batch.column("packed"), batch.column("__id"), batch.column("__h"), pa.array(start),
             pa.array(start + windows + np.int32(length - 1))], names=["kind", "packed", "__id", "__h", "start", "end"])

    runs = base.mapInArrow(cut, f"deal long, packed long, name long, __id {id_type}, __h long, start int, first boolean")
    dealt = runs.repartition("deal").sortWithinPartitions(F.shiftrightunsigned("packed", 14), "packed", "name", "__id", "__h", "start")
    return dealt.mapInArrow(rank, f"kind int, packed long, __id {id_type}, __h long, start int, end int")


def _ranked_windows(base: DataFrame, lists: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """Step 3: byte ranges (__id, __h, start, end) of repeated windows in the runs of ``lists``."""
    id_type = base.schema["__id"].dataType.simpleString()
    fields = f"deal long, kind int, name long, __id {id_type}, __h long, start int, end int, bytes binary"

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, order = _texts(batch), _order(batch)
            runs = batch.column("runs")
            size = runs.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            flat = runs.flatten()
            packed = flat.field("packed").to_numpy(zero_copy_only=False).view(np.uint64)
            start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            text = [values[r][a:b] for r, a, b in zip(row, start, end)]
            hot_run = _is_hot(packed, hot)
            cold = np.flatnonzero(~hot_run)
            take = pa.array(row[cold])
            yield _rows((packed[cold] >> _GEOMETRY).view(np.int64), np.ones(len(cold)), (packed[cold] >> _GEOMETRY).view(np.int64),
                        batch.column("__id").take(take), batch.column("__h").take(take), start[cold], end[cold],
                        pa.array([text[i] for i in cold], pa.binary()))
            warm = np.flatnonzero(hot_run)
            if not len(warm):
                continue
            data = np.frombuffer(b"".join(text[i] for i in warm), np.uint8)
            count = end[warm] - start[warm] - length + 1
            run = np.repeat(warm, count)
            shift = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(end[warm] - start[warm]) - (end[warm] - start[warm]), count) + shift
            name = _names(prefix_sums(data), at, at + length)
            window = start[run] + shift
            first = _first_of((name,), (order[row[run]], window))
            take = pa.array(row[run])
            yield _rows(name.view(np.int64), np.where(first, 2, 0), name.view(np.int64), batch.column("__id").take(take),
                        batch.column("__h").take(take), window, window + length, pa.nulls(len(run), pa.binary()))

    def _rows(deal, kind, name, ids, hashes, start, end, text):
        return pa.RecordBatch.from_arrays(
            [pa.array(deal), pa.array(np.asarray(kind, np.int32)), pa.array(name), ids, hashes, pa.array(start.astype(np.int32)),
             pa.array(end.astype(np.int32)), text], names=["deal", "kind", "name", "__id", "__h", "start", "end", "bytes"])

    def settle(table: pa.Table):
        """Ranges of repeated windows of whole groups; the table is sorted by name, then position."""
        kind = table.column("kind").to_numpy()
        start, end = table.column("start").to_numpy(), table.column("end").to_numpy()
        group = table.column("name").to_numpy()
        ready = np.flatnonzero(kind == 0)
        out = [(ready, start[ready], end[ready])]
        hot_row = np.flatnonzero(kind == 2)
        again = hot_row[~_first_of((group[hot_row],), (np.arange(len(hot_row)),))]
        out.append((again, start[again], end[again]))
        cold = np.flatnonzero(kind == 1)
        if len(cold):
            data = np.frombuffer(b"".join(table.column("bytes").take(pa.array(cold)).to_pylist()), np.uint8)
            size = (end - start)[cold].astype(np.int64)
            count = size - length + 1
            row = np.repeat(np.arange(len(cold)), count)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(size) - size, count) + shift
            name = _names(prefix_sums(data), at, at + length)
            gone = ~_first_of((group[cold][row], name), (np.arange(len(row)),))
            index = np.flatnonzero(gone)
            new = np.ones(len(index), bool)
            new[1:] = (row[index][1:] != row[index][:-1]) | (index[1:] != index[:-1] + 1)
            first = np.flatnonzero(new)
            after = np.append(first[1:], len(index)) - 1
            of = row[index[first]] if len(index) else np.zeros(0, np.int64)
            if len(index):
                out.append((cold[of], start[cold][of] + shift[index[first]], start[cold][of] + shift[index[after]] + length))
        row, low, high = (np.concatenate([o[i] for o in out]) for i in range(3))
        take = pa.array(row.astype(np.int64))
        for batch in pa.table({"__id": table.column("__id").take(take), "__h": table.column("__h").take(take),
                               "start": pa.array(low.astype(np.int32)), "end": pa.array(high.astype(np.int32))}).to_batches():
            yield batch

    def rank(batches):
        held: list[pa.RecordBatch] = []  # rows of the last name, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column("name").to_numpy()
            if held and held[-1].column("name")[-1].as_py() == name[-1]:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            cut_at = int(np.searchsorted(table.column("name").to_numpy(), name[-1]))
            if cut_at:
                yield from settle(table.slice(0, cut_at))
            held = table.slice(cut_at).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    named = lists.where(F.size("runs") > 0).select(F.col("__id").alias("__run_id"), F.col("__h").alias("__run_h"), "runs")
    rows = _joined(base, named, "__run_id", "__run_h").select("__id", "__h", "__text", "runs").mapInArrow(cut, fields)
    dealt = rows.repartition("deal").sortWithinPartitions("name", "__id", "__h", "start")
    return dealt.mapInArrow(rank, f"__id {id_type}, __h long, start int, end int")


def _joined(base: DataFrame, named: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Documents with their row of ``named``.  Few enough keys are first broadcast, so that only texts that are named move."""
    on = base["__id"].eqNullSafe(named[id_col]) & (base["__h"] == named[hash_col])
    if named.count() <= BROADCAST_ROWS:
        keys = named.select(F.col(id_col).alias("__key_id"), F.col(hash_col).alias("__key_h"))
        some = base.join(F.broadcast(keys), base["__id"].eqNullSafe(keys["__key_id"]) & (base["__h"] == keys["__key_h"]), "left_semi")
        return some.join(named.hint("merge"), some["__id"].eqNullSafe(named[id_col]) & (some["__h"] == named[hash_col]))
    return base.join(named, on)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document that loses bytes: ``__id``, ``__h`` (hash of the text),
    n_removed, ``spans`` (its maximal removed byte ranges, in order) and
    ``kept`` (the remaining bytes).  Documents that are not listed stay whole.

    Rows that repeat id and text cannot be told apart and count as one
    document; rows that share an id but not the text are ordered by the
    text's hash.  A null id comes first.  Texts shorter than ``length``, null
    and empty ones lose nothing.  Other columns are ignored.  An empty table
    gives no rows.
    """
    if not SEED < length < 128 + SEED:
        raise ValueError(f"length must be {SEED + 1} to {127 + SEED}")
    base = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), F.col(text_col).alias("__text"))
    base, rows = _one_row_each(base.where(F.octet_length("__text") >= length))
    hot = _hot_seeds(base, rows, length)
    place = F.struct("start", "end")
    lists = materialize(_ranked_runs(base, hot, length).groupBy("__id", "__h").agg(
        F.collect_list(F.when(F.col("kind") == 0, place)).alias("ranges"),
        F.collect_list(F.when(F.col("kind") == 1, F.struct("packed", "start", "end"))).alias("runs")))
    more = _ranked_windows(base, lists, hot, length).groupBy("__id", "__h").agg(F.collect_list(place).alias("ranges"))
    ranges = materialize(
        lists.select("__id", "__h", "ranges").unionByName(more).groupBy(F.col("__id").alias("__gone_id"), F.col("__h").alias("__gone_h"))
        .agg(F.flatten(F.collect_list("ranges")).alias("ranges")).where(F.size("ranges") > 0))
    id_type = base.schema["__id"].dataType.simpleString()

    def unite(batches):
        for batch in batches:
            gone, spans, kept = [], [], []
            for text, found in zip(_texts(batch), batch.column("ranges")):
                flat = found.values
                low, high = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.ones(len(low), bool)
                new[1:] = low[1:] > high[:-1]
                low, high = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
                gone.append(int((high - low).sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(low, high)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *high], [*low, len(text)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__h"), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["__id", "__h", "n_removed", "spans", "kept"])

    return _joined(base, ranges, "__gone_id", "__gone_h").select("__id", "__h", "__text", "ranges").mapInArrow(
        unite, f"__id {id_type}, __h long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
