"""Line dedup over repeated chunks of lines.

A chunk's boundaries are defined by content: a rolling hash over the hashes of
``window`` lines (two) is taken at every line, so whether a run is found depends
on its own lines alone, however the lines around it shift.  Runs whose hash
occurs earlier (least id, then least place) are seeds; seeds that follow each
other line by line make up one chunk, which therefore reaches as far in both
directions as the lines repeat, and a passage of any length from ``window``
lines goes whole, after its bytes have been compared.

1. One pass over the texts gives narrow rows (id, first line, 128-bit hash),
   one a line; partial aggregation finds repeated hashes and their first
   occurrence, so a run that a third of all documents share is one row per
   task before the shuffle.
2. Byte comparison: for repeated hashes the least and the greatest byte
   string are aggregated; where they differ, the hash stands for several
   runs, and these are told apart by a digest of the bytes.
3. Documents are joined with their lists of removed chunks.

Steps 2 and 3 concern only documents that have a repeated run.  Their lists are
broadcast if their exact size allows it, and no text moves; else their ids
alone, and only their texts move; beyond that all documents shuffle.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.names import fresh, plain
from tablelens.llm.worker import free, slices
from tablelens.session import checked_broadcast, materialize

WINDOW = 2


def _chunks(base: DataFrame, window: int) -> DataFrame:
    """Every run of ``window`` lines: id, h, first, hash (16 bytes, rolling over the lines' hashes)."""
    id_type = base.schema["__id"].dataType.simpleString()

    def cut(batches):
        free()
        for batch in slices(batches):
            rows, first, digest = [], [], []
            for i, value in enumerate(batch.column("__text")):
                text = value.as_py()
                if not text or "\n" not in text:
                    continue
                lines = [xxhash.xxh3_128_digest(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
                for at in range(len(lines) - window + 1):
                    rows.append(i)
                    first.append(at)
                    digest.append(xxhash.xxh3_128_digest(b"".join(lines[at:at + window])))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(take), batch.column("__h").take(take), pa.array(first, pa.int32()),
                 pa.array(digest, pa.binary())], names=["__id", "__h", "first", "hash"])

    return base.mapInArrow(cut, f"__id {id_type}, __h long, first int, hash binary")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _later(window: int) -> Column:
    """Whether a run is neither its ``origin`` nor overlaps it."""
    same = F.struct("__id", "__h") == F.struct(F.col("origin.__id").alias("__id"), F.col("origin.__h").alias("__h"))
    return ~(same & (F.col("first") < F.col("origin.first") + window))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                           removed_lines: str = "removed_lines", removed_chunks: str = "removed_chunks") -> DataFrame:
    """All rows and columns of ``docs`` with the repeated runs of at least
    ``window`` lines gone from ``text_col``, plus counts of removed lines and
    of removed chunks, which are runs without a gap (long).

    A line goes if it lies in ``window`` lines that occur before, in an earlier
    document or further up without overlap; so the first occurrence of every
    line stays.  A text without a line feed is a single line and stays, as do
    null and empty texts.  Removed lines go with their line feeds; an empty
    line is a line like others.  Rows that repeat the same id and the same
    text cannot be told apart and are treated alike, as one document; rows
    that share an id but not the text are ordered by the text's hash.  Other
    columns pass through.  An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("window must be at least 2 lines")
    for name in (removed_lines, removed_chunks):
        if name in docs.columns:
            raise ValueError(f"{name!r} is already a column")
    base = docs.select(plain(id_col).alias("__id"), F.xxhash64(plain(text_col)).alias("__h"), plain(text_col).alias("__text"))
    chunks = _chunks(base, window)  # cheaper to hash twice than to keep a row for every line
    place = F.struct("__id", "__h", "first")
    repeated = (  # repeated rows of one document have one place
        chunks.groupBy("hash").agg(F.min(place).alias("origin"), F.max(place).alias("last"))
        .where(F.col("origin") != F.col("last")).drop("last")
    )
    found = materialize(chunks.join(repeated, "hash").select("__id", "__h", "first", "hash", "origin"))
    # Bytes of every occurrence of a repeated hash; equal unless two runs share a hash.
    some, small = checked_broadcast(found.groupBy(F.col("__id").alias("__at_id"), F.col("__h").alias("__at_h")).agg(
        F.collect_set(F.struct("first", "hash")).alias("c")))
    here = F.col("__id").eqNullSafe(F.col("__at_id")) & (F.col("__h") == F.col("__at_h"))
    held = base.where(F.col("__text").contains("\n"))
    if not small:
        held = held.join(checked_broadcast(some.select("__at_id", "__at_h"))[0], here, "left_semi")
    held = held.join(some, here).select("__id", "__h", _lines(F.col("__text")).alias("l"), F.explode("c").alias("c"))
    bytes_of = held.select(
        "__id", "__h", "c.first", "c.hash", F.array_join(F.slice("l", F.col("c.first") + 1, window), "\n").alias("bytes"))
    clash = materialize(
        bytes_of.groupBy("hash").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
        .where(F.col("a") != F.col("b")).select("hash"))
    doomed = found.where(_later(window)).select("__id", "__h", "first", "hash")
    if clash.limit(1).count():  # tell the runs of such a hash apart by their bytes
        exact = bytes_of.join(clash, "hash").withColumn("hash", F.concat("hash", F.unhex(F.sha2("bytes", 256)))).drop("bytes")
        origin = exact.groupBy("hash").agg(F.min(place).alias("origin"))
        again = exact.join(origin, "hash").where(_later(window)).select(*doomed.columns)
        doomed = doomed.join(clash, "hash", "left_anti").select(*doomed.columns).unionByName(again)
    # Runs that start at consecutive lines are one chunk.
    step = F.dense_rank().over(Window.partitionBy("__id", "__h").orderBy("first"))
    joint = doomed.withColumn("run", F.col("first") - step).groupBy("__id", "__h", "run").agg(
        F.min("first").alias("a"), (F.max("first") + window).alias("b"))
    gone_id, gone_h, gone = fresh(docs, "__gone_id", "__gone_h", "__spans")
    spans, small = checked_broadcast(joint.groupBy(F.col("__id").alias(gone_id), F.col("__h").alias(gone_h)).agg(
        F.collect_list(F.struct("a", "b")).alias(gone)))
    on = plain(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(plain(text_col)) == F.col(gone_h))
    keys, few = (spans, False) if small else checked_broadcast(spans.select(gone_id, gone_h))
    if few:  # the other documents stay where they are
        rest = docs.join(keys, on, "left_anti").withColumn(gone, F.lit(None).cast(spans.schema[gone].dataType))
        joined = docs.join(keys, on, "left_semi").join(spans, on, "left").drop(gone_id, gone_h).unionByName(rest)
    else:
        joined = docs.join(spans, on, "left")
    lost = lambda i: F.exists(gone, lambda s: (s["a"] <= i) & (i < s["b"]))
    kept = F.array_join(F.filter(_lines(plain(text_col)), lambda x, i: ~lost(i)), "\n")
    text = F.when(F.col(gone).isNull(), plain(text_col)).otherwise(kept)
    count = F.aggregate(gone, F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))
    return joined.select(
        *[text.alias(text_col) if c == text_col else plain(c) for c in docs.columns],
        F.coalesce(count, F.lit(0).cast("long")).alias(removed_lines),
        F.coalesce(F.size(gone).cast("long"), F.lit(0).cast("long")).alias(removed_chunks))
