"""SimHash near-duplicates by Golay-code fuzzy hashing.

*Fingerprint.*  A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z
lower-cased.  Every run of three words (repeats included; fewer words: all of
them), joined by single spaces, is hashed by XXH64 with seed 42; a bit of the
fingerprint is 1 if over half the hashes have it.  No word: zero.

*Keys.*  The 64 bits are cut into three segments (22, 21, 21), padded to the
23 bits of the perfect Golay code.  Every 23-bit word lies within distance 3 of
exactly one codeword; a word and its 23 neighbours decode to one codeword or to
six.  Two words at distance 2 have a common neighbour, so they share a codeword
index.  Two fingerprints that differ in at most two bits therefore share an
index in *every* segment, and by the pigeonhole principle one segment has no
error at all.  A key is a segment's exact bits with one codeword index of the
next segment: about 16 keys of 33 bits for a fingerprint, and no link is missed.

*Links.*  Only distinct fingerprints are keyed.  A key's members are counted
with partial aggregation: a key of one member ends there, a key of two gives
its pair at once, up to ``CROWD`` members are compared among themselves, and
only verified pairs leave.  Members of larger buckets are not decoded but keyed
by the 64-bit word itself and its 64 neighbours: a word has at most 65 members,
any two of them differ in at most two bits, and a pair that does has a common
word.  So work is linear in the distinct fingerprints, whatever their groups.

*Components* are star contractions over distinct fingerprints; a row finds its
component through its fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.components import components
from tablelens.llm.worker import free, slices
from tablelens.session import checked_broadcast, materialize

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 2
CROWD = 64  # members of a bucket that are compared pair by pair
STEP_BYTES = 1 << 20  # of a text at a time

# Fixed values of the binary Golay code: length, message bits, generator polynomial.
LENGTH, MESSAGE, GENERATOR = 23, 12, 0b110001110101

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time; a piece starts with the last two words of the one before."""
    at, kept = 0, []
    while at < len(text):
        space = _SPACE.search(text, min(at + STEP_BYTES, len(text)))
        end = space.start() if space else len(text)
        words = kept + text[at:end].lower().split()
        yield words
        kept, at = words[1 - WORDS:], end


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    ones, total, few = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _words(data):
        few = words
        hashes = [digest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])]
        if hashes:
            parts = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
            ones += np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
            total += len(hashes)
    if not total:  # fewer words than a shingle has
        return digest(b" ".join(few), SEED) if few else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, fp long: the fingerprint's 64 bits, signed) for every row."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        free()
        for batch in slices(batches):
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["__id", "fp"])

    return rows.mapInArrow(run, f"__id {kind}, fp long")


@lru_cache(1)
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits; the error patterns of each remainder, and how many."""
    single = []
    for bit in range(LENGTH):
        value = 1 << bit
        for top in range(bit, LENGTH - MESSAGE - 1, -1):
            if value >> top & 1:
                value ^= GENERATOR << (top - (LENGTH - MESSAGE))
        single.append(value)

    def sums(rests: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for rest in rests:
            out = np.concatenate([out, out ^ rest])
        return out

    leader = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            rest = 0
            for bit in bits:
                rest ^= single[bit]
            leader[rest] = sum(1 << bit for bit in bits)
    errors, many = np.zeros((len(leader), 6), np.int64), np.zeros(len(leader), np.int64)
    for rest in range(len(leader)):
        near = {int(leader[rest])} | {int(leader[rest ^ one]) ^ (1 << bit) for bit, one in enumerate(single)}
        errors[rest, :len(near)], many[rest] = sorted(near), len(near)
    return sums(single[:MESSAGE]), sums(single[MESSAGE:]), errors, many


def codewords(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, index) of the codewords to which 23-bit values and their neighbours decode."""
    low, high, errors, many = _code()
    rest = low[values & ((1 << MESSAGE) - 1)] ^ high[values >> MESSAGE]
    row = np.repeat(np.arange(len(values)), many[rest])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many[rest]) - many[rest], many[rest])
    return row, (values[row] ^ errors[rest[row], nth]) >> (LENGTH - MESSAGE)


def keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of fingerprints (uint64)."""
    cut = [((found >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in SEGMENTS]
    rows, out = [], []
    for i, exact in enumerate(cut):
        row, index = codewords(cut[(i + 1) % len(cut)])
        rows.append(row)
        out.append((np.int64(i) << 34) | (exact[row] << MESSAGE) | index)
    return np.concatenate(rows), np.concatenate(out)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, 20_000):
            found = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = keys(found.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(found[row])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _close(a, b):
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within two bits of each other.

    Within buckets of up to ``crowd`` members every linked pair; of larger
    ones, each word's members to the least of them.
    """
    keyed = _keyed(distinct)
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    two = buckets.where("n = 2").select("a", "b").where(_close(F.col("a"), F.col("b")))
    some = keyed.join(buckets.where(F.col("n").between(3, crowd)).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    later = F.filter(F.expr("slice(fps, at + 2, size(fps))"), lambda x: _close(x, F.col("a")))
    few = some.select("fps", F.posexplode("fps").alias("at", "a")).select("a", F.explode(later).alias("b"))
    crowded = keyed.join(buckets.where(F.col("n") > crowd).select("key"), "key").select("fp").distinct()
    flip = F.when(F.col("bit") < BITS, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    words = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("bit")).select(F.col("fp").bitwiseXOR(flip).alias("word"), "fp")
    stars = words.groupBy("word").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    many = stars.select(F.col("fps")[0].alias("a"), F.explode(F.expr("slice(fps, 2, size(fps))")).alias("b"))
    return two.unionByName(few).unionByName(many).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    ``component_id`` is the least id reachable over links, itself included.
    A null text has no words; rows that repeat an id are rows of their own; a
    null id is never the least one (the component of null ids alone is null).
    An empty table gives an empty one; columns besides id and text don't count.
    """
    rows = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(rows.groupBy("fp").agg(F.min("__id").alias("least")))
    roots = components(links(distinct, crowd))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = checked_broadcast(joined.select("fp", "root").join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
