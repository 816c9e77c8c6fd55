"""Benchmark decontamination: a prefix-filtered set join, DataFrame functions only.

A benchmark item is cut into windows of ``window`` consecutive words (an item
with fewer words, but not none, is one window).  A document contains an item
where one of its windows occurs, word for word.

1. Words are ordered by rarity, from their counts over *all* documents.
2. Containment of a whole window needs every word of it, so its necessary
   prefix is one token: the rarest word.  Documents and windows are joined on
   that word alone, which keeps the candidate list short.  A window with a
   word that no document has is dropped before the join.
3. Positional and length bounds: the word's place in the document and its
   offset in the window fix the window's start; it must lie inside.
4. The words at that place are compared with the window's, one by one.

The window table is broadcast only if it has at most ``broadcast_windows``
rows and few enough bytes; a larger one is joined by a shuffle of words and places (AQE splits a
word that is hot), and the places found return to their documents for the
comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.names import fresh, plain
from tablelens.session import checked_broadcast, materialize

WINDOW = 10
BROADCAST_WINDOWS = 100_000
BROADCAST_HITS = 1_000_000  # of an id and a hash each

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Characters between words, before and after lower-casing A-Z.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of ``text`` with A-Z (and nothing else) lower-cased; null: none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lowered, _GAP), "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``win`` (array of words), ``win_len``, ``items`` (structs of an id as string)."""
    words = items.select(plain(id_col).cast("string").alias("item"), words_of(plain(text_col)).alias("words"))
    words = words.where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = words.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return (
        cut.select("item", F.slice("words", F.col("at") + 1, F.lit(window)).alias("win"))
        .groupBy("win").agg(F.collect_set(F.struct("item")).alias("items"))  # a struct holds a null id too
        .withColumn("win_len", F.size("win"))
    )


def _rarest_first(windows: DataFrame, docs: DataFrame, broadcast: bool) -> DataFrame:
    """Windows whose words all occur, with their rarest ``word`` and its ``offset``."""
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    if broadcast:  # at most ``window`` words a window
        vocabulary = F.broadcast(vocabulary)
    counts = (
        docs.select(F.explode("words").alias("word")).join(vocabulary, "word", "left_semi")
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    placed = windows.select("win", F.posexplode("win").alias("offset", "word"))
    rarest = (
        placed.join(counts, "word", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("offset"))).alias("r"))
        .where(F.col("r.n") > 0)
        .select("win", F.col("r.word").alias("word"), F.col("r.offset").alias("offset"))
    )
    return windows.join(rarest, "win")


def find_windows(docs: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS,
                 window: int = WINDOW) -> DataFrame:
    """Every occurrence of every window.

    ``docs``: any key columns plus ``words``.  Returns the key columns,
    ``start`` (word position, from 0), ``win_len`` and ``items``.
    """
    keys = [c for c in docs.columns if c != "words"]
    windows, broadcast = checked_broadcast(windows, broadcast_windows)  # by rows and bytes
    prefix = materialize(_rarest_first(windows, docs, broadcast))
    start = F.col("pos") - F.col("offset")
    same = F.slice("words", F.col("start") + 1, F.col("win_len")) == F.col("win")
    if broadcast:
        placed = docs.select(*keys, "words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(prefix), "word")
        inside = placed.where((start >= 0) & (start + F.col("win_len") <= F.size("words"))).withColumn("start", start)
        return inside.where(same).select(*keys, "start", "win_len", "items")
    # Only words and places move to the windows; the places found then go back to their documents.
    numbered = materialize(prefix.withColumn("win_id", F.monotonically_increasing_id()))
    placed = docs.select(*keys, F.posexplode("words").alias("pos", "word"))
    found = placed.join(numbered.drop("items"), "word").where(start >= 0).withColumn("start", start)
    lists = found.groupBy(*[F.col(k).alias(f"{k}__found") for k in keys]).agg(
        F.collect_list(F.struct("start", "win_id", "win", "win_len")).alias("found"))
    on = [docs[k].eqNullSafe(lists[f"{k}__found"]) for k in keys]
    held = docs.join(lists, on).select(*keys, "words", F.explode("found").alias("f")).select(*keys, "words", "f.*")
    held = held.where((F.col("start") + F.col("win_len") <= F.size("words")) & same).select(*keys, "start", "win_len", "win_id")
    return held.join(numbered.select("win_id", "items"), "win_id").drop("win_id")


def _covered(spans: Column) -> Column:
    """Number of positions in the union of ``(start, end)`` structs."""
    acc = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("long").alias("n"),
    )
    return F.aggregate(F.array_sort(spans), acc, step, lambda a: a["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents that contain a window: ``__hit_id``, ``__hit_h`` (xxhash64
    of the text), n_hit, n_items, items_sha256, one row per id and text."""
    base = docs.select(plain(id_col).alias("__id"), plain(text_col).alias("__text"))
    words = base.select("__id", F.xxhash64("__text").alias("__h"), words_of(F.col("__text")).alias("words"))
    windows = item_windows(benchmark, item_col, item_text_col, window)
    return (
        find_windows(words, windows, broadcast_windows, window)
        .groupBy(F.col("__id").alias("__hit_id"), F.col("__h").alias("__hit_h"))
        .agg(F.collect_set(F.struct("start", (F.col("start") + F.col("win_len")).alias("end"))).alias("spans"),
             F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .select("__hit_id", "__hit_h", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                F.sha2(F.concat_ws(",", F.array_sort(F.col("items.item"))), 256).alias("items_sha256"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_hit (words inside any
    occurrence), n_items, items_sha256 (of the sorted, comma-joined item ids)
    and contaminated.

    Null and empty texts have no words and are never contaminated; an item
    without words has no window; items of null id are one item, counted but
    without text in the digest.  Repeated rows each get their own result,
    also when they share a doc_id with a different text (rows are matched by
    id *and* text hash).  Other columns of both inputs are ignored.  An empty
    benchmark contaminates nothing.
    """
    hits = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col, window, broadcast_windows)
    n_words = F.regexp_count(F.coalesce(plain(text_col), F.lit("")), F.lit(_ANY_CASE_WORD)).cast("long")
    rows = docs.select(plain(id_col).alias("__id"), F.xxhash64(plain(text_col)).alias("__h"), n_words.alias("n_words"))
    zero = F.lit(0).cast("long")
    return (
        rows.join(hits, F.col("__id").eqNullSafe(F.col("__hit_id")) & (F.col("__h") == F.col("__hit_h")), "left")
        .select(F.col("__id").alias(id_col), "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                F.coalesce("n_items", zero).alias("n_items"),
                F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, in whose text no window of a benchmark item occurs."""
    hit_id, hit_h = fresh(docs, "__hit_id", "__hit_h")
    hits = contaminated(docs, benchmark, id_col, text_col, **options)
    hits, _ = checked_broadcast(hits.select(F.col("__hit_id").alias(hit_id), F.col("__hit_h").alias(hit_h)), BROADCAST_HITS)
    on = plain(id_col).eqNullSafe(F.col(hit_id)) & (F.xxhash64(plain(text_col)) == F.col(hit_h))
    return docs.join(hits, on, "left_anti")
