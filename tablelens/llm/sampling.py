"""Bounded, reproducible training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 40
MOST_TEXTS = 50_000


def held_out(id_col: Column) -> Column:
    """crc32 of the id, as text, is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(rows: DataFrame, class_col: str, salt: Column, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class at most, chosen by a hash of
    ``salt``, and the number of all rows of each class (one row per class on
    the driver).  The same rows give the same sample."""
    totals = {r[0]: r[1] for r in rows.groupBy(class_col).agg(F.count("*")).collect()}
    number = F.pmod(F.xxhash64(salt, F.lit("sample")), F.lit(_RANGE))
    take = F.lit(False)
    for value, n in totals.items():
        take |= (F.col(class_col) == F.lit(value)) & (number < int(_RANGE * min(1.0, per_class / n)))
    return rows.where(take), totals


def within_bytes(rows: DataFrame, class_col: str, id_col: str, text_col: str, most: int, most_texts: int = MOST_TEXTS) -> DataFrame:
    """The rows whose texts make up at most ``most`` bytes, before they are gathered in one task.

    All rows if they fit.  Else each class gets an equal part, and what small
    classes leave is dealt to the others; in hash order a text that does not
    fit is left out, not those after it.  A class keeps one text at least, its
    shortest, even if that one is longer than its part.  Only sizes come to
    the driver, of at most ``most_texts`` texts a class (those of least hash;
    an id may stand for any number of texts).
    """
    key = F.xxhash64(id_col, text_col)
    pairs = rows.select(F.col(class_col).alias("c"), key.alias("k"), F.octet_length(text_col).cast("long").alias("n")).distinct()
    nth = F.row_number().over(Window.partitionBy("c").orderBy("k", "n"))
    sizes: dict = {}
    for r in pairs.withColumn("nth", nth).where(F.col("nth") <= most_texts + 1).collect():
        sizes.setdefault(r["c"], []).append((r["k"], r["n"]))
    whole = all(len(texts) <= most_texts for texts in sizes.values())
    sizes = {c: sorted(texts)[:most_texts] for c, texts in sizes.items()}
    totals = {c: sum(n for _, n in texts) for c, texts in sizes.items()}
    if whole and sum(totals.values()) <= most:
        return rows
    kept, left = [], most
    for done, c in enumerate(sorted(sizes, key=lambda c: (totals[c], str(c)))):
        part, spent, before = left // (len(sizes) - done), 0, len(kept)
        for k, n in sorted(sizes[c]):
            if spent + n <= part:
                kept.append(k)
                spent += n
        if len(kept) == before:
            k, spent = min(sizes[c], key=lambda x: (x[1], x[0]))
            kept.append(k)
        left = max(0, left - spent)
    keys = rows.sparkSession.createDataFrame([(k,) for k in kept], "__k long")
    return rows.join(F.broadcast(keys), key == F.col("__k"), "left_semi")
