"""A corpus pipeline over ``documents``: quality, line dedup, near dedup,
benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All stages but
the last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import quality
from tablelens.llm.decontam import drop_contaminated
from tablelens.llm.line_dedup import remove_repeated_chunks
from tablelens.llm.names import fresh, plain
from tablelens.llm.near_dedup import drop_near_copies
from tablelens.llm.packing import pack
from tablelens.llm.registry import table
from tablelens.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.3).

    It learns from the labelled rows of ``docs`` that are not held out, and
    scores every whole text; a null or empty text has no features and gets the
    share of good labels as its score.
    """
    (score,) = fresh(docs, "score")
    scored = quality.add_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")), out=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*map(plain, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that an earlier document has; a
    document that is nothing but such chunks goes.  ``n_chars`` follows the text."""
    lines, chunks = fresh(docs, "removed_lines", "removed_chunks")
    left = remove_repeated_chunks(docs, removed_lines=lines, removed_chunks=chunks)
    left = left.where((F.col(lines) == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(lines) == 0, F.col("n_chars"))
                               .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(*map(plain, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id."""
    return drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces, placed in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

# A trained classifier, signatures and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on lies in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
