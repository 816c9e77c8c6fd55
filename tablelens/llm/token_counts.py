"""Token counts from an exact length histogram.

Documents are encoded once; all that leaves a task is (length, count) pairs.
Suffix sums over the histogram then answer, for *every* context limit: how
many documents reach it, the tokens kept if texts are truncated there, and
which quantile it is.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.worker import kept, slices
from tablelens.session import materialize

BLOCK = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    return kept(("token counts", path), lambda: _load(path))


def _load(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) over all rows of ``docs``: the number of rows of each encoded length.

    ``vocabulary``: path of a byte-level rank file, readable by every
    executor.  Null and empty texts have length 0; repeated rows count each
    time; other columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches):
        encoding = _encoding(path)
        for batch in slices(batches):
            counts: dict[int, int] = {}
            for value in batch.column(0):
                text = value.as_py()
                n = len(encoding.encode_ordinary(text)) if text else 0
                counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(counts, np.int64, len(counts))),
                 pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["n_tokens", "n"])

    lengths = docs.select(F.col(text_col).alias("text")).mapInArrow(encode, "n_tokens long, n long")
    return lengths.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: docs_at_least, tokens_at_least, tokens_if_truncated (every
    text cut to this length) and docs_at_most.

    Lengths are summed in blocks of ``BLOCK`` lengths, then over blocks, so no
    task holds the whole histogram however long the texts are.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    hist = materialize(histogram.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK)))
    blocks = hist.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum(tokens).alias("__t"))
    # One row per block of lengths: at most longest text / BLOCK rows.
    later = Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__later_d"),
                           F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__later_t"))
    total_docs, total_tokens = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0))).first()
    here = Window.partitionBy("__block").orderBy(F.col("n_tokens").desc())
    summed = hist.join(blocks, "__block").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(here) + F.col("__later_d")).alias("docs_at_least"),
        (F.sum(tokens).over(here) + F.col("__later_t")).alias("tokens_at_least"))
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.lit(total_tokens) - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_if_truncated"),
        (F.lit(total_docs) - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"))


def quantiles(summed: DataFrame, fractions: list[float]) -> dict[float, int | None]:
    """Smallest length that at least this fraction of documents does not exceed (one row per fraction)."""
    n = summed.agg(F.sum("n_docs")).first()[0] or 0
    need = [F.min(F.when(F.col("docs_at_most") >= max(1, math.ceil(q * n)), F.col("n_tokens"))) for q in fractions]
    return dict(zip(fractions, summed.agg(*need).first()))


def truncated_totals(summed: DataFrame, limits: list[int]) -> dict[int, int]:
    """Tokens kept if every text is cut to ``limit`` tokens, for any limits."""
    kept = [F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("n_docs")), F.lit(0)) for x in limits]
    return dict(zip(limits, summed.agg(*kept).first()))
