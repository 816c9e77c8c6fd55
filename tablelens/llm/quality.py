"""Supervised subword embeddings for text quality.

Every word, neighbouring word pair and byte 3- and 4-gram of a text is hashed
to a bucket with a learned vector; a text is the mean of its vectors, and a
softmax layer turns that into class probabilities.  Vectors and layer are
trained together by numpy stochastic gradient descent on a bounded sample
(``per_class`` rows of each class), in one task.

Scoring covers whole texts of any number of rows: the layer is linear, so it
is applied to each bucket's vector once and a text's logit is the mean of its
buckets' logits.  Only that table (4 bytes a bucket) is sent to executors.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablelens.llm.features import Hasher
from tablelens.llm.sampling import bounded_sample, held_out, within_bytes
from tablelens.llm.worker import free, give_back, slices

PER_CLASS = 3000
TRAIN_BYTES = 40_000_000
THRESHOLD = 0.3
_HASHER = dict(bits=18, orders=(3, 4), words=True)
_COUNT_BITS = 32 - _HASHER["bits"]


@dataclass
class QualityModel:
    """``logits``: of label 1 against label 0, per bucket; ``bias`` is added to their mean."""

    logits: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        mean = Hasher(**_HASHER).mean_weights(texts, self.logits[:, None])[:, 0]
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def _packed(features: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Distinct buckets and their counts: four bytes a bucket, unless a count is too large for its bits."""
    found, count = np.unique(features, return_counts=True)
    if not len(count) or count.max() < 1 << _COUNT_BITS:
        return (found.astype(np.uint32) << np.uint32(_COUNT_BITS)) | count.astype(np.uint32), None, int(count.sum())
    return found, count, int(count.sum())


def _unpacked(found: np.ndarray, count: np.ndarray | None, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of the text."""
    if count is None:
        found, count = found >> np.uint32(_COUNT_BITS), found & np.uint32((1 << _COUNT_BITS) - 1)
    return found, (count / max(1, total)).astype(np.float32)


def train(texts: Iterable[str], labels: np.ndarray, dim: int = 12, epochs: int = 6, rate: float = 0.5,
          seed: int = 7) -> np.ndarray:
    """Buckets x 2 class logits after SGD; the rows' order fixes the result.  Texts are hashed one by one and not held."""
    hasher, rng = Hasher(**_HASHER), np.random.default_rng(seed)
    rows = [_packed(hasher.row_features(text)) for text in texts]
    vectors = rng.uniform(-1 / dim, 1 / dim, (hasher.buckets, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found, share = _unpacked(*rows[i])
            step = rate * (1 - done / steps)
            done += 1
            if not len(found):
                continue
            text = share @ vectors[found]
            logits = text @ layer
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(text, p)
            # The mean spreads a text's gradient over its features; scale it back by their number.
            vectors[found] -= (step * min(len(found), 200)) * np.outer(share, back)
    return vectors @ layer


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> QualityModel:
    """Learn from labelled rows that are not held out.

    ``per_class`` bounds the rows of each label, ``train_bytes`` the text that
    the training task holds (see ``within_bytes``).
    Ids with conflicting or null labels are ignored.  The sample is
    stratified; the bias is corrected to the true share of label 1.  With no
    row or one label only, every score is that label (0.5 without rows).
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("most"))
        .where(F.col("label") == F.col("most")).select("id", "label")
    )
    sample, totals = bounded_sample(known, "label", F.col("id"), per_class)
    if len(totals) < 2:
        bias = 30.0 * (1 if 1 in totals else -1) if totals else 0.0
        return QualityModel(np.zeros(Hasher(**_HASHER).buckets, np.float32), bias)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), "id")  # about 2 * per_class rows
    chosen = within_bytes(chosen, "label", "id", "text", train_bytes)

    def run(batches):
        free()
        rows = sorted({(r["id"], r["text"], r["label"]) for b in batches for r in b.to_pylist()})
        kept = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
        y = np.array([r[2] for r in kept], np.int64)
        del rows
        kept.reverse()
        logits = train((kept.pop()[1] for _ in range(len(kept))), y) if kept else np.zeros((Hasher(**_HASHER).buckets, 2))
        ones = int(y.sum())
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array([(logits[:, 1] - logits[:, 0]).astype("<f4").tobytes()]), pa.array([len(y) - ones]), pa.array([ones])],
            names=["logits", "zeros", "ones"])

    row = chosen.repartition(1).mapInArrow(run, "logits binary, zeros long, ones long").first()
    if row is None:  # none of the labelled ids is in docs
        return QualityModel(np.zeros(Hasher(**_HASHER).buckets, np.float32), float(np.log(totals[1] / totals[0])))
    bias = np.log(totals[1] / totals[0]) - np.log(max(1, row["ones"]) / max(1, row["zeros"]))
    return QualityModel(np.frombuffer(row["logits"], "<f4"), float(bias))


def add_scores(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out`` (double, 0 to 1), from the whole text alone.

    A null text is scored as an empty one, which has no features.
    """
    if out in docs.columns:
        raise ValueError(f"{out!r} is already a column")
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns) + 1)]  # any name passes through
    fields = [StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)]

    def run(batches):
        free()
        for batch in slices(batches):
            scores = model.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return docs.toDF(*names[:-1]).mapInArrow(run, StructType([*fields, StructField(names[-1], DoubleType())])).toDF(*docs.columns, out)
