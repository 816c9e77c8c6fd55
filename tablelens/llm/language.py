"""Language identification by hierarchical discrimination.

Languages are first grouped into families, by average linkage of their mean
byte n-gram profiles in the training sample (about the square root of the
number of languages; no outside table).  One-versus-rest linear support
vector machines choose the family; within it, one-versus-one machines vote
between its languages.  All machines see the mean of a text's hashed n-grams
and are trained by numpy stochastic gradient descent on the hinge loss
(Pegasos steps, averaged), in one task, on a sample bounded by ``per_class``
rows of each language.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tablelens.llm.features import Hasher
from tablelens.llm.sampling import bounded_sample, held_out, within_bytes
from tablelens.llm.worker import free, slices

PER_CLASS = 1000
TRAIN_BYTES = 30_000_000
UNDETERMINED = "und"
_HASHER = dict(bits=16, orders=(1, 2, 3, 4), words=False)


@dataclass
class LanguageModel:
    """``families``: lists of languages.  ``weights``: buckets x machines, first
    one per family (if there are several), then one per ``pairs`` entry."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 for a text without letters."""
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.families:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        margin = Hasher(**_HASHER).mean_weights([t.lower() if ok else None for t, ok in zip(texts, lettered)], self.weights)
        margin = np.clip(margin + self.bias, -30, 30)
        sure = 1 / (1 + np.exp(-2 * margin))
        split = len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :split].argmax(axis=1) if split else np.zeros(len(texts), int)
        score = sure[np.arange(len(texts)), family] if split else np.ones(len(texts))
        names = np.empty(len(texts), object)
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, total = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages)))
            for m, (a, b) in enumerate(self.pairs, split):
                if a in languages and b in languages:
                    p, i, j = sure[rows, m], languages.index(a), languages.index(b)
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    total[:, i] += p
                    total[:, j] += 1 - p
            best = np.lexsort((np.broadcast_to(-np.arange(len(languages)), votes.shape), total, votes), axis=1)[:, -1]
            names[rows] = np.array(languages, object)[best]
            if len(languages) > 1:
                score[rows] *= total[np.arange(len(rows)), best] / (len(languages) - 1)
        return ([n if ok else UNDETERMINED for n, ok in zip(names, lettered)],
                np.where(lettered, np.clip(score, 0.0, 1.0), 0.0))


def group_families(profiles: dict[str, np.ndarray]) -> list[list[str]]:
    """Average linkage of unit profiles until about sqrt(n) groups are left; ties by name."""
    groups = [[name] for name in sorted(profiles)]
    unit = {k: v / (np.linalg.norm(v) or 1.0) for k, v in profiles.items()}
    while len(groups) > math.ceil(math.sqrt(len(profiles))):
        near = lambda a, b: float(np.mean([unit[x] @ unit[y] for x in a for y in b]))
        a, b = max(itertools.combinations(groups, 2), key=lambda ab: near(*ab))
        groups = sorted([g for g in groups if g not in (a, b)] + [sorted(a + b)])
    return groups


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, buckets: int, scale: float,
             rng: np.random.Generator, epochs: int = 6, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine: averaged stochastic subgradient steps on scaled mean features."""
    weights, mean, bias, bias_mean, size, t = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, 1.0, 0
    balance = {s: len(signs) / (2 * max(1, (signs == s).sum())) for s in (-1, 1)}
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (penalty * (t + 1 / penalty))
            found, share = rows[i]
            size *= 1 - rate * penalty
            if signs[i] * (size * scale * (share @ weights[found]) + bias) < 1:
                weights[found] += rate * balance[signs[i]] * signs[i] * scale * share / size
                bias += 0.1 * rate * balance[signs[i]] * signs[i]
        if epoch >= epochs // 2:
            mean += size * weights
            bias_mean += bias
    kept = epochs - epochs // 2
    return mean * scale / kept, bias_mean / kept


def train(texts: list[str], langs: list[str], seed: int = 5) -> LanguageModel:
    """Families and machines; the rows' order fixes the result."""
    hasher, rows = Hasher(**_HASHER), []
    for text in texts:
        found, count = np.unique(hasher.row_features(text.lower()), return_counts=True)
        rows.append((found, count / max(1, count.sum())))
    langs = np.array(langs, object)
    profiles = {}
    for name in sorted(set(langs)):
        profiles[name] = np.zeros(hasher.buckets)
        for i in np.flatnonzero(langs == name):
            np.add.at(profiles[name], rows[i][0], rows[i][1])
    families = group_families(profiles)
    scale = 1 / float(np.median([np.sqrt((s * s).sum()) for _, s in rows if len(s)] or [1.0]))
    family_of = {name: f for f, group in enumerate(families) for name in group}
    rng, columns, biases = np.random.default_rng(seed), [], []
    number = np.array([family_of[x] for x in langs])
    tasks = [(np.arange(len(rows)), np.where(number == f, 1, -1)) for f in range(len(families))] if len(families) > 1 else []
    pairs = [p for group in families for p in itertools.combinations(group, 2)]
    for a, b in pairs:
        of = np.flatnonzero((langs == a) | (langs == b))
        tasks.append((of, np.where(langs[of] == a, 1, -1)))
    for of, signs in tasks:
        w, b = _machine([rows[i] for i in of], signs, hasher.buckets, scale, rng)
        columns.append(w)
        biases.append(b)
    weights = np.stack(columns, axis=1) if columns else np.zeros((hasher.buckets, 1))
    return LanguageModel(families, pairs, weights.astype(np.float32), np.array(biases or [0.0]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> LanguageModel:
    """Learn from rows with a language, a text and an id that is not held out.

    ``per_class`` bounds the rows of each language, ``train_bytes`` the text
    in the training task (see ``within_bytes``).  Without such rows the model answers ``und``.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id")))
    sample, totals = bounded_sample(known, "lang", F.struct("id", "text"), per_class)
    if not totals:
        return LanguageModel([], [], np.zeros((1, 1), np.float32), np.zeros(1))

    sample = within_bytes(sample, "lang", "id", "text", train_bytes)

    def run(batches):
        free()
        rows = sorted({(str(r["id"]), r["text"], r["lang"]) for b in batches for r in b.to_pylist()})
        kept = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
        model = train([r[1] for r in kept], [r[2] for r in kept])
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.families], pa.list_(pa.list_(pa.string()))),
             pa.array([[list(p) for p in model.pairs]], pa.list_(pa.list_(pa.string()))),
             pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias.tolist()], pa.list_(pa.float64()))],
            names=["families", "pairs", "weights", "bias"])

    schema = "families array<array<string>>, pairs array<array<string>>, weights binary, bias array<double>"
    row = sample.repartition(1).mapInArrow(run, schema).first()
    weights = np.frombuffer(row["weights"], "<f4").reshape(Hasher(**_HASHER).buckets, -1)
    return LanguageModel([list(x) for x in row["families"]], [tuple(x) for x in row["pairs"]], weights, np.array(row["bias"]))


def add_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "lang_pred",
                  score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out`` and ``score``, from the whole text alone.

    Null, empty and letterless texts give ``und`` with score 0; equal texts
    get equal answers.
    """
    for name in (out, score):
        if name in docs.columns:
            raise ValueError(f"{name!r} is already a column")
    at, columns = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns) + 2)]  # any name passes through
    fields = [StructField(n, f.dataType, f.nullable) for n, f in zip(columns, docs.schema.fields)]
    schema = StructType([*fields, StructField(columns[-2], StringType()), StructField(columns[-1], DoubleType())])

    def run(batches):
        free()
        for batch in slices(batches):
            names, scores = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=columns)

    return docs.toDF(*columns[:-2]).mapInArrow(run, schema).toDF(*docs.columns, out, score)
