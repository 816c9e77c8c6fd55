"""Hashed word and character n-gram features of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STEP_BYTES = 1_000_000
_BASE = np.uint64(0x100000001B3)
_BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse (modulo 2 ** 64), kept for the next call."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, STEP_BYTES + 2), base, np.uint64)
            steps[0] = 1
            _tables[i] = np.multiply.accumulate(steps)
    return _tables


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of ``values`` is one difference (see :func:`run_hashes`)."""
    power = powers(len(values) + 1)[0]
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:len(values)], dtype=np.uint64, out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the runs ``[start, end)``; equal runs have equal hashes wherever they lie."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def buffers(texts: list[str | None], step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, ends) of runs of texts of about ``step`` bytes; a longer text is a run of its own."""
    first, parts, total = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if parts and total + len(data) > step:
            yield first, *_joined(parts)
            first, parts, total = i, [], 0
        parts.append(data)
        total += len(data) + 1
    if parts:
        yield first, *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts, starts + lengths


def segment_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of ``values[low:high]`` (float64), each independent of its neighbours; an empty segment is 0."""
    shape = (len(low), *values.shape[1:])
    full = high > low
    if not full.any():
        return np.zeros(shape)
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
    edges = np.stack([low[full], high[full]], axis=1).ravel()
    out = np.zeros(shape)
    out[full] = np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
    return out


class Hasher:
    """Buckets of byte n-grams (``orders``, at most 4) and, with ``words``, of
    words and of neighbouring word pairs.

    A pair is named by the *difference* of its words' hashes, so that a word
    said twice running always falls into one bucket.
    """

    def __init__(self, bits: int, orders: tuple[int, ...], words: bool):
        self.bits, self.orders, self.words = bits, orders, words

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def _bucket(self, names: np.ndarray, kind: int) -> np.ndarray:
        mixed = (names + np.uint64(kind)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int32)

    def parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(buckets, low, high): the features of row i are ``buckets[low[i]:high[i]]``, for each kind."""
        code, wide = data.astype(np.uint32), data.astype(np.uint32)
        for order in range(1, max(self.orders, default=0) + 1):
            if order > 1:
                code = code[:-1] | (wide[order - 1:] << np.uint32(8 * (order - 1)))
            if order in self.orders:
                mixed = (code + np.uint32(order)) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x85EBCA77)
                high = np.maximum(ends - order + 1, starts)
                yield (mixed >> np.uint32(32 - self.bits)).astype(np.int32), starts, high
        if self.words:
            yield from self._word_parts(data, starts, ends)

    def _word_parts(self, data, starts, ends):
        inside = data > 32
        edge = np.diff(inside.astype(np.int8), prepend=0)
        first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is a line feed
        names = run_hashes(prefix_sums(data), first, after)
        low, high = np.searchsorted(first, starts), np.searchsorted(first, ends)
        yield self._bucket(names, 7), low, high
        if len(names) > 1:
            yield self._bucket(names[1:] - names[:-1], 11), low, np.maximum(high - 1, low)

    def row_features(self, text: str | None) -> np.ndarray:
        """All features of one text."""
        (_, data, starts, ends), = buffers([text])
        return np.concatenate([b[lo[0]:hi[0]] for b, lo, hi in self.parts(data, starts, ends)])

    def mean_weights(self, texts: list[str | None], weights: np.ndarray) -> np.ndarray:
        """Mean of ``weights[bucket]`` over each text's features (0 without features): rows x columns."""
        out = np.zeros((len(texts), weights.shape[1]))
        for first, data, starts, ends in buffers(texts):
            total, count = np.zeros((len(starts), weights.shape[1])), np.zeros(len(starts))
            for bucket, low, high in self.parts(data, starts, ends):
                total += np.stack([segment_sums(w[bucket], low, high) for w in weights.T], axis=1)
                count += high - low
            out[first:first + len(starts)] = total / np.maximum(count, 1)[:, None]
        return out
