"""Word shingles of whole texts, in numpy.

A word is a run of ASCII letters or digits and of bytes above 127, with A-Z
lower-cased; what lies between words does not count.
"""

from __future__ import annotations

import hashlib

import numpy as np

from tablelens.llm.features import _BASE, _MIX, prefix_sums, run_hashes

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[65:91] = _IN_WORD[128:] = True
_SMALL = _LOWER.copy()
_SMALL[~_IN_WORD] = 32

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of joined texts (see features.buffers), and each text's first and end word."""
    inside = _IN_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is a line feed
    words = mixed(run_hashes(prefix_sums(_LOWER[data]), first, after) + (after - first).astype(np.uint64))
    return words, np.searchsorted(first, starts), np.searchsorted(first, ends)


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit shingle) of every run of ``words`` words; a text of fewer words, but not none, has one."""
    hashes, low, high = word_hashes(data, starts, ends)
    rolled = np.zeros(len(hashes) + words, np.uint64)
    padded = np.concatenate([hashes, np.zeros(2 * words, np.uint64)])
    for j in range(words):
        rolled = rolled * _BASE + padded[j:j + len(rolled)]
    count = np.where(high > low, np.maximum(high - low - words + 1, 1), 0)
    text = np.repeat(np.arange(len(low)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    out = mixed(rolled[at] * _MIX)
    last = np.cumsum(count) - 1
    for n in range(1, words):  # short texts: their own words only, and how many
        short = np.flatnonzero(high - low == n)
        value = np.full(len(short), n, np.uint64)
        for j in range(n):
            value = value * _BASE + hashes[low[short] + j]
        out[last[short]] = mixed(value * _MIX)
    return text, out


def words_digest(data: np.ndarray, start: int, end: int) -> bytes:
    """16 bytes that name the word sequence of one text (of its bytes, if it has no word)."""
    part = data[start:end]
    small = _SMALL[part]
    gap = small == 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    norm = small[keep].tobytes().strip(b" ")
    if not norm:
        return hashlib.blake2b(part.tobytes(), digest_size=16, person=b"bytes").digest()
    return hashlib.blake2b(norm, digest_size=16).digest()


def counted(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs and how often each occurs."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))
