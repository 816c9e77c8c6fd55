"""Best-fit packing of token pieces into sequences under several capacities.

Every sequence has a capacity of tokens, of documents and of attention cost
(the sum of squared piece lengths).  Pieces, longest first, go to the open
sequence that holds them under every capacity and has the least weighted norm
of what remains (or the largest weighted dot product of piece and remainder).

Scale: pieces of one length are interchangeable, so best fit runs on the
*histogram* of lengths - at most ``capacity`` rows on the driver, whatever the
number of documents.  Sequences with equal remainders are kept as ranges of
numbers; a placement fills a range at once.  What leaves the driver is a list
of intervals ("pieces of this length with rank a to b go to these sequences at
this offset"); Spark ranks the pieces of each length (a hot length is cut by a
salt) and looks each rank up.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.ranks import gapless_rank
from tablelens.llm.worker import kept, slices
from tablelens.session import materialize

CAPACITY = 2048
PART_CACHE = 300_000
WORD_CACHE = 600_000
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _settled(text: str) -> bool:
    """Whether lower-casing is all that the vocabulary's normalizer would change in letters."""
    if "\u03a3" in text or "\u0130" in text:  # lower-cased by context, or to two characters
        return False
    return unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())


class WordEncoder:
    """``tokenizers`` ids of whole texts, as little-endian unsigned 32-bit bytes.

    This kind of vocabulary never merges across a space or a line feed, so a
    text is cut there and the ids of each distinct part are kept.  A part that
    is a word of letters, with or without closing punctuation, is put together
    from the two; a new word then goes straight to the byte-pair model, and
    any other part through the whole tokenizer.  A text that spells one of the
    special tokens is encoded whole, as they may contain anything.  Each cache
    has two generations of at most ``PART_CACHE`` or ``WORD_CACHE`` entries;
    a full one becomes the old one, and what is asked for again moves up.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        if hasattr(self._model, "_resize_cache"):  # words are kept here; a second cache behind a lock only costs time
            self._model._resize_cache(0)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._parts, self._old_parts = {}, {}
        self._words, self._old_words = {}, {}
        self._closing: dict[str, bytes] = {"": b""}
        # Byte-level vocabularies show a byte as its Latin-1 character if that is printable, else as the next one above 255.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self._shown = dict(zip(shown, map(chr, shown)))
        self._shown |= {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = self._old_words.get(word)
            if found is None:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(self._shown)
                ids = [t.id for t in self._model.tokenize(shown)]
                found = array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()
            if len(self._words) >= WORD_CACHE:
                self._words, self._old_words = {}, self._words
            self._words[word] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self._old_parts.get(part)
        if found is None:
            found = self._new_part(part)
        if len(self._parts) >= PART_CACHE:
            self._old_parts = dict(self._parts)
            self._parts.clear()  # in place: callers hold its methods
        self._parts[part] = found
        return found

    def _new_part(self, part: str) -> bytes:
        if part.isalpha() and (part.isascii() or _settled(part)):
            return self._word(part.lower())
        word = part.rstrip(".,;:!?")
        if word.isalpha() and (word.isascii() or _settled(word)):
            end = part[len(word):]
            closing = self._closing.get(end)
            if closing is None:
                closing = self._closing[end] = self._whole(end)
            return self._word(word.lower()) + closing
        return self._whole(part)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self._special):
            return self._whole(text)
        if text.isascii() or _settled(text):  # fewer distinct parts, same ids
            text = text.lower()
        known, new = self._parts.get, self._part
        return b"".join([known(p) or new(p) if p else b"" for p in text.replace("\n", " ").split(" ")])


def _encoder(path: str) -> WordEncoder:
    return kept(("packing", path), lambda: WordEncoder(path))


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, end_id: int | None,
              with_ids: bool) -> DataFrame:
    """Token pieces: id, piece, start, length, ids_crc32 (and ids). Only longer documents are cut."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        encode = _encoder(tokenizer)
        for batch in slices(batches):
            rows, parts, index, start = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                data = encode(value.as_py()) + end
                for at in range(0, len(data), step):
                    rows.append(i)
                    parts.append(data[at:at + step])
                    index.append(at // step)
                    start.append(at // 4)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [ids, pa.array(index, pa.int32()), pa.array(start, pa.int64()),
                       pa.array([len(p) // 4 for p in parts], pa.int64()),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
                values = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def best_fit(histogram: dict[int, int], capacities: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
             rule: str = "norm") -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """Vector best fit of ``histogram`` (piece length -> count).

    ``capacities``: tokens, documents and attention cost of a sequence.
    ``rule``: "norm" (least weighted norm of the remainder after placing) or
    "dot" (largest weighted dot product of piece and remainder).  Returns the
    number of sequences and intervals (length, first rank, end rank, first
    sequence, pieces per sequence, offset): rank r goes to sequence
    ``first + (r - first_rank) // per`` at ``offset + (r - first_rank) % per * length``.
    """
    cap = np.array(capacities, float)
    weight = np.array(weights, float) / np.maximum(cap, 1.0) ** 2
    ranges: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # remainder -> [(first sequence, number)]
    sequences, out = 0, []
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        piece = (length, 1, length * length)
        if count and any(p > c for p, c in zip(piece, capacities)):
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacities}")
        states = [s for s in ranges if s[0] >= length and s[1] >= 1 and s[2] >= piece[2]]
        if states:
            left = np.array(states, float)
            score = ((left - piece) ** 2 * weight).sum(axis=1) if rule == "norm" else -(left * piece * weight).sum(axis=1)
            states = [states[i] for i in np.lexsort((*left.T[::-1], score))]
        for state in [*states, tuple(capacities)]:
            if not count:
                break
            fresh = state == tuple(capacities)
            per = min(r // p for r, p in zip(state, piece))
            held = [(sequences, -(-count // per))] if fresh else ranges.pop(state)
            if fresh:
                sequences += held[0][1]
            offset, keep = capacities[0] - state[0], []
            for first, number in held:
                if not count:
                    keep.append((first, number))
                    continue
                for per_now, n in ((per, min(number, count // per)), (count % per, 1)):
                    if not n or not per_now or not number or (per_now < per and count >= per):
                        continue
                    out.append((length, rank, rank + per_now * n, first, per_now, offset))
                    after = tuple(r - per_now * p for r, p in zip(state, piece))
                    if after[0] > 0 and after[1] > 0:
                        ranges.setdefault(after, []).append((first, n))
                    rank, count, first, number = rank + per_now * n, count - per_now * n, first + n, number - n
                if number:
                    keep.append((first, number))
            if keep and not fresh:
                ranges.setdefault(state, []).extend(keep)
    return sequences, out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, max_docs: int | None = None,
         max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
         id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences; one row per piece: ``id_col``,
    piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids followed by ``end_id``; only one longer than
    ``capacity`` is cut.  ``max_docs`` and ``max_cost`` default to what a
    sequence of ``capacity`` tokens can hold at most, so that they don't bind.
    Null and empty texts are one piece holding ``end_id`` (no piece where
    ``end_id`` is None).  Repeated rows are packed each; ties are dealt by id
    and piece.  An empty table gives no rows.  Other columns are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()
    capacities = (capacity, max_docs or capacity, max_cost or capacity * capacity)
    pieces = materialize(pieces_of(docs, tokenizer, capacity, id_col, text_col, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    _, intervals = best_fit(histogram, capacities, weights, rule)
    table = np.array(intervals, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    salt = F.struct("id", "piece", "ids_crc32")
    ranked = gapless_rank(pieces, ["length"], salt, [F.col("id"), F.col("piece"), F.col("ids_crc32")],
                          sum(histogram.values()), "rank")
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    high = np.int64(1) << 42  # ranks of one length stay below it

    def place(batches):
        edges = table[:, 0] * high + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(edges, length * high + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(row[:, 3] + nth // row[:, 4]),
                 pa.array(row[:, 5] + nth % row[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    schema = (f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
              + ", sequence_id long, offset long")
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence (of ``pack(..., with_ids=True)``): sequence_id, ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
