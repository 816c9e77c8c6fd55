"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is in order if its role initials are nothing or ``s?(ua)+``.
An edit keeps a turn (K), gives it the role that is due (R), deletes it (D) or
inserts an empty turn of the role that is due (I).  Four states describe what
has been read: nothing, ``s``, ``...u``, ``...a``.  The audit is the edits'
initials; wanted is a cheapest edit whose audit is the least in ASCII order.

*Vectors.*  A forward vector has, for each state, the least cost of reaching it
and the rank of its least audit among the states' audits (audits up to a turn
never are prefixes of each other, so ranks carry over from turn to turn); a
backward vector has the costs of what is left.  Apart from a common amount few
vectors occur, so a step is one look-up.

*Reconstruction.*  Forward and backward vectors meet in the middle; of the
cheapest crossings the one of least rank is taken, and both halves are solved
alike.  Only the turns' symbols (a byte each) and the edits are held.

*Spark.*  Turns become narrow rows (role, digest of the text, flags); equal rows
of one turn number are one row with a count.  They are sorted by conversation
and turn into ranges, so a conversation of any length is spread over tasks.
Each task sums up its part of a conversation as vectors from all four states;
the first and last part of every range (two rows a range) meet on the driver,
which chooses the crossings between ranges; then each part is solved alone.
Texts move once, for the replay: edits and texts are sorted by conversation and
streamed, never gathered, because a digest of a whole conversation (SHA-256) is
one chain over its bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.worker import free
from tablelens.session import materialize

TAKES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # state -> role initial -> state
DUE = "uuau"  # the initial of an inserted or re-roled turn
INSERTS_TO_END = (0, 2, 1, 0)
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
KEYS = ["__conv", "__known", "__turn", "__role", "__digest"]
ROWS_AT_ONCE = 5000

Vector = tuple[tuple[int | None, ...], tuple[int, ...]]  # costs of the states, states in order of their audits


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # of a truncated turn that is not deleted


def symbol(initial: str, gone: bool, cut: bool) -> int:
    """One byte for all that the repair needs of a turn."""
    return 0 if gone else 1 + 2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + cut


class Repair:
    """Steps of the four-state machine over turn symbols, kept once computed."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.ending = tuple(n * costs.insert for n in INSERTS_TO_END)
        # no state that is dearer than another by more than this can be on a cheapest way
        self.most = 4 * (costs.rerole + costs.delete + costs.insert + costs.truncated)
        self.steps = [[self._step(s, p) for p in range(4)] for s in range(9)]
        self._ahead: dict = {}
        self._behind: dict = {}

    def _step(self, code: int, start: int) -> dict[int, tuple[int, str]]:
        """State after one turn -> (cost, audit) of the best edits: up to two inserts, then what becomes of the turn."""
        best: dict[int, tuple[int, str]] = {}

        def offer(state, cost, audit):
            best[state] = min(best.get(state, (cost, audit)), (cost, audit))

        state, gone = start, code == 0
        letter, cut = "" if gone else "sua?"[(code - 1) // 2], 0 if gone else (code - 1) % 2
        for inserts in range(3):
            cost, audit = inserts * self.costs.insert, "I" * inserts
            offer(state, cost + self.costs.delete, audit + "D")
            stay = cost + cut * self.costs.truncated
            if not gone:
                offer(TAKES[state][DUE[state]], stay + self.costs.rerole, audit + "R")
            if letter in TAKES[state]:
                offer(TAKES[state][letter], stay, audit + "K")
            state = TAKES[state][DUE[state]]
        return best

    @staticmethod
    def at(state: int) -> Vector:
        return tuple(0 if s == state else None for s in range(4)), (state,)

    def ahead(self, vector: Vector, code: int) -> tuple[Vector, int]:
        """The forward vector after one more turn, and the amount all its costs have lost."""
        if (vector, code) not in self._ahead:
            costs, order = vector
            found: dict = {}
            for rank, p in enumerate(order):
                for q, (cost, audit) in self.steps[code][p].items():
                    offer = (costs[p] + cost, rank, audit)
                    found[q] = min(found.get(q, offer), offer)
            least = min(found.values())[0]
            live = sorted((q for q in found if found[q][0] - least <= self.most), key=lambda q: found[q][1:])
            after = tuple(found[q][0] - least if q in live else None for q in range(4))
            self._ahead[vector, code] = (after, tuple(live)), least
        return self._ahead[vector, code]

    def behind(self, left: tuple, code: int) -> tuple:
        """Costs of what is left, before one more turn (less a common amount)."""
        if (left, code) not in self._behind:
            ways = [[c + left[q] for q, (c, _) in self.steps[code][p].items() if left[q] is not None] for p in range(4)]
            best = [min(w) if w else None for w in ways]
            least = min(b for b in best if b is not None)
            self._behind[left, code] = tuple(b - least if b is not None and b - least <= self.most else None for b in best)
        return self._behind[left, code]

    def forward(self, vector: Vector, codes) -> tuple[Vector, int]:
        total = 0
        for code in codes:
            vector, more = self.ahead(vector, code)
            total += more
        return vector, total

    def last(self, vector: Vector) -> tuple[int, int]:
        """(cost, state) with which a conversation ends best."""
        costs, order = vector
        cost = min(costs[q] + self.ending[q] for q in order)
        return cost, next(q for q in order if costs[q] + self.ending[q] == cost)

    def path(self, codes: bytes, start: int, end: int) -> list[str]:
        """The edits of each turn on the cheapest way of least audit between two states."""
        out = [""] * len(codes)
        todo = [(0, len(codes), start, end)]
        while todo:
            low, high, p, q = todo.pop()
            if high - low == 1:
                out[low] = self.steps[codes[low]][p][q][1]
                continue
            middle = (low + high) // 2
            (costs, order), _ = self.forward(self.at(p), codes[low:middle])
            left = self.at(q)[0]
            for code in reversed(codes[middle:high]):
                left = self.behind(left, code)
            cross = min((s for s in order if left[s] is not None), key=lambda s: costs[s] + left[s])  # the first of equals
            todo += [(low, middle, p, cross), (middle, high, cross, q)]
        return out

    def join(self, vector: Vector, part: list) -> tuple[Vector, int, dict[int, int]]:
        """``vector`` moved over a part given as (forward vector, amount) from every state; also each state's way in."""
        costs, order = vector
        found: dict = {}
        for rank, p in enumerate(order):
            (inner, inner_order), total = part[p]
            for place, q in enumerate(inner_order):
                offer = (costs[p] + total + inner[q], rank, place, p)
                found[q] = min(found.get(q, offer), offer)
        least = min(found.values())[0]
        live = sorted(found, key=lambda q: found[q][1:3])
        return (tuple(found[q][0] - least if q in found else None for q in range(4)), tuple(live)), least, {q: found[q][3] for q in live}


@lru_cache(4)
def _repair(costs: Costs) -> Repair:
    return Repair(costs)


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows as (KEYS, __text, __blank, __cut); a null role or text is one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    body = F.rtrim(text, F.lit(BLANKS))
    ended = body.endswith(".") | body.endswith("!") | body.endswith("?")
    turn = F.col(turn_col).cast("long")
    return rows.select(
        F.col(conv_col).alias("__conv"), turn.isNotNull().alias("__known"), turn.alias("__turn"), role.alias("__role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("__digest"), text.alias("__text"),
        (body == "").alias("__blank"), ((body != "") & ~ended).alias("__cut"))


def _ranged(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, sorted into ranges; ``__first``: role and text are new here."""
    light = turns.groupBy(*KEYS).agg(F.count("*").alias("__copies"), F.max("__blank").alias("__blank"), F.max("__cut").alias("__cut"))
    firsts = (
        light.where(~F.col("__blank")).groupBy("__conv", "__role", "__digest")
        .agg(F.min(F.struct("__known", "__turn")).alias("__at"))
        .select("__conv", "__at.__known", "__at.__turn", "__role", "__digest", F.lit(0).cast("long").alias("__copies"),
                F.lit(False).alias("__blank"), F.lit(False).alias("__cut"), F.lit(True).alias("__first"))
    )
    marked = materialize(
        light.withColumn("__first", F.lit(False)).unionByName(firsts).groupBy(*KEYS)
        .agg(F.sum("__copies").alias("__copies"), *(F.max(c).alias(c) for c in ("__blank", "__cut", "__first"))))
    ranged = marked.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    return materialize(ranged.withColumn("__part", F.spark_partition_id()))


def _codes(batch: pa.RecordBatch) -> tuple[list, list[str], bytes]:
    """Conversations, role initials and symbols of a batch's rows (of the first copy; the others have to go)."""
    conv, role, first, cut = (batch.column(c).to_pylist() for c in ("__conv", "__role", "__first", "__cut"))
    initials = [r[:1] for r in role]
    return conv, initials, bytes(symbol(i, not f, c) for i, f, c in zip(initials, first, cut))


_PART = ("part int, head boolean, tail boolean, n long, blank long, duplicate long, truncated long, illegal long, low long, high long, "
         "turns long, first_turn long, last_turn long, first_role string, last_role string, cost long, ways string")


def _parts(ranged: DataFrame, costs: Costs) -> DataFrame:
    """One row for each conversation of each range: its counts and, for the outer two, its vectors."""

    def run(batches):
        free()
        repair, part, now, done = _repair(costs), 0, None, []

        def closed(x, tail):
            ways, amounts = x.pop("vectors"), x.pop("amounts")
            x["cost"] = amounts[0] + repair.last(ways[0])[0]
            x["tail"] = tail
            x["ways"] = json.dumps(list(zip(ways, amounts))) if x["head"] or tail else None
            return x

        for batch in batches:
            conv, initials, codes = _codes(batch)
            turn, copies, blank = (batch.column(c).to_pylist() for c in ("__turn", "__copies", "__blank"))
            part = batch.column("__part")[0].as_py() if batch.num_rows else part
            for i, code in enumerate(codes):
                if now is None or conv[i] != now["__conv"]:
                    if now:
                        done.append(closed(now, False))
                    now = {"__conv": conv[i], "part": part, "head": now is None, "n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                           "low": turn[i], "high": None, "turns": 0, "first_turn": turn[i], "last_turn": None,
                           "first_role": initials[i], "last_role": None, "vectors": [repair.at(p) for p in range(4)], "amounts": [0] * 4}
                if now["n"]:
                    now["illegal"] += now["last_role"] + initials[i] not in ("su", "ua", "au")
                now["illegal"] += copies[i] - 1
                now["n"] += copies[i]
                now["blank"] += copies[i] if blank[i] else 0
                now["duplicate"] += 0 if blank[i] else copies[i] - (code > 0)
                now["truncated"] += code > 0 and (code - 1) % 2
                if turn[i] is not None:
                    now["turns"] += turn[i] != now["last_turn"]
                    now["low"], now["high"] = turn[i] if now["low"] is None else now["low"], turn[i]
                now["last_turn"], now["last_role"] = turn[i], initials[i]
                for p in range(4):
                    now["vectors"][p], more = repair.ahead(now["vectors"][p], code)
                    now["amounts"][p] += more + costs.delete * (copies[i] - 1)
            if len(done) >= ROWS_AT_ONCE:
                yield _batch(done, batch, _PART)
                done = []
        if now:
            yield _batch([*done, closed(now, True)], batch, _PART)

    return materialize(ranged.mapInArrow(run, f"__conv {ranged.schema['__conv'].dataType.simpleString()}, {_PART}"))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(rows: list[dict], like: pa.RecordBatch, ddl: str) -> pa.RecordBatch:
    """``rows`` as a batch: the conversation as in ``like``, the other columns as ``ddl`` names them."""
    fields = [like.schema.field("__conv")] + [pa.field(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _crossings(parts: DataFrame, costs: Costs) -> tuple[dict, list]:
    """States between which each part of a split conversation is solved, and what its counts lack.

    Only the first and last part of each range come to the driver.
    """
    repair = _repair(costs)
    edges = parts.where("head or tail").collect()
    chains: list[list] = []
    for x in sorted(edges, key=lambda r: (r["part"], not r["head"])):
        if chains and chains[-1][-1]["tail"] and x["head"] and chains[-1][-1]["__conv"] == x["__conv"]:
            chains[-1].append(x)
        else:
            chains.append([x])
    bounds, lacks = {}, []
    for chain in (c for c in chains if len(c) > 1):
        vector, total, back = repair.at(0), 0, []
        for x in chain:
            ways = [((tuple(v[0]), tuple(v[1])), amount) for v, amount in json.loads(x["ways"])]
            vector, more, ways_in = repair.join(vector, ways)
            total += more
            back.append(ways_in)
        cost, end = repair.last(vector)
        total += cost
        for x, ways_in in zip(reversed(chain), reversed(back)):
            bounds[x["part"], x["__conv"]] = (ways_in[end], end, x is chain[-1])
            end = ways_in[end]
        pairs = list(zip(chain, chain[1:]))
        illegal = sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in pairs)
        twice = sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
        lacks.append((chain[0]["__conv"], illegal, -twice, total - sum(x["cost"] for x in chain)))
    return bounds, lacks


def _edits(ranged: DataFrame, bounds: dict, costs: Costs) -> DataFrame:
    """KEYS with each distinct row's edits: ``__edit`` of its first copy (the others are deleted), ``__inserts`` at the very end."""

    def run(batches):
        free()
        repair = _repair(costs)
        waiting: list[pa.RecordBatch] = []
        edits: list[str] = []
        inserts: list[int] = []
        codes, conv, part, began = bytearray(), None, 0, False

        def solve():
            start, end, last = bounds.get((part, conv), (0, None, True))
            if end is None:
                end = repair.last(repair.forward(repair.at(0), codes)[0])[1]
            edits.extend(repair.path(bytes(codes), start, end))
            inserts.extend([0] * (len(codes) - 1) + [INSERTS_TO_END[end] if last else 0])
            codes.clear()

        def ready():
            while waiting and len(edits) >= waiting[0].num_rows:
                batch = waiting.pop(0)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in (*KEYS, "__copies")] + [pa.array(edits[:n], pa.string()), pa.array(inserts[:n], pa.int32())],
                                                 names=[*KEYS, "__copies", "__edit", "__inserts"])
                del edits[:n], inserts[:n]

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("__part")[0].as_py()
            waiting.append(batch)
            names, _, more = _codes(batch)
            for name, code in zip(names, more):
                if began and name != conv:
                    solve()
                conv, began = name, True
                codes.append(code)
            yield from ready()
        if began:
            solve()
        yield from ready()

    kind = ranged.schema["__conv"].dataType.simpleString()
    return ranged.mapInArrow(run, f"__conv {kind}, __known boolean, __turn long, __role string, __digest binary, __copies long, __edit string, __inserts int")


def _replay(batches) -> Iterator[tuple]:
    """(batch, conversation, edit initials, role or None, text), in order; a role where a turn stays or comes in."""
    conv, state, waiting, began = None, 0, None, False

    def inserted(n):
        nonlocal state
        for _ in range(n):
            role = DUE[state]
            state = TAKES[state][role]
            yield conv, "I", ROLES[role], ""

    def rest(copies, inserts):
        if copies > 1:
            yield conv, "D" * (copies - 1), None, ""
        yield from inserted(inserts)

    def events(batch):
        nonlocal conv, state, waiting, began
        for name, role, text, edit, copies, inserts in zip(*(batch.column(c).to_pylist() for c in ("__conv", "__role", "__text", "__edit", "__copies", "__inserts"))):
            if edit is None:  # a text: of a turn that stays, of a further copy, or of a deleted turn
                if waiting:
                    letter, copies, inserts = waiting
                    due, waiting = DUE[state] if letter == "R" else role[:1], None
                    state = TAKES[state][due]
                    yield conv, letter, ROLES[due] if letter == "R" else role, text
                    yield from rest(copies, inserts)
                continue
            if not began or name != conv:
                conv, state, began = name, 0, True
            yield from inserted(len(edit) - 1)
            if edit[-1] == "D":
                yield conv, "D", None, ""
                yield from rest(copies, inserts)
            else:
                waiting = edit[-1], copies, inserts

    for batch in batches:
        for event in events(batch):
            yield batch, *event


_TURN = "place long, edit string, role string, text string"
_DIGEST = "audit string, repaired_sha256 string"


@dataclass(frozen=True)
class Repaired:
    """``counts``: a row for each conversation (conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost)."""

    counts: DataFrame
    conv_col: str
    _replayed: DataFrame

    def _streamed(self, run, ddl: str) -> DataFrame:
        kind = self._replayed.schema["__conv"].dataType.simpleString()
        return self._replayed.mapInArrow(run, f"__conv {kind}, {ddl}").withColumnRenamed("__conv", self.conv_col)

    def turns(self) -> DataFrame:
        """(conv_id, place from 0, edit, role, text) of every turn that is kept, re-roled or inserted."""

        def run(batches):
            free()
            out, conv, place, began, batch = [], None, 0, False, None
            for batch, name, edit, role, text in _replay(batches):
                if not began or name != conv:
                    conv, place, began = name, 0, True
                if role is not None:
                    out.append({"__conv": name, "place": place, "edit": edit, "role": role, "text": text})
                    place += 1
                if len(out) >= ROWS_AT_ONCE:
                    yield _batch(out, batch, _TURN)
                    out = []
            if out:
                yield _batch(out, batch, _TURN)

        return self._streamed(run, _TURN)

    def digests(self) -> DataFrame:
        """(conv_id, audit, repaired_sha256): the edits' initials and a digest of the repaired ``role:text`` lines."""

        def run(batches):
            free()
            out, conv, audit, digest, lines, began, batch = [], None, [], hashlib.sha256(), 0, False, None

            def closed():
                return {"__conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

            for batch, name, edit, role, text in _replay(batches):
                if not began or name != conv:
                    if began:
                        out.append(closed())
                    conv, audit, digest, lines, began = name, [], hashlib.sha256(), 0, True
                    if len(out) >= ROWS_AT_ONCE:
                        yield _batch(out, batch, _DIGEST)
                        out = []
                audit.append(edit)
                if role is not None:
                    digest.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    lines += 1
            if began:
                yield _batch([*out, closed()], batch, _DIGEST)

        return self._streamed(run, _DIGEST)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           costs: Costs = Costs()) -> Repaired:
    """Faults of every conversation and its cheapest repair, of least audit.

    Turns go by turn number, nulls first; rows of equal number by role, then by
    the SHA-256 of the text.  A null role or text is one space; rows without a
    conversation are one conversation.  A turn without a character other than
    blanks is *blank*; one whose role and text came earlier is a *duplicate*;
    one whose last such character isn't ``.``, ``!`` or ``?`` is *truncated*;
    the first of these counts.  Blank and duplicate turns are always deleted.
    An empty role has no initial: it is never kept and no pair with it is
    legal.  ``gaps`` ends at the largest long.  Other columns don't count; an
    empty table gives empty results.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    ranged = _ranged(turns)
    parts = _parts(ranged, costs)
    bounds, lacks = _crossings(parts, costs)
    edits = _edits(ranged, bounds, costs)
    null = F.lit(None)
    replayed = (
        edits.select(*KEYS, null.cast("string").alias("__text"), "__edit", "__copies", "__inserts")
        .unionByName(turns.where(~F.col("__blank")).select(*KEYS, "__text", null.cast("string").alias("__edit"), null.cast("long").alias("__copies"), null.cast("int").alias("__inserts")))
        .repartition("__conv").sortWithinPartitions(*KEYS, F.col("__edit").isNull())
    )
    columns = ["__conv", "n", "blank", "duplicate", "truncated", "illegal", "cost", "turns", "low", "high"]
    kind = parts.schema["__conv"].dataType.simpleString()
    added = rows.sparkSession.createDataFrame(
        [(conv, 0, 0, 0, 0, illegal, cost, turns, None, None) for conv, illegal, turns, cost in lacks],
        f"__conv {kind}, " + ", ".join(f"{c} long" for c in columns[1:]))
    span = F.max("high").cast("decimal(20,0)") - F.min("low") + 1 - F.sum("turns")
    counts = parts.select(*columns).unionByName(added).groupBy("__conv").agg(
        F.sum("n").alias("n_turns"), F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")))
    return Repaired(counts.withColumnRenamed("__conv", conv_col), conv_col, replayed)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 calls for:
    0 drops the row, 1 empties the text, 2 removes ``.!?``, 3 repeats the row, 4 makes the role ``user``."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    role = F.when(harm == 4, "user").otherwise(shown(role_col))
    text = F.when(harm == 1, "").when(harm == 2, F.translate(shown(text_col), ".!?", "")).otherwise(shown(text_col))
    copies = F.array_repeat(F.lit(0), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1))
    out = rows.select(F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), role.alias("__role"), text.alias("__text"), copies.alias("__copies"))
    return out.withColumn("__copy", F.explode("__copies")).select(
        F.col("__conv").alias(conv_col), F.col("__turn").alias(turn_col), F.col("__role").alias(role_col), F.col("__text").alias(text_col))
