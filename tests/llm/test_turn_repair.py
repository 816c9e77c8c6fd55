from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tablelens.llm import turn_repair as tr
from tablelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORDER = re.compile(r"(s?(ua)+)?")
MARK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """Fault of each (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        marks = MARK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def by_all_edits(rows, costs):
    """(cost, audit, lines) by every sequence of edits: up to two inserts before each turn and at the end."""
    found = faults(rows)
    added = [(costs.insert * n, "I" * n, ["%s:" % r for r in rs]) for n in range(3) for rs in itertools.product(("user", "assistant"), repeat=n)]
    options = []
    for (_, role, text), fault in zip(rows, found):
        ways = [(costs.delete, "D", [])]
        if fault not in ("blank", "duplicate"):
            stay = costs.truncated if fault else 0
            ways += [(stay, "K", [f"{role}:{text}"])]
            ways += [(stay + costs.rerole, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
        options += [added, ways]
    best = None
    for chosen in itertools.product(*options, added):
        cost, audit = sum(c[0] for c in chosen), "".join(c[1] for c in chosen)
        if best and (cost, audit) >= best[:2]:
            continue
        lines = [line for c in chosen for line in c[2]]
        if ORDER.fullmatch("".join(line[:1] for line in lines)):
            best = cost, audit, lines
    return best


def by_strings(rows, costs=tr.Costs()):
    """(cost, audit, lines) by keeping the least (cost, audit) of every state after every turn."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def widen(states):
        for _ in range(2):
            for state, (cost, audit, lines) in list(states.items()):
                for letter, to in after[state].items():
                    if letter != "s":
                        new = (cost + costs.insert, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[letter]])
                        states[to] = min(states.get(to, new), new)
        return states

    states = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults(rows)):
        stay, new = costs.truncated if fault else 0, {}
        for state, (cost, audit, lines) in widen(dict(states)).items():
            offers = [(state, (cost + costs.delete, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                if role[:1] in after[state]:
                    offers.append((after[state][role[:1]], (cost + stay, audit + "K", [*lines, f"{role}:{text}"])))
                offers += [(after[state][r[:1]], (cost + stay + costs.rerole, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant") if r[:1] in after[state]]
            for to, offer in offers:
                new[to] = min(new.get(to, offer), offer)
        states = new
    return min(v for s, v in widen(dict(states)).items() if s in ("", "a"))


def order(r):
    turn, role, text = r
    return turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest()


def brute(rows, costs=tr.Costs(), solve=by_strings):
    """What is wanted of (conv, turn, role, text) rows: conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=order)
        found, numbers = faults(turns), [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = solve(turns, costs)
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        row = (conv, turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
        out += [row] * (2 if harm == 3 else 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run(spark, rows, costs=tr.Costs()):
    found = tr.repair(rows if hasattr(rows, "columns") else frame(spark, rows), costs=costs)
    told = {r.conv_id: (r.audit, r.repaired_sha256) for r in found.digests().collect()}
    counts = found.counts.collect()
    assert len(counts) == len(told)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *told[r.conv_id]) for r in counts}


def random_rows(rng, convs, longest, texts=6):
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(["", " \t", "Yes.", "No", "Why? \n"] + [f"t{i}" + rng.choice([".", "!", "", "? "]) for i in range(texts)])
            out.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return out


OTHER_COSTS = [tr.Costs(), tr.Costs(1, 5, 1, 3), tr.Costs(3, 2, 1, 1), tr.Costs(2, 4, 2, 0)]


@pytest.mark.parametrize("costs", OTHER_COSTS)
def test_machine_against_all_edits(costs):
    rng = random.Random(11)
    machine = tr.Repair(costs)
    for _ in range(60):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "a.", "b", f"c{t}."])) for t in range(rng.randint(1, 3))]
        want = by_all_edits(rows, costs)
        assert by_strings(rows, costs) == want
        codes = bytes(tr.symbol(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults(rows)))
        vector, total = machine.forward(machine.at(0), codes)
        cost, end = machine.last(vector)
        assert total + cost == want[0] and "".join(machine.path(codes, 0, end)) + "I" * tr.INSERTS_TO_END[end] == want[1]


@pytest.mark.parametrize("costs", OTHER_COSTS)
def test_long_conversations_and_their_parts(costs):
    """The halves meet where the strings do, also when a conversation is cut into parts."""
    rng = random.Random(12)
    machine = tr.Repair(costs)
    for n in (40, 301):
        rows = [(t, rng.choice(["user", "assistant", "system"]), rng.choice(["", "a.", "b", f"c{t}.", f"d{t}"])) for t in range(n)]
        codes = bytes(tr.symbol(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(rows, faults(rows)))
        want = by_strings(rows, costs)
        whole, total = machine.forward(machine.at(0), codes)
        assert machine.path(codes, 0, machine.last(whole)[1]) and total + machine.last(whole)[0] == want[0]
        at, vector, total, ways = 0, machine.at(0), 0, []
        cuts = sorted(rng.sample(range(1, n), 7)) + [n]
        for cut in cuts:
            vector, more, back = machine.join(vector, [machine.forward(machine.at(p), codes[at:cut]) for p in range(4)])
            total, at = total + more, cut
            ways.append(back)
        cost, end = machine.last(vector)
        audit = "I" * tr.INSERTS_TO_END[end]
        for low, high, back in zip(reversed([0, *cuts[:-1]]), reversed(cuts), reversed(ways)):
            audit = "".join(machine.path(codes[low:high], back[end], end)) + audit
            end = back[end]
        assert (total + cost, audit) == want[:2]


@pytest.mark.parametrize("costs", OTHER_COSTS[:2])
def test_random_conversations(spark, costs):
    rows = random_rows(random.Random(13), 60, 12)
    assert run(spark, rows, costs) == brute(rows, costs)


def test_one_conversation_over_many_ranges(spark, request):
    """A conversation with most rows is cut into ranges; the crossings between them give the same repair."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rng = random.Random(14)
    rows = random_rows(rng, 10, 6)
    rows += [(77, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"x{t}.", f"y{t}", "same.", ""])) for t in range(3000)]
    rows += [(99, t // 3, "user", "again.") for t in range(900)]
    df = frame(spark, rows)
    ranged = tr._ranged(tr._turns(df, "conv_id", "turn", "role", "text"))
    assert ranged.where("__conv = 77").select("__part").distinct().count() > 3
    assert run(spark, df) == brute(rows)


def test_repaired_turns_are_in_order(spark):
    rows = random_rows(random.Random(15), 40, 10)
    turns = {}
    for r in sorted(tr.repair(frame(spark, rows)).turns().collect(), key=lambda r: (r.conv_id, r.place)):
        assert r.place == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    want = brute(rows)
    assert all(ORDER.fullmatch("".join(x[0] for x in t)) for t in turns.values())
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: v[-1] for c, v in want.items()}


def test_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (1, None, "user", "A."), (1, None, None, "B."), (1, 5, "assistant", None),
            (2, 0, "user", "a" * 200_000 + "."), (2, 1, "assistant", "é。"), (3, 0, "system", "Only."), (4, 0, "user", "x."), (4, 0, "user", "x."),
            (4, 1, "assistant", "x."), (5, -(1 << 63), "user", "a."), (5, (1 << 63) - 1, "assistant", "b."), (6, None, "user", "　")]
    want = brute(rows)
    want[5] = ((1 << 63) - 1, *want[5][1:])
    assert run(spark, rows) == want


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == {}
    rows = random_rows(random.Random(16), 5, 5)
    df = frame(spark, rows)
    more = df.selectExpr("*", "conv_id as __conv", "role as __role", "1 as cost", "text as `a.b`")
    assert run(spark, more) == run(spark, df)
    named = df.withColumn("conv_id", df.conv_id.cast("string"))
    assert {int(k): v for k, v in run(spark, named).items()} == brute(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. b! c? {t}") for c in range(30) for t in range(10)] + [(None, 3, None, None), (4, None, "user", None), (None, None, "user", "x.")]
    got = sorted((tuple(r) for r in tr.damaged(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute_damage(rows), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    sf_dir = SF.replace("sf0.001", sf)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | brute(brute_damage(rows))
    q = QUERIES["op11_turn_repair"](spark, sf_dir)
    assert q.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in q.collect()} == want
