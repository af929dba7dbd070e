"""Conversation repair against exhaustive search and a plain dynamic program."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from plumbline.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, segment int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 1:
            text = ""
        elif lot == 2:
            text = re.sub("[.!?]", "", text)
        elif lot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0d]", text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def dynamic(rows, marks):
    """(cost, audit) by a table of best audits per state of the output so far."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "")}

    def inserts(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for new in follow[state].replace("s", ""):
                    best[new] = min(best.get(new, (10**9, "")), (cost + 3, audit + "I"))
        return best

    for (_, _, role, _), fault in zip(rows, marks):
        now = {}
        for state, (cost, audit) in inserts(best).items():
            options = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for new in follow[state]:
                    if role[:1] == new:
                        options.append((new, more, "K"))
                    if new != "s":
                        options.append((new, 3 + more, "R"))
            for new, price, edit in options:
                now[new] = min(now.get(new, (10**9, "")), (cost + price, audit + edit))
        best = now
    best = inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def exhaustive(rows, marks):
    best = None
    n = len(rows)
    for gaps in product(range(3), repeat=n + 1):
        for edits in product("DKR", repeat=n):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""]))
            cost, state, at = 0, "", 0
            for edit in audit:
                new = "a" if state == "u" else "u"
                if edit == "I":
                    cost, state = cost + 3, new
                    continue
                role, fault = rows[at][2], marks[at]
                at += 1
                if edit == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    break
                if edit == "K":
                    if role[:1] != new and not (state == "" and role[:1] == "s"):
                        break
                    new = role[:1]
                cost += (3 if edit == "R" else 0) + 3 * (fault == "truncated")
                state = new
            else:
                if state in ("", "a") and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def text_of(rows, audit):
    out, at, state = [], 0, ""
    for edit in audit:
        new = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[new]
        if edit == "I":
            out.append(f"{full}:")
            state = new
            continue
        _, _, role, text = rows[at]
        at += 1
        if edit != "D":
            out.append(f"{full if edit == 'R' else role}:{text}")
            state = new if edit == "R" else role[:1]
    return "\n".join(out)


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = damaged([r for r in table if r[0] == conv])
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(rows)
        known = {r[1] for r in rows if r[1] is not None}
        first = [r[2][:1] for r in rows]
        cost, audit = dynamic(rows, marks)
        out[conv] = (
            max(known) - min(known) + 1 - len(known) if known else 0,
            *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            cost,
            audit,
            hashlib.sha256(text_of(rows, audit).encode()).hexdigest(),
        )
    return out


def got(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def conversations(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        turn = rng.choice([0, 0, 5, -3])
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "Assistant", "ua"])
            text = rng.choice(["Yes.", "No!", "why?  \n", "cut", None, "", " \t", "é…", f"{rng.random()}.", f"{rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows + rows[:5]


@pytest.mark.parametrize("segment", [4, 1024])
def test_repair_equals_dynamic_program(spark, monkeypatch, segment):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    rows = conversations(segment, 60, 12) + conversations(segment + 1, 2, 90)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    want = brute(rows)
    assert got(turns.repair(table)) == want
    assert any(len(w[6]) > 3 * 4 for w in want.values())


def test_empty_table_dropped_rows_and_repeats(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert turns.repair(frame([])).collect() == []
    dropped = next(i for i in range(999) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = [(dropped, 1, "user", "Hi.")]
    assert got(turns.repair(frame(rows))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} == brute(rows)
    rows = [(3, 2, "user", "Hi.")] * 7 + [(3, None, "assistant", "long " * 5000)] + [(4, None, "system", "Be brief.")]
    assert got(turns.repair(frame(rows))) == brute(rows)


def test_dynamic_program_equals_exhaustive_search():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "cut", "", "c!"])) for i in range(rng.randrange(5))]
        marks = faults(rows)
        assert dynamic(rows, marks) == exhaustive(rows, marks)


def test_crossings_choose_the_least_audit():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.choice([0, 0, 1, 2]), rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(1, 14))]
        costs, closing = zip(*turns.CLOSING)
        whole = "".join(turns.edits_of(rows, turns.START, list(costs), closing))
        audit, cost, _, _ = turns.repaired(rows, turns.START, None)
        plain, marks = [], []
        for initial, kind, copies in rows:
            plain += [(0, 0, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[initial], "")] * copies
            marks += [["", "truncated", "blank"][kind], *["duplicate"] * (copies - 1)]
        assert (cost, audit) == dynamic(plain, marks) and audit.startswith(whole)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(turns.op11_repair(spark, sf)) == brute(rows)
