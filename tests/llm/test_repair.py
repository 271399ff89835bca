import hashlib
import heapq
import random
import re
import zlib

import pytest
from conftest import FOLDER

from __spark_entry__ import queries
from farelens.llm import conversation_repair
from farelens.llm.common import table

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    """Conversations of (turn, role, text) after damage, in order."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for kept in found.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return found


def solve(rows):
    """(cost, letters, lines) by Dijkstra over (rows read, initials written), letters breaking ties."""
    open_, done = [(0, "", 0, "", ())], set()
    while open_:
        cost, letters, at, last, lines = heapq.heappop(open_)
        if at == len(rows) and last in ("", "a"):
            return cost, letters, lines
        if (at, last) in done:
            continue
        done.add((at, last))
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in ("user", "assistant"):
            if role[0] in following:
                heapq.heappush(open_, (cost + 2, letters + "I", at, role[0], (*lines, role + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(open_, (cost + 3, letters + "D", at + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                if role[:1] and role[:1] in following:
                    heapq.heappush(open_, (more, letters + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in following:
                        heapq.heappush(open_, (more + 2, letters + "R", at + 1, new[0], (*lines, f"{new}:{text}")))


def brute(rows):
    out = []
    for conv, kept in after_damage(rows).items():
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, role, text in kept:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, letters, lines = solve(faulty)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def messy(seed, conversations=120):
    """Conversations with every fault, odd roles, gaps, nulls, repeated texts, and rows that damage drops."""
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = rng.randrange(3)
        for _ in range(rng.choice((1, 2, 3, 5, 9, 30))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"))
            text = rng.choice(("Yes.", "no", "Why? \n", " ", "", None, f"Text {rng.randrange(9)}!", " ", "x.　"))
            rows.append((conv if conv else None, turn, role, text))
            turn += rng.choice((1, 1, 1, 2, 5))
        rows.append((conv if conv else None, None, rng.choice(("system", "user")), "First."))
    return rows


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op13_repair"](spark, FOLDER)
    assert set(COLUMNS) <= set(got.columns) and rows_of(got) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_messy_conversations(spark, seed):
    rows = messy(seed)
    assert rows_of(conversation_repair.repair(spark.createDataFrame(rows, ROWS))) == brute(rows)


def test_one_conversation_over_many_tasks_and_fragments(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "FRAGMENT_ROWS", 7)
    rng = random.Random(5)
    roles = ("user", "assistant", "system", "tool")
    rows = [(7, t, rng.choice(roles), rng.choice(("Yes.", "no", " ", f"T{t}."))) for t in range(0, 1500, 2)]
    rows += [(i, t, roles[t % 2], f"Text {t}.") for i in (6, 8, 9) for t in range(4)]
    got = conversation_repair.repair(spark.createDataFrame(rows, ROWS), partitions=5)
    assert rows_of(got) == brute(rows)


def test_symbols_of_any_grammar_cost_the_same():
    rng = random.Random(2)
    strings = ["".join(rng.choice(conversation_repair.SYMBOLS) for _ in range(n)) for n in (0, 1, 2, 5, 40, 300)]
    plain = conversation_repair.Grammar([])
    first = chr(conversation_repair.FIRST_RULE)
    ruled = conversation_repair.Grammar(["ua", "xx", first + first, "UA", "ox", chr(conversation_repair.FIRST_RULE + 2) + "x"])
    for s in strings:
        assert plain.whole(s) == ruled.whole(s)
        assert all(plain.follow(p, s) == ruled.follow(p, s) for p in conversation_repair.STATES)
    assert len(ruled.compress("uauauaua")) == 2


def test_rules_are_the_commonest_pairs(spark):
    strings = [("uauauaua",)] * 5 + [("suaua",), ("xx",), ("oo",)]
    rules = conversation_repair.learn_rules(spark.createDataFrame(strings, "symbols string"), rounds=2, a_round=1)
    assert rules == ["ua", chr(conversation_repair.FIRST_RULE) * 2]


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(6)]
    extra = ROWS + ", kind int, fault string, symbol string, part long, copy int, dropped string, text_hash string"
    more = spark.createDataFrame([(*r, 1, "f", "s", 2, 3, "d", "h") for r in rows], extra)
    assert rows_of(conversation_repair.repair(more)) == brute(rows)
    assert conversation_repair.repair(spark.createDataFrame([], ROWS)).count() == 0


def test_a_conversation_that_damage_drops(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = rows_of(conversation_repair.repair(spark.createDataFrame([(conv, 0, "user", "Hi.")], ROWS)))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
