"""Conversation repair against a search over all edits, and the query against the contract turn by turn."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from motifloom.llm import conversations as C
from motifloom.llm import queries as Q

GOOD = re.compile(r"(s?(ua)+)?")


def slow_solve(signature):
    """Dijkstra over (turns done, roles given); the cheapest audit, then the least by ASCII."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, given = heapq.heappop(heap)
        if i == len(signature) and GOOD.fullmatch(given):
            return cost, audit
        state = (i, given[-1:], len(given) > 0)
        if state in seen:
            continue
        seen.add(state)
        ways = [(3, "I", i, r) for r in "ua"]
        if i < len(signature):
            turn, extra = signature[i], 3 * signature[i].isupper()
            ways.append((4, "D", i + 1, ""))
            if turn != "d":
                ways += [(extra, "K", i + 1, turn.lower())] + [(3 + extra, "R", i + 1, r) for r in "ua"]
        for paid, edit, j, role in ways:
            if role == "" or GOOD.fullmatch(given + role) or GOOD.fullmatch(given + role + "a") or GOOD.fullmatch(given + role + "ua"):
                heapq.heappush(heap, (cost + paid, audit + edit, j, given + role))
    raise AssertionError


def test_all_short_signatures():
    for n in range(5):
        for letters in product("suaxSUd", repeat=n):
            assert C.solve("".join(letters)) == slow_solve("".join(letters))


@pytest.mark.parametrize("seed", range(3))
def test_long_signatures(seed):
    rng = random.Random(seed)
    for _ in range(25):
        s = "".join(rng.choice("suauauauaxSUAXd") for _ in range(rng.randint(5, 40)))
        assert C.solve(s) == slow_solve(s)
    cost, audit = C.solve("s" + "ua" * 50_000 + "d" + "uA" * 3)
    assert cost == 4 + 9 and audit.count("K") == 100_007


def contract(rows):
    """conv_id -> the row that the contract asks for, straight from its words."""
    given = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        given.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1))
    out = []
    for conv, turns in given.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        signature, seen, faults = "", set(), {"b": 0, "d": 0, "t": 0}
        for _, role, text in turns:
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            words = text.strip("\t\n\x0b\x0c\r ")
            fault = "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            signature += "d" if fault in ("b", "d") else letter.upper() if fault else letter
        initials = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = slow_solve(signature)
        lines, i, last = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else turns[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def asked(spark, path):
    got = Q.op12_repair_conversations(spark, path).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, got.collect()), key=repr)


SCHEMA = "conv_id bigint, turn int, role string, text string, cid string, place int"


@pytest.mark.parametrize("parts", [1, 7])
def test_query_equals_the_contract(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = []
    for conv in [*range(60), None]:
        turn = rng.choice([0, 5])
        for k in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            role = rng.choice(["user", "assistant", "system"]) if rng.random() < 0.4 else ("assistant" if k % 2 else "user")
            text = rng.choice(["Yes.", "Yes.", f"w{rng.random()}!", f"é{rng.random()} \n", " \t", "", None, "a? ", "x ", "y. ", "z.\x85"])
            rows.append((conv, rng.choice([turn, turn, turn, turn, None]), rng.choice([role] * 12 + [None, "", "tool", "unknown"]), text))
            turn += rng.choice([1, 1, 1, 2, 0])
    rows += [(900, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(700)] + [(901, 3, "user", "same.")] * 50 + [rows[0]]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    frame.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    assert asked(spark, str(tmp_path)) == contract(rows)


def test_conversations_that_lose_all_rows_and_empty_tables(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0)], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    empty = hashlib.sha256(b"").hexdigest()
    assert asked(spark, str(tmp_path)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert asked(spark, str(tmp_path / "none")) == []


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "Q?"), (1, 2, "user", "Q?")], "conv_id int, turn int, role string, text string")
    summary, repaired = C.repair_conversations(rows)
    (row,) = summary.collect()
    assert (row.duplicate, row.illegal) == (1, 2) and (row.cost, row.audit) == slow_solve("saud")
    got = [(r.place, r.edit, r.role, r.text) for r in repaired.orderBy("place").collect()]
    assert [g[0] for g in got] == list(range(len(got))) and GOOD.fullmatch("".join(g[2][0] for g in got))
    assert "".join(g[1] for g in got) == row.audit.replace("D", "")
