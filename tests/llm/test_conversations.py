import hashlib
import random
from functools import lru_cache

import pytest

from scrivel.llm import conversations as C


def brute(initials, fault, before=0):
    """Over all edits, by the definition: (cost, audit) for each role that may stand last."""
    allow = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
    n = len(initials)

    @lru_cache(None)
    def ways(j, state):
        """All least (cost, audit) from row j on, by last role; insertions only before a retained row."""
        if j == n:
            return {state: (0, "")}
        out = {}

        def add(cost, edits, follow):
            for q, (c, a) in follow.items():
                out[q] = min(out.get(q, (10**9, "")), (cost + c, edits + a))

        add(3, "D", ways(j + 1, state))
        if fault[j] in (0, 3):
            for inserts in range(3):
                now = state
                good = True
                for _ in range(inserts):
                    nxt = 3 if now == 2 else 2
                    good = good and (now, nxt) in allow
                    now = nxt
                for q in (1, 2, 3):
                    if not good or (now, q) not in allow:
                        continue
                    own = {"s": 1, "u": 2, "a": 3}.get(initials[j])
                    for edit, cost in (("K", 0), ("R", 2)):
                        if edit == "K" and own != q or edit == "R" and q == 1:
                            continue
                        add(2 * inserts + cost + (fault[j] == 3), "I" * inserts + edit, ways(j + 1, q))
        return out

    return ways(0, before)


@pytest.mark.parametrize("seed", range(6))
def test_solve_is_the_least_over_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.randrange(0, 9)
        initials, fault = [rng.choice("suax" if rng.random() < 0.3 else "ua") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        for before in range(4):
            got, want = C.solve(initials, fault, before), brute(initials, fault, before)
            assert {q: (w.cost, w.audit) for q, w in got.items()} == want
            assert sorted(got, key=lambda q: got[q].rank) == sorted(got, key=lambda q: got[q].audit)


def expected(rows):
    """One conversation after damage: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ", t) for t, r, x in rows))
    fault, seen = [], set()
    for *_, role, text, _t in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[4] for r in rows if r[4] is not None]
    best = min((c + 2 * C._AFTER[q], a + "I" * C._AFTER[q]) for q, (c, a) in brute(tuple(initials), tuple(fault)).items())
    lines, k, state = [], 0, 0
    for e in best[1]:
        if e == "D":
            k += 1
            continue
        due = 3 if state == 2 else 2
        if e == "K":
            state = {"s": 1, "u": 2, "a": 3}[initials[k]]
            lines.append(f"{rows[k][2]}:{rows[k][3]}")
        else:
            state = due
            lines.append({2: "user", 3: "assistant"}[due] + ":" + (rows[k][3] if e == "R" else ""))
        k += e != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(fault.count(k) for k in (1, 2, 3)), illegal, best[0], best[1], hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "cut, ", "", " \t", "Some words here.\n", "é.", None]
    return [(conv if conv else None, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "user "]), rng.choice(texts)) for conv in [rng.randrange(n) for _ in range(9 * n)]]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_repair_against_all_edits(spark, monkeypatch, bits):
    """Small blocks: conversations go over many pieces, each begun from every role."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rows = made(bits, 40)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos int, seg string").repartition(3)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    got = {r.conv_id: tuple(r)[1:] for r in C.report(frame, frame).collect()}
    assert got == {conv: expected(own) for conv, own in by.items()}


def test_long_conversations(spark):
    """One conversation has most rows: its repair is the same as in one piece, and its turns come in order."""
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), f"{k}." if rng.random() < 0.9 else f"cut {k}") for k in range(6000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    summary, turns = C.repair(frame)
    one = {r.conv_id: r for r in summary.collect()}
    own = rows[:6000]
    ways = C.solve([r[2][0] for r in own], [0 if r[3][-1] == "." else 3 for r in own], 0)
    best = min((w.cost + 2 * C._AFTER[q], w.audit + "I" * C._AFTER[q]) for q, w in ways.items())
    assert (one[7].cost, one[7].audit) == best and one[8].audit == "KK"
    roles = "".join(r.role[0] for r in turns.where("conv_id = 7").orderBy("place").collect())
    assert roles.removeprefix("s") == "ua" * (len(roles) // 2) and [r.place for r in turns.where("conv_id = 7").orderBy("place").collect()] == list(range(len(roles)))


def test_damage_and_empty(spark):
    assert C.report(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0
    given = spark.createDataFrame([(5, 1, "user", "Hi."), (None, None, None, None)], SCHEMA)
    rows = C.report(given, spark.createDataFrame([], SCHEMA)).collect()
    assert {r.conv_id for r in rows} == {5, None} and all(r.cost == 0 and r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    many = spark.createDataFrame([(k, 0, "assistant", "Yes. No!") for k in range(400)], SCHEMA)
    got = C.damage(many).collect()
    import zlib

    kinds = [zlib.crc32(f"{k}:0".encode()) % 20 for k in range(400)]
    want = [(k, "user" if x == 4 else "assistant", {1: "", 2: "Yes No"}.get(x, "Yes. No!")) for k, x in enumerate(kinds) if x for _ in range(1 + (x == 3))]
    assert sorted((r.conv_id, r.role, r.text) for r in got) == sorted(want)
