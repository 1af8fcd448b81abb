"""Conversation repair against a plain search over all edit sequences' states."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from casetrail.llm import conversations, queries

FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, audit long"
BARE = re.compile("[^\x20\x09-\x0d]")


def dynamic(rows):
    """Cheapest (cost, audit, lines) by going through the rows forward with the best of each state; ties by audit."""
    def grow(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                role, after = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}[state]
                found = (cost + 5, audit + "I", [*lines, f"{role}:"])
                if after not in best or found[:2] < best[after][:2]:
                    best[after] = found
        return best

    best = grow({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}

        def offer(state, found):
            if state not in new or found[:2] < new[state][:2]:
                new[state] = found

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            first = role[:1]
            if (state, first) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                offer(first, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            other = "assistant" if state == "u" else "user"
            offer(other[0], (cost + more + 1, audit + "R", [*lines, f"{other}:{text}"]))
        best = grow(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda f: f[:2])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        roll = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if roll == 0:
            continue
        text = "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text
        out += [(turn, "user" if roll == 4 else role, text)] * (2 if roll == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))


def judged(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = BARE.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        left = damaged([r[:4] for r in rows if r[0] == conv])
        told = judged(left)
        turns = [r[0] for r in left if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(t[2] == f for t in told) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        cost, audit, lines = dynamic(told)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(spark, rows):
    got = conversations.damaged_and_repaired(spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "supervisor", "Ünter"]


def chats(seed, convs, longest):
    rnd = random.Random(seed)
    out = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if rnd.random() < 0.8 else rnd.choice(ROLES)
            text = rnd.choice(["Yes.", "No!", "Why?", "so", f"Text {turn}.", f"Text {turn} and", "\n\t ", "", "Über é. ", "a ", "x.\u0085", "x.\x0b"])
            out.append((conv, rnd.choice([turn, turn, turn, 2 * turn, None]) if rnd.random() < 0.2 else turn, role, text))
    return out


def test_equals_search(spark):
    odd = [(None, 1, "user", "A."), (None, None, None, None), (None, 2, "assistant", "B."), (700, None, "system", "S."), (700, None, "system", "S."), (701, 3, None, "x.")]
    odd += [(conv, 0, "user", "gone") for conv in range(800, 860)]
    odd += [(900, 5, "user", "Hi.\n" * 30000), (900, 6, "assistant", "x" * 200000 + ".")] + [(901, t, "user", "again.") for t in range(90)]
    same(spark, chats(1, 120, 40) + odd)


def test_long_conversation_over_partitions(spark):
    """One conversation holds most rows: it lies in several partitions and blocks, and the answer is that of the whole."""
    rows = [(7000, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"t{t % 900}" + ("." if t % 7 else "")) for t in range(9000)]
    frame = spark.createDataFrame([(*r, "c", 1, 2) for r in rows + chats(2, 20, 9)], SCHEMA)
    found, pieces = conversations.repair(conversations.damage(frame))
    assert pieces.where("conv = 'c7000'").select("part").distinct().count() > 3
    got = {r.conv: tuple(r[f] for f in FIELDS) for r in found.collect()}
    want = brute(rows)[7000]
    assert got["c7000"] == want


@pytest.mark.parametrize("seed", range(3))
def test_auctions_equal_search_for_all_ends(seed):
    """Every pair of states, short random stretches: costs, and traces through exact prices."""
    rnd = random.Random(seed)
    for _ in range(300):
        codes = bytes(rnd.choices(range(12), k=rnd.randint(1, 40)))
        rows = [(("system", "user", "assistant", "tool")[c % 4], str(i), ("", "truncated", "blank")[c // 4]) for i, c in enumerate(codes)]
        cost, audit, lines = dynamic(rows)
        to = conversations.costs(codes)
        assert min(to[0][q] + conversations.FINAL[q] for q in range(4)) == cost
        letters, states = conversations.plan(codes, conversations.FINAL, [0])[0]
        assert "".join(letters) + "I" * conversations.TRAILING[states[-1]] == audit
        cut = rnd.randint(0, len(codes))
        a, b = conversations.costs(codes[:cut]), conversations.costs(codes[cut:])
        assert all(to[p][q] == min(min(a[p][m] + b[m][q] for m in range(4)), conversations.INF) for p in range(4) for q in range(4))


def test_audits_are_least_among_all_edits():
    """All edit sequences of short conversations, listed outright."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def every(rows, state="", cost=0, audit="", inserts=0):
        if not rows and state in ("", "a"):
            yield cost, audit
        if inserts < 3:
            yield from every(rows, step[state], cost + 5, audit + "I", inserts + 1)
        if rows:
            role, _, fault = rows[0]
            yield from every(rows[1:], state, cost + 2, audit + "D", inserts)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[0] == step[state] or (state == "" and role[0] == "s"):
                    yield from every(rows[1:], role[0], cost + more, audit + "K", inserts)
                yield from every(rows[1:], step[state], cost + more + 1, audit + "R", inserts)

    rnd = random.Random(5)
    for _ in range(200):
        codes = bytes(rnd.choices(range(12), k=rnd.randint(1, 5)))
        rows = [(("system", "user", "assistant", "tool")[c % 4], str(i), ("", "truncated", "blank")[c // 4]) for i, c in enumerate(codes)]
        letters, states = conversations.plan(codes, conversations.FINAL, [0])[0]
        assert min(every(rows))[1] == "".join(letters) + "I" * conversations.TRAILING[states[-1]]


def test_empty_and_query(spark):
    assert conversations.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, folder).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == brute(rows)
