"""Conversation structure repair by auction shortest paths.

A conversation is a lattice: a node for each place before a row and each state (nothing yet, after a system turn, after
a user turn, after an assistant turn), arcs for deleting, keeping or changing the row and for inserting a turn. The
auction extends a path from its origin along the cheapest arc and takes back nodes whose price is too low, raising
the price, until the path ends; prices then are distances along the path, and all cheapest paths consist of tight arcs
(cost = price difference). Among them the least in ASCII order is traced.

A conversation may be longer than a task should hold. Rows are dealt by range, so a long conversation lies in several
partitions (its runs). Each run tells what it costs to go from state to state (auctions to each end); composing these per
conversation gives every run the distances at its end, with which its prices become exact; each run then traces from
every state it may be entered in, and composing these says which trace holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base

INF = 2**60
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or changed turn, and after a kept row of each initial (None: not allowed there).
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
DELETE, INSERT, CHANGE, CUT_OFF = 2, 5, 1, 5
#: Faults of a row; a faulty one of the last kind must go.
FINE, TRUNCATED, GOES = range(3)
#: What is still inserted at the very end in each state: its number of turns; and the price of that.
TRAILING = (0, 2, 1, 0)
FINAL = [INSERT * n for n in TRAILING]
#: Rows of one auction; rows and bytes of text of one stored block.
STRETCH, BLOCK_ROWS, BLOCK_BYTES = 16, 1024, 256 * 1024
SPACE = " \t\n\x0b\x0c\r"


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """Arcs out of a node before a row: letter, cost, how far on in the price array; in ASCII order of the letters."""
    fault, initial = divmod(code, 4)
    more = CUT_OFF if fault == TRUNCATED else 0
    out = [("D", DELETE, 4), ("I", INSERT, NEXT[state] - state)]
    if fault != GOES:
        if KEPT[state][initial] is not None:
            out.append(("K", more, 4 + KEPT[state][initial] - state))
        out.append(("R", CHANGE + more, 4 + NEXT[state] - state))
    return out


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(12)]
#: Least cost of going past a row (insertions move by two places of the price array at most, all others by three or more).
LEAST = [min(cost for arcs in ARCS[code] for _, cost, step in arcs if step >= 3) for code in range(12)]


def auction(codes: bytes, ends: list[int]) -> list[int]:
    """Prices of all nodes (place * 4 + state) for leaving after the last row at price ``ends`` of the state then.

    Exact at the four first nodes (INF where no end can be reached) and along their cheapest paths; elsewhere no more
    than the distance. Starts from the sum of the least cost of each row left, which no arc undercuts.
    """
    n = len(codes)
    # From each state the later ones can be reached, earlier ones not; nothing leads into SYSTEM but kept system rows.
    talk = min(ends[USER], ends[ASSISTANT]) < INF
    lowest = min(ends)
    price = [0] * (4 * n) + list(ends)
    left, systems = lowest, False
    for i in range(n - 1, -1, -1):
        code = codes[i]
        left += LEAST[code]
        systems = systems or code in (FINE * 4, TRUNCATED * 4)
        price[4 * i + USER] = price[4 * i + ASSISTANT] = left if talk else INF
        price[4 * i + SYSTEM] = left if talk or ends[SYSTEM] < INF else INF
        price[4 * i + START] = left if talk or ends[START] < INF or (systems and ends[SYSTEM] < INF) else INF
    goal = 4 * n
    for origin in range(4):
        if price[origin] >= INF:
            continue
        path = [origin]
        while path[-1] < goal:
            at = path[-1]
            best, to = INF, -1
            for _, cost, step in ARCS[codes[at >> 2]][at & 3]:
                value = cost + price[at + step]
                if value < best:
                    best, to = value, at + step
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
                elif best >= INF:
                    break
            else:
                path.append(to)
    return price


def trace(codes: bytes, price: list[int], entry: int) -> list[str]:
    """The ASCII-least cheapest path from state ``entry``: the letters spent on each row, insertions before it first."""
    n = len(codes)
    # Nodes from which tight arcs lead to the end.
    leads = [False] * (4 * n) + [p < INF for p in price[4 * n:]]
    for i in range(n - 1, -1, -1):
        for _ in range(2):  # insertions lead back from ASSISTANT to USER too
            for at in (4 * i + ASSISTANT, 4 * i + USER, 4 * i + SYSTEM, 4 * i):
                if not leads[at] and price[at] < INF:
                    leads[at] = any(leads[at + step] and price[at] == cost + price[at + step] for _, cost, step in ARCS[codes[i]][at & 3])
    letters = [""] * n
    at = entry
    while at < 4 * n:
        letter, step = next((letter, step) for letter, cost, step in ARCS[codes[at >> 2]][at & 3] if leads[at + step] and price[at] == cost + price[at + step])
        letters[at >> 2] += letter
        at += step
    return letters


def costs(codes: bytes) -> list[list[int]]:
    """Cheapest way through the rows from each state (row) to each state (column)."""
    out = [[INF if a != b else 0 for b in range(4)] for a in range(4)]
    for k in range(0, len(codes), STRETCH):
        part = codes[k:k + STRETCH]
        to = [auction(part, [0 if q == end else INF for q in range(4)])[:4] for end in range(4)]
        out = [[min(min(out[a][m] + to[b][m] for m in range(4)), INF) for b in range(4)] for a in range(4)]
    return out


def moved(state: int, code: int, letters: str) -> int:
    """State after the letters spent on a row."""
    for letter in letters:
        state = KEPT[state][code % 4] if letter == "K" else NEXT[state] if letter in "IR" else state
    return state


def backward(codes: bytes, ends: list[int]) -> list[list[int]]:
    """Prices of all stretches, the last stretch first."""
    prices: list[list[int]] = []
    for k in reversed(range(0, len(codes), STRETCH)):
        prices.append(auction(codes[k:k + STRETCH], ends))
        ends = prices[-1][:4]
    return prices


def plan(codes: bytes, ends: list[int], entries: list[int]) -> dict[int, tuple[list[str], list[int]]]:
    """For each entry state: the letters of each row, and the state before each row and after the last."""
    parts = [codes[k:k + STRETCH] for k in range(0, len(codes), STRETCH)]
    prices = backward(codes, ends)[::-1]
    known: dict[tuple[int, int], list[str]] = {}
    out = {}
    for entry in entries:
        letters, states, state = [], [], entry
        for k, part in enumerate(parts):
            if (k, state) not in known:
                known[k, state] = trace(part, prices[k], state)
            for code, word in zip(part, known[k, state]):
                letters.append(word)
                states.append(state)
                state = moved(state, code, word)
        out[entry] = letters, [*states, state]
    return out


def repaired(roles: list[str], texts: list[str], letters: list[str], state: int) -> list[str]:
    """``role:text`` of what is left of these rows. There may be one more entry of letters, for what follows the last row."""
    lines = []
    for k, word in enumerate(letters):
        for letter in word:
            if letter == "K":
                state = KEPT[state][initial(roles[k])]
                lines.append(f"{roles[k]}:{texts[k]}")
            elif letter in "IR":
                state = NEXT[state]
                lines.append(f"{('', '', 'user', 'assistant')[state]}:{texts[k] if letter == 'R' else ''}")
    return lines


def initial(role: str) -> int:
    """Number of a role's initial; 3 for any other than s, u, a."""
    return "sua".find(role[:1]) % 4 if role else 3


_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Run:
    """What is known of the rows of one conversation in one partition."""

    def __init__(self, first: int, turn: int | None):
        self.first = self.last = first
        self.low = self.high = self.seen = turn
        self.turns = int(turn is not None)
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.codes = bytearray()

    def summary(self, whole: bool) -> list[int]:
        """Initials, counts and costs from state to state. A whole conversation only needs its own cost from START on."""
        if whole:
            to = [[INF] * 4 for _ in range(4)]
            to[START][ASSISTANT] = backward(bytes(self.codes), FINAL)[-1][START]
        else:
            to = costs(bytes(self.codes))
        return [self.first, self.last, *self.counts, self.turns, *(x for row in to for x in row)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows to blocks of one conversation; the last block of each run carries the run's summary."""
    part = TaskContext.get().partitionId()
    held: dict[str, list] = {}
    conv, seq, size, run, edge = None, 0, 0, None, True

    def block(last: bool) -> pa.RecordBatch:
        codes = bytes(held["codes"])
        run.codes += codes
        about = run.summary(not edge) if last else None
        return pa.RecordBatch.from_pylist([{"conv": conv, "part": part, "seq": seq, "codes": codes, "roles": held["roles"], "texts": held["texts"],
                                            "about": about, "low": run.low if last else None, "high": run.high if last else None}], _BLOCK)

    for batch in batches:
        for name, turn, role, text, blank, truncated, duplicate in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "blank", "truncated", "duplicate"))):
            at = initial(role)
            if run is None or name != conv:
                if run is not None:
                    # The partition's first and last conversation may go on in others.
                    yield block(True)
                    edge = False
                conv, seq, size, run, held = name, 0, 0, _Run(at, turn), {"codes": [], "roles": [], "texts": []}
            else:
                run.counts[3] += (run.last, at) not in _LEGAL
                run.last = at
                if turn is not None and turn != run.seen:
                    run.turns += 1
                    run.low = turn if run.low is None else run.low
                    run.high = run.seen = turn
                if len(held["codes"]) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield block(False)
                    seq, size, held = seq + 1, 0, {"codes": [], "roles": [], "texts": []}
            if blank:
                run.counts[0] += 1
            elif duplicate:
                run.counts[1] += 1
            elif truncated:
                run.counts[2] += 1
            held["codes"].append((GOES if blank or duplicate else TRUNCATED if truncated else FINE) * 4 + at)
            held["roles"].append(role)
            held["texts"].append(text)
            size += len(text) + len(role)
    if run is not None:
        edge = True
        yield block(True)


_BLOCK = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())),
                    ("texts", pa.list_(pa.string())), ("about", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64())])
_BLOCK_DDL = "conv string, part int, seq long, codes binary, roles array<string>, texts array<string>, about array<long>, low long, high long"


def _groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal key."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, lambda r: tuple(r[k] for k in key))


def _packed(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_GOAL = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("ends", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_()),
                   *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]])
_GOAL_DDL = "conv string, part int, ends array<long>, first boolean, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _goals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the runs of each conversation (one per partition it lies in, in order): distances at their ends, and the totals."""
    def rows() -> Iterator[dict]:
        for (conv,), group in _groups(batches, "conv"):
            runs = list(group)
            ends, at_end = FINAL, []
            for run in reversed(runs):
                at_end.append(ends)
                to = run["about"][7:]
                ends = [min(min(to[4 * a + b] + ends[b] for b in range(4)), INF) for a in range(4)]
            at_end.reverse()
            total = [sum(run["about"][k] for run in runs) for k in range(2, 7)]
            for before, run in zip(runs, runs[1:]):
                total[3] += (before["about"][1], run["about"][0]) not in _LEGAL
                total[4] -= before["high"] is not None and before["high"] == run["low"]
            turns = [run[c] for run in runs for c in ("low", "high") if run[c] is not None]
            gaps = max(turns) - min(turns) + 1 - total[4] if turns else 0
            for k, run in enumerate(runs):
                yield {"conv": conv, "part": run["part"], "ends": at_end[k], "first": k == 0, "last": k == len(runs) - 1, "gaps": gaps,
                       "blank": total[0], "duplicate": total[1], "truncated": total[2], "illegal": total[3], "cost": ends[START]}
    yield from _packed(rows(), _GOAL)


_PLAN = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("entry", pa.int32()), ("state", pa.int32()),
                   ("letters", pa.list_(pa.string())), ("leaves", pa.int32())])
_PLAN_DDL = "conv string, part int, seq long, entry int, state int, letters array<string>, leaves int"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of each block for each state its run may be entered in; the run's last block says in which it is left."""
    def rows() -> Iterator[dict]:
        for (conv, part), group in _groups(batches, "conv", "part"):
            blocks = list(group)
            head = blocks[0]
            found = plan(b"".join(b["codes"] for b in blocks), head["ends"], [START] if head["first"] else [START, SYSTEM, USER, ASSISTANT])
            for entry, (letters, states) in found.items():
                at = 0
                for k, b in enumerate(blocks):
                    until, last = at + len(b["codes"]), k == len(blocks) - 1
                    tail = ["I" * TRAILING[states[until]]] if last and head["last"] else []
                    yield {"conv": conv, "part": part, "seq": b["seq"], "entry": entry, "state": states[at], "letters": letters[at:until] + tail,
                           "leaves": states[until] if last else None}
                    at = until
    yield from _packed(rows(), _PLAN, 200)


_ENTRY = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("entry", pa.int32())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each run of a conversation is entered."""
    def rows() -> Iterator[dict]:
        for (conv,), group in _groups(batches, "conv"):
            state = START
            for (part,), variants in groupby(group, lambda r: (r["part"],)):
                leaves = {v["entry"]: v["leaves"] for v in variants}
                yield {"conv": conv, "part": part, "entry": state}
                state = leaves[state]
    yield from _packed(rows(), _ENTRY)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's part of the audit and of the repaired text."""
    for batch in batches:
        for r in batch.to_pylist():
            lines = repaired(r["roles"], r["texts"], r["letters"], r["state"])
            yield pa.RecordBatch.from_pydict({"conv": [r["conv"]], "part": pa.array([r["part"]], pa.int32()), "seq": [r["seq"]],
                                              "audit": ["".join(r["letters"])], "piece": ["\n".join(lines) if lines else None]},
                                             pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("audit", pa.string()), ("piece", pa.string())]))


_DIGEST = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole audit of each conversation and the hash of its repaired text, which is read piece by piece."""
    def rows() -> Iterator[dict]:
        for (conv,), group in _groups(batches, "conv"):
            digest, audit, begun = hashlib.sha256(), [], False
            for piece in group:
                audit.append(piece["audit"])
                if piece["piece"] is not None:
                    digest.update(("\n" if begun else "").encode() + piece["piece"].encode())
                    begun = True
            yield {"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
    yield from _packed(rows(), _DIGEST)


def damage(turns: DataFrame) -> DataFrame:
    """Rows (``conv_id, turn, role, text``, ``copy``) after the set damage: crc32 of ``conv_id:turn``, modulo 20, decides.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it (``copy`` 1), 4 makes it the user's. Nulls
    are one space in role and text, and in the string that is hashed; conv_id and turn stay null.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.crc32(F.encode(F.concat(word("conv_id"), F.lit(":"), word("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), roll.alias("roll")).where("roll <> 0")
    text = F.when(F.col("roll") == 1, "").when(F.col("roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("roll") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("roll") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def name_of(conv: str = "conv_id") -> Column:
    """A conversation's key as a string that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit(""))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of conversations given as ``conv_id, turn, role, text`` (role and text never null).

    Rows stand by turn (null first), then by role, then by a hash of role and text; equal rows in any order. Faults, edits
    and their prices are those of the module's constants. Returns two stored tables: totals and audit per conversation
    (``conv``: see ``name_of``), and the repaired text in ordered pieces (``conv, part, seq, audit, piece``; null piece:
    nothing left of these rows).
    """
    blank, truncated = F.rtrim(F.col("text"), F.lit(SPACE)) == "", ~F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    digest = F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)
    rows = turns.select(name_of().alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", digest.alias("digest"),
                        blank.alias("blank"), truncated.alias("truncated"), F.monotonically_increasing_id().alias("id"))
    rows = base.store(rows, "turns")
    # The first of rows with equal role and text; only groups of two and more are met by the rows again.
    firsts = rows.groupBy("conv", "digest").agg(F.min(F.struct("turn", "id")).alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = base.store(firsts.select("conv", "digest", F.col("least.id").alias("first_id")), "first-turns")
    told = rows.join(firsts, ["conv", "digest"], "left").withColumn("duplicate", F.coalesce(F.col("id") != F.col("first_id"), F.lit(False)))
    ordered = ["conv", "turn", "role", "digest", "id"]
    told = told.select(*ordered, "text", "blank", "truncated", "duplicate").repartitionByRange(base.partitions(rows), *ordered).sortWithinPartitions(*ordered)
    blocks = base.store(told.mapInArrow(_blocks, _BLOCK_DDL), "conversation-blocks")
    runs = blocks.where("about is not null").select("conv", "part", "about", "low", "high")
    goals = base.store(runs.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_goals, _GOAL_DDL), "goals")
    coded = blocks.select("conv", "part", "seq", "codes").join(goals.select("conv", "part", "ends", "first", "last"), ["conv", "part"])
    plans = base.store(coded.repartition("conv", "part").sortWithinPartitions("conv", "part", "seq").mapInArrow(_plans, _PLAN_DDL), "plans")
    leaves = plans.where("leaves is not null").select("conv", "part", "entry", "leaves")
    entries = leaves.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_entries, "conv string, part int, entry int")
    chosen = plans.join(entries, ["conv", "part", "entry"]).select("conv", "part", "seq", "state", "letters")
    pieces = blocks.select("conv", "part", "seq", "roles", "texts").join(chosen, ["conv", "part", "seq"])
    pieces = base.store(pieces.mapInArrow(_texts, "conv string, part int, seq long, audit string, piece string"), "repaired-pieces")
    digests = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_digests, "conv string, audit string, repaired_sha256 string")
    totals = goals.where("first").drop("part", "ends", "first", "last")
    return totals.join(digests, "conv"), pieces


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """Per conv_id of ``turns``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after ``damage``.

    A null conv_id is a conversation of its own. Conversations of which the damage leaves no row have zeros, an empty
    audit and the hash of the empty string. Equal rows and repeated turns stay; other columns are not looked at; an
    empty table gives no rows. Long conversations are cut over tasks; only their audit and the hash of their text, one
    value each, are put together in one task, piece by piece.
    """
    found, _ = repair(damage(turns))
    every = turns.select("conv_id").distinct().withColumn("conv", name_of())
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                                                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
