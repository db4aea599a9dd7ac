"""Least-cost repair of the structure of conversations, by cost layers of bitsets.

A conversation's roles should read ``(s?(ua)+)?`` by their initials: nothing, or pairs of user and assistant turns, with a
system turn before them or without. A turn may be kept, get the role user or assistant, or be deleted, and empty user and
assistant turns may be put in anywhere; blank turns and repeated ones must go, and a truncated turn that stays costs more.

1. Each turn becomes a code: what its role is to the grammar and which fault it has first. A turn is repeated if role and text
   have occurred before it; first occurrences are found by a grouped minimum, so a text that a third of all turns share
   is combined before the shuffle.
2. Layer ``c`` is a bitset of four bits a turn: the grammar's states from which, ahead of that turn, the rest can be accepted
   at a cost of ``c`` at most. It follows from earlier layers by shifts and masks of whole bitsets, one for each edit by its
   cost, and is closed under keeping, which costs nothing. The first layer that holds the start state ahead of the first turn
   gives the cost.
3. From there the least audit is traced bit by bit: the first edit, in the order of its initial, whose target is in the layer
   of the cost that is left. A state and an edit have one target, so the audit gives the repaired turns.

A conversation is layered in blocks of ``BLOCK`` turns from its end on: what the states cost at the start of a block is where
the layers of the block before begin. So work is linear in turns, however long a conversation is, and blocks that look alike,
as most do, are layered once in a task.

Turns are streamed in order through the task of their conversation, as its digest is of all of them: first the codes, of
which the task holds one byte a turn; then, behind the audit, the texts, one batch at a time.

Defined cases: null roles and texts are one space, so such a turn is blank; null turns come first, and turns of one number go
by role and by the digest of role and text; rows of a null conversation form one conversation; repeated rows are repeated turns, of which all but the
first must go; a role with another initial than s, u and a can't be kept; texts of any length are streamed; other columns are not
read, so they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import arrow_schema, materialize

#: What edits cost; a truncated turn that is not deleted adds ``TRUNCATED``.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns layered at once, and blocks of codes remembered.
BLOCK, REMEMBERED = 64, 1 << 14
#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = {START: 0, ASSISTANT: 0, USER: INSERT, SYSTEM: 2 * INSERT}
#: The state after an empty or renamed turn: the user's, but after a user turn the assistant's.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Codes of turns: one that must go; then two for each role, whole and truncated.
GONE, ROLES = 0, "sua?"
#: What is no word.
SPACE = " \t\n\x0b\x0c\r"


def code(role: str, truncated: bool) -> int:
    return 1 + 2 * max(0, "sua?".find(role) if role in ("s", "u", "a") else 3) + truncated


def _kept(state: int, role: str) -> int | None:
    """The state after keeping a turn, if the grammar allows it."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


class Layers:
    """The layers of a block of codes, given what each state costs behind it."""

    def __init__(self, codes: bytes, behind: tuple[int, ...]) -> None:
        n, least = len(codes), min(behind)
        places = [sum(1 << 4 * i for i, c in enumerate(codes) if want(c)) for want in (lambda c: True, lambda c: c and c % 2, lambda c: c and c % 2 == 0)]
        every, whole, cut = places
        kept = {(r, t): sum(1 << 4 * i for i, c in enumerate(codes) if c == code(r, t)) for r in "sua" for t in (False, True)}
        of = [((every | 1 << 4 * n) << s) for s in range(4)]

        def before_next(g: int) -> int:
            """States whose next one is in ``g``, at the same place."""
            user, assistant = g & of[USER], g & of[ASSISTANT]
            return user >> USER | user >> USER - SYSTEM | user << ASSISTANT - USER | assistant >> ASSISTANT - USER

        def at(g: int, turns: int) -> int:
            """``g`` of the places behind such turns, ahead of them."""
            return (g >> 4) & turns * 15

        def before_kept(g: int, truncated: bool) -> int:
            system, user, assistant = at(g, kept["s", truncated]) & of[SYSTEM], at(g, kept["u", truncated]) & of[USER], at(g, kept["a", truncated]) & of[ASSISTANT]
            return system >> SYSTEM | user >> USER | user >> USER - SYSTEM | user << ASSISTANT - USER | assistant >> ASSISTANT - USER

        self.codes, self.least, self.layers = codes, least, []
        first = [None] * 4
        layers = self.layers
        while None in first:
            c = len(layers)
            g = layers[-1] if layers else 0
            for s, cost in enumerate(behind):
                if cost - least == c:
                    g |= 1 << 4 * n + s
            if c >= DELETE:
                g |= at(layers[c - DELETE], every)
            if c >= INSERT:
                g |= before_next(layers[c - INSERT])
            if c >= REROLE:
                g |= at(before_next(layers[c - REROLE]), whole)
            if c >= REROLE + TRUNCATED:
                g |= at(before_next(layers[c - REROLE - TRUNCATED]), cut)
            if c >= TRUNCATED:
                g |= before_kept(layers[c - TRUNCATED], True)
            while True:
                more = g | before_kept(g, False)
                if more == g:
                    break
                g = more
            layers.append(g)
            for s in range(4):
                if first[s] is None and g >> s & 1:
                    first[s] = c
        self.ahead = tuple(least + c for c in first)

    def holds(self, cost: int, place: int, state: int) -> bool:
        return 0 <= cost < len(self.layers) and bool(self.layers[cost] >> 4 * place + state & 1)

    def trace(self, state: int, last: bool) -> tuple[str, int]:
        """The least audit of the block from a state on, and the state behind it; the last block ends accepted."""
        place, left, audit, n = 0, self.ahead[state] - self.least, [], len(self.codes)
        while place < n or last and (left > 0):
            c = self.codes[place] if place < n else None
            added = TRUNCATED if c and c % 2 == 0 else 0
            moves = [("D", DELETE, place + 1, state)] if c is not None else []
            moves.append(("I", INSERT, place, NEXT[state]))
            if c:
                target = _kept(state, ROLES[(c - 1) // 2])
                if target is not None:
                    moves.append(("K", added, place + 1, target))
                moves.append(("R", REROLE + added, place + 1, NEXT[state]))
            for name, cost, to, target in moves:
                if self.holds(left - cost, to, target):
                    audit.append(name)
                    place, state, left = to, target, left - cost
                    break
        return "".join(audit), state


@lru_cache(REMEMBERED)
def _layers(codes: bytes, behind: tuple[int, ...]) -> Layers:
    return Layers(codes, behind)


@lru_cache(REMEMBERED)
def _traced(codes: bytes, behind: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    return _layers(codes, behind).trace(state, last)


def least_repair(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The least cost of repairing turns of these codes, and of the audits that have it the least."""
    blocks = [codes[i : i + block] for i in range(0, len(codes), block)]
    behind, cost = [], [0]
    costs = tuple(ACCEPTED[s] for s in range(4))
    for own in reversed(blocks):
        low = min(costs)
        behind.append(tuple(c - low for c in costs))
        cost[0] += low
        costs = _layers(own, behind[-1]).ahead
    total, state, audit = cost[0] + costs[START], START, []
    for i, (own, after) in enumerate(zip(blocks, reversed(behind), strict=True)):
        part, state = _traced(own, after, state, i == len(blocks) - 1)
        audit.append(part)
    return total, "".join(audit)


class Repaired:
    """The repaired turns of a conversation, as its turns arrive in order behind its audit."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, START, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _inserted(self) -> None:
        while self.audit.startswith("I", self.at):
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _kept(self.state, role[:1])
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line("user" if self.state == USER else "assistant", text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def _first_faults(turns: DataFrame) -> DataFrame:
    """``turns`` (``conv_id, turn, role, text, copy, seen``) with ``fault``: b(lank), d(uplicate), t(runcated), or none."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    firsts = turns.groupBy(F.col("conv_id").alias("c"), F.col("seen").alias("s")).agg(F.min(F.struct("turn", "copy")).alias("first"))
    met = turns.join(firsts, turns["conv_id"].eqNullSafe(firsts["c"]) & (turns["seen"] == firsts["s"]))
    again = ~F.struct("turn", "copy").eqNullSafe(F.col("first"))
    fault = F.when(last == "", "b").when(again, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return met.select(*turns.columns, fault.alias("fault"))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text`` rows; ``turn`` is a whole number, anything else is null.

    ``conv_id, n_turns, gaps`` (numbers missing between the least and the greatest), ``blank, duplicate, truncated`` (turns by
    their first fault), ``illegal`` (turns and their next whose initials may not follow each other), ``cost, audit`` (the
    initials of Keep, Rerole, Delete and Insert in order) and ``repaired_sha256`` (of the repaired turns, ``role:text``, a line
    each).
    """
    spark, id_type = turns.sparkSession, turns.schema["conv_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    space = F.lit(" ")
    own = turns.select("conv_id", F.col("turn").try_cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    seen = F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)
    own = materialize(own.withColumns({"copy": F.monotonically_increasing_id(), "seen": seen}), "repair-turns")
    rows = materialize(_first_faults(own), "repair-faults")

    def ordered(df: DataFrame, *first: str) -> DataFrame:
        return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "seen", "copy")

    counted = f"conv_id {id_type}, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    codes = ordered(rows.drop("text")).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    audits = materialize(codes.mapInArrow(_audits(counted), counted), "repair-audits")

    digest = f"conv_id {id_type}, repaired_sha256 string"
    behind = rows.drop("fault").withColumns({"part": F.lit(1), "audit": F.lit(None).cast("string")})
    ahead = audits.select("conv_id", F.lit(0).alias("part"), "audit")
    both = ordered(behind.unionByName(ahead, allowMissingColumns=True), "part").select("conv_id", "part", "role", "text", "audit")
    digests = both.mapInArrow(_digests(digest), digest).select(F.col("conv_id").alias("c"), "repaired_sha256")
    return audits.join(digests, audits["conv_id"].eqNullSafe(digests["c"])).drop("c")


def _streamed(schema: str, start, take, close):
    """A task over rows sorted by their first column: ``close(conv, state)`` of each conversation as a row of ``schema``."""
    fields = arrow_schema(schema)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, state, done = nothing, None, []
        for batch in batches:
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is nothing or conv != current:
                    if current is not nothing:
                        done.append(close(current, state))
                    current, state = conv, start()
                take(state, *rest)
            if len(done) > 1000:
                yield batch_of(done)
                done = []
        if current is not nothing:
            done.append(close(current, state))
        if done:
            yield batch_of(done)

    return run


def _audits(schema: str):
    legal = {"su", "ua", "au"}

    def start() -> dict:
        return {"codes": bytearray(), "b": 0, "d": 0, "t": 0, "": 0, "illegal": 0, "last": None, "low": None, "turn": None, "numbers": 0}

    def take(s: dict, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != s["turn"]:
            s["low"] = turn if s["low"] is None else s["low"]
            s["turn"], s["numbers"] = turn, s["numbers"] + 1
        s["codes"].append(GONE if fault in ("b", "d") else code(initial, fault == "t"))
        s[fault] += 1
        s["illegal"] += s["last"] is not None and s["last"] + initial not in legal
        s["last"] = initial

    def close(conv, s: dict) -> tuple:
        cost, audit = least_repair(bytes(s["codes"]))
        gaps = 0 if s["low"] is None else s["turn"] - s["low"] + 1 - s["numbers"]
        return conv, len(s["codes"]), gaps, s["b"], s["d"], s["t"], s["illegal"], cost, audit

    return _streamed(schema, start, take, close)


def _digests(schema: str):
    def take(s: list, part: int, role: str, text: str, audit: str | None) -> None:
        if part == 0:
            s.append(Repaired(audit))
        else:
            s[0].turn(role, text)

    return _streamed(schema, list, take, lambda conv, s: (conv, s[0].digest()))
