"""Repair of the role structure of conversations, as a stream of rows sorted by turn.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Each row is kept (free), given the role user or assistant (2), or
deleted (3; a must for blank and repeated rows), and rows with that role and no text may be inserted anywhere (2); a row
cut short that stays costs 1. The cheapest edits are taken, of equally cheap ones those whose initials are least in ASCII order.

Rows are dealt out by conversation once. Two sorts inside the partitions follow. Latest turn first, the dynamic programme runs
from the end: the cost of the rest of the conversation from each of four states (nothing yet, after a system, user or assistant row) is all that it
carries from row to row, and so across Arrow batches. Its choices, two bits a state, are one byte a row: these back pointers leave with their
rows and Spark's sorter spills them, so a conversation of any length takes no more memory than any other. Earliest turn
first, a second pass follows the back pointers and puts the edits out. Four costs and the state are all that is ever held of a conversation.
One conversation is one stream, by its definition: its rows go through one task, however many they are.

Cases: nulls of role and text count as one space; a null turn comes first; a null conv_id is a conversation of its own. Rows of one turn
stand in order of role and text, and a row that equals the one before it is a repeated one. Empty texts are blank. Texts of any length
pass through whole. An empty table has no rows in any result. Only the four named columns are read, others have no part in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of that initial, for each state; a new conversation or a system row is followed by a user row.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Rest of a conversation after its last row: the row pair that it must still get.
END = (0, 2 * INSERT, INSERT, 0)
#: Numbers that may be null travel as text: pandas would make floating point numbers of them.
EDITS = "conv_id string, place bigint, edit string, turn string, old_role string, role string, text string, fault string, charge bigint"
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def choices(initial: str, fault: str | None, rest: list[int]) -> tuple[list[int], int]:
    """The costs of the conversation from this row on for each state before it, and the byte of what to do there: 0 delete, 1
    insert a row, 2 keep, 3 rerole, which is their order in ASCII too."""
    must = fault in (BLANK, DUPLICATE)
    cut = CUT if fault == TRUNCATED else 0
    costs, does = [0] * 4, [0] * 4
    for state in range(4):
        best, do = DELETE + rest[state], 0
        if not must:
            after = AFTER[state].get(initial)
            if after is not None and KEEP + cut + rest[after] < best:
                best, do = KEEP + cut + rest[after], 2
            changed = REROLE + cut + rest[NEXT[state]]
            if changed < best:
                best, do = changed, 3
        costs[state], does[state] = best, do
    # a row may be put before this one; two in a row never pay, as they lead back
    plain = list(costs)
    for state in (USER, ASSISTANT):
        other = INSERT + plain[NEXT[state]]
        if other < plain[state] or (other == plain[state] and does[state] > 1):
            costs[state], does[state] = other, 1
    for state in (START, SYSTEM):
        other = INSERT + costs[USER]
        if other < plain[state] or (other == plain[state] and does[state] > 1):
            costs[state], does[state] = other, 1
    return costs, does[0] | does[1] << 2 | does[2] << 4 | does[3] << 6


def faults(text: str, repeated: bool) -> str | None:
    last = LAST.search(text)
    if last is None:
        return BLANK
    if repeated:
        return DUPLICATE
    return None if last.group(1) in ".!?" else TRUNCATED


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Latest turn first: adds fault, back (the back pointers) and far (rows of the conversation behind this one)."""
    conversation: object = frames  # no conversation equals it
    rest, far = list(END), 0
    for frame in frames:
        found, back, behind = [], [], []
        for group, role, text, repeated in zip(frame["group"], frame["role"], frame["text"], frame["repeated"]):
            if group != conversation:
                conversation, rest, far = group, list(END), 0
            fault = faults(text, repeated)
            rest, do = choices(role[:1], fault, rest)
            found.append(fault)
            back.append(do)
            behind.append(far)
            far += 1
        frame["fault"], frame["back"], frame["far"] = pd.Series(found, dtype=object), back, behind
        yield frame.drop(columns="repeated")


def _forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Earliest turn first: follows the back pointers and gives the edits."""
    names = [c.split()[0] for c in EDITS.split(", ")]
    conversation: object = frames
    state, place = START, 0
    for frame in frames:
        out: list[tuple] = []

        def put(conv_id, edit, turn, old, role, text, fault, charge):
            nonlocal place
            out.append((conv_id, place, edit, turn, old, role, text, fault, charge))
            place += 1

        columns = ("group", "conv_id", "turn", "role", "text", "fault", "back", "far")
        for group, conv_id, turn, role, text, fault, back, far in zip(*(frame[c] for c in columns)):
            if group != conversation:
                conversation, state, place = group, START, 0
            cut = CUT if fault == TRUNCATED else 0
            while (do := back >> 2 * state & 3) == 1:
                state = NEXT[state]
                put(conv_id, "Insert", None, None, ROLES[state], "", None, INSERT)
            if do == 0:
                put(conv_id, "Delete", turn, role, None, None, fault, DELETE)
            elif do == 2:
                state = AFTER[state][role[:1]]
                put(conv_id, "Keep", turn, role, role, text, fault, KEEP + cut)
            else:
                state = NEXT[state]
                put(conv_id, "Rerole", turn, role, ROLES[state], text, fault, REROLE + cut)
            while far == 0 and state in (SYSTEM, USER):
                state = NEXT[state]
                put(conv_id, "Insert", None, None, ROLES[state], "", None, INSERT)
        yield pd.DataFrame(out, columns=names)


def number(column: str, kind: str = "bigint") -> Column:
    return F.col(column).cast("bigint").cast(kind).alias(column)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per edit, in order inside each partition: conv_id, place (of the edit in its conversation), edit (Keep, Rerole, Delete or
    Insert), turn and old_role of the row it comes from, role and text after it (null where deleted), fault, charge."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("group"),
        number("conv_id", "string"), number("turn"), spaced("role").alias("role"), spaced("text").alias("text"),
    )
    dealt = rows.repartition("group").withColumn("same", F.xxhash64("role", "text"))
    # rows of one conversation are together, so this window sorts only; equal hashes of unequal rows part by role and text
    seen = Window.partitionBy("group", "same", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = dealt.withColumn("repeated", F.row_number().over(seen) > 1)
    last_first = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("repeated").desc()]
    columns = ["group", "conv_id", number("turn", "string"), "role", "text", "repeated"]
    back = dealt.sortWithinPartitions("group", *last_first).select(columns)
    kinds = "group string, conv_id string, turn string, role string, text string, fault string, back int, far bigint"
    chosen = back.mapInPandas(_backward, kinds)
    edits = chosen.sortWithinPartitions(F.col("group"), F.col("far").desc()).mapInPandas(_forward, EDITS)
    return edits.withColumns({c: number(c) for c in ("conv_id", "turn")})


REPORT = (
    "conv_id string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


def report(edits: DataFrame) -> DataFrame:
    """One row a conversation of `repair`'s rows as it gives them, in order: faults and gaps of the rows, cost and initials of the
    edits, hash of the repaired `role:text`."""
    names = [c.split()[0] for c in REPORT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        current: dict | None = None

        def row(c: dict) -> tuple:
            gaps = c["high"] - c["low"] + 1 - c["turns"] if c["turns"] else 0
            counts = (c["faults"][f] for f in (BLANK, DUPLICATE, TRUNCATED))
            return (c["conv_id"], gaps, *counts, c["illegal"], c["cost"], c["audit"].decode(), c["sha"].hexdigest())

        for frame in frames:
            done = []
            columns = (frame[c] for c in ("conv_id", "place", "edit", "turn", "old_role", "role", "text", "fault", "charge"))
            for conv_id, place, edit, turn, old, role, text, fault, charge in zip(*columns):
                if place == 0:  # the first edit of a conversation
                    if current is not None:
                        done.append(row(current))
                    none = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
                    current = {"conv_id": conv_id, "high": None, "low": None, "turns": 0, "faults": none, "illegal": 0, "cost": 0}
                    current |= {"audit": bytearray(), "sha": hashlib.sha256(), "before": None, "empty": True}
                c = current
                c["audit"] += edit[:1].encode()
                c["cost"] += charge
                if fault is not None:
                    c["faults"][fault] += 1
                if edit != "Insert":
                    if c["before"] is not None and c["before"] + old[:1] not in ("su", "ua", "au"):
                        c["illegal"] += 1
                    c["before"] = old[:1]
                    if turn is not None and int(turn) != c["high"]:  # turns come in order
                        c["high"], c["turns"] = int(turn), c["turns"] + 1
                        c["low"] = c["high"] if c["low"] is None else c["low"]
                if edit != "Delete":
                    c["sha"].update(("" if c["empty"] else "\n").encode() + f"{role}:{text}".encode())
                    c["empty"] = False
            yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([row(current)], columns=names)

    texts = edits.withColumns({c: number(c, "string") for c in ("conv_id", "turn")})
    return texts.mapInPandas(run, REPORT).withColumn("conv_id", number("conv_id"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that the hash of conversation and turn names: rows dropped, emptied, without
    full stops, twice, or of the user."""
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = spaced("role"), spaced("text")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(number("conv_id"), number("turn"), role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.filter("times > 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).drop("again")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report of every conversation of the table, after damage."""
    found = report(repair(damage(conversations))).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = every.join(found, every.conv_id.eqNullSafe(found.c), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
