import hashlib
import random
import zlib

import pytest

from mldiag.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\v\f\r"


def first_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.rstrip(WHITE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else None if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def fits(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def cheapest(rows, faults):
    """Shortest edits by relaxing (cost, audit, repaired) over (row, initials) until nothing changes."""
    table = {(0, ""): (0, "", ())}
    queue = [(0, "")]
    while queue:
        i, head = queue.pop(0)
        cost, audit, out = table[i, head]
        steps = []
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((3, "D", None, i + 1))
            if faults[i] in (None, "truncated"):
                more = int(faults[i] == "truncated")
                steps.append((more, "K", (role, text), i + 1))
                steps += [(2 + more, "R", (new, text), i + 1) for new in ("user", "assistant")]
        steps += [(2, "I", (new, ""), i) for new in ("user", "assistant")]
        for price, edit, row, at in steps:
            now = head + (row[0][:1] if row else "")
            if row and row[0][:1] == "":
                continue
            rest = now[1:] if now[:1] == "s" else now
            if rest != ("ua" * len(rest))[: len(rest)]:
                continue
            now = now if len(rest) < 3 else now[:-2]
            new = (cost + price, audit + edit, out + ((row,) if row else ()))
            if new[0] <= 3 * len(rows) and new < table.get((at, now), (1 << 30,)):
                table[at, now] = new
                queue.append((at, now))
    return min(v for (i, head), v in table.items() if i == len(rows) and fits(head))


def expected(rows):
    """The report of one conversation of (turn, role, text) rows in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    faults = first_faults(rows)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(rows, faults)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def grouped(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in groups.items()}


def conversations(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", "two\nlines.", "end. \t", "é", "über."]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 8)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, rng.choice(texts + [None])))
    return rows


def test_report_by_brute_force(spark):
    rows = conversations(250, 5) + [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (1 << 60, 3, "system", "S."), ((1 << 60) + 1, 3, "user", "S.")]
    found = turns.report(turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: expected(x) for c, x in grouped(rows).items()}
    assert len(found) == len({r[0] for r in rows})


def test_damaged_conversations(spark):
    rows = conversations(300, 9)
    damaged = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    wanted = {c: expected([]) for c in {r[0] for r in rows}} | {c: expected(x) for c, x in grouped(damaged).items()}
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA + ", `group` string, back int, repeated boolean")
    assert {r.conv_id: tuple(r)[1:] for r in turns.repair_damaged(docs).collect()} == wanted


def test_edits_are_whole_rows(spark):
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (2, 0, "assistant", "cut")]
    out = turns.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    first = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.place)
    assert [(r.edit, r.role, r.text, r.charge) for r in first] == [
        ("Keep", "user", long, 0), ("Insert", "assistant", "", 2), ("Keep", "user", "B.", 0), ("Keep", "assistant", "C.", 0)
    ]
    assert [(r.edit, r.fault) for r in out if r.conv_id == 2] == [("Insert", None), ("Keep", "truncated")] or [r.edit for r in out if r.conv_id == 2] == ["Delete"]


@pytest.mark.parametrize("size", [7])
def test_state_goes_on_over_batches(spark, size):
    """One conversation over many Arrow batches, with repeats, in one stream."""
    rng = random.Random(1)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(60)}.") for t in range(90)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = turns.report(turns.repair(spark.createDataFrame(rows, SCHEMA))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuple(found[0])[1:] == expected(grouped(rows)[5])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.repair(empty).count() == 0 and turns.repair_damaged(empty).count() == 0
