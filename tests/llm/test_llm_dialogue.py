import hashlib
import itertools
import random
import re
import zlib

import pytest

from veilframe.llm import dialogue
from veilframe.llm.queries import QUERIES

COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def by_force(rows, faults):
    """The least (cost, audit) of all edits with at most two rows inserted at a place."""
    found = []
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and f in (1, 2) for e, f in zip(edits, faults)):
            continue
        base = sum(COSTS[e] for e in edits) + sum(5 for e, f in zip(edits, faults) if e != "D" and f == 3)
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            cost = base + 5 * sum(gaps)
            if found and (cost, audit) >= found[0]:
                continue
            kept, options = iter(rows), []
            for e in audit:
                role = None if e == "I" else next(kept)[0]
                if e != "D":
                    options.append(role[:1] if e == "K" else "[ua]")
            # do the choices of all rows meet the grammar together?
            if any(re.fullmatch("(s?(ua)+)?", "".join(choice)) for choice in itertools.product(*[o if len(o) < 2 else "ua" for o in options])):
                found = [(cost, audit)]
    return found[0]


def test_equals_all_edits():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "ugly"]
    for i in range(260):
        n = rng.randint(0, 4 if i % 13 == 0 else 3)
        rows = [(rng.choice(roles), f"t{k}") for k in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in rows]
        cost, audit, lines = dialogue.repaired_rows(rows, faults)
        assert (cost, audit) == by_force(rows, faults), (rows, faults)
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))


def test_what_is_decided_does_not_depend_on_when(monkeypatch):
    rng = random.Random(5)
    for n in (10, 300, 1500):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"t{k}") for k in range(n)]
        faults = [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in rows]
        monkeypatch.setattr(dialogue, "DECIDE_EVERY", 10**9)
        whole = dialogue.repaired_rows(rows, faults)
        for every in (1, 7, 64):
            monkeypatch.setattr(dialogue, "DECIDE_EVERY", every)
            assert dialogue.repaired_rows(rows, faults) == whole
        monkeypatch.setattr(dialogue, "SLACK", 10**9)
        assert dialogue.repaired_rows(rows, faults) == whole
        monkeypatch.undo()


def test_only_the_last_rows_are_held():
    rng, most, lines = random.Random(6), 0, []
    repair = dialogue.Repair(lines.append)
    for k in range(5000):
        repair.read(("user", "assistant")[k % 2] if rng.random() < 0.9 else "user", f"t{k}", rng.choice([0] * 9 + [2]))
        most = max(most, len(repair.rows))
    repair.end()
    assert most <= 4 * dialogue.DECIDE_EVERY


def expected(rows):
    """The contract, row by row, for one conversation."""
    made = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        made += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in made:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in made if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in made]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = dialogue.repaired_rows([(role, text) for _, role, text in made], faults)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)


def results(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    groups = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        groups.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    assert results(QUERIES["op12_dialogue"](spark, sf)) == {k: expected(v) for k, v in groups.items()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_edges(spark, partitions):
    rng = random.Random(9)
    rows = [(None, None, None, None), (1, None, None, ""), (2, 5, "user", "x" * 300_000 + "."), (2, 5, "user", "x" * 300_000 + "."), (2, 9, "assistant", "fine? ")]
    rows += [(3, t, "user", "Again.") for t in range(40)] + [(4, 3, "assistant", "Ties."), (4, 3, "assistant", "Ties.")]
    rows += [(10 + c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "No", "", " \t", None, "So!"])) for c in range(60) for t in range(rng.randint(1, 9))]
    schema = "conv_id long, turn long, role string, text string, gone string, `a.b` string, key string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(partitions)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    damaged = dialogue.damage_conversations(table)
    assert results(dialogue.repair_conversations(damaged)) == {k: expected(v) for k, v in groups.items()}
    assert dialogue.repair_conversations(dialogue.damage_conversations(table.limit(0))).count() == 0


def test_all_rows_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    got = results(dialogue.repair_conversations(dialogue.damage_conversations(table)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
