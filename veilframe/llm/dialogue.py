"""Conversations with damaged structure, repaired by a generalised LR parse.

The roles of a sound conversation form the language `(s?(ua)+)?` over their
initials.  An LR automaton reads a conversation's rows while all edits are tried at
once: keep a row, give it another role, delete it, insert a row.  The stacks of all
readings share their lower parts, and those that have equal tops are merged into the
one with the smallest (cost, audit), the audit being the edits' initials in order.

Merging is safe.  What may follow depends on the top alone.  Two audits of equal
cost up to the same row can't be one the beginning of the other, since an edit more
costs more, so their order does not change by what is added to both.

Only the last rows of a conversation are undecided at any time: what all stacks
agree on is written and let go, so a conversation of any length is read in the
memory of a few rows (beside its audit, which is a value of the result).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import col, row_key

#: What edits cost: Keep, Rerole, Delete, Insert; and a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A reading that costs so much more than the best can't win any more: two inserted rows
#: lead from any top to where all that may follow another one may follow, too.
SLACK = 2 * INSERT
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Rows after which what is decided is written.
DECIDE_EVERY = 64
#: White space of a text's ends, as characters.
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

# The grammar: C -> (nothing) | P | s P ;  P -> u a | P u a.  States of its LR automaton:
# 0 start, 1 after s, 2 after P, 3 after s P, 4 after u, 5 after u a, 6 after P u, 7 after P u a.
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 6, (3, "u"): 6, (4, "a"): 5, (6, "a"): 7}
#: How many symbols a reduction to P takes off the stack, and where P leads from the state below.
REDUCE = {5: 2, 7: 3}
GOTO = {0: 2, 1: 3}
ACCEPT = (0, 2, 3)


class Node(NamedTuple):
    """A node of the shared stacks: a state on top of the node below."""

    state: int
    below: Node | None


class Best(NamedTuple):
    """The cheapest reading with a certain top: its cost, its audit since the last row decided, its stack."""

    cost: int
    audit: str
    stack: Node


def shifted(stack: Node, symbol: str) -> Node | None:
    """The stack after a symbol and the reductions that follow; None if the symbol can't come."""
    state = SHIFT.get((stack.state, symbol))
    if state is None:
        return None
    stack = Node(state, stack)
    while stack.state in REDUCE:
        for _ in range(REDUCE[stack.state]):
            stack = stack.below
        stack = Node(GOTO[stack.state], stack)
    return stack


class Repair:
    """One conversation, row by row; `write` gets the lines of the repaired one."""

    def __init__(self, write) -> None:
        self.write = write
        self.rows: list[tuple[str, str]] = []  # not decided yet
        self.audit: list[str] = []
        self.next = "u"  # the initial of a row that is inserted or given a role
        self.heads = {0: Best(0, "", Node(0, None))}
        self._insert()

    def _add(self, heads: dict[int, Best], cost: int, audit: str, stack: Node | None) -> bool:
        if stack is None:
            return False
        there = heads.get(stack.state)
        if there is not None and (there.cost, there.audit) <= (cost, audit):
            return False
        heads[stack.state] = Best(cost, audit, stack)
        return True

    def _insert(self) -> None:
        """Readings with inserted rows, until they make none better."""
        todo = list(self.heads.values())
        while todo:
            head = todo.pop()
            if self.heads[head.stack.state] is head:  # not merged away since
                for symbol in ROLES:
                    stack = shifted(head.stack, symbol)
                    if self._add(self.heads, head.cost + INSERT, head.audit + "I", stack):
                        todo.append(self.heads[stack.state])

    def read(self, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        heads: dict[int, Best] = {}
        for cost, audit, stack in self.heads.values():
            self._add(heads, cost + DELETE, audit + "D", stack)
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                self._add(heads, cost + KEEP + more, audit + "K", shifted(stack, role[:1]))
                for symbol in ROLES:
                    self._add(heads, cost + REROLE + more, audit + "R", shifted(stack, symbol))
        self.heads = heads
        self._insert()
        most = min(h.cost for h in self.heads.values()) + SLACK
        self.heads = {state: h for state, h in self.heads.items() if h.cost <= most}
        if len(self.rows) % DECIDE_EVERY == 0:
            self._decide(commonprefix([h.audit for h in self.heads.values()]))

    def _decide(self, audit: str) -> None:
        """Write the rows of a beginning that all readings share."""
        if not audit:
            return
        self.heads = {state: h._replace(audit=h.audit[len(audit) :]) for state, h in self.heads.items()}
        at = 0
        for edit in audit:
            role, text = (ROLES[self.next], "") if edit == "I" else self.rows[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[self.next]
            self.write(f"{role}:{text}")
            self.next = "a" if role[:1] == "u" else "u"
        self.rows = self.rows[at:]
        self.audit.append(audit)

    def end(self) -> tuple[int, str]:
        """Cost and audit of the cheapest reading."""
        best = min(h for state, h in self.heads.items() if state in ACCEPT)
        self.heads = {best.stack.state: best}
        self._decide(best.audit)
        return best.cost, "".join(self.audit)


class _Digest:
    """SHA-256 of lines with line feeds between them."""

    def __init__(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def line(self, text: str) -> None:
        self.hash.update(("\n" + text if self.any else text).encode())
        self.any = True


class _Conversation:
    """Figures of one conversation, whose rows come in order."""

    def __init__(self, key) -> None:
        self.key, self.digest, self.counts, self.illegal = key, _Digest(), [0, 0, 0, 0], 0
        self.first = self.last = self.before = self.same = None
        self.turns = 0
        self.repair = Repair(self.digest.line)

    def read(self, gone: bool, turn: int | None, role: str, text: str, fault: int, same) -> None:
        if gone:
            return
        if fault in (SOUND, CUT) and same == self.same:
            fault = DUPLICATE  # a repeat of the row before, at the same turn
        self.same = same
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.counts[fault] += 1
        self.repair.read(role, text, fault)

    def row(self) -> dict:
        cost, audit = self.repair.end()
        return {
            "key": self.key, "gaps": 0 if self.first is None else self.last - self.first + 1 - self.turns,
            "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT], "illegal": self.illegal,
            "cost": cost, "audit": audit, "repaired_sha256": self.digest.hash.hexdigest(),
        }


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RETURNED = 1000


def _parsed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation of rows that come sorted."""
    now, done = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "role", "text", "fault", "a", "b")]
        for conv, gone, turn, role, text, fault, a, b in zip(*columns):
            if now is None or now.key != (conv,):
                if now is not None:
                    done.append(now.row())
                now = _Conversation((conv,))
            now.read(gone, turn, role, text, fault, (turn, a, b))
        if len(done) >= RETURNED:
            yield _batch(done, schema)
            done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield _batch(done, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**r, "conv_id": r["key"][0]} for r in rows], schema)


def _code(conv_id: Column, turn: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20


def damage_conversations(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text, some of them damaged by a hash of id and turn.

    Of twenty values, 0 takes the row (it stays here with `gone`), 1 its text, 2 the
    text's full stops, question and exclamation marks; 3 doubles the row, 4 makes it
    the user's.  Null roles and texts become one space.  Other columns go.
    """
    role, text = F.coalesce(col("role"), F.lit(" ")), F.coalesce(col("text"), F.lit(" "))
    code = _code(col("conv_id"), col("turn"))
    plain = rows.select(col("conv_id").alias("conv_id"), col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    return plain.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("code") == 0).alias("gone"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation from rows of conv_id, turn, role, text and, if some are only there to name it, `gone`.

    Rows are taken by turn, nulls first; ties by role and a hash of the text.  The
    first fault of a row counts: blank, duplicate (role and text seen earlier in
    the conversation), truncated (last character that is not white space is no `.!?`).
    Keep costs 0, Rerole 1, Delete 2 (blank and duplicate rows must go), Insert of
    an empty row 5; a truncated row that stays adds 5.

    Null ids make one conversation, of which the id is null; null roles and texts
    count as a space.  A conversation without rows has zeros, an empty audit and the
    digest of the empty text; an empty table gives an empty one.  Long texts and
    repeated rows are read as any other; further columns are ignored.

    First places of equal texts are found by an aggregate and a join, which spread
    the rows of one conversation.  The parse itself, and the digest, which is of one
    text, read a conversation in order in one task, a batch at a time.
    """
    gone = col("gone") if "gone" in rows.columns else F.lit(False)
    kind = rows.schema["conv_id"].dataType
    own = rows.select(
        col("conv_id").alias("conv_id"), col("turn").cast("long").alias("turn"),
        F.coalesce(col("role"), F.lit(" ")).alias("role"), F.coalesce(col("text"), F.lit(" ")).alias("text"), gone.alias("gone"),
    )
    keyed = own.withColumn("key", row_key(F.col("conv_id"), F.col("role"), F.col("text")))
    keyed = keyed.select(*own.columns, F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # where a role and text come first; only those that come more than once matter
    firsts = keyed.filter("not gone").groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "first")
    placed = keyed.join(firsts.hint("merge"), ["a", "b"], "left")
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    later = F.coalesce(place > F.col("first"), F.lit(False))
    fault = (
        F.when(trimmed == "", BLANK).when(later, DUPLICATE).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    ready = placed.select(*own.columns, "a", "b", fault.alias("fault"))
    ordered = ready.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "a", "b")
    out = T.StructType([
        T.StructField("conv_id", kind), *[T.StructField(n, T.LongType()) for n in FIGURES],
        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
    ])

    def parse(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _parsed(batches, to_arrow_schema(out))

    return ordered.select("conv_id", "gone", "turn", "role", "text", "fault", "a", "b").mapInArrow(parse, out)


def repaired_rows(role_text: list[tuple[str, str]], faults: list[int]) -> tuple[int, str, list[str]]:
    """Cost, audit and repaired lines of one conversation at hand."""
    lines: list[str] = []
    repair = Repair(lines.append)
    for (role, text), fault in zip(role_text, faults, strict=True):
        repair.read(role, text, fault)
    return *repair.end(), lines
