"""Repair of conversation structure by a lazily determinised weighted automaton.

A conversation should read as nothing, or as turns of user and assistant in
alternation, after at most one system turn.  Editing rows until they do is a
weighted automaton: states are what the last kept turn was, arcs are edits.  Its
vectors of costs still to pay, made relative to their least entry, are the
states of a deterministic one.  They are few; each is made when a row first
leads to it and kept in a table of (state, kind of row) -> (state, cost).  One
scan of the table over a conversation, last row first, gives the cost; a trace
back over that scan along tight arcs, those that lose nothing against the
vectors, gives the edits.  An edit's letter decides its target, so the least
tight letter at each step gives the least string.

Rows are named by a 128-bit hash of role and text.  Equal rows of one turn are one
row with a count before they meet anything else, and texts take part only in the
last step.  A conversation is a stream of sorted rows in one task (its hash
admits no other order): tasks hold one Arrow slice of it and its edits' letters, never all of it.

Defined results: nulls of turn sort first and make no gap; a null role or text is
one space, a null conv_id a conversation of its own; rows of one turn go by role
and hash; empty texts are blank; very long texts are one row; equal rows of one
turn stand together; a conversation that loses all rows has zeros and an empty
audit; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, table

#: What an edit costs, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: White space of the definitions.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after system, after user, after assistant.  What an added turn leads to, what a kept one leads to.
NEXT = (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}
FINAL = (0, 3)
#: More than any way to an end costs.
NEVER = 100
#: A row that has to go.
GONE = "-"
#: Rows of an Arrow slice.
SLICE = 256


def _closed(costs: list) -> tuple:
    """Costs from each state when turns may be added first; three added turns lead through all states."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


class Transitions:
    """The deterministic automaton, made as it is met: vectors of costs still to pay, and what a kind of row does to them."""

    def __init__(self):
        self.end = _closed([0 if q in FINAL else NEVER for q in range(4)])
        self.known: dict[tuple[tuple, str], tuple[tuple, int]] = {}

    def step(self, ahead: tuple, kind: str) -> tuple[tuple, int]:
        """(vector before the row, cost) for the vector behind it."""
        found = self.known.get((ahead, kind))
        if found is None:
            costs = [DELETE + c for c in ahead]
            if kind != GONE:
                more = TRUNCATED if kind.endswith("t") else 0
                for q in range(4):
                    costs[q] = min(costs[q], REROLE + more + ahead[NEXT[q]])
                for q, to in KEPT.get(kind[0], {}).items():
                    costs[q] = min(costs[q], more + ahead[to])
            closed = _closed(costs)
            found = self.known[ahead, kind] = (tuple(c - min(closed) for c in closed), min(closed))
        return found

    def edits(self, state: int, ahead: tuple, kind: str | None):
        """Tight edits from a state up to and with the one that takes the row (None: the end): (letter, next state)."""
        if kind is None:
            before, paid = ahead, 0
        else:
            before, paid = self.step(ahead, kind)
        more = TRUNCATED if kind and kind.endswith("t") else 0
        while True:
            owed = before[state] + paid
            if kind is None and owed == 0:
                return
            if kind is not None and DELETE + ahead[state] == owed:
                yield "D", state
                return
            if INSERT + before[NEXT[state]] + paid == owed:
                state = NEXT[state]
                yield "I", state
                continue
            kept = KEPT.get(kind[0], {}).get(state)
            if kept is not None and more + ahead[kept] == owed:
                yield "K", kept
            else:
                yield "R", NEXT[state]
            return


def packed(vector: tuple) -> int:
    return vector[0] | vector[1] << 8 | vector[2] << 16 | vector[3] << 24


def unpacked(code: int) -> tuple:
    return code & 255, code >> 8 & 255, code >> 16 & 255, code >> 24 & 255


def named(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies with the row's name and its own faults; nulls of role and text are one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("name"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"),
    )


def with_kinds(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, name, copies, blank, seen, cut: one row for equal rows of one turn.

    ``seen``: an earlier turn has the same role and text.  Only names that occur
    in several turns come to the join, each once a conversation.
    """
    one = scratch.save(rows.groupBy("conv_id", "turn", "role", "name", "blank", "cut").agg(F.sum("copies").alias("copies")), "rows")
    first = one.groupBy("conv_id", "name").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("__c"), F.col("name").alias("__n"), "first")
    joined = one.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("name") == F.col("__n")), "left")
    seen = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return joined.select("conv_id", "turn", "role", "name", "copies", "blank", seen.alias("seen"), "cut")


def kind_of(role: str, blank: bool, seen: bool, cut: bool) -> str:
    return GONE if blank or seen else (role[:1] if role[:1] in KEPT else "?") + ("t" if cut else "")


def scanned(kinds: DataFrame) -> DataFrame:
    """with_kinds() with ``ahead`` and ``owed``: the automaton's state behind each row and what was paid for it.

    Streams sorted rows, last first; carried on is one state.
    """
    fields = StructType([*kinds.schema, StructField("ahead", LongType()), StructField("owed", LongType())])

    def scan(batches):
        table_, last, vector, owed = Transitions(), (), None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                columns = [part.column(c).to_pylist() for c in ("conv_id", "role", "copies", "blank", "seen", "cut")]
                states, debts = [], []
                for conv, role, copies, blank, seen, cut in zip(*columns):
                    if last != (conv,):
                        last, vector, owed = (conv,), table_.end, 0
                    owed += DELETE * (copies - 1)  # the others of equal rows go, which leaves the vector as it is
                    states.append(packed(vector))
                    debts.append(owed)
                    vector, cost = table_.step(vector, kind_of(role, blank, seen, cut))
                    owed += cost
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(states, pa.int64()), pa.array(debts, pa.int64())], names=[*part.schema.names, "ahead", "owed"])

    backwards = kinds.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("name").desc())
    return backwards.mapInArrow(scan, fields)


#: Columns that only the last row of a conversation has.
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, scratch: Scratch, every: DataFrame | None = None) -> DataFrame:
    """The edits that repair conversations: conv_id, edit, turn, role, text, and a last row with the facts.

    rows(conv_id, turn, role, text[, copies]); ``every`` (conv_id) adds
    conversations without rows.  ``edit`` is K(eep), R(erole), D(elete) or
    I(nsert); deleted rows have no role and text here.  The last row of a
    conversation has a null edit and the columns of FACTS.  All rows of a
    conversation lie in one partition, in their order, so a reader may stream them.
    """
    told = named(rows)
    decided = scanned(with_kinds(told, scratch))
    none = {c: F.lit(None) for c in ("turn", "role", "name", "copies", "blank", "seen", "cut", "ahead", "owed")}
    starts = (rows if every is None else rows.select("conv_id").unionByName(every)).select("conv_id").distinct()
    starts = starts.withColumns(none).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in decided.schema]).withColumns({"text": F.lit(None).cast("string"), "step": F.lit(0)})
    letters = decided.withColumns({"text": F.lit(None).cast("string"), "step": F.lit(1)})
    texts = told.filter(~F.col("blank")).select("conv_id", "turn", "role", "name", "text", F.lit(2).alias("step"))
    stream = starts.unionByName(letters).unionByName(texts, allowMissingColumns=True)
    ordered = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.col("step") > 0, F.col("turn").asc_nulls_first(), "role", "name", "step")
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, edit string, turn long, role string, text string, " + ", ".join(f"{c} long" for c in FACTS)
    return ordered.mapInArrow(_edits, schema)


class _Trace:
    """One conversation on its way: where the automaton stands, and what was counted."""

    def __init__(self, conv):
        self.conv, self.state, self.initial, self.waits = conv, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.low = self.high = None
        self.ahead = None

    def row(self, table_: Transitions, turn, role, copies, blank, seen, cut, ahead, owed):
        """Rows of one name in one turn; yields the edits of the first, whose text is still to come."""
        kind, vector = kind_of(role, blank, seen, cut), unpacked(ahead)
        if self.ahead is None:  # the first row: what the scan has paid, and what the start owes
            before, paid = table_.step(vector, kind)
            self.cost = owed + paid + before[0]
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if seen else copies - 1
        self.truncated += 1 if cut and not blank and not seen else 0
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial, self.ahead = initial, vector
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        for letter, state in table_.edits(self.state, vector, kind):
            self.state = state
            if letter == "I":
                yield letter, None, ROLE[state]
            else:
                yield letter, turn, role if letter == "K" else ROLE[state] if letter == "R" else None

    def end(self, table_: Transitions):
        if self.ahead is not None:
            for letter, state in table_.edits(self.state, table_.end, None):
                self.state = state
                yield letter, None, ROLE[state]

    def facts(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost


def _edits(batches):
    table_, now, out, nothing = Transitions(), None, [], [None] * len(FACTS)
    held: list = []  # edits of a row whose text comes next
    more, conv_type = (0, None), pa.int64()  # and how many equal rows of which turn go after it

    def full(least: int):
        if len(out) >= least:
            types = [conv_type, pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.int64()] * len(FACTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "edit", "turn", "role", "text", *FACTS])
            out.clear()

    def release(text=None):
        nonlocal more
        for letter, turn, role in held:
            out.append((now.conv, letter, turn, role, text if letter in "KR" else "" if letter == "I" else None, *nothing))
        held.clear()
        for _ in range(more[0]):
            out.append((now.conv, "D", more[1], None, None, *nothing))
            yield from full(SLICE)
        more = (0, None)

    def finish():
        yield from release()
        out.extend((now.conv, letter, turn, role, "", *nothing) for letter, turn, role in now.end(table_))
        out.append((now.conv, None, None, None, None, *now.facts()))

    names = ("conv_id", "step", "turn", "role", "copies", "blank", "seen", "cut", "ahead", "owed", "text")
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for conv, step, turn, role, copies, blank, seen, cut, ahead, owed, text in zip(*[part.column(c).to_pylist() for c in names]):
                if step == 0:
                    if now is not None:
                        yield from finish()
                    now = _Trace(conv)
                elif step == 1:
                    yield from release()
                    held.extend(now.row(table_, turn, role, copies, blank, seen, cut, ahead, owed))
                    more = (copies - 1, turn)
                else:
                    yield from release(text)  # texts of further equal rows find nothing held
            yield from full(1)
    if now is not None:
        yield from finish()
        yield from full(1)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of full stops, repeated or given to the user, by a hash of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code, text = F.crc32(key) % 20, F.coalesce("text", F.lit(" "))
    return conversations.filter(code != 0).select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(code == 3, 2).otherwise(1).alias("copies"),
    )


def digest(edits: DataFrame) -> DataFrame:
    """One row per conversation: the facts, the letters of its edits, and a hash of what they leave."""
    conv = edits.schema["conv_id"].dataType.simpleString()
    kept: Column = F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text"))
    fields = ["conv_id", *FACTS[:5], "cost", "audit", "repaired_sha256"]

    def fold(batches):
        letters, hashed, some = bytearray(), hashlib.sha256(), False
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for conv_id, edit, line, *facts in zip(*[part.column(c).to_pylist() for c in ("conv_id", "edit", "line", *FACTS)]):
                    if edit is None:
                        out.append((conv_id, *facts, letters.decode(), hashed.hexdigest()))
                        letters, hashed, some = bytearray(), hashlib.sha256(), False
                        continue
                    letters += edit.encode()
                    if line is not None:
                        hashed.update((b"\n" if some else b"") + line.encode())
                        some = True
            types = [batch.schema.field("conv_id").type] + [pa.int64()] * len(FACTS) + [pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[] for _ in fields], types)], names=fields)

    schema = f"conv_id {conv}, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"
    return edits.select("conv_id", "edit", kept.alias("line"), *FACTS).mapInArrow(fold, schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return digest(repair(damaged(conversations), Scratch(spark, "repair"), conversations.select("conv_id")))
