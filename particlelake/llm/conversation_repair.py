"""Cheapest structural repair of conversations by a square-root checkpointed program.

A conversation is legal if its roles read ``(system? (user assistant)+)?``. Keeping a row
costs nothing, giving it the role that is due 3, deleting it 4, inserting an empty
row of the role that is due 3; a truncated row that stays costs 3 more, and blank or
repeated rows must go. What is due depends on one of four states: nothing yet, after
``s``, after ``u``, after ``a``.

The cost to the end from every state is computed backwards over rows in falling order,
and written only at the ends of blocks of sqrt(n) rows. A second pass in rising order
meets each block behind its checkpoint, recomputes its costs and walks it forward, always
taking the ASCII-least edit that keeps the cost minimal. A task thus holds one block of
the conversation at hand, however long it is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, plain_names, stored

SPACE = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
CLEAN, CUT, BLANK, REPEATED = 0, 1, 2, 3
#: State after the role that is due: nothing yet, after s, after u, after a.
DUE = (2, 2, 3, 2)
DUE_ROLE = ("user", "user", "assistant", "user")
#: State after keeping a row with this initial; others cannot stay.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LEGAL_PAIRS = ("su", "ua", "au")
Costs = tuple[int, int, int, int]
#: Costs after the last row: only "nothing yet" and "after a" may end.
AT_END: Costs = (0, 6, 3, 0)


def _with_inserts(c: list[int]) -> Costs:
    """Lowers costs by what inserted rows reach; two inserts in a row come back to the same state."""
    u, a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + u), min(c[1], INSERT + u), u, a


def costs_before(after: Costs, initial: str, fault: int) -> Costs:
    """Cost to the end from each state before a row, given those after it."""
    costs = [DELETE + x for x in after]
    if fault < BLANK:
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            costs[state] = min(costs[state], REROLE + extra + after[DUE[state]])
            kept = KEEP[state].get(initial)
            if kept is not None:
                costs[state] = min(costs[state], extra + after[kept])
    return _with_inserts(costs)


def edit_at(state: int, here: Costs, after: Costs, initial: str, fault: int) -> tuple[str, int]:
    """The ASCII-least edit of minimal cost before or on a row, and the state after it."""
    left = here[state]
    if DELETE + after[state] == left:
        return "D", state
    if INSERT + here[DUE[state]] == left:
        return "I", DUE[state]
    extra = TRUNCATED if fault == CUT else 0
    kept = KEEP[state].get(initial)
    if kept is not None and extra + after[kept] == left:
        return "K", kept
    return "R", DUE[state]


def judged_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(conv, turn, role, text, *order)`` with position from 0, initial and first fault."""
    at = F.row_number().over(Window.partitionBy("conv").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = stored(rows.select("conv", "turn", "role", "text", (at - 1).cast("long").alias("position"), digest.alias("digest")), "turns")
    firsts = placed.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("position").alias("first"))
    seen = placed.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(bare == "", BLANK).when(F.col("first") < F.col("position"), REPEATED)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(CLEAN)
    )
    return seen.select("conv", "turn", "role", "text", "position", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _values(batches: Batches) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, 1000).columns])


def _checkpoints(batches: Batches) -> Batches:
    """(conv, position, costs) at every block's first position, from rows in falling order."""
    out: list[tuple] = []
    conv, costs, last, block = None, AT_END, 0, 1
    for name, position, initial, fault in _values(batches):
        if name != conv or last == 0:
            conv, costs, block, size = name, AT_END, math.isqrt(position) + 1, position + 1
        if position + 1 == size or (position + 1) % block == 0:
            out.append((conv, position // block * block, list(costs)))
        costs = costs_before(costs, initial, fault)
        last = position
        if len(out) >= 1000:
            yield _as_batch(out, CHECKPOINT)
            out = []
    yield _as_batch(out, CHECKPOINT)


def _as_batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema)], names=[n for n, _ in schema])


CHECKPOINT = [("conv", pa.int64()), ("position", pa.int64()), ("costs", pa.list_(pa.int64()))]
EDIT = [("conv", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
TOTAL = [
    *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
]
RESULT = [*EDIT, *TOTAL]
RESULT_SCHEMA = "conv long, step long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Walk:
    """One conversation walked forward, block by block."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.before = conv, 0, 0, None
        self.after: Costs = AT_END
        self.block: list[tuple] = []
        self.audit, self.hash, self.empty = bytearray(), hashlib.sha256(), True
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.turns, self.low, self.high = 0, None, None

    def meet(self, turn: int | None, role: str, text: str, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.block.append((role, text, initial, fault))

    def _step(self, edit: str, role: str, text: str) -> tuple:
        self.audit += edit.encode()
        if edit != "D":
            self.hash.update(f"{'' if self.empty else '\n'}{role}:{text}".encode())
            self.empty = False
        return (self.conv, len(self.audit) - 1, edit, role, text, *[None] * len(TOTAL))

    def finish_block(self, costs: Costs) -> Iterator[tuple]:
        """Edits of the buffered rows; ``costs`` are those after the last of them."""
        vectors = [costs]
        for _, _, initial, fault in reversed(self.block):
            vectors.append(costs_before(vectors[-1], initial, fault))
        if not self.audit:
            self.cost = vectors[-1][0]
        for role, text, initial, fault in self.block:
            here, after = vectors.pop(), vectors[-1]
            while True:
                due = DUE_ROLE[self.state]
                edit, self.state = edit_at(self.state, here, after, initial, fault)
                if edit != "I":
                    break
                yield self._step("I", due, "")
            yield self._step(edit, due if edit == "R" else role, text)
        self.block = []

    def end(self) -> Iterator[tuple]:
        while AT_END[self.state]:
            due, self.state = DUE_ROLE[self.state], DUE[self.state]
            yield self._step("I", due, "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        totals = (gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())
        yield (self.conv, -1, None, None, None, *totals)


def _edits(batches: Batches, with_rows: bool) -> Batches:
    """Edits in order and, at step -1, the totals of each conversation, from checkpoints and rows in rising order."""

    def walked() -> Iterator[tuple]:
        walk, pending = None, None
        for conv, position, costs, turn, role, text, initial, fault in _values(batches):
            if costs is not None:
                if walk is not None:
                    yield from walk.finish_block(pending)
                if walk is None or position == 0:
                    if walk is not None:
                        yield from walk.end()
                    walk = _Walk(conv)
                pending = tuple(costs)
            else:
                walk.meet(turn, role, text, initial, fault)
        if walk is not None:
            yield from walk.finish_block(pending)
            yield from walk.end()

    out, size = [], 0
    for row in walked():
        if with_rows or row[1] < 0:
            out.append(row)
            size += len(row[4] or "") + len(row[-2] or "")
        if len(out) >= 1000 or size > 1 << 22:
            yield _as_batch(out, RESULT)
            out, size = [], 0
    yield _as_batch(out, RESULT)


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    order: list[str] | None = None, with_rows: bool = True,
) -> DataFrame:
    """The cheapest repair of every conversation.

    Rows with ``step`` from 0 are the edits in order: K(eep), R(erole), D(elete) or I(nsert)
    with the row's role and text after it. The row with ``step`` -1 has the totals: gaps
    in turns, rows by first fault (blank, duplicate, truncated), illegal neighbours, cost,
    audit (all edits) and the digest of the repaired ``role:text`` lines. ``with_rows=False``
    returns totals only.

    Rows come by ``order`` (turn, role, text if not given), nulls first. Null roles and texts
    count as one space; rows without conversation are one conversation. Repeated rows are
    duplicates. Other columns are ignored, whatever their names; an empty table gives an
    empty one. Ids and turns are integers.
    """
    kept = [F.col(f"`{c}`").alias(f"__order{k}") for k, c in enumerate(order or [turn_col, role_col, text_col])]
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    plain = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), *kept)
    judged = stored(judged_rows(plain, [f"__order{k}" for k in range(len(kept))]), "judged-turns")
    falling = judged.select("conv", "position", "initial", "fault").repartition("conv").sortWithinPartitions("conv", F.desc("position"))
    marks = stored(falling.mapInArrow(_checkpoints, "conv long, position long, costs array<bigint>"), "cost-checkpoints")
    none = lambda kind: F.lit(None).cast(kind)
    both = marks.select("conv", "position", "costs", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("initial"), none("int").alias("fault"))
    both = both.unionByName(judged.select("conv", "position", none("array<bigint>").alias("costs"), "turn", "role", "text", "initial", "fault"))
    rising = both.repartition("conv").sortWithinPartitions("conv", "position", F.col("costs").isNull())
    return rising.mapInArrow(lambda b: _edits(b, with_rows), RESULT_SCHEMA)


def damaged_rows(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with known faults, chosen by a hash of id and turn.

    Of twenty rows one is dropped, one emptied, one loses its ``.!?``, one comes twice and
    one turns to user. Nulls count as one space; ``role0``, ``text0`` and ``copy`` keep the order.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = plain_names(rows, ("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text"))
    kind: Column = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    known = plain.select("conv_id", "turn", spaced("role").alias("role0"), spaced("text").alias("text0"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text0", "[.!?]", "")).otherwise(F.col("text0"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return known.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role0")).alias("role"), text.alias("text"), "role0", "text0", copies)


def repaired_totals(rows: DataFrame) -> DataFrame:
    """Totals of the repair of damaged ``rows`` for every conversation of ``rows``; zeros if no row is left."""
    totals = repair_conversations(damaged_rows(rows), order=["turn", "role0", "text0", "copy"], with_rows=False).drop("step", "edit", "role", "text")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = ids.join(totals, ids["conv_id"].eqNullSafe(totals["conv"]), "left")
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
