"""Repair of conversations with the fewest and cheapest edits, by block tables in the manner of the Four Russians.

A repaired conversation has an optional system row and then user and assistant rows in turn. While it is written
there are four states (nothing yet, after system, after user, after assistant). What the rest of a conversation costs
from each of them is a vector of four numbers; taken from the end, a row turns the vector of what follows into its
own. Up to their smallest entry there are few such vectors, so for every block of BLOCK row symbols a table says which
vector becomes which, and what is added. Blocks are looked up from the end; then each is expanded backward into the
vectors between its rows, along which the first of the cheapest edits in ASCII order is taken from the front.

Rows are put in order by a range exchange, so a long conversation lies in many tasks. Conversations that lie within
one are repaired there. Of the others each stretch of rows becomes a function from vector to vector; the functions of
a conversation, one for thousands of rows, are composed from the end, and tell each stretch the vector behind it. Last,
their edits and the digest, which only exists in order, are streamed.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from deltascope.llm import common

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 4
#: Rows and characters of a stretch of a conversation that is handled at a time.
RUN_ROWS, RUN_CHARS = 4096, 1 << 20
NO_FAULT, BLANK, DUPLICATE, CUT_SHORT = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a further row that alternates, from each state.
TURN = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Symbols of rows: one that must go, then each initial without and with a text cut short.
INITIALS = ("s", "u", "a", "")
SYMBOLS = 1 + 2 * len(INITIALS)


def _after_keeping(state: int, initial: int) -> int | None:
    if INITIALS[initial] == "s":
        return SYSTEM if state == NOTHING else None
    wanted = {"u": USER, "a": ASSISTANT}.get(INITIALS[initial])
    return wanted if wanted is not None and TURN[state] == wanted else None


def _step(symbol: int, behind: tuple) -> list[int]:
    """Costs from each state before a row, given those behind it."""
    cost = [DELETE + behind[q] for q in range(4)]
    if symbol:
        initial, extra = divmod(symbol - 1, 2)
        for q in range(4):
            kept = _after_keeping(q, initial)
            cost[q] = min(cost[q], REROLE + extra * TRUNCATED + behind[TURN[q]], *([extra * TRUNCATED + behind[kept]] if kept is not None else []))
    for _ in range(3):  # rows inserted before this one
        cost = [min(cost[q], INSERT + cost[TURN[q]]) for q in range(4)]
    return cost


class Tables:
    """Vectors, and for blocks of 1 to BLOCK symbols the vector and the sum that each turns a vector into."""

    def __init__(self, block: int = BLOCK):
        end = (0, 2 * INSERT, INSERT, 0)
        numbers, self.vectors, single = {end: 0}, [end], []
        while len(single) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                cost = _step(symbol, self.vectors[len(single)])
                low = min(cost)
                vector = tuple(c - low for c in cost)
                if vector not in numbers:
                    numbers[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((numbers[vector], low))
            single.append(row)
        table = np.array(single).transpose(1, 0, 2)  # symbol, vector behind
        self.next, self.added = [None, table[..., 0].copy()], [None, table[..., 1].copy()]
        for size in range(2, block + 1):
            rest, rest_added = self.next[-1], self.added[-1]
            self.next.append(self.next[1][:, rest].reshape(SYMBOLS**size, -1))
            self.added.append((self.added[1][:, rest] + rest_added).reshape(SYMBOLS**size, -1))
        self.block = block

    def blocks(self, symbols: np.ndarray) -> list[tuple[int, int]]:
        """Size and code of each block; the first is the odd one."""
        odd = len(symbols) % self.block
        codes = symbols[odd:].reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))
        head = [(odd, int(functools.reduce(lambda code, s: code * SYMBOLS + int(s), symbols[:odd], 0)))] if odd else []
        return head + [(self.block, int(code)) for code in codes]

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a stretch turns each vector into, and what it adds."""
        vector = np.arange(len(self.vectors))
        total = np.zeros(len(self.vectors), np.int64)
        for size, code in reversed(self.blocks(symbols)):
            total += self.added[size][code][vector]
            vector = self.next[size][code][vector]
        return vector, total

    def trace(self, symbols: np.ndarray, behind: int, state: int, last: bool) -> tuple[str, int]:
        """ASCII-least of the cheapest edits from `state` on, with vector `behind` after the stretch, and the state after it.

        last: the conversation ends with the stretch.
        """
        blocks = self.blocks(symbols)
        right = [behind]
        for size, code in reversed(blocks):
            right.append(int(self.next[size][code][right[-1]]))
        right = right[::-1][1:]  # the vector behind each block
        audit, at = [], 0
        for (size, _), vector in zip(blocks, right):
            inner = [vector]
            for symbol in symbols[at : at + size][::-1]:
                inner.append(int(self.next[1][symbol][inner[-1]]))
            inner.reverse()
            for k in range(size):
                state = self._edit(int(symbols[at + k]), inner[k], inner[k + 1], state, audit)
            at += size
        while last and state in (SYSTEM, USER):
            audit.append("I")
            state = TURN[state]
        return "".join(audit), state

    def _edit(self, symbol: int, here: int, behind: int, state: int, audit: list[str]) -> int:
        cost, after, added = self.vectors[here], self.vectors[behind], int(self.added[1][symbol][behind])
        while True:
            goal = added + cost[state]
            if DELETE + after[state] == goal:
                audit.append("D")
                return state
            if INSERT + cost[TURN[state]] == cost[state]:
                audit.append("I")
                state = TURN[state]
                continue
            initial, extra = divmod(symbol - 1, 2)
            kept = _after_keeping(state, initial)
            if kept is not None and extra * TRUNCATED + after[kept] == goal:
                audit.append("K")
                return kept
            audit.append("R")
            return TURN[state]


@functools.cache
def tables() -> Tables:
    return Tables()


@functools.lru_cache(maxsize=1 << 16)
def _short_trace(symbols: bytes, behind: int, state: int, last: bool) -> tuple[str, int]:
    return tables().trace(np.frombuffer(symbols, np.uint8).astype(np.int64), behind, state, last)


def _symbol(initial: str, fault: int) -> int:
    if fault in (BLANK, DUPLICATE):
        return 0
    return 1 + 2 * (INITIALS.index(initial) if initial in INITIALS else INITIALS.index("")) + (fault == CUT_SHORT)


class Repair:
    """Counts, edits and digest of one conversation, whose rows come in order and in stretches."""

    def __init__(self, with_text: bool):
        self.faults = [0] * 4
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.initial, self.state, self.audit = None, NOTHING, []
        self.digest, self.lines, self.written = hashlib.sha256(), [] if with_text else None, False

    def add(self, rows: list[tuple], behind: int, last: bool) -> None:
        """rows: (turn, fault, initial, role, text); behind: the vector after them."""
        symbols = bytes(_symbol(initial, fault) for _, fault, initial, _, _ in rows)
        for turn, fault, initial, _, _ in rows:
            self.faults[fault] += 1
            if turn is not None:
                if turn != self.turn:
                    self.turns += 1
                self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.initial = initial
        state = self.state
        edits, self.state = (_short_trace if len(symbols) <= 64 else _short_trace.__wrapped__)(symbols, behind, state, last)
        self.audit.append(edits)
        at = 0
        for edit in edits:
            if edit == "I":
                state, self.cost = TURN[state], self.cost + INSERT
                self._write(ROLE_OF[state], "")
                continue
            _, fault, initial, role, text = rows[at]
            at += 1
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += TRUNCATED * (fault == CUT_SHORT)
            if edit == "R":
                state, self.cost = TURN[state], self.cost + REROLE
                role = ROLE_OF[state]
            else:
                state = SYSTEM if initial == "s" else TURN[state]
            self._write(role, text)

    def _write(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update((("\n" if self.written else "") + line).encode())
        self.written = True
        if self.lines is not None:
            self.lines.append(line)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        text = () if self.lines is None else ("\n".join(self.lines),)
        return (gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_SHORT], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest(), *text)


RESULT = ["gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string"]
_ROWS = "array<struct<turn: long, fault: int, initial: string, role: string, text: string>>"


def _arrow(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[]] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id and row, each copy after its row as a duplicate without text; None for a conversation without rows here."""
    for batch in batches:
        for conv, turn, role, text, copies, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "copies", "fault"))):
            if copies == 0:
                yield conv, None
                continue
            gone = fault in (BLANK, DUPLICATE)
            yield conv, (turn, fault, role[:1], role, "" if gone else text)
            for _ in range(copies - 1):
                yield conv, (turn, fault if gone else DUPLICATE, role[:1], role, "")


def _split(schema: StructType, with_text: bool):
    """Repairs conversations that lie within the task, and hands on the others in stretches."""
    blank = (None,) * (len(RESULT) + with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out, held, chars = TaskContext.get().partitionId(), [], [], 0
        current, opened, whole, number, waiting = None, False, False, 0, 0

        def stretch() -> None:
            nonlocal held, chars, whole, number, waiting
            out.append((current, piece, number, held, *blank))
            held, chars, whole, number, waiting = [], 0, False, number + 1, waiting + chars

        for conv, row in _entries(batches):
            if not opened or conv != current:
                if opened and whole:
                    repair = Repair(with_text)
                    repair.add(held, 0, True)
                    out.append((current, None, None, None, *repair.result()))
                    held, chars = [], 0
                elif opened:
                    stretch()
                current, whole, opened = conv, opened, True  # the task's first conversation may have begun before
            if row is not None:
                held.append(row)
                chars += len(row[3]) + len(row[4])
            if len(held) >= RUN_ROWS or chars >= RUN_CHARS:
                stretch()
            if len(out) >= 1000 or waiting >= RUN_CHARS:
                yield _arrow(out, schema)
                out, waiting = [], 0
        if opened:
            stretch()
        yield _arrow(out, schema)

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [], []
        for rows in batch.column("rows").to_pylist():
            vector, added = tables().function(np.array([_symbol(r["initial"], r["fault"]) for r in rows], np.int64))
            out[0].append(vector.tolist())
            out[1].append(added.tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("piece"), batch.column("number"), pa.array(out[0], pa.list_(pa.int32()))], names=["conv_id", "piece", "number", "becomes"]
        )


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector behind each stretch; stretches come by conversation, last first."""
    current, vector, opened = None, 0, False
    for batch in batches:
        behind, last = [], []
        for conv, becomes in zip(batch.column("conv_id").to_pylist(), batch.column("becomes").to_pylist()):
            last.append(not opened or conv != current)
            if last[-1]:
                current, vector, opened = conv, 0, True
            behind.append(vector)
            vector = becomes[vector]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("number"), pa.array(behind, pa.int32()), pa.array(last, pa.bool_())], names=["piece", "number", "behind", "last"])


def _put_together(schema: StructType, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = None
        for batch in batches:
            out = []
            for conv, rows, behind, last in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "rows", "behind", "last"))):
                repair = repair or Repair(with_text)
                repair.add([(r["turn"], r["fault"], r["initial"], r["role"], r["text"]) for r in rows], behind, last)
                if last:
                    out.append((conv, *repair.result()))
                    repair = None
            yield _arrow(out, schema)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by the crc32 of `conv_id:turn`, a null counting as one space; `copies` says how often each comes.

    Of 20 remainders, 0 drops the row (no copy), 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes the user its role.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def _ends_open(text: Column) -> Column:
    return ~F.substring(F.rtrim(text, F.lit(common.WORD_BREAKS)), -1, 1).isin(".", "!", "?")


def repair(conversations: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Columns read: conv_id, turn, role, text, and `copies` (1 if there is none): rows with 0 copies only name their
    conversation. Null roles and texts are one space. Rows of a conversation are ordered by turn (nulls first), then
    role, first 32 characters and digest of the text; equal rows are next to each other and all but the first are
    duplicates. Rows without conv_id are one conversation. A conversation without rows has zeros, no edits and the
    digest of nothing. An empty table gives no rows. with_text: adds `repaired`, the repaired rows as one text.
    """
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = common.small_batches(conversations).select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), copies.cast("long").alias("copies"))
    conv = spaced("conv_id")
    rows = rows.withColumn("mark", F.unhex(F.sha2(F.concat_ws(":", F.length(conv), F.col("conv_id").isNull(), F.length("role"), conv, "role", "text").cast("binary"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    repeated = rows.where("copies > 0").groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = common.stored(repeated, "repeated")
    rows = rows.join(repeated, "mark", "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    own = ["conv_id", "turn", "role", "text", "mark", "later"]
    single = rows.where("first IS NULL OR copies = 0").select(*own, "copies")
    many = rows.where("first IS NOT NULL AND copies > 0").groupBy(*own).agg(F.sum("copies").alias("copies"))
    ink = F.length(F.rtrim(F.col("text"), F.lit(common.WORD_BREAKS))) > 0
    fault = F.when(~ink, BLANK).when(F.col("later"), DUPLICATE).when(_ends_open(F.col("text")), CUT_SHORT).otherwise(NO_FAULT)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("begins"), F.asc("mark")]
    ranged = single.unionByName(many).withColumn("begins", F.substring("text", 1, 32)).repartitionByRange(*order).sortWithinPartitions(*order)
    results = [*RESULT, *(["repaired string"] if with_text else [])]
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(", ".join([f"conv_id {kind}", "piece int", "number long", f"rows {_ROWS}", *results]))
    parts = common.stored(ranged.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")).mapInArrow(_split(schema, with_text), schema), "conversations")
    names = ["conv_id", *(x.split()[0] for x in results)]
    stretches = parts.where("piece IS NOT NULL").select("conv_id", "piece", "number", "rows")
    functions = stretches.mapInArrow(_functions, f"conv_id {kind}, piece int, number long, becomes array<int>")
    backward = functions.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"), F.desc("number"))
    behind = backward.mapInArrow(_from_the_end, "piece int, number long, behind int, last boolean")
    forward = stretches.join(behind, ["piece", "number"]).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "number")
    final = StructType.fromDDL(", ".join([f"conv_id {kind}", *results]))
    whole = parts.where("piece IS NULL").select(*names)
    return whole.unionByName(forward.select("conv_id", "rows", "behind", "last").mapInArrow(_put_together(final, with_text), final))
