"""Repair of conversation structure by cheapest edits, with Four-Russians block tables.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. A row may be kept, given the role
user or assistant, or deleted; empty user and assistant turns may be inserted. A small automaton with four states reads the repaired roles, so the
costs of all edits so far are a vector of four numbers.

Less its smallest entry, and with entries that no cheapest repair can pass through taken as unreachable, such a vector takes few values. ``_Tables``
lists them, and precomputes for every vector and every block of ``BLOCK`` symbols the vector behind the block and what it adds to the cost. A
conversation's symbols, one byte a row, are processed by one lookup a block. Then blocks are expanded from the last to the first: single
steps give the vectors within a block, and a lookup a row gives the states that lie on some cheapest repair. Reading those from the front and taking the
least letter each time gives the least of all cheapest edit strings, since a letter leads from a state to one other state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacansift.llm.shared import saved

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# States of the automaton: nothing yet, after a system turn, after a user turn, after a pair. The first and the last may be the end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FINAL = (0, 3)
_FAR = 99
# Whatever can be done from one state can be done from another for at most 5 more, so an entry further off is never part of a cheapest repair.
_REACH = 8

#: Symbols of rows: one to delete in any case, then the role's initial (s, u, a, other), whole or truncated.
INITIALS = "sua"
DELETED, SYMBOLS = 0, 9


def symbol(initial: int, truncated: bool) -> int:
    return 1 + 2 * initial + truncated


def _edits(state: int, sym: int) -> list[tuple[str, str, int, int]]:
    """letter, what is done, cost, next state of the edits of a row, in the order of their letters."""
    found = [("D", "D", DELETE, state)]
    if sym != DELETED:
        initial, extra = "sua?"[(sym - 1) // 2], TRUNCATED * ((sym - 1) % 2)
        if initial in _NEXT[state]:
            found.append(("K", "K", KEEP + extra, _NEXT[state][initial]))
        found += [("R", role.upper(), REROLE + extra, to) for role, to in _NEXT[state].items() if role != "s"]
    return found


def _inserts(state: int) -> list[tuple[str, int]]:
    return [(role, to) for role, to in _NEXT[state].items() if role != "s"]


def _with_inserts(costs: list[int]) -> list[int]:
    costs = list(costs)
    for _ in range(2):
        for state in range(4):
            for _role, to in _inserts(state):
                costs[to] = min(costs[to], costs[state] + INSERT)
    return costs


def _normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c - least <= _REACH else _FAR for c in costs), least


class _Tables:
    """Transitions of normalised cost vectors by symbol and by block, and of co-optimal states backwards."""

    def __init__(self) -> None:
        first = _normal(_with_inserts([0, _FAR, _FAR, _FAR]))[0]
        self.vectors = [first]
        place = {first: 0}
        after, add = [], []
        for vector in self.vectors:  # grows while it is read
            row = []
            for sym in range(SYMBOLS):
                costs = [_FAR] * 4
                for state in range(4):
                    for _letter, _do, cost, to in _edits(state, sym):
                        costs[to] = min(costs[to], vector[state] + cost)
                following, least = _normal(_with_inserts(costs))
                if following not in place:
                    place[following] = len(self.vectors)
                    self.vectors.append(following)
                row.append((place[following], least))
            after.append([r[0] for r in row])
            add.append([r[1] for r in row])
        self.after, self.add = np.array(after, np.int32), np.array(add, np.int32)
        count = len(self.vectors)
        self.block_after = np.repeat(np.arange(count, dtype=np.int32)[:, None], SYMBOLS**BLOCK, axis=1)
        self.block_add = np.zeros((count, SYMBOLS**BLOCK), np.int32)
        codes = np.arange(SYMBOLS**BLOCK)
        for k in reversed(range(BLOCK)):
            sym = codes // SYMBOLS**k % SYMBOLS
            self.block_add += self.add[self.block_after, sym]
            self.block_after = self.after[self.block_after, sym]
        self.back = np.zeros((count, SYMBOLS, 16), np.uint8)
        for v in range(count):
            for sym in range(SYMBOLS):
                for marks in range(16):
                    self.back[v, sym, marks] = self._before(v, sym, marks)
        self._chosen: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def _joins(self, v: int, sym: int, state: int) -> list[tuple[str, str, int]]:
        """Edits of a row that keep to the cost vectors before and behind it."""
        ahead, add = self.vectors[self.after[v, sym]], self.add[v, sym]
        here = self.vectors[v][state]
        return [(a, do, to) for a, do, cost, to in _edits(state, sym) if here < _FAR and here + cost - add == ahead[to]]

    def _inserted_before(self, v: int, marks: int) -> int:
        """Marked states, and those from which inserted turns lead to them at no loss."""
        vector = self.vectors[v]
        for _ in range(2):
            for state in range(4):
                if vector[state] < _FAR and any(
                    marks >> to & 1 and vector[state] + INSERT == vector[to] for _, to in _inserts(state)
                ):
                    marks |= 1 << state
        return marks

    def _before(self, v: int, sym: int, marks: int) -> int:
        found = 0
        for state in range(4):
            if any(marks >> to & 1 for _, _, to in self._joins(v, sym, state)):
                found |= 1 << state
        return self._inserted_before(v, found)

    def ends(self, v: int) -> tuple[int, int]:
        """What is left to pay behind the last row, and the states that lie on a cheapest repair there."""
        vector = self.vectors[v]
        least = min(vector[q] for q in _FINAL)
        return least, self._inserted_before(v, sum(1 << q for q in _FINAL if vector[q] == least))

    def choose(self, v: int, sym: int, marks: int, ahead: int, state: int) -> tuple[str, int]:
        """The least edit letters up to and with that of a row, as roles to insert and what is done, and the state behind it.

        ``marks`` and ``ahead`` are the states that lie on a cheapest repair before and behind the row.
        """
        key = (v, sym, marks << 4 | ahead, state)
        if key not in self._chosen:
            done = ""
            while True:
                steps = [(a, do, to, False) for a, do, to in self._joins(v, sym, state) if ahead >> to & 1]
                steps += [("I", role, to, True) for role, to in self._inserted_next(v, marks, state)]
                _, do, state, more = min(steps)
                done += do
                if not more:
                    break
            self._chosen[key] = (done, state)
        return self._chosen[key]

    def _inserted_next(self, v: int, marks: int, state: int) -> list[tuple[str, int]]:
        vector = self.vectors[v]
        return [(role, to) for role, to in _inserts(state) if marks >> to & 1 and vector[state] + INSERT == vector[to]]

    def choose_end(self, v: int, marks: int, state: int) -> str:
        least, _ = self.ends(v)
        done = ""
        while not (state in _FINAL and self.vectors[v][state] == least):
            role, state = self._inserted_next(v, marks, state)[0]
            done += role
        return done


@cache
def _tables() -> _Tables:
    return _Tables()


def repaired(symbols: bytes) -> tuple[int, list[str]]:
    """Cost of the cheapest repair, and per row the roles to insert before it (u, a) and what is done with it: K, D, or U or A for a new role.

    The last entry has the roles to insert behind all rows. Of repairs of equal cost, the one whose :func:`audit` is least in ASCII.
    """
    t = _tables()
    n = len(symbols)
    whole = n // BLOCK
    row = np.frombuffer(symbols, np.uint8).astype(np.int64)
    codes = row[: whole * BLOCK].reshape(whole, BLOCK) @ (SYMBOLS ** np.arange(BLOCK)[::-1])
    starts, v, cost = [], 0, 0
    for code in codes.tolist():  # one lookup a block
        starts.append(v)
        cost += int(t.block_add[v, code])
        v = int(t.block_after[v, code])
    starts.append(v)

    def expanded(block: int) -> list[int]:
        """Vectors before each row of a block, and behind its last one."""
        found = [starts[block]]
        for sym in symbols[block * BLOCK : (block + 1) * BLOCK]:
            found.append(int(t.after[found[-1], sym]))
        return found

    last = expanded(whole)  # rows that fill no block
    for k, sym in enumerate(symbols[whole * BLOCK :]):
        cost += int(t.add[last[k], sym])
    rest, marks = t.ends(last[-1])
    cost += rest
    cheapest = bytearray(n + 1)
    cheapest[n] = marks
    for block in reversed(range(whole + 1)):
        vectors = last if block == whole else expanded(block)
        for k in reversed(range(len(vectors) - 1)):
            at = block * BLOCK + k
            cheapest[at] = t.back[vectors[k], symbols[at], cheapest[at + 1]]
    edits, state = [], 0
    for block in range(whole + 1):
        vectors = last if block == whole else expanded(block)
        for k in range(len(vectors) - 1):
            at = block * BLOCK + k
            done, state = t.choose(vectors[k], symbols[at], cheapest[at], cheapest[at + 1], state)
            edits.append(done)
    edits.append(t.choose_end(last[-1], marks, state))
    return cost, edits


_LETTERS = str.maketrans("uaUA", "IIRR")


def audit(edits: list[str]) -> str:
    return "".join(edits).translate(_LETTERS)


_SEEN = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def marked(turns: DataFrame) -> DataFrame:
    """Rows with their place ``pos`` in the conversation (by turn, null first, then role and text), first fault and symbol.

    The fault is blank, duplicate (role and text of an earlier row), truncated or null; ``illegal`` tells of a role that can't follow the one
    before it, ``new_turn`` of a turn number that differs from it. Null roles and texts are one space.
    """
    one = F.lit(" ")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    before = F.lag("turn").over(order)
    rows = rows.select(
        "*",
        F.row_number().over(order).cast("long").alias("pos"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~before.eqNullSafe(F.col("turn"))).alias("new_turn"),
        F.sha2("text", 256).alias("digest"),
    )
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("pos")
    fault = (
        F.when(~F.col("text").rlike(_SEEN), "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.col("text").rlike(_ENDED), "truncated")
    )
    place = F.position(initial, F.lit(INITIALS)) - 1
    initial_number = F.when((initial == "") | (place < 0), len(INITIALS)).otherwise(place)
    whole = F.coalesce(F.col("fault") != "truncated", F.lit(True))
    sym = F.when(F.col("fault").isin("blank", "duplicate"), DELETED).otherwise(
        1 + 2 * initial_number + F.when(whole, 0).otherwise(1)
    )
    return rows.withColumn("fault", fault).withColumn("symbol", sym.cast("int")).drop("digest")


_EDITS = "conv_id long, pos long, edit string, cost long, audit string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of edits from rows of symbols in order; of a conversation only its symbols, a byte a row, are held."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]
    )

    def done(conv: int | None, symbols: bytearray) -> list[tuple]:
        cost, edits = repaired(bytes(symbols))
        rows = [(conv, k + 1, e, None, None) for k, e in enumerate(edits)]
        return [*rows, (conv, None, None, cost, audit(edits))]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    nothing = object()
    current, symbols = nothing, bytearray()
    for batch in batches:
        out = []
        for conv, sym in zip(batch.column("conv_id").to_pylist(), batch.column("symbol").to_pylist(), strict=True):
            if conv != current:
                if current is not nothing:
                    out += done(current, symbols)
                current, symbols = conv, bytearray()
            symbols.append(sym)
        yield made(out)
    if current is not nothing:
        yield made(done(current, symbols))


_ROLES = {"u": "user", "a": "assistant"}


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each repaired conversation, from its edits and rows in order, held one at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    nothing = object()
    current, edit, digest, lines = nothing, "", hashlib.sha256(), 0
    for batch in batches:
        ids, digests = [], []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")]
        for conv, new_edit, role, text in zip(*columns, strict=True):
            if conv != current:
                if current is not nothing:
                    ids.append(current)
                    digests.append(digest.hexdigest())
                current, digest, lines = conv, hashlib.sha256(), 0
            if new_edit is not None:
                edit = new_edit
                out = [f"{_ROLES[c]}:" for c in edit if c in _ROLES]
            else:
                out = [] if edit[-1] == "D" else [f"{_ROLES.get(edit[-1].lower(), role)}:{text}"]
            for line in out:
                digest.update((("\n" if lines else "") + line).encode())
                lines += 1
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], schema=schema)
    if current is not nothing:
        last = [pa.array([current], pa.int64()), pa.array([digest.hexdigest()], pa.string())]
        yield pa.RecordBatch.from_arrays(last, schema=schema)


def edits(rows: DataFrame) -> DataFrame:
    """Edits of the rows of :func:`marked`: conv_id, pos, edit, and a row per conversation with a null pos that has cost and audit."""
    return (
        rows.select("conv_id", "pos", "symbol")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos")
        .mapInArrow(_edited, _EDITS)
    )


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id and turn (integers), role and text; other columns are ignored. Null roles and texts count as one space, rows without a conv_id are
    one conversation, null turns come first, and rows of one turn follow role, then text. ``conversations`` (conv_id) names conversations to
    report besides; one without rows has zeros, an empty audit and the digest of an empty string. An empty table gives no rows.

    Costs: keep 0, new role 2, delete 3 (blank and duplicate rows must go), insert 2; a truncated row that stays costs 1 more. ``gaps`` are turn
    numbers missing between the smallest and the largest. A conversation passes through a task as a sorted stream: a byte a row and its edits are held,
    its texts never. Texts move twice, sorted by conversation.
    """
    rows = saved(marked(turns.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})), "marked-turns")

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0)).alias("gaps"),
        *[count(F.col("fault").eqNullSafe(f)).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
    )
    found = saved(edits(rows), "turn-edits")
    costs = found.where("pos IS NULL").select("conv_id", "cost", "audit")
    stream = found.where("pos IS NOT NULL").select(
        "conv_id", "pos", F.lit(0).alias("kind"), "edit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")
    )
    texts = rows.select("conv_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edit"), "role", "text")
    digests = (
        stream.unionByName(texts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos", "kind")
        .mapInArrow(_digested, "conv_id long, repaired_sha256 string")
    )
    ids = rows.select("conv_id")
    if conversations is not None:
        ids = ids.unionByName(conversations.select(F.col("conv_id").cast("long")))
    out = ids.distinct()
    for part in (counts, costs, digests):
        part = part.withColumnRenamed("conv_id", "same_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("same_id")), "left").drop("same_id")
    zeros = dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0)
    return out.na.fill({**zeros, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}).select(
        "conv_id", *zeros, "audit", "repaired_sha256"
    )
