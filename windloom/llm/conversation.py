"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation should read ``(system? (user assistant)+)?``: four states, named by what was read last. A row can be kept,
given the other role, or deleted, and empty rows can be inserted. The forward vector holds the least cost of reaching each
state and the order of the least audits that do so; the backward vector holds the least cost of getting from each state to
the end. They meet in the middle, the audit-least optimal state there is taken, and both halves go on alone, so what is
kept besides the rows' kinds is two vectors of four.

Two audits that reach one crossing have equally many edits besides insertions and end in one, so neither is a prefix of the
other, and an audit fixes its state. Therefore the order of the left parts alone settles ties.

At scale the rows are sorted by conversation and turn over range partitions, which cut a long conversation into segments. A
conversation inside a partition is repaired there. Of a segment only a 4 by 4 table of costs and orders goes to the task that
joins the segments of a conversation, by the same divide and conquer; then each segment is repaired alone, between its
states. A hash of a whole repaired text is sequential by nature, so the kept rows of a cut conversation are streamed through
one task, never gathered.

Defined results: a null conv_id is a conversation of its own; null turns sort first; rows of one turn go by role, then by the
md5 of the text; rows equal in all of these are one row that is repeated; a null role or text is one space, an empty role
has no initial; texts are compared by md5; long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_heavy

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What the grammar lets follow a state, by initial; and the state that an inserted or given role leads to.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ONWARD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Insertions that end a conversation from each state.
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60

#: Rows and bytes of text that a task holds of one conversation before it hands them on as a segment.
HELD_ROWS, HELD_BYTES = 4096, 8 << 20


def _edits(kind: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a row of this kind: (state before, cost, edits). Kinds: d must go, an initial or o stays as it is, in capitals truncated."""
    into: list[list[tuple[int, int, str]]] = [[] for _ in STATES]
    extra = TRUNCATED if kind.isupper() else 0
    for before in STATES:
        state, cost, edits = before, 0, ""
        for _ in range(3):  # two insertions lead back to where they began, so more than two are never cheapest
            into[state].append((before, cost + DELETE, edits + "D"))
            if kind != "d":
                if (state, kind.lower()) in FOLLOWS:
                    into[FOLLOWS[state, kind.lower()]].append((before, cost + extra, edits + "K"))
                into[ONWARD[state]].append((before, cost + REROLE + extra, edits + "R"))
            state, cost, edits = ONWARD[state], cost + INSERT, edits + "I"
    return [[min(found for found in options if found[0] == p) for p in sorted({o[0] for o in options})] for options in into]


EDITS = {kind: _edits(kind) for kind in "dsuaoSUAO"}
Tables = Sequence[list[list[tuple]]]


def forward(tables: Tables, low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Least cost of each state after steps low to high, and the order of the least edits that reach it."""
    cost, order = [FAR] * 4, [0] * 4
    cost[start] = 0
    for table in tables[low:high]:
        best = [min(((cost[p] + c, order[p], key) for p, c, key in options if cost[p] < FAR), default=(FAR, 0, None)) for options in table]
        ranked = {key: k for k, key in enumerate(sorted(b[1:] for b in best if b[0] < FAR))}
        cost, order = [b[0] for b in best], [ranked.get(b[1:], 0) if b[0] < FAR else 0 for b in best]
    return cost, order


def backward(tables: Tables, low: int, high: int, end: Sequence[int]) -> list[int]:
    """Least cost from each state before steps low to high to the costs at the end."""
    cost = list(end)
    for table in reversed(tables[low:high]):
        before = [FAR] * 4
        for q, options in enumerate(table):
            for p, c, _ in options:
                before[p] = min(before[p], c + cost[q])
        cost = before
    return cost


def crossings(tables: Tables, start: int, end: int) -> list[int]:
    """The state before and after each step on the audit-least cheapest way from start to end."""
    states = [start] * len(tables) + [end]

    def halve(low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        ahead, order = forward(tables, low, middle, states[low])
        behind = backward(tables, middle, high, [0 if q == states[high] else FAR for q in STATES])
        states[middle] = min(STATES, key=lambda q: (ahead[q] + behind[q], order[q]))
        halve(low, middle)
        halve(middle, high)

    halve(0, len(tables))
    return states


def last_state(cost: Sequence[int], order: Sequence[int]) -> int:
    """The state from which a conversation ends at the least cost, by the least audit."""
    return min(STATES, key=lambda q: (cost[q] + INSERT * len(ENDING[q]), order[q]))


@lru_cache(50_000)
def _short_audit(kinds: str, start: int, end: int | None) -> str:
    return _audit(kinds, start, end)


def _audit(kinds: str, start: int, end: int | None) -> str:
    tables = [EDITS[k] for k in kinds]
    tail = ""
    if end is None:
        end = last_state(*forward(tables, 0, len(tables), start))
        tail = ENDING[end]
    states = crossings(tables, start, end)
    return "".join(min(o[1:] for o in t[q] if o[0] == p)[1] for t, p, q in zip(tables, states, states[1:])) + tail


def audit(kinds: str, start: int = START, end: int | None = None) -> str:
    """The least of the cheapest audits from start to a state, or to the conversation's end."""
    return _short_audit(kinds, start, end) if len(kinds) <= 24 else _audit(kinds, start, end)


def replay(edits: str, kinds: str, state: int) -> tuple[list[tuple[int, str | None]], int, int]:
    """(row, role given to it or None; row -1 is an inserted one), the cost and the last state."""
    lines, cost, row = [], 0, 0
    for edit in edits:
        if edit == "I":
            state, cost = ONWARD[state], cost + INSERT
            lines.append((-1, ROLES[state]))
            continue
        kind, row = kinds[row], row + 1
        if edit == "D":
            cost += DELETE
            continue
        cost += (TRUNCATED if kind.isupper() else 0) + (REROLE if edit == "R" else 0)
        state = ONWARD[state] if edit == "R" else FOLLOWS[state, kind.lower()]
        lines.append((row - 1, ROLES[state] if edit == "R" else None))
    return lines, cost, state


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by the crc32 of ``conv_id:turn``: key, conv_id, turn, role, text, md5, n times. Dropped rows stay as n = 0 without text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("fate"))
    gone = F.col("fate") == 0
    after = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone, "").otherwise(after).alias("text"),
        F.when(gone, "").otherwise(F.md5(after.cast("binary"))).alias("md5"),
        F.when(gone, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _repeats(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, turn, role, md5) of rows whose role and text occur at an earlier turn."""
    light = scratch.save(rows.where("n > 0").groupBy("key", "turn", "role", "md5").agg(F.count("*").alias("rows")).drop("rows"), "light")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = scratch.save(light.groupBy("key", "role", "md5").agg(F.min(turn).alias("first"), F.count("*").alias("m")).where("m > 1"), "several")
    return join_heavy(light, several, ["key", "role", "md5"], "m", light.count()).where(turn > F.col("first")).select("key", "turn", "role", "md5")


class _Run:
    """The rows of one conversation as one partition has them, in order. What was handed on as a segment is kept as kinds only."""

    def __init__(self, row: dict, number: int):
        self.key, self.conv_id, self.number = row["key"], row["conv_id"], number
        self.kinds, self.roles, self.texts, self.counts = [], [], [], []
        self.bytes, self.seq, self.split, self.done = 0, 0, False, ""
        self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_initial = self.last_initial = None

    def add(self, row: dict, seen: bool) -> None:
        n, turn, text, initial = row["n"], row["turn"], row["text"], row["role"][:1]
        if turn is not None and (turn != self.last_turn or self.turns == 0):
            self.first_turn, self.last_turn, self.turns = turn if self.turns == 0 else self.first_turn, turn, self.turns + 1
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.illegal += n - 1
        self.last_initial = initial
        words = text.rstrip(BLANKS)
        kind = initial if initial and initial in "sua" else "o"
        if not words:
            self.blank += n
            kinds = "d" * n
        else:
            again = n if seen else n - 1
            self.duplicate += again
            short = not seen and words[-1] not in ".!?"
            self.truncated += short
            kinds = "d" * again if seen else (kind.upper() if short else kind) + "d" * again
        self.kinds.append(kinds)
        self.roles.append(row["role"])
        self.texts.append(text if kinds[0] != "d" else "")
        self.counts.append(n)
        self.bytes += len(self.texts[-1])

    def result(self) -> dict:
        kinds = "".join(self.kinds)
        edits = audit(kinds)
        lines, cost, _ = replay(edits, kinds, START)
        at = [k for k, x in enumerate(self.kinds) for _ in x]
        text = "\n".join(f"{role}:" if k < 0 else f"{self.roles[at[k]] if role is None else role}:{self.texts[at[k]]}" for k, role in lines)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"what": "result", "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def rows(self) -> Iterator[dict]:
        """The rows held so far, which are then handed on."""
        for kinds, role, text, n in zip(self.kinds, self.roles, self.texts, self.counts):
            if n:
                self.seq += 1
                yield {"what": "row", "key": self.key, "conv_id": self.conv_id, "segment": self.number, "seq": self.seq, "role": role, "text": text, "kinds": kinds}
        self.done += "".join(self.kinds)
        self.kinds, self.roles, self.texts, self.counts, self.bytes, self.split = [], [], [], [], 0, True

    def segment(self) -> dict:
        tables = [EDITS[k] for k in self.done]
        ways = [forward(tables, 0, len(tables), p) for p in STATES]
        numbers = [self.first_turn, self.last_turn, self.turns, self.blank, self.duplicate, self.truncated, self.illegal]
        return {"what": "segment", "key": self.key, "conv_id": self.conv_id, "segment": self.number, "seq": 0, "kinds": self.done, "initials": [self.first_initial, self.last_initial], "numbers": numbers, "costs": [c for way in ways for c in way[0]], "orders": [o for way in ways for o in way[1]]}


def _sorted_part_schema(conv_type: pa.DataType) -> pa.Schema:
    longs = pa.int64()
    fields = [("what", pa.string()), ("key", pa.string()), ("conv_id", conv_type), ("segment", longs), ("seq", longs), ("role", pa.string()), ("text", pa.string()), ("kinds", pa.string()), ("initials", pa.list_(pa.string())), ("numbers", pa.list_(longs)), ("costs", pa.list_(longs)), ("orders", pa.list_(longs))]
    return pa.schema(fields + _result_fields())


def _result_fields() -> list[tuple[str, pa.DataType]]:
    return [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held, volume = [], 0
    for row in rows:
        held.append(row)
        volume += len(row.get("text") or "")
        if len(held) >= size or volume > HELD_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, volume = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from batch.slice(k, 256).to_pylist()


def _repair_sorted(batches: Iterator[pa.RecordBatch], held_rows: int) -> Iterator[dict]:
    """Results of the conversations that lie inside this partition; rows and a summary of those that may go on beyond it."""
    part = TaskContext.get().partitionId() << 32
    run, number, repeat = None, 0, None
    for row in _in_order(batches):
        if run is None or row["key"] != run.key:
            if run is not None:
                if number == 1 or run.split:
                    yield from run.rows()
                    yield run.segment()
                else:
                    yield run.result()
            run, number = _Run(row, part + number), number + 1
        name = (row["turn"], row["role"], row["md5"])
        if row["kind"] == 0:
            repeat = name
        elif row["n"]:
            run.add(row, repeat == name)
            repeat = None
            if len(run.kinds) >= held_rows or run.bytes >= HELD_BYTES:
                yield from run.rows()
    if run is not None:
        yield from run.rows()
        yield run.segment()


def _join_segments(segments: pa.Table) -> pa.Table:
    """The states between the segments of one conversation, and each segment's audit between its states."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["segment"])
    tables = [[[(p, r["costs"][4 * p + q], r["orders"][4 * p + q]) for p in STATES if r["costs"][4 * p + q] < FAR] for q in STATES] for r in rows]
    states = crossings(tables, START, last_state(*forward(tables, 0, len(tables), START)))
    pieces = [{"segment": r["segment"], "before": p, "after": q, "last": k == len(rows) - 1} for k, (r, p, q) in enumerate(zip(rows, states, states[1:]))]
    return pa.Table.from_pylist(pieces, pa.schema([("segment", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))


def _segment_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for row in _in_order(batches):
        row["text"] = audit(row["kinds"], row["before"], row["after"]) + (ENDING[row["after"]] if row["last"] else "")
        yield row


def _stream_open(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Results of the conversations that were cut: segment rows, each followed by its rows, pass by once."""
    key, found = None, None
    for row in _in_order(batches):
        if found is None or row["key"] != key:
            if found is not None:
                yield found.end()
            key, found = row["key"], _Open(row)
        if row["what"] == "segment":
            found.segment(row)
        else:
            found.row(row)
    if found is not None:
        yield found.end()


class _Open:
    """A conversation while its segments pass by: sums, and the running hash of the repaired text."""

    def __init__(self, row: dict):
        self.conv_id, self.sums, self.cost, self.audits = row["conv_id"], [0] * 5, 0, []
        self.first_turn = self.last_turn = self.initial = None
        self.hash, self.lines = hashlib.sha256(), 0
        self.edits, self.at, self.state = "", 0, START

    def segment(self, row: dict) -> None:
        self._rest()
        first, last, turns, *counts = row["numbers"]
        initials = row["initials"]
        if first is not None:
            turns -= first == self.last_turn
            self.first_turn = first if self.first_turn is None else self.first_turn
            self.last_turn = last
        if initials[0] is not None:
            counts[3] += self.initial is not None and self.initial + initials[0] not in LEGAL
            self.initial = initials[1]
        self.sums = [a + b for a, b in zip(self.sums, [turns, *counts])]
        self.edits, self.at, self.state = row["text"], 0, row["before"]
        self.audits.append(self.edits)

    def _line(self, text: str) -> None:
        self.hash.update((f"\n{text}" if self.lines else text).encode())
        self.lines += 1

    def _step(self, kinds: str, role: str, text: str) -> None:
        end, left = self.at, len(kinds)
        while end < len(self.edits) and left:
            left -= self.edits[end] != "I"
            end += 1
        edits, self.at = self.edits[self.at : end], end
        lines, cost, self.state = replay(edits, kinds, self.state)
        self.cost += cost
        for k, given in lines:
            self._line(f"{given}:" if k < 0 else f"{given or role}:{text}")

    def row(self, row: dict) -> None:
        self._step(row["kinds"], row["role"], row["text"])

    def _rest(self) -> None:
        lines, cost, self.state = replay(self.edits[self.at :], "", self.state)
        self.cost, self.at = self.cost + cost, len(self.edits)
        for _, given in lines:
            self._line(f"{given}:")

    def end(self) -> dict:
        self._rest()
        turns, blank, duplicate, truncated, illegal = self.sums
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": self.cost, "audit": "".join(self.audits), "repaired_sha256": self.hash.hexdigest()}


def repair(rows: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """conv_id, faults, cost, audit and hash of the repaired text of each conversation in ``rows`` (as ``damaged`` gives them)."""
    scratch = Scratch(rows.sparkSession, "conversations")
    kind = dict(rows.dtypes)["conv_id"]
    conv_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}.get(kind)
    if conv_type is None:
        rows, kind, conv_type = rows.withColumn("conv_id", F.col("conv_id").cast("string")), "string", pa.string()
    columns = ["key", "turn", "role", "md5", "conv_id", "text", "n", "kind"]
    whole = rows.groupBy("key", "turn", "role", "md5").agg(F.first("conv_id").alias("conv_id"), F.first("text").alias("text"), F.sum("n").alias("n")).withColumn("kind", F.lit(1))
    marks = _repeats(rows, scratch).select("key", "turn", "role", "md5", F.lit(None).cast(kind).alias("conv_id"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("kind"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "md5"]
    ordered = whole.select(*columns).unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    schema = _sorted_part_schema(conv_type)
    results = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    parts = f"what string, key string, conv_id {kind}, segment long, seq long, role string, text string, kinds string, initials array<string>, numbers array<long>, costs array<long>, orders array<long>, " + results.split(", ", 1)[1]
    done = scratch.save(ordered.mapInArrow(lambda batches: _batches(_repair_sorted(batches, held_rows), schema), parts), "parts")
    names = [f.split()[0] for f in results.split(", ")]
    cut = ["what", "key", "conv_id", "segment", "seq", "role", "text", "kinds", "initials", "numbers"]
    segments = done.where("what = 'segment'")
    states = segments.select("key", "segment", "costs", "orders").groupBy("key").applyInArrow(_join_segments, "segment long, before int, after int, last boolean")
    piece_schema = pa.schema([schema.field(c) for c in cut] + [("before", pa.int32())])
    with_states = segments.select(*cut).join(states, "segment").select(*cut, "before", "after", "last")
    pieces = with_states.mapInArrow(lambda batches: _batches(_segment_audits(batches), piece_schema), ", ".join(f"{p}" for p in parts.split(", ") if p.split()[0] in cut) + ", before int")
    flow = pieces.unionByName(done.where("what = 'row'").select(*cut, F.lit(0).alias("before"))).repartition("key").sortWithinPartitions("key", "segment", "seq")
    result_schema = pa.schema([("conv_id", conv_type), *_result_fields()])
    streamed = flow.mapInArrow(lambda batches: _batches(_stream_open(batches), result_schema), results)
    return done.where("what = 'result'").select(*names).unionByName(streamed.select(*names))
