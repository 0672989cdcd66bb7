"""Repair of conversation structure by a square-root checkpointed dynamic program.

Rows of a conversation, in the order of turns, are kept (cost 0), given the role user or assistant (1) or deleted (2, which blank
and repeated rows must be), and turns without text are inserted (5), so that the roles' initials become `(s?(ua)+)?` at the least
cost; truncated rows that stay cost 5 more. Of the cheapest repairs the one whose edits D, I, K, R read least in ASCII is taken.

What the rest of a conversation costs is a vector of four, one for each state of that grammar. Walking back over the rows, only
the vectors at checkpoints are stored, a square root of the rows apart; walking forward, each block's vectors are worked out anew
from its checkpoint, and of the tight edits the least is taken. Vectors are kept less their smallest cost, so there are few
different ones and steps are remembered.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks, and each task
cuts what it gets into segments of bounded size. A conversation that lies in one segment is repaired there and then. Of the
others, segments say what they cost from each state to each state (a task each), the costs are added up backwards over segments to
the checkpoints between them, segments say where each state leads (a task each), the states are followed forwards, and then every
segment is repaired by itself. Equal rows are counted before they are shuffled. Only the digests of the report read a
conversation in order, row by row of its segments.

Cases: a null role or text counts as one space; rows without a conv_id are a conversation of their own; rows of one turn (null
first) follow role and text; repeated rows stay and all but the first are duplicates; roles other than those three can't be kept;
an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import shared_dir, stored

#: Rows and bytes of text of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
#: Characters of role and text by which rows are dealt; rows that agree in them go to one task, where whole texts order them.
DEALT_CHARS = 32
DELETE, INSERT, RELABEL, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 40
#: States: nothing yet, after system, after user, after assistant. Where a turn put in leads, its role, and where initials lead.
FILL, FILLED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
LEGAL = {"su", "ua", "au"}
_SPACES = " \t\n\x0b\x0c\r"


# Costs --------------------------------------------------------------------------------------------------------------------


def _with_inserts(cost: list[int]) -> tuple[int, ...]:
    """Least cost from each state if turns may be put in first."""
    out = list(cost)
    for _ in range(3):
        out = [min(c, INSERT + out[FILL[s]], NEVER) for s, c in enumerate(out)]
    return tuple(out)


#: At the end of a conversation: nothing, or a turn of the assistant last.
END = _with_inserts([0, NEVER, NEVER, 0])


def _lowered(cost: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(cost)
    return tuple(NEVER if c >= NEVER else c - least for c in cost), least


def _choices(state: int, code: str) -> Iterator[tuple[str, int, int]]:
    """Edit, cost and next state of a row, in the order of ASCII. code: d if it must go, else its initial (x: another), upper case
    if it is truncated."""
    yield "D", DELETE, state
    if code == "d":
        return
    extra = TRUNCATED if code.isupper() else 0
    to = STEP[code.lower()][state] if code.lower() in STEP else None
    if to is not None:
        yield "K", extra, to
    yield "R", RELABEL + extra, FILL[state]


@lru_cache(1 << 16)
def _before(after: tuple[int, ...], code: str) -> tuple[tuple[int, ...], int]:
    """The vector before a row from the one after it, lowered, and by how much."""
    return _lowered(_with_inserts([min(min(c + after[to] for _, c, to in _choices(s, code)), NEVER) for s in range(4)]))


@lru_cache(1 << 16)
def _edits(state: int, code: str, after: tuple[int, ...]) -> tuple[str, int, int]:
    """The least tight edits at a row, those put in before it included; the next state; their cost."""
    costs = [min(min(c + after[to] for _, c, to in _choices(s, code)), NEVER) for s in range(4)]
    here, edits, spent = _with_inserts(costs), "", 0
    while True:
        tight = [("I", INSERT, FILL[state])] if here[state] == INSERT + here[FILL[state]] else []
        tight += [x for x in _choices(state, code) if here[state] == x[1] + after[x[2]]]
        edit, cost, state = min(tight)
        edits, spent = edits + edit, spent + cost
        if edit != "I":
            return edits, state, spent


def _back(codes: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    total = 0
    for code in reversed(codes):
        after, less = _before(after, code)
        total += less
    return after, total


def walk(codes: str, after: tuple[int, ...], state: int, last: bool) -> tuple[str, int, int]:
    """Edits, next state and cost of rows from a state, where `after` are the costs of what follows. last: nothing follows."""
    n = len(codes)
    block = isqrt(n) + 1
    checkpoints = [_lowered(after)[0]]
    for at in range(n // block * block, 0, -block):
        checkpoints.append(_back(codes[at : at + block], checkpoints[-1])[0])
    edits, spent = [], 0
    for at in range(0, n, block):
        vectors = [checkpoints.pop()]
        for code in reversed(codes[at + 1 : at + block]):
            vectors.append(_before(vectors[-1], code)[0])
        for code in codes[at : at + block]:
            some, state, cost = _edits(state, code, vectors.pop())
            edits.append(some)
            spent += cost
    while last and END[state]:
        edits.append("I")
        state, spent = FILL[state], spent + INSERT
    return "".join(edits), state, spent


def rewritten(codes: str, edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits. roles, texts: of the rows that need not go."""
    out_roles, out_texts, row, kept = [], [], 0, 0
    for edit in edits:
        if edit == "I":
            role, text = FILLED[state], ""
        else:
            code, row = codes[row], row + 1
            if code != "d":
                role, text, kept = roles[kept], texts[kept], kept + 1
            if edit == "D":
                continue
            role = FILLED[state] if edit == "R" else role
        state = FILL[state] if edit in "IR" else STEP[role[0]][state]
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


# Segments -----------------------------------------------------------------------------------------------------------------

_STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = (
    "conv_id long, part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first_initial string, last_initial string, codes string, roles array<string>, texts array<string>, edits string, cost long"
)
_NAMES = [x.split(" ")[0] for x in _SEGMENT.split(", ")]


class _Segment:
    def __init__(self, conv, part: int, seq: int, most_rows: int, most_bytes: int):
        self.most_rows, self.most_bytes = most_rows, most_bytes
        self.conv, self.part, self.seq = conv, part, seq
        self.stats = dict.fromkeys(_STATS, 0)
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.codes, self.rows, self.roles, self.texts, self.bytes, self.whole = [], 0, [], [], 0, False

    def full(self) -> bool:
        return self.rows >= self.most_rows or self.bytes >= self.most_bytes

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        """copies rows alike; again: the first of them repeats an earlier row as well."""
        said, initial = text.rstrip(_SPACES), role[:1]
        if turn is not None:
            self.stats["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.rows:
            self.stats["illegal"] += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        self.stats["illegal"] += copies - 1
        goes = copies if not said or again else copies - 1
        self.stats["blank" if not said else "duplicate"] += goes
        if goes < copies:
            code = initial if initial in STEP else "x"
            if said[-1] not in ".!?":
                self.stats["truncated"] += 1
                code = code.upper()
            self.codes.append(code)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(role) + len(text)
        self.codes.append("d" * goes)
        self.rows += copies

    def row(self) -> tuple:
        codes, roles, texts, edits, cost = "".join(self.codes), self.roles, self.texts, None, None
        if self.whole:
            edits, _, cost = walk(codes, END, 0, True)
            roles, texts = rewritten(codes, edits, 0, roles, texts)
        ends = (self.first_turn, self.last_turn, self.first_initial, self.last_initial)
        return (self.conv, self.part, self.seq, self.whole, *self.stats.values(), *ends, codes, roles, texts, edits, cost)


def _kinds() -> pa.Schema:
    one = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, one[k]) for n, k in (x.split(" ") for x in _SEGMENT.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _segments(most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order to segments. A conversation between two others in a task's rows is whole; the first and the last may go
        on in other tasks."""
        part, schema = TaskContext.get().partitionId(), _kinds()
        seq, first, now, cut, done, size = 0, True, None, False, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again")]
            for conv, turn, role, text, copies, again in zip(*columns, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        now.whole = not first and not cut
                        done.append(now.row())
                        size, seq, first = size + now.bytes, seq + 1, False
                    now, cut = _Segment(conv, part, seq, most_rows, most_bytes), False
                left = copies
                while left:  # copies go in chunks, too, as all but one only stand for a deletion
                    if now.full():
                        done.append(now.row())
                        size, seq, cut = size + now.bytes, seq + 1, True
                        now = _Segment(conv, part, seq, most_rows, most_bytes)
                    some = min(left, most_rows - now.rows)
                    now.add(turn, role, text, some, again or left < copies)
                    left -= some
                if len(done) >= 1024 or size >= 4 * most_bytes:
                    if done:
                        yield _batch(done, schema)
                    done, size = [], 0
        if now is not None:
            done.append(now.row())
        if done:
            yield _batch(done, schema)

    return run


def _ordered(pieces: DataFrame, *order: Column) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _through(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType], step) -> Iterator[pa.RecordBatch]:
    """Rows of conversations one after another; step(carried or None, row) gives what is carried on and a row."""
    held, carried, some = None, None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if not some or row["conv_id"] != held:
                held, carried, some = row["conv_id"], None, True
            carried, one = step(carried, row)
            out.append(one)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment costs from each state to each, row by row of that table."""
    for batch in batches:
        costs = []
        for codes in batch.column("codes").to_pylist():
            table = []
            for end in range(4):
                after, total = _back(codes, tuple(0 if s == end else NEVER for s in range(4)))
                table.append([min(NEVER, c + total) for c in after])
            costs.append([table[end][s] for s in range(4) for end in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "part", "seq")] + [pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "part", "seq", "costs"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last to the first: the costs of what follows each."""

    def step(after, row):
        last, after = after is None, END if after is None else after
        mine = [min(min(row["costs"][4 * s + e] + after[e] for e in range(4)), NEVER) for s in range(4)]
        return _lowered(tuple(mine))[0], (row["part"], row["seq"], list(after), last)

    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()]
    yield from _through(batches, ["part", "seq", "after", "last"], kinds, step)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), batch.column("possible").to_pylist(), strict=True)
        to = [[walk(codes, tuple(after), s, False)[1] if able[s] else None for s in range(4)] for codes, after, able in rows]
        names = ["conv_id", "part", "seq", "after", "last"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(to, pa.list_(pa.int32()))], [*names, "to"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the first to the last: the state that each begins in."""

    def step(state, row):
        state = 0 if state is None else state
        return row["to"][state], (row["part"], row["seq"], row["after"], row["last"], state)

    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int32()]
    yield from _through(batches, ["part", "seq", "after", "last", "state"], kinds, step)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _kinds()
    for batch in batches:
        for row in batch.to_pylist():
            edits, _, cost = walk(row["codes"], tuple(row["after"]), row["state"], row["last"])
            roles, texts = rewritten(row["codes"], edits, row["state"], row["roles"], row["texts"])
            yield _batch([tuple((row | {"edits": edits, "cost": cost, "roles": roles, "texts": texts})[c] for c in schema.names)], schema)


def _finished(pieces: DataFrame, base: str) -> DataFrame:
    """Segments of conversations that lie in several, repaired."""
    by = ["part", "seq"]
    crossed = stored(pieces.select("conv_id", *by, "codes").mapInArrow(_crossed, "conv_id long, part int, seq int, costs array<long>"), base, "costs")
    after = _ordered(crossed, F.desc("part"), F.desc("seq")).mapInArrow(_checkpoints, "part int, seq int, after array<long>, last boolean")
    # A state from which nothing leads to an end isn't walked from.
    possible = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.exists(F.sequence(F.lit(0), F.lit(3)), lambda e: (F.get("costs", s * 4 + e) + F.get("after", e)) < NEVER))
    led = crossed.join(after, by).withColumn("possible", possible).join(pieces.select(*by, "codes"), by)
    led = led.select("conv_id", *by, "codes", "after", "last", "possible").mapInArrow(_led, "conv_id long, part int, seq int, after array<long>, last boolean, to array<int>")
    states = _ordered(led, F.asc("part"), F.asc("seq")).mapInArrow(_states, "part int, seq int, after array<long>, last boolean, state int")
    return pieces.join(states, by).select(*_NAMES, "after", "last", "state").mapInArrow(_mended, _SEGMENT)


def repaired(rows: DataFrame, base: str | None = None) -> DataFrame:
    """Segments of the repaired conversations, written below base: conv_id, part and seq (their order), edits, cost, roles and texts
    after the repair, faults of the rows before it.

    rows: conv_id, turn, role, text; and copies where a row stands for several, or for none and only says that the conversation exists.
    """
    base = base or shared_dir(rows.sparkSession)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    there = copies > 0
    one = lambda c: F.when(there, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("").alias(c)
    counted = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(there, F.col("turn").cast("long")).alias("turn"), one("role"), one("text"), there.alias("there"), copies.alias("copies"))
    counted = counted.groupBy("conv_id", "turn", "role", "text", "there").agg(F.sum("copies").alias("copies"))
    # (role, text) that several turns of a conversation have, with the first of them; a null turn comes before all.
    alike = counted.filter("there").groupBy("conv_id", "role", F.sha2("text", 256).alias("digest"))
    several = alike.agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    several = several.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.b").alias("first"))
    known = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.sha2("text", 256) == F.col("d"))
    again = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    marked = counted.join(several, known, "left").select("conv_id", "turn", "role", "text", F.when(F.col("there"), F.col("copies")).otherwise(0).alias("copies"), again.alias("again"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    dealt = marked.repartitionByRange(*order, F.left("role", F.lit(DEALT_CHARS)), F.left("text", F.lit(DEALT_CHARS))).sortWithinPartitions(*order, "role", "text")
    found = stored(dealt.mapInArrow(_segments(SEGMENT_ROWS, SEGMENT_BYTES), _SEGMENT), base, "segments")
    split = stored(_finished(found.filter("NOT whole"), base), base, "split")
    return found.filter("whole").unionByName(split)


# Report -------------------------------------------------------------------------------------------------------------------

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its segments in order."""
    names = [x.split(" ")[0] for x in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    held = None

    def close() -> tuple:
        gaps = held["last"] - held["first"] + 1 - held["turns"] if held["first"] is not None else 0
        return (held["conv_id"], gaps, held["blank"], held["duplicate"], held["truncated"], held["illegal"], held["cost"], "".join(held["audit"]), held["sha"].hexdigest())

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is None or held["conv_id"] != row["conv_id"]:
                if held is not None:
                    out.append(close())
                held = {"conv_id": row["conv_id"], "first": None, "last": None, "turns": 0, "initial": None, "audit": [], "sha": hashlib.sha256(), "some": False, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)}
            for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                held[c] += row[c]
            if row["first_turn"] is not None:
                held["turns"] -= held["last"] == row["first_turn"]
                held["first"], held["last"] = row["first_turn"] if held["first"] is None else held["first"], row["last_turn"]
            if row["first_initial"] is not None:
                held["illegal"] += held["initial"] is not None and held["initial"] + row["first_initial"] not in LEGAL
                held["initial"] = row["last_initial"]
            held["audit"].append(row["edits"])
            for role, text in zip(row["roles"], row["texts"], strict=True):
                held["sha"].update(("\n" * held["some"] + role + ":" + text).encode())
                held["some"] = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(close(), kinds, strict=True)], names)


def repair_report(segments: DataFrame) -> DataFrame:
    """Faults, edits, cost and digest of each conversation, from the segments of repaired(). Conversations in one segment need no shuffle."""
    needed = segments.select("conv_id", "part", "seq", "whole", *_STATS, "first_turn", "last_turn", "first_initial", "last_initial", "edits", "cost", "roles", "texts")
    split = _ordered(needed.filter("NOT whole"), F.asc("part"), F.asc("seq"))
    return needed.filter("whole").mapInArrow(_reported, REPORT).unionByName(split.mapInArrow(_reported, REPORT))


def repaired_turns(segments: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, their order (part, seq, place), role, text."""
    return segments.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")).select("conv_id", "part", "seq", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops a row, 1 empties
    its text, 2 takes `[.!?]` out, 3 repeats it, 4 makes it the user's. With copies, as repaired() takes them."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
