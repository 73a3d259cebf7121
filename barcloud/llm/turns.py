"""Conversations repaired at least cost, their edits rebuilt in linear space by divide and conquer.

A repaired conversation's roles read ``(s?(ua)+)?`` by initials: an optional system turn, then user and assistant in
turns.  Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty turn 5; a truncated row
that isn't deleted adds 5; blank and duplicate rows must go.  Among the cheapest edit strings the ASCII-least wins.

After each row the repaired part is in one of four states (nothing yet, after s, after u, after a), so a stretch of rows
is known by a 4 x 4 table of costs.  Inserts are counted with the row behind them: then no edit string of the
same rows is a prefix of another, ties between states are decided by the strings so far alone, and a rank per
state stands for its string.  Forward vectors (cost and rank) and backward vectors (cost) meet mid-conversation at the
crossing of least cost and then least rank, and each half is solved between its two known states.

Rows are range partitioned by (conversation, turn, role, text hash) and sorted; a partition keeps one byte a row.
A conversation that lies in several partitions is cut there: each part sends its table, one small row, the crossings
between parts are chosen from those, and every part is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcloud.llm.common import attach_facts, table
from barcloud.session import write_table

SPACE = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: state of a repaired part that a role of this initial makes, and the states it may follow
_AFTER = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
#: up to three inserts: the state they lead to from each state
_INSERTED = {p: [p] for p in STATES}
for _p in STATES:
    for _ in range(3):
        _INSERTED[_p].append(ASSISTANT if _INSERTED[_p][-1] == USER else USER)
#: rows of a stretch that is solved without splitting
BASE = 16
_NEVER = 1 << 60

# a row's class: its initial ('s', 'u', 'a' or another) and fault, as one byte
_INITIALS = "sua?"
SOUND, MUST_GO, CUT = range(3)


def class_of(initial: str, fault: int) -> int:
    return 3 * (_INITIALS.find(initial) if initial in ("s", "u", "a") else 3) + fault


def _steps(kind: int) -> dict[tuple[int, int], list[tuple[int, str]]]:
    """For a row of this class: (state before, state after) -> the cheapest ways as (cost, edits), the ASCII-least alone."""
    initial, fault = _INITIALS[kind // 3], kind % 3
    own = [(DELETE, "D", None)]
    if fault != MUST_GO:
        extra = TRUNCATED if fault == CUT else 0
        own += [(REROLE + extra, "R", r) for r in "ua"] + ([(KEEP + extra, "K", initial)] if initial in _AFTER else [])
    ways: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        for inserts, between in enumerate(_INSERTED[before]):
            for cost, edit, role in own:
                if role is None:
                    after = between
                elif between in _AFTER[role][1]:
                    after = _AFTER[role][0]
                else:
                    continue
                way = (cost + INSERT * inserts, "I" * inserts + edit)
                if way < ways.get((before, after), (_NEVER, "")):
                    ways[before, after] = way
    return ways


#: class -> state after -> [(state before, cost, edits)]
STEPS = [
    [[(p, *w) for (p, q), w in sorted(_steps(kind).items()) if q == after] for after in STATES] for kind in range(12)
]
#: state -> inserts at the end that make the roles complete
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _ranked(found: list) -> list:
    """(cost, key) per state, keys replaced by their order among the states."""
    order = {k: i for i, k in enumerate(sorted(key for _, key in found if key is not None))}
    return [(cost, order.get(key, -1)) for cost, key in found]


@lru_cache(1 << 16)
def _ahead(now: tuple, kind: int) -> tuple[int, tuple]:
    """One row onward from costs and ranks whose least cost is 0: what the least grows by, and the same again."""
    found = []
    for ways in STEPS[kind]:
        best, key = _NEVER, None
        for before, cost, edits in ways:
            at, rank = now[before]
            if at + cost < best or (at + cost == best and best < _NEVER and (rank, edits) < key):
                best, key = at + cost, (rank, edits)
        found.append((best, key))
    least = min(cost for cost, _ in found)
    return least, tuple((cost - least if cost < _NEVER else _NEVER, rank) for cost, rank in _ranked(found))


def forward(classes: bytes, state: int) -> list[tuple[int, int]]:
    """Cost and rank of the cheapest edits of ``classes`` from ``state`` to each state.

    Differences between states are small, so few vectors occur and a row is one look-up.
    """
    total, now = 0, tuple((0, 0) if s == state else (_NEVER, -1) for s in STATES)
    for kind in classes:
        more, now = _ahead(now, kind)
        total += more
    return [(cost + total if cost < _NEVER else _NEVER, rank) for cost, rank in now]


@lru_cache(1 << 16)
def _behind(now: tuple, kind: int) -> tuple[int, tuple]:
    """One row backward from costs whose least is 0."""
    costs = [_NEVER] * 4
    for after, ways in enumerate(STEPS[kind]):
        for before, cost, _ in ways:
            costs[before] = min(costs[before], cost + now[after])
    least = min(costs)
    return least, tuple(c - least if c < _NEVER else _NEVER for c in costs)


def backward(classes: bytes, state: int) -> list[int]:
    """Least cost of ``classes`` from each state to ``state``."""
    total, now = 0, tuple(0 if s == state else _NEVER for s in STATES)
    for kind in reversed(classes):
        more, now = _behind(now, kind)
        total += more
    return [c + total if c < _NEVER else _NEVER for c in now]


def _direct(classes: bytes, start: int, end: int) -> str:
    """The edits of a few rows: the strings themselves are carried."""
    now = {start: (0, "")}
    for kind in classes:
        then: dict[int, tuple[int, str]] = {}
        for after, ways in enumerate(STEPS[kind]):
            found = [(now[p][0] + cost, now[p][1] + edits) for p, cost, edits in ways if p in now]
            if found:
                then[after] = min(found)
        now = then
    return now[end][1]


def between(classes: bytes, start: int, end: int) -> str:
    """The cheapest, then ASCII-least edits of ``classes`` that lead from ``start`` to ``end``."""
    out, todo = [], [(0, len(classes), start, end)]
    while todo:  # a stack instead of recursion: its depth is the logarithm of the length
        low, high, p, q = todo.pop()
        if high - low <= BASE:
            out.append(_direct(classes[low:high], p, q))
            continue
        middle = (low + high) // 2
        ahead, behind = forward(classes[low:middle], p), backward(classes[middle:high], q)
        crossing = min((ahead[s][0] + behind[s], ahead[s][1], s) for s in STATES if ahead[s][0] + behind[s] < _NEVER)[2]
        todo += [(middle, high, crossing, q), (low, middle, p, crossing)]
    return "".join(out)


def _end(costs: list[tuple[int, int]]) -> tuple[int, int]:
    """The final state of least cost, then least rank, and the whole cost."""
    total, _, state = min((c + INSERT * len(ENDING[s]), rank, s) for s, (c, rank) in enumerate(costs) if c < _NEVER)
    return state, total


@lru_cache(1 << 14)
def _short(classes: bytes) -> tuple[str, int]:
    state, cost = _end(forward(classes, START))
    return between(classes, START, state) + ENDING[state], cost


def solve(classes: bytes) -> tuple[str, int]:
    """Edit string and cost of a whole conversation."""
    return _short(classes) if len(classes) <= 64 else _short.__wrapped__(classes)


def choose_crossings(tables: list[list[list[tuple[int, int]]]]) -> tuple[list[int], int]:
    """States before, between and after the parts of a conversation, from their tables, and the whole cost."""
    now, sources = [(0, 0), *[(_NEVER, -1)] * 3], []
    for costs in tables:
        found, source = [], []
        for after in STATES:
            ways = [(now[p][0] + costs[p][after][0], now[p][1], p) for p in STATES if now[p][0] + costs[p][after][0] < _NEVER]
            if ways:
                cost, rank, p = min(ways)
                found.append((cost, (rank, costs[p][after][1])))
                source.append(p)
            else:
                found.append((_NEVER, None))
                source.append(-1)
        now = _ranked(found)
        sources.append(source)
    state, cost = _end(now)
    states = [state]
    for source in reversed(sources):
        states.append(source[states[-1]])
    return states[::-1], cost


# --- tables ---------------------------------------------------------------------------------------------------------

def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of the columns ``conv, turn, role, text, n``: copies added up, and the fault of the first copy.

    ``fault`` is 'blank' (no character but white space), 'duplicate' (role and text stood in the conversation before),
    'truncated' (the last character that isn't white space is none of ``.!?``) or ''; all further copies of a row
    are duplicates, or blank.  Texts are known by two hashes from here on.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    named = rows.select("conv", "turn", "role", "n", blank.alias("blank"), cut.alias("cut"), *_hashes())
    each = write_table(named.groupBy("conv", "turn", "role", "t1", "t2", "blank", "cut").agg(F.sum("n").alias("n")), "turns")
    # the turn a repeated (role, text) stands in first, turns that are null before all others
    same = [F.xxhash64("conv", "role", "t1", "t2").alias("s1"), F.xxhash64(F.lit(7), "conv", "role", "t1", "t2").alias("s2")]
    first = each.where(~F.col("blank")).groupBy(*same).agg(
        F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("from_null"), F.count("*").alias("turns")
    ).where("turns > 1")
    joined = attach_facts(each.select("*", *same), write_table(first, "turn-firsts"), ["s1", "s2"], "turns", ["conv", "turn", "role", "t1", "t2"])
    later = F.col("turns").isNotNull() & F.col("turn").isNotNull() & (F.col("from_null") | (F.col("turn") > F.col("first_turn")))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return joined.select("conv", "turn", "role", "t1", "t2", "n", fault.alias("fault"))


def _hashes() -> list[Column]:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2")]


_ORDER = ["turn", "role", "t1", "t2"]  # nulls first, as Spark sorts
_PART = "blank long, duplicate long, truncated long, cost long, audit string, classes binary, costs array<long>"


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict[str, int], bytes]]:
    """(conversation, faults counted, classes) of each run of rows of one conversation in a sorted partition."""
    conv, count, classes, begun = None, {}, bytearray(), False
    for batch in batches:
        for key, role, n, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "n", "fault"))):
            if not begun or key != conv:
                if begun:
                    yield conv, count, bytes(classes)
                conv, count, classes, begun = key, {"blank": 0, "duplicate": 0, "truncated": 0}, bytearray(), True
            kind = MUST_GO if fault in ("blank", "duplicate") else CUT if fault else SOUND
            classes.append(class_of(role[:1], kind))
            classes.extend(bytes([class_of(role[:1], MUST_GO)]) * (n - 1))
            if fault:
                count[fault] += 1
            if n > 1:
                count["blank" if fault == "blank" else "duplicate"] += n - 1
    if begun:
        yield conv, count, bytes(classes)


def audits(rows: DataFrame) -> DataFrame:
    """Per part of a conversation of ``conv, turn, role, text, n``: its place ``part``, faults, edits, and the cost in the last part.

    A conversation is one part unless a partition ends inside it.  An empty table gives no row.
    """
    found = write_table(faults(rows), "turn-faults")
    kind = found.schema["conv"].dataType.simpleString()
    order = ["conv", *_ORDER]

    def solve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        names = ["part", "conv", *[c.split()[0] for c in _PART.split(", ")]]

        def out(item, border: bool) -> pa.RecordBatch:
            conv, count, classes = item
            audit, cost = (None, 0) if border else solve(classes)
            costs = [x for p in STATES for pair in forward(classes, p) for x in pair] if border else None
            made = [part, conv, count["blank"], count["duplicate"], count["truncated"], cost, audit, classes if border else None, costs]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, arrow)], names)

        conv_type, first = None, True
        for item in _part_rows(_remember(batches, types := [])):
            conv_type = conv_type or types[0]
            arrow = [pa.int32(), conv_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.int64())]
            if held is not None:
                yield out(held, first)
                first = False
            held = item
        if held is not None:
            yield out(held, True)

    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = write_table(ranged.mapInArrow(solve_parts, f"part int, conv {kind}, {_PART}"), "turn-parts")
    # at most the first and last conversation of a partition: two narrow rows of each
    border = parts.where("costs IS NOT NULL").select("conv", "part", "costs")

    def crossings(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        tables = [[[(r[8 * p + 2 * q], r[8 * p + 2 * q + 1]) for q in STATES] for p in STATES] for r in frame["costs"]]
        states, cost = choose_crossings(tables)
        last = len(frame) - 1
        return pd.DataFrame({
            "part": frame["part"], "hash": frame["hash"], "before": states[:-1], "after": states[1:],
            "ends": [i == last for i in range(last + 1)], "whole": [cost if i == last else 0 for i in range(last + 1)],
        })

    name = F.xxhash64(F.col("conv").isNull(), "conv").alias("hash")  # conversations of few parts, told apart by id
    chosen = border.select(name, "part", "costs").groupBy("hash").applyInPandas(
        crossings, "part int, hash long, before int, after int, ends boolean, whole long"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            solved = []
            for classes, before, after, ends in zip(*(batch.column(c).to_pylist() for c in ("classes", "before", "after", "ends"))):
                solved.append(between(classes, before, after) + (ENDING[after] if ends else ""))
            columns = [batch.column(c) for c in ("part", "conv", "blank", "duplicate", "truncated", "whole")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(solved, pa.string())],
                                             ["part", "conv", "blank", "duplicate", "truncated", "cost", "audit"])

    schema = f"part int, conv {kind}, blank long, duplicate long, truncated long, cost long, audit string"
    open_ = parts.where("costs IS NOT NULL").select("*", name).join(F.broadcast(chosen), ["hash", "part"])
    columns = ["part", "conv", "blank", "duplicate", "truncated", "classes", "before", "after", "ends", "whole"]
    closed = parts.where("costs IS NULL").select("part", "conv", "blank", "duplicate", "truncated", "cost", "audit")
    return closed.unionByName(open_.select(*columns).mapInArrow(finish, schema))


def _remember(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        types.append(batch.schema.field("conv").type)
        yield batch


_ROLE = {USER: "user", ASSISTANT: "assistant"}


def repaired_rows(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The conversations edit by edit, in order, each conversation whole in one partition: one row per edit.

    Columns: ``conv``, ``turn``, ``edit`` (K, R, I, D), ``role`` and ``text`` after it, ``role_before`` (null for I), and in a
    conversation's first row ``summary`` with the sums over its parts.  A conversation without rows has one row without
    edit.  Rows stream through: a conversation's edits are held, its texts are not.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    null = lambda t: F.lit(None).cast(t)
    texts = rows.select("conv", F.lit(1).alias("what"), null("int").alias("part"), "turn", "role", *_hashes(), "text", "n",
                        null("string").alias("audit"), *[null("long").alias(c) for c in _SUMS])
    edits = solved.select("conv", F.lit(0).alias("what"), "part", null("long").alias("turn"), null("string").alias("role"),
                          null("long").alias("t1"), null("long").alias("t2"), null("string").alias("text"), null("long").alias("n"),
                          "audit", *_SUMS)
    both = edits.unionByName(texts)
    ordered = both.repartition("conv").sortWithinPartitions("conv", "what", "part", *_ORDER)
    schema = (f"conv {kind}, turn long, edit string, role string, text string, role_before string, "
              f"summary struct<{', '.join(f'{c}: long' for c in _SUMS)}>")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["what", "turn", "role", "text", "n", "audit", *_SUMS]
        names = [c.split()[0] for c in schema.split(", summary")[0].split(", ")] + ["summary"]
        state = _Walk()
        for batch in batches:
            out = []
            for conv, *values in zip(batch.column("conv").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                state.take(conv, dict(zip(columns, values)), out)
            types = [batch.schema.field("conv").type, pa.int64(), *[pa.string()] * 4, pa.struct([(c, pa.int64()) for c in _SUMS])]
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if state.begun:
            out = []
            state.finish(out)
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return ordered.mapInArrow(walk, schema)


_SUMS = ["blank", "duplicate", "truncated", "cost"]


class _Walk:
    """Applies edit strings to rows that come in order."""

    def __init__(self):
        self.conv, self.begun = None, False

    def take(self, conv, row: dict, out: list) -> None:
        if not self.begun or conv != self.conv:
            if self.begun:
                self.finish(out)
            self.conv, self.begun, self.audits, self.place, self.state = conv, True, [], 0, START
            self.sums, self.told = dict.fromkeys(_SUMS, 0), False
        if row["what"] == 0:
            self.audits.append(row["audit"])
            for c in _SUMS:
                self.sums[c] += row[c]
            return
        for _ in range(row["n"]):
            self._inserts(out)
            edit = self.audits[self.place]
            self.place += 1
            role, text = row["role"], row["text"]
            if edit == "R":
                role = _ROLE[self._next()]
            if edit == "D":
                self._add(out, row["turn"], "D", None, None, row["role"])
            else:
                self.state = _AFTER[role[:1]][0]
                self._add(out, row["turn"], edit, role, text, row["role"])

    def finish(self, out: list) -> None:
        self._inserts(out)
        if not self.told:
            self._add(out, None, None, None, None, None)

    def _next(self) -> int:
        return ASSISTANT if self.state == USER else USER

    def _inserts(self, out: list) -> None:
        if isinstance(self.audits, list):  # the parts are all here before the first text
            self.audits = "".join(self.audits)
        while self.audits[self.place : self.place + 1] == "I":
            self.place += 1
            self.state = self._next()
            self._add(out, None, "I", _ROLE[self.state], "", None)

    def _add(self, out: list, turn, edit, role, text, before) -> None:
        out.append((self.conv, turn, edit, role, text, before, None if self.told else self.sums))
        self.told = True


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`repaired_rows` of a table.  Null roles and texts are one space, null turns come first, equal turns are
    ordered by role and a hash of the text, a null conversation is one conversation; other columns are not read."""
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        F.lit(1).cast("long").alias("n"),
    )
    return repaired_rows(rows, audits(rows))


class _Digest:
    """Sums and digests of one conversation's edits, streamed."""

    def __init__(self, conv, summary: dict):
        self.conv, self.sums = conv, summary
        self.low = self.high = self.turn = self.before = None
        self.turns, self.illegal, self.edits, self.kept, self.hash = 0, 0, [], 0, hashlib.sha256()

    def add(self, turn, edit, role, text, before) -> None:
        if edit is None:
            return
        self.edits.append(edit)
        if edit != "I":
            if turn is not None:
                self.turns += turn != self.turn
                self.low, self.high, self.turn = (turn if self.low is None else self.low), turn, turn
            if self.before is not None:
                self.illegal += self.before[:1] + before[:1] not in ("su", "ua", "au")
            self.before = before
        if edit != "D":
            self.hash.update((("\n" if self.kept else "") + f"{role}:{text}").encode())
            self.kept += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        s = self.sums
        return (self.conv, gaps, s["blank"], s["duplicate"], s["truncated"], self.illegal, s["cost"], "".join(self.edits), self.hash.hexdigest())


_DIGESTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repaired_rows`, whose order is used as it is, without a shuffle."""
    kind = edits.schema["conv"].dataType.simpleString()
    names = ["conv", *[c.split()[0] for c in _DIGESTS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv_type = None, None

        def out(done: list) -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            columns = (batch.column(c).to_pylist() for c in ("conv", "summary", "turn", "edit", "role", "text", "role_before"))
            for conv, summary, *values in zip(*columns):
                if summary is not None:  # a conversation's first row
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv, summary)
                now.add(*values)
            yield out(done)
        if now is not None:
            yield out([now.row()])

    return edits.mapInArrow(run, f"conv {kind}, {_DIGESTS}")


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20`` as ``conv, turn, role, text, n``; dropped rows have n = 0."""
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(texts["conv_id"], F.lit(":"), texts["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(texts["text"], "[.!?]", "")).otherwise(texts["text"])
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(texts["role"]).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def op12_turns_hirschberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, edits and digest of every conversation after the contract's damage, repaired."""
    rows = damage(table(spark, sf_dir, "conversations"))
    edits = repaired_rows(rows, audits(rows.where("n > 0")))
    return digests(edits).withColumnRenamed("conv", "conv_id")


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS codes
  FROM range(256) r(i)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), numbered AS (
  SELECT named.*, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM numbered WHERE kind <> 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM damaged
), turns AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN stripped = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen
), inserted(before, inserts, middle) AS (
  VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3),
    (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)
), follow(role, middle, after) AS (
  VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), ways AS (
  SELECT before, middle AS after, inserts || 'D' AS edits, NULL AS initial, 5 * length(inserts) + 2 AS cost FROM inserted
  UNION ALL SELECT before, after, inserts || 'R', '*', 5 * length(inserts) + 1 FROM inserted JOIN follow USING (middle) WHERE role <> 's'
  UNION ALL SELECT before, after, inserts || 'K', role, 5 * length(inserts) FROM inserted JOIN follow USING (middle)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM turns
  UNION ALL
  SELECT walk.conv_id, turns.i, ways.after,
    min({'cost': walk.best.cost + ways.cost + CASE WHEN ways.initial IS NOT NULL AND turns.fault = 'truncated' THEN 5 ELSE 0 END,
      'audit': walk.best.audit || ways.edits})
  FROM walk JOIN turns ON walk.conv_id IS NOT DISTINCT FROM turns.conv_id AND turns.i = walk.i + 1
  JOIN ways ON ways.before = walk.state AND (ways.initial IS NULL
    OR (turns.fault NOT IN ('blank', 'duplicate') AND (ways.initial = '*' OR ways.initial = turns.initial)))
  GROUP BY walk.conv_id, turns.i, ways.after
), lengths AS (
  SELECT conv_id, max(i) AS n FROM turns GROUP BY conv_id
), solved AS (
  SELECT walk.conv_id, min({'cost': best.cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END,
    'audit': best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS best
  FROM walk JOIN lengths ON walk.conv_id IS NOT DISTINCT FROM lengths.conv_id AND walk.i = lengths.n GROUP BY walk.conv_id
), edits AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS place FROM solved
), placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS i,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY place) AS nth
  FROM edits
), joined AS (
  SELECT p.*, t.role AS own, t.initial, t.text,
    max(CASE WHEN p.edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS head
  FROM placed p LEFT JOIN turns t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.edit <> 'I' AND p.i = t.i
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN own WHEN (nth - head) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole
  FROM joined WHERE edit <> 'D' GROUP BY conv_id
), pairs AS (
  SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM turns
), illegal AS (
  SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS n FROM pairs GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated
  FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal.n, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN illegal ON o.conv_id IS NOT DISTINCT FROM illegal.conv_id
LEFT JOIN solved ON o.conv_id IS NOT DISTINCT FROM solved.conv_id
LEFT JOIN repaired ON o.conv_id IS NOT DISTINCT FROM repaired.conv_id
"""
