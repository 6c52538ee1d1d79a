"""Repair of conversations' structure at the least cost: run-length min-plus dynamic programming.

A conversation should have the role initials ``(s?(ua)+)?``. Each row can be kept (0), given the role user or assistant
(3) or deleted (4); empty messages can be inserted anywhere (3). Blank rows and repeats of an earlier role and text must
go; a truncated row that stays costs 3 more. A row is one of nine symbols (role initial s, u, a or another, truncated or
not; or must go), a symbol is a 4 x 4 min-plus matrix over the states start, after s, after u, after a, and a row's
inserts lie before it. Equal consecutive symbols are one run; a run of n is advanced by the cached binary powers of its
matrix. The choices are unrolled from the start: the first letter in the order D, I, K, R that keeps the least cost, which
gives the least audit as a string, as every letter has but one next state. Blocks of 2^k equal symbols are unrolled once
for each state and each vector of costs behind them, and then remembered.

How it runs: equal rows of a turn are one row with a number, and dropped rows one of number 0, before anything else is
shuffled; repeats are found by a join with those role-text pairs of a conversation that have several turns. The rows are
range-partitioned by conversation, turn, role and text, so that a long conversation lies in several tasks, numbered and
written. Each piece that a task holds becomes one row of runs; only these meet by conversation, where the choices are
made, a piece at a time. Then choices and texts are merged by order and the repaired messages stream through: a hash of a
whole conversation needs its texts one after the other, but no task holds more of them than a batch. A conversation's
audit, one value, has a letter for each of its rows.

Edge cases: a null role or text is one space, and null identifiers and turns are so in the hash that chooses the damage;
null conv_ids are one conversation; null turns come first; rows of the same turn go by role, then text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60  # no way
GO = 8  # the symbol of a row that must go; others are twice the place of the initial in "suax", plus one if truncated
#: Where an empty message leads: user after all but user.
NEXT = (USER, USER, ASSISTANT, USER)
BLOCK = 10  # blocks of up to 2^BLOCK symbols are remembered
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


# --- one conversation ---------------------------------------------------------------------------------------------


def _kept(symbol: int, p: int) -> int | None:
    """The state after a kept row, if it may be kept there."""
    role = symbol >> 1
    if role == 0:
        return SYSTEM if p == START else None
    return NEXT[p] if (role, NEXT[p]) in ((1, USER), (2, ASSISTANT)) else None


def _inserting(v: list[int]) -> Vector:
    """Costs when messages may be inserted first; three in a row never pay."""
    for _ in range(2):
        v = [min(v[p], INSERT + v[NEXT[p]]) for p in range(4)]
    return tuple(v)  # type: ignore[return-value]


def _step(symbol: int, after: Vector) -> Vector:
    """Costs before a row, given those after it."""
    out = [DELETE + after[p] for p in range(4)]
    if symbol != GO:
        more = TRUNCATED * (symbol & 1)
        for p in range(4):
            out[p] = min(out[p], REROLE + more + after[NEXT[p]])
            if (q := _kept(symbol, p)) is not None:
                out[p] = min(out[p], KEEP + more + after[q])
    return _inserting(out)


END: Vector = _inserting([0, FAR, FAR, 0])


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2^k rows of one symbol; 9 symbols by the bits of the longest run."""
    if k == 0:
        columns = [_step(symbol, tuple(0 if q == c else FAR for q in range(4))) for c in range(4)]  # type: ignore[arg-type]
        return tuple(tuple(min(FAR, columns[c][p]) for c in range(4)) for p in range(4))  # type: ignore[misc]
    half = power(symbol, k - 1)
    return tuple(tuple(min(FAR, *(half[p][m] + half[m][q] for m in range(4))) for q in range(4)) for p in range(4))  # type: ignore[misc]


def advance(symbol: int, n: int, v: Vector) -> Vector:
    """Costs before a run of ``n`` rows, given those after it."""
    k = 0
    while n >> k:
        if n >> k & 1:
            v = tuple(min(c + x for c, x in zip(row, v, strict=True)) for row in power(symbol, k))  # type: ignore[assignment]
        k += 1
    return v


def _level(v: Vector) -> Vector:
    least = min(v)
    return tuple(min(FAR, x - least) for x in v)  # type: ignore[return-value]


def _one(symbol: int, p: int, after: Vector) -> tuple[str, int]:
    before, out = _step(symbol, after), ""
    while True:
        if before[p] == DELETE + after[p]:
            return out + "D", p
        if before[p] == INSERT + before[NEXT[p]]:
            out, p = out + "I", NEXT[p]
            continue
        q, more = _kept(symbol, p), TRUNCATED * (symbol & 1)
        if q is not None and before[p] == KEEP + more + after[q]:
            return out + "K", q
        return out + "R", NEXT[p]


def _block(symbol: int, k: int, p: int, after: Vector) -> tuple[str, int]:
    if k == 0:
        return _one(symbol, p, after)
    unroll = _remembered if k <= BLOCK + 1 else _block
    first, p = unroll(symbol, k - 1, p, _level(advance(symbol, 1 << k - 1, after)))
    second, p = unroll(symbol, k - 1, p, after)
    return first + second, p


_remembered = lru_cache(maxsize=8192)(_block)


def choices(symbol: int, n: int, p: int, after: Vector) -> tuple[str, int]:
    """The letters of a run of ``n`` rows from state ``p`` on, with the costs after it; and the state it ends in."""
    out = []
    while n:
        k = n.bit_length() - 1
        n -= 1 << k
        part, p = (_remembered if k <= BLOCK else _block)(symbol, k, p, _level(advance(symbol, n, after)))
        out.append(part)
    return "".join(out), p


def closing(p: int) -> str:
    return {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[p]


def solve(pieces: list[list[tuple[int, int]]]) -> tuple[int, list[str]]:
    """The least cost of a conversation, and the letters of each piece (runs of symbol and number)."""
    behind, v = [], END
    for runs in reversed(pieces):
        ends = []
        for symbol, n in reversed(runs):
            ends.append(v)
            v = advance(symbol, n, v)
        behind.append(ends[::-1])
    letters, p = [], START
    for runs, ends in zip(pieces, reversed(behind), strict=True):
        out = []
        for (symbol, n), end in zip(runs, ends, strict=True):
            part, p = choices(symbol, n, p, end)
            out.append(part)
        letters.append("".join(out))
    if letters:
        letters[-1] += closing(p)
    return v[START], letters


# --- rows -----------------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times (0: dropped) after the damage that crc32 of ``conv_id:turn`` chooses."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind, role, text = F.crc32(key) % 20, F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """The distinct rows in order, each with its number ``at``, initial and symbol."""
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("n")).withColumn("digest", F.unhex(F.md5("text")))
    several = distinct.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    several = several.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first"))
    joined = distinct.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    initial = F.substring("role", 1, 1)
    blank, repeat = last == "", F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    plain = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6) + F.when(last.isin(".", "!", "?"), 0).otherwise(1)
    marked = joined.select("conv_id", "turn", "role", "text", "n", blank.alias("blank"), F.when(blank | repeat, GO).otherwise(plain).alias("symbol"), (F.floor(plain / 2)).cast("int").alias("initial"))
    ordered = marked.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.withColumn("at", F.monotonically_increasing_id())


PIECE = "conv_id long, at long, first_turn long, last_turn long, turns long, first_role int, last_role int, blank long, duplicate long, truncated long, illegal long, symbols array<int>, numbers array<long>"
EDITS = "conv_id long, at long, begins boolean, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = frozenset([(0, 1), (1, 2), (2, 1)])  # su, ua, au as places in "suax"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of a conversation in a batch."""
    for batch in batches:
        conv, at, turn, role, n, blank, symbol = (batch.column(i).to_pylist() for i in range(7))
        starts = [i for i in range(len(at)) if i == 0 or conv[i] != conv[i - 1] or at[i] != at[i - 1] + 1]
        rows = []
        for a, b in pairwise([*starts, len(at)]):
            there = [i for i in range(a, b) if n[i]]
            turns = [turn[i] for i in there if turn[i] is not None]
            runs: list[list[int]] = []
            for i in there:
                for s, k in ((symbol[i], 1), (GO, n[i] - 1)):
                    if k and runs and runs[-1][0] == s:
                        runs[-1][1] += k
                    elif k:
                        runs.append([s, k])
            roles = [role[i] for i in there]
            illegal = sum(n[i] - 1 for i in there) + sum(pair not in LEGAL for pair in pairwise(roles))
            blanks = sum(n[i] for i in there if blank[i])
            truncated = sum(1 for i in there if symbol[i] != GO and symbol[i] & 1)
            duplicate = sum(n[i] if symbol[i] == GO else n[i] - 1 for i in there if not blank[i])
            different = len(dict.fromkeys(turns))
            rows.append((conv[a], at[a], turns[0] if turns else None, turns[-1] if turns else None, different, roles[0] if roles else None, roles[-1] if roles else None, blanks, duplicate, truncated, illegal, [s for s, _ in runs], [k for _, k in runs]))
        if rows:
            yield _batch(rows, PIECE)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The pieces of each conversation, in order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for pieces in _conversations(batches):
        cost, letters = solve([list(zip(p["symbols"], p["numbers"], strict=True)) for p in pieces])
        counts = [sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")]
        roles = [(p["first_role"], p["last_role"]) for p in pieces if p["first_role"] is not None]
        counts[3] += sum((a[1], b[0]) not in LEGAL for a, b in pairwise(roles))
        turns = [(p["first_turn"], p["last_turn"], p["turns"]) for p in pieces if p["turns"]]
        different = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in pairwise(turns))
        gaps = turns[-1][1] - turns[0][0] + 1 - different if turns else 0
        for i, (p, edits) in enumerate(zip(pieces, letters, strict=True)):
            rows.append((p["conv_id"], p["at"], i == 0, edits, gaps, *counts, cost, "".join(letters) if i == 0 else None))
        if len(rows) >= 500:
            yield _batch(rows, EDITS)
            rows = []
    if rows:
        yield _batch(rows, EDITS)


class _Writer:
    """Follows a conversation's letters along its rows."""

    def __init__(self):
        self.state, self.letters, self.i = START, "", 0

    def take(self, letters: str) -> None:
        self.letters, self.i = self.letters[self.i :] + letters, 0

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str]]:
        while n:
            letter = self.letters[self.i]
            self.i += 1
            n -= letter != "I"
            if letter == "K":
                self.state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
                yield role, text
            elif letter != "D":
                yield self._new(text if letter == "R" else "")

    def rest(self) -> Iterator[tuple[str, str]]:
        while self.i < len(self.letters):
            self.i += 1
            yield self._new("")

    def _new(self, text: str) -> tuple[str, str]:
        self.state = NEXT[self.state]
        return ("user" if self.state == USER else "assistant"), text


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's first row of choices with its repaired messages, which must be taken before the next one."""
    rows = (row for batch in batches for row in batch.to_pylist())
    head = next(rows, None)

    def messages(writer: _Writer) -> Iterator[tuple[str, str]]:
        nonlocal head
        for row in rows:
            if row["edits"] is None:
                yield from writer.row(row["role"], row["text"], row["n"])
            elif row["begins"]:
                head = row
                break
            else:
                writer.take(row["edits"])
        yield from writer.rest()

    while head is not None:
        first, head = head, None
        writer = _Writer()
        writer.take(first["edits"])
        yield first, messages(writer)


def _merged(rows: DataFrame) -> DataFrame:
    """Choices and rows in order, a conversation's all in one task, which reads them one by one."""
    spark = rows.sparkSession
    bounded_batches(spark)
    ordered = staged(_ordered(rows), "conversation-rows")
    pieces = ordered.select("conv_id", "at", "turn", "initial", "n", "blank", "symbol").mapInArrow(_pieces, PIECE)
    edits = staged(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_edits, EDITS), "conversation-edits")
    both = edits.unionByName(ordered.where("n > 0").select("conv_id", "at", "role", "text", "n"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("edits").isNull())


def repair(rows: DataFrame) -> DataFrame:
    """The repaired messages of conversations (conv_id, turn, role, text, times): conv_id, place from 0 on, role, text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for first, messages in _messages(batches):
            for i, (role, text) in enumerate(messages):
                out.append((first["conv_id"], i, role, text))
                if len(out) >= 500:
                    yield _batch(out, "conv_id long, place long, role string, text string")
                    out = []
        if out:
            yield _batch(out, "conv_id long, place long, role string, text string")

    return _merged(rows).mapInArrow(write, "conv_id long, place long, role string, text string")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame) -> DataFrame:
    """A row for each conversation: faults, least cost, audit and the hash of the repaired ``role:text`` lines."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for first, messages in _messages(batches):
            value = hashlib.sha256()
            for i, (role, text) in enumerate(messages):
                value.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            out.append((*(first[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), value.hexdigest()))
            if len(out) >= 500:
                yield _batch(out, REPORT)
                out = []
        if out:
            yield _batch(out, REPORT)

    return _merged(rows).mapInArrow(digest, REPORT)
