"""Repair of a conversation's structure by the cheapest edits (operator 11).

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant
turns.  Turns are kept, given another role or deleted, and empty turns are inserted; blank and repeated
turns must go, and unfinished ones cost extra where they stay.  The cheapest edits follow from
a dynamic program over the turns with four states: nothing yet, after the system turn, after a user turn
and after an assistant turn.

Of several cheapest edits the ones whose initials come first in ASCII order are taken, so the
walk must go forward and know the cost of what is left.  The backward pass keeps the costs of the four
states at every square root of n-th turn only; the forward walk computes those between two checkpoints
again when it gets there.  All edits of equal initials are walked together as a set of states; their roles follow
from their number, as the pairs alternate.

Spark prepares the turns (faults, copies, order) by key and block, so only a byte for each turn of a
conversation reaches the task that walks it; texts never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.shared import prepare, stored

REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: Turn numbers of a block; turns are ordered and numbered within their block.
BLOCK = 1024
FLUSH = 1 << 14
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of this initial, by the state before it.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = ["s", "u", "a", ""]
FINE, BLANK, REPEATED, CUT = range(4)
#: Costs at the end: after the system turn a pair is missing, after a user turn its answer.
END = (0, 2 * INSERT, INSERT, 0)
REPORT = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
SOLVED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("idx", pa.int64()), ("seq", pa.int64()), ("role", pa.string()),
                    ("own", pa.bool_()), ("report", REPORT)])
SOLVED_SQL = ("conv_id long, block long, idx long, seq long, role string, own boolean, report struct<"
              "gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>")


class Program:
    """The costs of the turns that are left, by state, and the steps of the walk; both are remembered."""

    def __init__(self):
        self.known, self.steps = {}, {}

    @staticmethod
    def edits(code: int) -> list[tuple[str, int, str | None]]:
        """(initial, cost, initial of the role it leaves) of each edit of one turn."""
        initial, fault = INITIALS[code >> 2], code & 3
        if fault in (BLANK, REPEATED):
            return [("D", DELETE, None)]
        extra = UNFINISHED if fault == CUT else 0
        kept = [("K", extra, initial)] if initial else []
        return [("D", DELETE, None), *kept, ("R", REROLE + extra, "u"), ("R", REROLE + extra, "a")]

    def raw(self, code: int, left: tuple) -> tuple:
        """Costs by state before a turn, given those behind it."""
        best = [min(c + left[q if role is None else AFTER[role][q]]
                    for _, c, role in self.edits(code) if role is None or q in AFTER[role]) for q in range(4)]
        best[USER] = min(best[USER], INSERT + best[ASSISTANT])
        for q in (NOTHING, SYSTEM, ASSISTANT):
            best[q] = min(best[q], INSERT + best[USER])
        return tuple(best)

    def before(self, code: int, left: tuple) -> tuple[tuple, int]:
        """The same without their minimum, and the minimum; few different ones occur."""
        if (code, left) not in self.known:
            raw = self.raw(code, left)
            self.known[code, left] = tuple(c - min(raw) for c in raw), min(raw)
        return self.known[code, left]

    def walk(self, code: int, left: tuple, states: frozenset) -> tuple[str, frozenset]:
        """Initials of the least of the cheapest edits up to and with this turn, and the states they may lead to."""
        if (code, left, states) not in self.steps:
            raw, out, now = self.raw(code, left), "", states
            while True:
                then = {(initial, left_in) for initial, c, role in self.edits(code) for q in now
                        if role is None or q in AFTER[role]
                        for left_in in [q if role is None else AFTER[role][q]] if raw[q] == c + left[left_in]}
                inserted = {AFTER[role][q] for role in "ua" for q in now if q in AFTER[role] and raw[q] == INSERT + raw[AFTER[role][q]]}
                first = min([i for i, _ in then] + ["I"] * bool(inserted))
                out += first
                if first != "I":
                    break
                now = inserted
            self.steps[code, left, states] = out, frozenset(q for i, q in then if i == first)
        return self.steps[code, left, states]

    @staticmethod
    def ending(states: frozenset) -> str:
        """Inserts that end a conversation; all states of a walk are equally far from the end."""
        return "I" * (min(END[q] for q in states) // INSERT)

    def solve(self, codes: bytes) -> tuple[int, list[str]]:
        """The cost, and the initials of the edits of each turn; inserts stand before their turn, the last ones at the end."""
        n = len(codes)
        gap = isqrt(n) + 1
        marks, left, cost = {n: END}, END, 0
        for j in range(n - 1, -1, -1):
            left, more = self.before(codes[j], left)
            cost += more
            if j % gap == 0:
                marks[j] = left
        cost += left[NOTHING]
        out, states = [], frozenset([NOTHING])
        for begin in range(0, n, gap):
            end = min(begin + gap, n)
            lefts = [marks[end]]
            for j in range(end - 1, begin, -1):
                lefts.append(self.before(codes[j], lefts[-1])[0])
            for j in range(begin, end):
                edits, states = self.walk(codes[j], lefts[end - 1 - j], states)
                out.append(edits)
        out.append(self.ending(states))
        return cost, out


class Turns:
    """The turns of one conversation as bytes, and what its report counts."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.copies, self.blocks = conv_id, bytearray(), {}, []
        self.faults, self.illegal, self.last = [0] * 4, 0, None
        self.low = self.high = None
        self.turns = self.rows = 0

    def add(self, block, turn, initial, fault, copies):
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1
        self.last = initial or " "
        code = INITIALS.index(initial) << 2
        again = BLANK if fault == BLANK else REPEATED
        self.faults[fault] += 1
        self.faults[again] += copies - 1
        self.codes.append(code | fault)
        if copies > 1:
            self.codes.extend(bytes([code | again]) * (copies - 1))
            self.copies[self.rows] = copies
        if not self.blocks or self.blocks[-1][0] != block:
            self.blocks.append([block, 0])
        self.blocks[-1][1] += 1
        self.rows += 1

    def solved(self, program: Program) -> Iterator[tuple]:
        """A row for each turn of the repaired conversation, then the report."""
        cost, edits = program.solve(bytes(self.codes))
        shift = sum(len(e) - e.count("D") for e in edits) % 2  # a system turn comes first
        at = seq = row = 0
        for block, count in self.blocks:
            for idx in range(1, count + 1):
                many = self.copies.get(row, 1)
                row += 1
                these = edits[at:at + many] + (edits[-1:] if at + many == len(self.codes) else [])
                at += many
                for edit in "".join(these):
                    if edit != "D":
                        role = None if edit == "K" else "user" if (seq - shift) % 2 == 0 else "assistant"
                        yield self.conv_id, block, idx, seq, role, edit != "I", None
                        seq += 1
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        counts = (gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT], self.illegal, cost, "".join(edits))
        yield self.conv_id, None, None, None, None, None, dict(zip((f.name for f in REPORT), counts, strict=True))


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SOLVED, strict=True)], schema=SOLVED)


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks conversations whose turns come one after another, in order."""
    program, now, ready = Program(), None, []
    for batch in batches:
        for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                for row in now.solved(program) if now else ():
                    ready.append(row)
                    if len(ready) >= FLUSH:
                        yield record(ready)
                        ready = []
                now = Turns(conv_id)
            now.add(*turn)
    ready.extend(now.solved(program) if now else ())
    if ready:
        yield record(ready)


def faults(rows: DataFrame) -> DataFrame:
    """Different turns with their copies, their first fault and their place in the conversation.

    A turn repeats one seen earlier if role and text do; turns of one number come in the order of
    role and text, so equal ones are neighbours and count as copies of one row.
    """
    turns = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("print", F.md5(F.col("text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = turns.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p")).agg(F.min(place).alias("earliest"))
    turns = turns.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p")))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("earliest") < place, REPEATED).when(
        ~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    block = F.coalesce(F.expr(f"turn DIV {BLOCK}"), F.lit(-(1 << 63)))
    turns = turns.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"),
                         F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"), block.alias("block"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return turns.withColumn("idx", F.row_number().over(order).cast("long"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report of each conversation, and the turns of the repaired ones.

    The report: conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate and
    truncated turns (each by its first fault), illegal (neighbours that may not follow each other), cost, and
    audit, the initials of the edits (Delete, Insert, Keep, Rerole).  The turns: conv_id, seq (from 0), role, text.

    NULL role and text are one space.  Turns come by number, those without one first, then by role and text.
    Roles count by their first letter, as it is; others than s, u and a are given another role or go.
    Rows without conv_id are one conversation; repeated rows are duplicates; further columns are ignored.
    """
    prepare(conversations.sparkSession)
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"))
    turns = stored(faults(rows), "turns")  # read for the walk and for the texts
    short = turns.select("conv_id", "block", "turn", "initial", "fault", "copies", "idx")
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "block", "idx").drop("idx")
    solved = stored(short.mapInArrow(solve, SOLVED_SQL), "solved")
    report = solved.filter("report IS NOT NULL").select("conv_id", "report.*")
    edits = solved.filter("seq IS NOT NULL").select(*(F.col(c).alias(f"e_{c}") for c in ("conv_id", "block", "idx")), "seq",
                                                   F.col("role").alias("given"), "own")
    same = F.col("conv_id").eqNullSafe(F.col("e_conv_id")) & (F.col("block") == F.col("e_block")) & (F.col("idx") == F.col("e_idx"))
    text = F.when(F.col("own"), F.col("text")).otherwise("")
    return report, edits.join(turns, same).select(
        F.col("e_conv_id").alias("conv_id"), "seq", F.coalesce("given", "role").alias("role"), text.alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's ``role:text`` lines, read one turn at a time."""

    def run(batches):
        conv_id, hashed, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if hashed is None or c != conv_id:
                    if hashed:
                        out.append((conv_id, hashed.hexdigest()))
                    conv_id, hashed = c, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            if len(out) >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_id", "sha"])
                out = []
        if hashed:
            out.append((conv_id, hashed.hexdigest()))
            ids, shas = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas)], names=["conv_id", "sha"])

    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "role", "text")
    return sorted_.mapInArrow(run, "conv_id long, sha string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults to repair: by the remainder of a checksum of ``conv_id:turn`` (NULLs: one space) a turn is dropped,
    emptied, loses its full stops, is repeated or becomes the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(name.cast("binary")) % 20).alias("damage")).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The report of ``rows`` with the digest of what they are repaired to, for every id of ``conversations``; zeros where no row is left."""
    report, turns = repair(rows)
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    joined = joined.join(digests(turns), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(F.col("id").alias("conv_id"), *(zero(f.name) for f in list(REPORT)[:-1]), F.coalesce("audit", F.lit("")).alias("audit"),
                         empty_or("sha").alias("repaired_sha256"))


def empty_or(sha: str) -> Column:
    return F.coalesce(F.col(sha), F.sha2(F.lit("").cast("binary"), 256))
