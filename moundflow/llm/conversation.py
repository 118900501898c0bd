"""Conversation structure repair: the cheapest edits that give a conversation
whole turns in the order ``(s?(ua)+)?``, found by a secondary-sorted stream.

Rows without their text are repartitioned by conversation and sorted from the
last turn to the first; ``mapInPandas`` carries the costs of the four states
across Arrow batches and keeps one small backpointer a row, which spill to a
file of the task for giant conversations.  At the first turn the pointers are
followed forward, which gives a byte a row: its fault and its edits.  A second
stream, sorted forward, meets these bytes with the texts."""
from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundflow.llm.base import named, record, saved

#: Characters that make a text blank, and the ends of a whole text.
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Faults by number; a row has the first that holds.
FAULTS = (None, "blank", "duplicate", "truncated")
#: After nothing, a system, a user and an assistant turn: where each role leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What a rerole or an insertion gives in each state, and the cost of ending there.
WANTED, ROLES = "uuau", {"u": "user", "a": "assistant"}
ENDINGS = ("", "ua", "a", "")
#: Edits of one row: inserted turns (u, a), then D, K, U or A (rerole to user or assistant), then turns inserted at the end.
MOVES = [p + x + e for p in ("", "u", "a", "ua", "au") for x in "DKUA" for e in ("", "a", "ua")]
NUMBER = {m: i for i, m in enumerate(MOVES)}
LETTER = {"D": "D", "K": "K", "U": "R", "A": "R", "u": "I", "a": "I"}
#: Backpointers held in memory; more go to a file of the task.  Bytes of decisions in one row.
HELD, BLOCK = 1 << 20, 1 << 16


# --- the shortest path ---------------------------------------------------------

def options(after: tuple, state: int, first: str, fault: int) -> Iterator[tuple[int, str, int]]:
    """(cost to go, edits, next state) of one row met in a state."""
    yield DELETE + after[state], "D", state
    if fault in (1, 2):
        return
    stays = CUT_SHORT if fault == 3 else 0
    to = STEPS[state].get(first)
    if to is not None:
        yield stays + after[to], "K", to
    to = STEPS[state][WANTED[state]]
    yield REROLE + stays + after[to], WANTED[state].upper(), to


def step(after: tuple, first: str, fault: int) -> tuple[tuple, list[str], list[int]]:
    """Costs before a row from those after it, less their minimum, and what each
    state does.  Of equal costs the edits whose letters come first in ASCII; two
    ways with the same letters are the same way, so this choice is the least audit."""
    costs, edits, nexts = [], [], []
    for state in range(4):
        found, at, put = [], state, ""
        for n in range(3):          # more insertions before one row come back to a state passed
            found += [(INSERT * n + c, "".join(LETTER[x] for x in put + e), put + e, to) for c, e, to in options(after, at, first, fault)]
            put, at = put + WANTED[at], STEPS[at][WANTED[at]]
        cost, _, edit, to = min(found)
        costs.append(cost)
        edits.append(edit)
        nexts.append(to)
    least = min(costs)
    return tuple(c - least for c in costs), edits, nexts


class Automaton:
    """Steps seen so far.  Costs differ by a few edits only, so there are few
    distinct cost vectors and a step is one look-up."""

    def __init__(self):
        self.end = tuple(INSERT * len(e) for e in ENDINGS)
        self.known: dict[tuple, tuple] = {}
        self.moves: list[tuple] = []

    def back(self, after: tuple, first: str, fault: int) -> tuple[tuple, int]:
        key = (after, first, fault)
        if key not in self.known:
            before, edits, nexts = step(after, first, fault)
            self.moves.append(([fault * len(MOVES) + NUMBER[e] for e in edits], nexts))
            self.known[key] = before, len(self.moves) - 1
        return self.known[key]


class Backpointers:
    """Two bytes a row, pushed from the last row on and read from the first."""

    def __init__(self, held: int = HELD):
        self.held, self.some, self.file, self.n = held, array("H"), None, 0

    def push(self, code: int) -> None:
        self.some.append(code)
        self.n += 1
        if len(self.some) >= self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.some.tofile(self.file)
            self.some = array("H")

    def pop_all(self) -> Iterator[int]:
        yield from reversed(self.some)
        for block in range((self.n - len(self.some)) // self.held - 1, -1, -1):
            part = array("H")
            self.file.seek(block * self.held * 2)
            part.fromfile(self.file, self.held)
            yield from reversed(part)
        if self.file:
            self.file.close()


def decide(pointers: Backpointers, auto: Automaton) -> Iterator[bytes]:
    """The decisions of a conversation from its first row on, in blocks."""
    state, out, left = 0, bytearray(), pointers.n
    for code in pointers.pop_all():
        moves, nexts = auto.moves[code]
        move, state, left = moves[state], nexts[state], left - 1
        if not left:
            move += NUMBER[MOVES[move % len(MOVES)] + ENDINGS[state]] - move % len(MOVES)
        out.append(move)
        if len(out) >= BLOCK:
            yield bytes(out)
            out = bytearray()
    if out:
        yield bytes(out)


def _backward(held: int):
    """Rows from the last turn to the first; the costs are carried over batches."""
    def run(pdfs):
        import pandas as pd
        auto, conv, after, pointers, waiting = Automaton(), None, None, None, None

        def take(same: bool) -> None:       # the row before decides whether this one repeats it
            nonlocal after
            first, fault = waiting[1] & 7, waiting[1] >> 3
            after, code = auto.back(after, "-sua"[first], 2 if same and fault != 1 else fault)
            pointers.push(code)

        def end():
            take(False)
            for i, block in enumerate(decide(pointers, auto)):
                yield (*conv, i, block)

        def frame(rows):
            return pd.DataFrame(rows, columns=["k1", "k2", "block", "moves"])

        out = []
        for pdf in pdfs:
            for k1, k2, has, t, h1, h2, kind in zip(*[pdf[c].tolist() for c in ("k1", "k2", "has", "t", "h1", "h2", "kind")]):
                row = (has, t, h1, h2)
                if (k1, k2) == conv:
                    take(waiting[0] == row)
                else:
                    if conv is not None:
                        for x in end():
                            out.append(x)
                            if len(out) >= 4096 or len(x[3]) >= BLOCK:
                                yield frame(out)
                                out = []
                    conv, after, pointers = (k1, k2), auto.end, Backpointers(held)
                waiting = (row, kind)
        if conv is not None:
            for x in end():
                out.append(x)
                if len(out) >= 4096 or len(x[3]) >= BLOCK:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)
    return run


# --- rows -------------------------------------------------------------------------

KEYS = ("k1", "k2", "has", "t", "role", "lead", "h1", "h2")


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text with hashes of the conversation and of the row."""
    d = df.select(named(conv).alias("conv"), named(turn).cast("long").alias("turn"),
                  F.coalesce(named(role).cast("string"), F.lit(" ")).alias("role"),
                  F.coalesce(named(text).cast("string"), F.lit(" ")).alias("text"))
    key = F.col("conv").cast("string")
    return d.select("*", F.xxhash64(key, key.isNull()).alias("k1"), F.xxhash64(F.lit(7), key, key.isNull()).alias("k2"),
                    F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("t"),
                    F.substring("text", 1, 32).alias("lead"),
                    F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(7), "role").alias("h2"))


def decisions(rows: DataFrame, held: int = HELD) -> DataFrame:
    """k1, k2, block, moves: a byte for each row of a conversation in its order."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    first = F.substring("role", 1, 1)
    light = rows.select(*KEYS, F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).alias("first"),
                        F.when(end == "", 1).when(end.isin(*ENDS), 0).otherwise(3).alias("end"))
    # texts that stand in several turns: all but the first of these are duplicates
    same = ["k1", "k2", "h1", "h2"]
    turn = F.struct("has", "t")
    repeated = saved(light.groupBy(*same).agg(F.min(turn).alias("one"), F.max(turn).alias("last"))
                     .where(F.col("one") != F.col("last")).drop("last"))
    light = light.join(repeated, same, "left")
    fault = F.when(F.col("end") == 1, 1).when(turn > F.col("one"), 2).otherwise(F.col("end"))
    light = light.select(*KEYS, (fault * 8 + F.col("first")).cast("int").alias("kind"))
    ordered = light.repartition("k1", "k2").sortWithinPartitions(
        "k1", "k2", *[F.col(c).desc() for c in KEYS[2:]]).select("k1", "k2", "has", "t", "h1", "h2", "kind")
    return ordered.mapInPandas(_backward(held), "k1 long, k2 long, block long, moves binary")


class Queue:
    """Bytes in, bytes out, in order; what is more than ``HELD`` waits in a file."""

    def __init__(self):
        self.file, self.some, self.at = tempfile.SpooledTemporaryFile(HELD), b"", 0

    def put(self, block: bytes) -> None:
        self.file.write(block)

    def start(self) -> None:
        self.file.seek(0)

    def get(self) -> int:
        if self.at == len(self.some):
            self.some, self.at = self.file.read(BLOCK), 0
        self.at += 1
        return self.some[self.at - 1]


COLUMNS = ("conv", "turn", "role", "text", "seq", "fault", "edit", "new_role")


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the decisions that came before them; equal conversations stand together."""
    queue, open_, seq, conv = None, False, 0, None
    for b in batches:
        schema = pa.schema([("conv", b.schema.field(3).type), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("seq", pa.int64()),
                            ("fault", pa.string()), ("edit", pa.string()), ("new_role", pa.string())])
        if b.num_rows:
            src, seqs, faults, edits, new, keep = [], [], [], [], [], []
            roles = b.column(4).to_pylist()
            for i, (k1, k2, moves) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())):
                if (k1, k2) != conv:
                    queue, open_, seq, conv = Queue(), False, 0, (k1, k2)
                if moves is not None:
                    queue.put(moves)
                    continue
                if not open_:
                    queue.start()
                    open_ = True
                code = queue.get()
                for x in MOVES[code % len(MOVES)]:
                    seq += 1
                    own = x in "DKUA"
                    src.append(i)
                    keep.append(i if own else None)
                    seqs.append(seq)
                    faults.append(FAULTS[code // len(MOVES)] if own else None)
                    edits.append(LETTER[x])
                    new.append(None if x == "D" else roles[i] if x == "K" else ROLES[x.lower()])
            keep = pa.array(keep, pa.int64())
            yield record(schema, b.column(3).take(pa.array(src, pa.int64())), b.column(6).take(keep), b.column(4).take(keep).cast(pa.string()),
                         b.column(5).take(keep).cast(pa.string()).fill_null(""), seqs, faults, edits, new)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           held: int = HELD) -> DataFrame:
    """One row for each edit: conv, turn, role and text (what was there), seq
    (its place in the conversation), fault, edit (K, R, D or I) and new_role
    (null where deleted).  The repaired conversation is new_role and text of the
    rows that are not deleted, by seq.

    Keeping a row is free, giving it another role costs 1, deleting it 2, an
    empty inserted turn 5, and a truncated row that stays 5; blank and duplicate
    rows are deleted.  Of the cheapest ways the one whose letters come first.
    Rows go by turn, nulls first; within a turn by role, the first 32 characters
    of the text and a hash, so equal rows are neighbours and all but one of them
    duplicates.  Null roles and texts are one space, a null conversation id is an
    id like others, other columns are left out; an empty table gives none.  Roles
    are told by their first letter.  Conversations come out whole and in order
    within the partitions of the result, whatever their size."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col)
    moves = decisions(rows, held)
    kind = rows.schema["conv"].dataType
    both = (moves.select("k1", "k2", "block", "moves", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("conv", "turn", "text", *KEYS[2:])])
            .unionByName(rows.select("*", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("moves"))))
    ordered = both.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("block").asc_nulls_last(), *KEYS[2:])
    out = T.StructType([T.StructField("conv", kind)])
    for name, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("seq", "long"), ("fault", "string"), ("edit", "string"), ("new_role", "string")):
        out.add(name, t)
    return ordered.select("k1", "k2", "moves", "conv", "role", "text", "turn").mapInArrow(_forward, out)


# --- a conversation's counts ------------------------------------------------------------

class Count:
    """What one conversation's edits amount to; texts pass through the hash and are not kept."""

    def __init__(self):
        self.sha, self.sep, self.audit, self.last = hashlib.sha256(), b"", [], None
        self.low = self.high = self.at = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS[1:], 0)

    def add(self, turn, role, text, fault, edit, new) -> None:
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.at:
                self.low = turn if self.low is None else self.low
                self.high = self.at = turn
                self.turns += 1
            first = role[:1]
            self.illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
            self.last = first
            if fault:
                self.faults[fault] += 1
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (CUT_SHORT if fault == "truncated" and edit != "D" else 0)
        if edit != "D":
            self.sha.update(self.sep + f"{new}:{text}".encode())
            self.sep = b"\n"

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def report(edits: DataFrame) -> DataFrame:
    """conv and ``COUNTS`` of each conversation, from the rows of ``repair`` as
    they come (whole conversations, in order; not after another shuffle).  The
    hash of a conversation is one sequence of bytes: its rows stream through one
    task, none is held."""
    kind = edits.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind)])
    for c in COUNTS:
        schema.add(c, "string" if c in ("audit", "repaired_sha256") else "long")

    def run(batches):
        conv, now = None, None
        for b in batches:
            ids, rows = [], []
            for i, (turn, role, text, seq, fault, edit, new) in enumerate(zip(*[b.column(j).to_pylist() for j in range(1, 8)])):
                if seq == 1:
                    if now is not None:
                        ids.append(conv)
                        rows.append(now.row())
                    conv, now = b.column(0).slice(i, 1), Count()
                now.add(turn, role, text, fault, edit, new)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, zip(*rows))], names=["conv", *COUNTS])
        if now is not None:
            yield pa.RecordBatch.from_arrays([conv, *map(pa.array, zip(now.row()))], names=["conv", *COUNTS])

    return edits.mapInArrow(run, schema)


# --- the query's damage -------------------------------------------------------------------

def damage(df: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with faults dealt by a checksum of
    ``conv_id:turn``: of 20 cases one drops the row, one empties its text, one
    takes its sentence ends, one repeats it and one makes it a user's.  Nulls
    count as one space (a null id or turn stays null)."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
                  (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("case"))
    d = d.where(F.col("case") != 0).select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return d.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def digest(conversations: DataFrame) -> DataFrame:
    """Every conversation's counts after damage and repair; one without rows left has zeros."""
    got = report(repair(damage(conversations))).withColumnRenamed("conv", "__conv")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(got, ids["conv_id"].eqNullSafe(got["__conv"]), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c in COUNTS])
