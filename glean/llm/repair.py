"""Repair of conversation structure by Four-Russians block tables.

A repaired conversation reads ``(system? (user assistant)+)?`` by the initials of its roles.
Edits: keep a row (0), change its role to user or assistant (3), delete it (4), insert an
empty user or assistant row (3); blank rows and rows that repeat the role and text of an
earlier one must go, truncated rows that stay cost 3 more.  The repair is the cheapest one, of equal ones
that whose initials (D, I, K, R) come first.

Four states (start, after the system row, after a user row, complete) have a cost to go
each.  From right to left a row changes this cost vector by its symbol, one of nine: the
initial (s, u, a, other) with and without truncation, or must go.  Less its minimum, the vector takes
few values, so they are numbered, and for every value and every block of ``BLOCK`` symbols a
table holds the value before the block and what the minimum grew by.  Blocks are
processed by lookup; the edits are then read from left to right, each block
expanded backward from the value on its right, so that every choice between equally
cheap edits is seen.

A conversation may hold a large share of all rows.  Rows get their place by balanced prefix
sums, and stretches of ``STRETCH`` rows are the unit of work: each gives its transition for every
value, a pass over these short rows from right to left gives each stretch the value on its
right, each stretch then reads its edits for the four states it may begin in, and a pass from
left to right takes the right one.  Both passes hold one row at a time.

Defined results: rows stand by turn (nulls first), then role, hash of the text; a null conv_id is a
conversation like any other; null roles and texts count as one space; rows without any non-space
character are blank; conversations all of whose rows go are repaired to nothing; only conv_id,
turn, role and text are read, so extra columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.llm.common import stored
from glean.operators.ordered import ordinal

START, SYSTEM, USER, DONE = range(4)
NEXT = (USER, USER, DONE, USER)  # after a user or assistant row, whichever may stand there
ENTERS = ("user", "user", "assistant", "user")  # the role of that row
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
GONE, SYMBOLS, BLOCK, STRETCH = 8, 9, 4, 4096
FINE, CUT, REPEATED, BLANK = range(4)  # faults of a row; its code is 4 * initial + fault
_SPACES = " \t\n\x0b\x0c\r"


def _keeps(state: int, symbol: int) -> int | None:
    """The state after a row that is kept, or None."""
    if symbol == GONE:
        return None
    initial = symbol // 2
    if initial == 0:
        return SYSTEM if state == START else None
    return NEXT[state] if initial == (2 if state == USER else 1) else None


def _with_inserts(h: list[int]) -> list[int]:
    """Costs to go if up to two rows may be inserted first (a third would only undo them)."""
    return [min(h[s], INSERT + h[NEXT[s]], 2 * INSERT + h[NEXT[NEXT[s]]]) for s in range(4)]


def _row_edits(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, state after it, cost to go with it) of a row that is not preceded by inserts, by the edits' initials."""
    out = [("D", state, DELETE + after[state])]
    if symbol != GONE:
        more = TRUNCATED * (symbol % 2)
        kept = _keeps(state, symbol)
        if kept is not None:
            out.append(("K", kept, more + after[kept]))
        out.append(("R", NEXT[state], REROLE + more + after[NEXT[state]]))
    return out


class Tables:
    """The values of the cost vector and their transitions by symbol and by block."""

    def __init__(self, block: int = BLOCK) -> None:
        end = tuple(_with_inserts([0, 10**6, 10**6, 0]))
        self.values, step, add = [end], [], []
        number = {end: 0}
        for after in self.values:  # grows while it is read
            to, by = [], []
            for symbol in range(SYMBOLS):
                before = _with_inserts([min(c for _, _, c in _row_edits(after, symbol, s)) for s in range(4)])
                least = min(before)
                value = tuple(c - least for c in before)
                if value not in number:
                    number[value] = len(self.values)
                    self.values.append(value)
                to.append(number[value])
                by.append(least)
            step.append(to)
            add.append(by)
        self.block = block
        self.steps = [(np.array(step, np.int16), np.array(add, np.int64))]  # by blocks of 1, 2, ... symbols
        for _ in range(block - 1):
            to, by = self.steps[-1]
            one, plus = self.steps[0]
            # The block's first symbol is processed last.
            self.steps.append((one[to].transpose(0, 2, 1).reshape(len(to), -1), (by[:, None, :] + plus[to].transpose(0, 2, 1)).reshape(len(to), -1)))
        self.reads = {
            (v, symbol, s): self._read(self.values[v], self.values[step[v][symbol]], add[v][symbol], symbol, s)
            for v in range(len(self.values))
            for symbol in range(SYMBOLS)
            for s in range(4)
        }

    @staticmethod
    def _read(after: tuple[int, ...], before: tuple[int, ...], added: int, symbol: int, state: int) -> tuple[str, int]:
        """The least of the cheapest edits up to and with one row, and the state after it."""
        text = ""
        while True:
            options = {edit: to for edit, to, cost in _row_edits(after, symbol, state) if cost == before[state] + added}
            if "D" in options:
                return text + "D", state
            if INSERT + before[NEXT[state]] == before[state]:
                text, state = text + "I", NEXT[state]
                continue
            edit = min(options)
            return text + edit, options[edit]

    def blocks(self, symbols: np.ndarray) -> list[tuple[int, int, int]]:
        """(length, code, begin) of the blocks of a stretch, from left to right; the first may be short."""
        out, first = [], len(symbols) % self.block
        weights = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        if first:
            out.append((first, int(symbols[:first] @ weights[self.block - first :]), 0))
        codes = symbols[first:].reshape(-1, self.block) @ weights
        return out + [(self.block, int(c), first + i * self.block) for i, c in enumerate(codes)]

    def through(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every value on the right of a stretch: the value on its left and the growth of the minimum."""
        at = np.arange(len(self.values), dtype=np.int16)
        total = np.zeros(len(at), np.int64)
        for n, code, _ in reversed(self.blocks(symbols)):
            to, by = self.steps[n - 1]
            total += by[at, code]
            at = to[at, code]
        return at, total

    def trace(self, symbols: np.ndarray, right: int) -> tuple[list[str], list[int]]:
        """The edits of a stretch and the state after it, for each state before it."""
        blocks = self.blocks(symbols)
        rights = []  # the value on the right of each block
        for n, code, _ in reversed(blocks):
            rights.append(right)
            right = int(self.steps[n - 1][0][right, code])
        one = self.steps[0][0]
        texts, states = [[] for _ in range(4)], list(range(4))
        for (n, _, begin), value in zip(blocks, reversed(rights)):
            inside = [value]
            for symbol in symbols[begin + n - 1 : begin : -1] if begin else symbols[n - 1 : 0 : -1]:
                inside.append(int(one[inside[-1], symbol]))
            for symbol, after in zip(symbols[begin : begin + n].tolist(), reversed(inside)):
                for k in range(4):
                    text, states[k] = self.reads[after, symbol, states[k]]
                    texts[k].append(text)
        return ["".join(t) for t in texts], states


TABLES = Tables()
TAIL = ("", "II", "I", "")  # inserts after the last row, by state


def _symbols(codes: np.ndarray) -> np.ndarray:
    fault = codes % 4
    return np.where(fault >= REPEATED, GONE, codes // 4 * 2 + fault).astype(np.int64)


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``pos`` from 0 in each conversation and ``code``, stored."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may be many: ranges can part them
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("_tie")]
    placed = ordinal(spread, "conv_id", order, "pos").withColumn("pos", F.col("pos") - 1).drop("_tie")
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    placed = stored(placed.withColumn("same", same), "placed")
    firsts = placed.groupBy("conv_id", "same").agg(F.min("pos").alias("p")).select(F.col("conv_id").alias("c"), "p", F.lit(True).alias("first"))
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = (
        F.when(end == "", BLANK)
        .when(F.col("first").isNull(), REPEATED)
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(FINE)
    )
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    found = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")), "left")
    return stored(found.select("conv_id", "turn", "role", "text", "pos", (initial * 4 + fault).cast("int").alias("code")), "coded")


def _streamed(df: DataFrame, order: Column, step: Callable, schema: str) -> DataFrame:
    """``step(rows)`` over the rows of each conversation in ``order``, one row at a time; it yields tuples.

    ``step`` gets an iterator of (is it the first row of a conversation, row as a dict).
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([pa.field(n, _ARROW[c.split(" ", 1)[1]]) for n, c in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last = object()
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["conv_id"] != last, row
                    last = row["conv_id"]

        out = []
        for made in step(rows()):
            out.append(dict(zip(names, made)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "int": pa.int32(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def _backward(rows: Iterator) -> Iterator[tuple]:
    """The value on the right of each stretch, last stretch first; the first stretch carries the cost of all."""
    value = cost = 0
    for new, r in rows:
        if new:
            value = cost = 0
        right, cost = value, cost + r["add"][value]
        value = r["to"][value]
        yield r["conv_id"], r["part"], right, cost + TABLES.values[value][START] if r["part"] == 0 else 0


def _forward(stretch: int, rows: Iterator) -> Iterator[tuple]:
    """The edits of each stretch for the state it begins in, with the rows they stand for."""
    held = state = before = None

    def made(last: bool) -> tuple:
        text = held["texts"][state] + (TAIL[held["states"][state]] if last else "")
        base, s = held["part"] * stretch, state
        rows, becomes, at = [], [], base
        for edit in text:
            rows.append(None if edit == "I" else at)
            becomes.append(ENTERS[s] if edit in "IR" else None)
            if edit != "I":
                at += 1
            if edit != "D":
                # Only a kept row at the start can be the system row.
                s = SYSTEM if edit == "K" and s == START and held["systems"][at - 1 - base] else NEXT[s]
        wrong = held["illegal"] + (before is not None and (before, held["first"]) not in _LEGAL)
        return held["conv_id"], held["part"], text, rows, becomes, wrong

    for new, r in rows:
        if held is not None:
            yield made(new)
            state, before = (START, None) if new else (held["states"][state], held["last"])
        else:
            state, before = START, None
        held = r | {"systems": [c // 4 == 0 for c in r["codes"]]}
    if held is not None:
        yield made(True)


_LEGAL = {(0, 1), (1, 2), (2, 1)}  # initials s u, u a, a u


def edits(placed: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(stretches, conversations' stretch statistics) of rows with ``pos`` and ``code``.

    The first has conv_id, part, audit, rows and becomes (arrays, one entry for each edit) and illegal, the second conv_id,
    cost, blank, duplicate and truncated.
    """
    fault = F.col("code") % 4
    counts = [F.sum((fault == k).cast("long")).alias(n) for n, k in (("blank", BLANK), ("duplicate", REPEATED), ("truncated", CUT))]
    codes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes")
    part = F.floor(F.col("pos") / stretch).cast("bigint").alias("part")
    parts = stored(placed.groupBy("conv_id", part).agg(codes, *counts), "stretches")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [TABLES.through(_symbols(np.array(c))) for c in b.column(2).to_pylist()]
            to, add = pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), pa.array([f[1].tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), to, add], names=["conv_id", "part", "to", "add"])

    key = placed.schema["conv_id"].dataType.simpleString()
    moved = parts.select("conv_id", "part", "codes").mapInArrow(maps, f"conv_id {key}, part bigint, to array<int>, add array<bigint>")
    rights = stored(_streamed(moved, F.col("part").desc(), _backward, f"conv_id {key}, part bigint, right int, cost bigint"), "values")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, states, ends = [], [], []
            for codes, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                codes = np.array(codes)
                t, s = TABLES.trace(_symbols(codes), right)
                initial = (codes // 4).tolist()
                texts.append(t)
                states.append(s)
                ends.append((initial[0], initial[-1], sum(x not in _LEGAL for x in zip(initial, initial[1:]))))
            made = [pa.array(texts, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))]
            made += [pa.array([e[i] for e in ends], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["conv_id", "part", "codes", "texts", "states", "first", "last", "illegal"])

    r = rights.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "right")
    joined = parts.join(r, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    schema = f"conv_id {key}, part bigint, codes array<int>, texts array<string>, states array<int>, first int, last int, illegal int"
    traced = joined.select("conv_id", "part", "codes", "right").mapInArrow(traces, schema)
    schema = f"conv_id {key}, part bigint, audit string, rows array<bigint>, becomes array<string>, illegal int"
    out = stored(_streamed(traced, F.col("part"), partial(_forward, stretch), schema), "edits")
    sums = parts.select("conv_id", F.lit(0).cast("long").alias("cost"), "blank", "duplicate", "truncated")
    costs = rights.select("conv_id", "cost", *[F.lit(0).cast("long").alias(n) for n in ("blank", "duplicate", "truncated")])
    return out, sums.unionByName(costs)


def repaired(placed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (ascending), edit (K, R or I), role, text."""
    each = found.select("conv_id", "part", "audit", F.posexplode(F.arrays_zip("rows", "becomes")).alias("k", "e"))
    each = each.select(
        F.col("conv_id").alias("c"),
        (F.col("part") * (1 << 32) + F.col("k")).alias("place"),
        F.expr("substring(audit, k + 1, 1)").alias("edit"),
        F.col("e.rows").alias("p"),
        F.col("e.becomes").alias("becomes"),
    ).filter("edit <> 'D'")
    rows = placed.select("conv_id", "pos", "role", "text")
    kept = each.filter("edit <> 'I'").join(rows, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("pos")))
    new = each.filter("edit = 'I'").select(F.col("c").alias("conv_id"), "place", "edit", F.col("becomes").alias("role"), F.lit("").alias("text"))
    return kept.select("conv_id", "place", "edit", F.coalesce("becomes", "role").alias("role"), "text").unionByName(new)


def _hashed(rows: Iterator) -> Iterator[tuple]:
    """The SHA-256 of each conversation's lines, updated line by line."""
    key = digest = None
    for new, r in rows:
        if new:
            if digest is not None:
                yield key, digest.hexdigest()
            key, digest = r["conv_id"], hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{r['role']}:{r['text']}".encode())
    if digest is not None:
        yield key, digest.hexdigest()


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256.  One hash over a conversation is sequential, so its lines stream through one task."""
    key = lines.schema["conv_id"].dataType.simpleString()
    return _streamed(lines.select("conv_id", "place", "role", "text"), F.col("place"), _hashed, f"conv_id {key}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the row's key calls for."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "code")
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def repair_report(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """What the query returns: a row for every conv_id, with faults, the cheapest edits and the hash of the repaired lines."""
    rows = stored(damaged(conversations), "damaged")
    placed = coded(rows)
    found, sums = edits(placed, stretch)
    zero = F.lit(0).cast("long")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def filled(df: DataFrame) -> DataFrame:
        """The columns of the report, zero where ``df`` lacks them."""
        piece = F.struct("part", "audit") if "audit" in df.columns else F.lit(None).cast("struct<part:bigint,audit:string>")
        return df.select("conv_id", *[(F.col(n) if n in df.columns else zero).cast("long").alias(n) for n in names], piece.alias("piece"))

    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), zero).alias("gaps"))
    every = filled(conversations.select("conv_id").distinct()).unionByName(filled(gaps)).unionByName(filled(sums))
    every = every.unionByName(filled(found))
    pieces = F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["audit"])
    report = every.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in names], F.array_join(pieces, "").alias("audit"))
    d = digests(repaired(placed, found)).withColumnRenamed("conv_id", "c")
    joined = report.join(d, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
