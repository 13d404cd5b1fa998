"""Runs of repeated words by online dyadic square catching.

Words ``[^\\x20\\x09-\\x0D]+`` are appended to a :class:`Catchers`.  Every completed
block of L = 1, 2, 4, ... words at a multiple of L is a catcher.  It watches the
L words that begin 2L to 4L-1 words after it (1 to 3 for L = 1): the first half of a
square of period p holds a whole such block for the L with 2L <= p < 4L, so a square shows
itself as a block that comes again p words later.  A window is met by the two blocks of
each L that watch its place; equal prefix hashes name the candidates and the words
themselves decide.

A caught copy becomes a comparison (period, start, end): it is carried to the left as
far as words p apart agree, and every appended word carries the open ones to the right.
A comparison of two periods or more is a square; all squares of one stretch and period
are one comparison, hence one run.  A copy inside a known run whose period divides p is
left out, since p is not its smallest period then.

How the words are dealt into ``append`` calls does not change the runs; documents
are fed ``BATCH`` words at a time, so that the scratch arrays stay small.  What is held
grows with one document: its words, two numbers a word, and the open comparisons.

Defined results: null and empty texts and texts of white space have no words and no runs;
repeated rows and rows with a null doc_id give a row each; only doc_id and text are read, so
extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_EXPONENT = 24, 3
BATCH = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next text."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, np.uint64)
        have[0] = 1
        _POWERS[int(base)] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class Catchers:
    """Squares of a growing sequence of words (integers)."""

    def __init__(self) -> None:
        self.n = 0
        self._words = np.empty(256, np.int64)
        self._sums = np.zeros(257, np.uint64)  # prefix sums of mixed word * base**place
        self._open: dict[int, tuple[int, int]] = {}  # period -> (start, end) of the comparison that reaches the last word
        self._runs: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        self._grow()
        n = self.n
        self._words[before:n] = words
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= _powers(_BASE, n)[before:]
        self._sums[before + 1 : n + 1] = self._sums[before] + np.cumsum(mixed, dtype=np.uint64)
        known = {}  # period -> comparisons of this call, the last one last
        for p, (start, end) in self._open.items():
            known[p] = [(start, end + self._ahead(end - p, p))]
        size = 1
        while 3 * size <= n or (size == 1 and n > 1):
            # Multiples of a known period must be seen after it, which only matters inside the smallest size.
            for shifts in ([(1,), (2,), (3,)] if size == 1 else [(2, 3)]):
                self._catch(before, size, shifts, known)
            size *= 2
        self._open = {}
        for p, found in known.items():
            for start, end in found:
                if end == n:
                    self._open[p] = (start, end)
                elif end - start >= 2 * p:
                    self._runs.append((start, end - start, p))

    def runs(self, min_words: int = 2, min_exponent: int = 2) -> np.ndarray:
        """(start, length, period) of the runs so far, by start, then period."""
        found = self._runs + [(s, e - s, p) for p, (s, e) in self._open.items()]
        kept = [r for r in found if r[1] >= max(min_words, min_exponent * r[2], 2 * r[2])]
        return np.array(sorted(kept, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)

    def _grow(self) -> None:
        if self.n > len(self._words):
            room = max(self.n, 2 * len(self._words))
            self._words = np.resize(self._words, room)
            self._sums = np.concatenate((self._sums, np.zeros(room + 1 - len(self._sums), np.uint64)))

    def _hashes(self, at: slice | np.ndarray, end: slice | np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[at]) * _powers(_UNBASE, self.n + 1)[at]

    def _catch(self, before: int, size: int, shifts: tuple[int, ...], known: dict[int, list[tuple[int, int]]]) -> None:
        """Copies of blocks of ``size`` words in the windows that the new words complete."""
        least = shifts[0] * size
        first, last = max(least, before - size + 1), self.n - size
        if last < first:
            return
        windows = self._hashes(slice(first, last + 1), slice(first + size, last + size + 1))
        low = (first - least) // size - len(shifts) + 1  # the earliest block that watches one of them, maybe before the text
        blocks = np.arange(max(low, 0), (last - least) // size + 1) * size
        sums = self._hashes(blocks, blocks + size)
        at = np.arange(first, last + 1)
        watch = (at - least) // size
        found = []
        for back in range(len(shifts)):
            block = watch - back
            ok = block >= 0
            place = block - max(low, 0)
            hit = at[ok][sums[place[ok]] == windows[ok]]
            if len(hit):
                found.append(np.stack((hit - ((hit - least) // size - back) * size, hit)))
        if not found:
            return
        period, place = np.concatenate(found, axis=1)
        for p, comparisons in known.items():
            # A known run must reach over block, gap and copy to settle anything here.
            long = [r for r in comparisons if r[1] - r[0] >= max(2 * p, 3 * size if size > 1 else 2)]
            if long and len(period):
                starts, ends = np.array(long).T  # both ascend: runs of one period overlap by less than it
                last_before = np.searchsorted(starts, place - period, "right") - 1
                settled = (last_before >= 0) & (period % p == 0) & (place + size <= ends[last_before])
                if settled.any():
                    period, place = period[~settled], place[~settled]
        order = np.lexsort((place, period))
        for p, c in zip(period[order].tolist(), place[order].tolist()):
            b = c - p
            mine = known.get(p)
            if mine and mine[-1][0] <= b and c + size <= mine[-1][1]:
                continue
            if not np.array_equal(self._words[b : b + size], self._words[c : c + size]):
                continue
            start = b - self._behind(b, p)
            end = c + size + self._ahead(b + size, p)
            if end - start >= 2 * p or end == self.n:
                known.setdefault(p, []).append((start, end))

    def _ahead(self, i: int, p: int) -> int:
        """How many words from ``i`` on equal those ``p`` later."""
        w, step, done = self._words, 32, 0
        while (top := min(step, self.n - p - i - done)) > 0:
            a = i + done
            differ = w[a : a + top] != w[a + p : a + p + top]
            k = int(differ.argmax())
            if differ[k]:
                return done + k
            done, step = done + top, step * 4
        return done

    def _behind(self, i: int, p: int) -> int:
        """How many words before ``i`` equal those ``p`` later."""
        w, step, done = self._words, 32, 0
        while (top := min(step, i - done)) > 0:
            a = i - done
            differ = (w[a - top : a] != w[a - top + p : a + p])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                return done + k
            done, step = done + top, step * 4
        return done


def find(words: list, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of every run of at least ``min_words`` words and ``min_exponent`` periods."""
    if len(words) < max(min_words, 2):
        return np.empty((0, 3), np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < min(min_words, len(words)) * (min_exponent - 1) // min_exponent:
        return np.empty((0, 3), np.int64)  # a run repeats that many words at least
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    caught = Catchers()
    for i in range(0, len(ids), BATCH):
        caught.append(ids[i : i + BATCH])
    return caught.runs(min_words, min_exponent)


def collapse(words: list, runs: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist()) if not inside]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs array<struct<start,length,period>> by start and period, collapsed: the text with each run cut to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column(1):
                # bytes.split() divides at U+0020 and U+0009..U+000D and nowhere else.
                words = (text.as_py() or "").encode().split()
                runs = find(words, min_words, min_exponent)
                counts.append(len(words))
                found.append(runs)
                texts.append(b" ".join(collapse(words, runs)).decode())
            flat = np.concatenate([*found, np.empty((0, 3), np.int64)])
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, items), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, then the smallest start, then the smallest period; null without runs."""

    def better(a: Column, b: Column) -> Column:
        x, y = b["length"] * a["period"], a["length"] * b["period"]
        earlier = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when(a.isNull() | (x > y) | ((x == y) & earlier), b).otherwise(a)

    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), better)


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text; from some word on, the text of one document in ten repeats with one period."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("bigint").alias("g"))
    rows = rows.withColumn("ws", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("ws").cast("bigint"))  # -1 for no array
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("bigint"))
    again = F.transform(
        "ws",
        lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))),
    )
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query, from the rows of ``repeats``."""
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    top = found.withColumn("top", strongest(F.col("runs")))
    return top.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
