"""Packing documents into token windows: bounded-space online best fit.

A document becomes its token ids and one end id.  Whole windows of ``WINDOW`` ids are
cut off it as long as it is longer than one; what remains is placed online: every task
keeps ``OPEN`` windows, puts a piece into the one it fills best, and when none has room
emits the fullest.  If that one still has a gap of ``LEAST_CUT`` ids or more, the head of the piece
fills it, so no window leaves with a larger gap while pieces still come.

What is open at the end of a task is merged: the pieces of ``FAN`` tasks each meet in one
task of the next round and are packed in the same way, the longest first, until one task
is left.  Its windows are filled up by cutting, and the last one is cut at powers of
two, which need no padding.  A round holds at most FAN * OPEN windows a task, whatever the
input; the rows of every round are written before the next one reads them.

Tokens.  The vocabulary divides at white space, so the ids of a text are those of its
words between U+0020 and U+0009..U+000D.  Each task keeps the ids of the words it has met (up to
``KNOWN_WORDS``, then it starts afresh) and gives the library only new words.  Strings of
special tokens in a text are ordinary text.

Defined results: null and empty texts are the end id alone; repeated rows are packed
each for itself; only doc_id and text are read, so extra columns may have any name; a very
long text is read in stretches of ``STRETCH`` bytes and its ids are held two bytes each.
Sequence ids are unique, not gapless: round, task and number.  Which pieces share a sequence depends
on how the input is dealt into tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.llm.common import stored

WINDOW, END_ID = 2048, 1
OPEN, LEAST_CUT, FAN = 64, 64, 64
KNOWN_WORDS, STRETCH, TOGETHER = 1 << 20, 1 << 20, 1 << 17
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Known(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Words:
    """Ids of texts by way of the ids of their words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as 16 bits")
        self._clear()

    def _clear(self) -> None:
        self._known = _Known()
        self._flat = np.empty(1 << 16, np.uint16)
        self._ends = np.zeros(1 << 16, np.int64)
        self._used = 0

    def _learn(self) -> None:
        new, self._known.new = self._known.new, []
        encoded = self._tokenizer.encode(
            [w.decode("utf-8", "surrogatepass") for w in new], is_pretokenized=True, add_special_tokens=False
        )
        ids = np.array(encoded.ids, np.uint16)
        of = np.array([-1 if i is None else i for i in encoded.word_ids], np.int64)
        ends = self._used + np.cumsum(np.bincount(of, minlength=len(new)))
        first = len(self._known) - len(new)
        if self._used + len(ids) > len(self._flat):
            self._flat = np.resize(self._flat, 2 * (self._used + len(ids)))
        if first + len(new) + 1 > len(self._ends):
            self._ends = np.resize(self._ends, 2 * (first + len(new) + 1))
        self._flat[self._used : self._used + len(ids)] = ids
        self._ends[first + 1 : first + 1 + len(new)] = ends
        self._used += len(ids)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids up to and with each word)."""
        if len(self._known) > KNOWN_WORDS:
            self._clear()
        at = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        if self._known.new:
            self._learn()
        begin = self._ends[at]
        length = self._ends[at + 1] - begin
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        return self._flat[np.repeat(begin - upto + length, length) + np.arange(total)], upto


def stretches(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` cut at white space into parts of about ``size`` bytes."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def tokenised(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids with the end id) of the rows of a batch, many short texts at a time."""
    waiting: list[tuple[object, int]] = []
    gathered: list[bytes] = []

    def flush() -> Iterator[tuple[object, np.ndarray]]:
        ids, upto = words.ids(gathered)
        begin = 0
        for doc_id, n in waiting:
            end = int(upto[n - 1]) if n else 0
            yield doc_id, np.append(ids[begin:end], np.uint16(END_ID))
            begin = end
        waiting.clear()
        gathered.clear()

    for doc_id, text in zip(batch.column(0), batch.column(1)):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if len(raw) > STRETCH:
            yield from flush()
            parts = [words.ids(part.split())[0] for part in stretches(raw, STRETCH)]
            yield doc_id.as_py(), np.concatenate([*parts, np.array([END_ID], np.uint16)])
            continue
        gathered += raw.split()
        waiting.append((doc_id.as_py(), len(gathered)))
        if len(gathered) >= TOGETHER:
            yield from flush()
    yield from flush()


class Piece:
    """Ids ``start`` .. of a document of ``total`` ids."""

    __slots__ = ("doc_id", "start", "ids", "total")

    def __init__(self, doc_id: object, start: int, ids: np.ndarray, total: int) -> None:
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.total), Piece(self.doc_id, self.start + n, self.ids[n:], self.total)


class Packer:
    """Best fit with at most ``open_windows`` windows; ``add`` gives the windows that are done."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN, least_cut: int = LEAST_CUT) -> None:
        self.window, self.open_windows, self.least_cut = window, open_windows, least_cut
        self._gaps: list[tuple[int, int]] = []  # (free ids, number) of the open windows, ascending
        self._held: dict[int, list[Piece]] = {}
        self._next = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.window:
            whole, piece = piece.cut(self.window)
            yield [whole]
        while len(piece.ids):
            at = bisect_left(self._gaps, (len(piece.ids), -1))
            if at < len(self._gaps):
                gap, name = self._gaps.pop(at)
                self._held[name].append(piece)
                yield from self._keep(gap - len(piece.ids), name)
                return
            if len(self._gaps) < self.open_windows:
                self._next += 1
                self._held[self._next] = [piece]
                yield from self._keep(self.window - len(piece.ids), self._next)
                return
            gap, name = self._gaps.pop(0)
            full = self._held.pop(name)
            if gap >= self.least_cut:
                head, piece = piece.cut(gap)
                full.append(head)
            yield full

    def _keep(self, gap: int, name: int) -> Iterator[list[Piece]]:
        if gap:
            insort(self._gaps, (gap, name))
        else:
            yield self._held.pop(name)

    def rest(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        return [self._held[name] for _, name in self._gaps]


def filled(windows: list[list[Piece]], window: int) -> Iterator[list[Piece]]:
    """The windows' pieces in a row, cut into whole windows; the end is cut at powers of two."""
    left = sum(len(p.ids) for w in windows for p in w)
    room = 0
    out: list[Piece] = []
    for piece in (p for w in windows for p in w):
        while len(piece.ids):
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
            head, piece = piece.cut(room)
            out.append(head)
            room -= len(head.ids)
            left -= len(head.ids)
            if not room:
                yield out
                out = []


ROW = (
    "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary, open boolean"
)


def _rows(done: Iterable[tuple[list[Piece], bool]], base: int, kind: pa.DataType, with_ids: bool, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of windows; open ones carry their ids to the next round."""
    cols: list[list] = [[] for _ in range(9)]

    def batch() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.binary(), pa.bool_()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ROW.split(", ")])

    for number, (pieces, is_open) in enumerate(done):
        offset = 0
        for p in pieces:
            raw = p.ids.astype("<u4").tobytes()
            row = (p.doc_id, p.start, len(p.ids), zlib.crc32(raw), p.total, base + number, offset, raw if is_open or with_ids else None, is_open)
            for c, v in zip(cols, row):
                c.append(v)
            offset += len(p.ids)
        if len(cols[0]) >= at_once:
            yield batch()
            cols = [[] for _ in range(9)]
    yield batch()


def _base(round_: int) -> int:
    return (round_ << 56) | (TaskContext.get().partitionId() << 32)


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids (uint32)."""
    arrow = pa.int64() if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") else pa.string()
    kind = "bigint" if arrow == pa.int64() else "string"
    schema = ROW.format(kind=kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows():
            words, packer = _words(path), Packer(window)
            for batch in batches:
                for doc_id, ids in tokenised(batch, words):
                    for done in packer.add(Piece(doc_id, 0, ids, len(ids))):
                        yield done, False
            for left in packer.rest():
                yield left, True

        yield from _rows(windows(), _base(0), arrow, with_ids)

    def merge(round_: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def windows():
                pieces = [
                    Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
                    for batch in batches
                    for r in batch.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist()
                ]
                packer = Packer(window)
                for piece in sorted(pieces, key=lambda p: -len(p.ids)):
                    for done in packer.add(piece):
                        yield done, False
                if last:
                    for done in filled(packer.rest(), window):
                        yield done, False
                else:
                    for left in packer.rest():
                        yield left, True

            yield from _rows(windows(), _base(round_), arrow, with_ids)

        return run

    rows = stored(docs.select(F.col("doc_id").cast(kind), "text").mapInArrow(first, schema), "packed")
    out, round_ = rows.filter("NOT open"), 0
    tasks = rows.filter("open").select(F.expr("shiftright(sequence_id, 32)").alias("t")).distinct().count()
    while tasks:
        tasks, round_ = -(-tasks // FAN) if tasks > 1 else 1, round_ + 1
        rows = stored(rows.filter("open").repartition(tasks).mapInArrow(merge(round_, tasks == 1), schema), "packed")
        out = out.unionByName(rows.filter("NOT open"))
        if tasks == 1:
            break
    return out.drop("open") if with_ids else out.drop("open", "ids")


_LOADED: dict[str, Words] = {}


def _words(path: str) -> Words:
    """The words a worker has met so far serve its later tasks."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]
