"""Benchmark decontamination by greedy string tiling.

Words (runs of letters and digits, lower-cased) of texts and benchmark items are
compared.  Seeds, runs of ``min_match`` words, join each text with the items that
share one.  For a candidate pair, running Karp-Rabin finds the longest matches
between unmarked words, marks them from the longest down without overlaps, and
goes on with shorter ones to ``min_match``.  Tiles may stand in any order, so a
reordered passage is caught.  A text is contaminated by an item if tiles cover
at least ``threshold`` of the item's words.

The benchmark is read in blocks of at most ``block_words`` words.  Each is shipped to
the executors and meets every text in a pass of its own; what the pass finds is written
and the block released before the next one, so any size of benchmark works in bounded
memory.  Documents are never shuffled.

Defined results: null or empty texts and items match nothing; an item of fewer
than ``min_match`` words matches where all its words stand together; repeated
rows and items are each reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.llm.common import stored

MIN_MATCH, THRESHOLD, BLOCK_WORDS = 4, 0.7, 1_000_000

HITS = "array<struct<item_id:bigint,coverage:double,matched_words:int,item_words:int,n_tiles:int,longest_tile:int>>"

_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _rolling(ids: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``s`` ids."""
    h = np.zeros(len(ids) - s + 1, np.uint64)
    for i in range(s):
        h = h * np.uint64(0x100000001B3) + ids[i : i + len(h)]
    return h ^ (h >> np.uint64(29))


def _free_windows(free: np.ndarray, s: int) -> np.ndarray:
    """Begins of the windows of ``s`` unmarked words."""
    run = np.concatenate(([0], np.cumsum(~free)))
    return np.flatnonzero(run[s:] == run[:-s]) if len(free) >= s else np.empty(0, np.int64)


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays (uint64; 0 in ``text``: not a word of the benchmark).

    Returns (begin in item, begin in text, length) of the tiles, longest first; ties in item, then text order.
    """
    free_a, free_b = np.ones(len(item), bool), text != 0
    tiles: list[tuple[int, int, int]] = []
    s = len(item)
    while s >= min_match:
        matches = []
        begins_a = _free_windows(free_a, s)
        begins_b = _free_windows(free_b, s)
        if len(begins_a) and len(begins_b):
            by_hash = defaultdict(list)
            hash_a, hash_b = _rolling(item, s), _rolling(text, s)
            for i in begins_a.tolist():
                by_hash[int(hash_a[i])].append(i)
            known = np.fromiter(by_hash, np.uint64, len(by_hash))
            for j in begins_b[np.isin(hash_b[begins_b], known)].tolist():
                for i in by_hash[int(hash_b[j])]:
                    if np.array_equal(item[i : i + s], text[j : j + s]):
                        matches.append((i, j))
        for i, j in sorted(matches):
            if free_a[i : i + s].all() and free_b[j : j + s].all():
                free_a[i : i + s] = False
                free_b[j : j + s] = False
                tiles.append((i, j, s))
        if not matches:
            # No match of s words: shorter windows, in steps that end at the longest remaining match.
            s = min(s - 1, _longest(item, text, free_a, free_b, s, min_match))
        else:
            s -= 1
    return tiles


def _longest(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int, min_match: int) -> int:
    """Length of the longest common run of unmarked words below ``s``, by bisection over Karp-Rabin windows; 0 if none."""
    low, high, found = min_match, s - 1, 0
    while low <= high:
        mid = (low + high) // 2
        x, y = _free_windows(free_a, mid), _free_windows(free_b, mid)
        if len(x) and len(y) and np.isin(_rolling(a, mid)[x], _rolling(b, mid)[y]).any():
            found, low = mid, mid + 1
        else:
            high = mid - 1
    return found


class Tester:
    """One block of the benchmark, ready to meet texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int, threshold: float):
        self.min_match, self.threshold = min_match, threshold
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds = []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.uint64)
            if not len(ids):
                continue
            k, s = len(self.items), min(min_match, len(ids))
            self.items.append((item_id, ids))
            seeds += [(s, int(h), k, i) for i, h in enumerate(_rolling(ids, s))]
        self.seeds = {}  # seed length -> sorted hashes, and the (item, begin) of each
        for s in {x[0] for x in seeds}:
            own = sorted(x[1:] for x in seeds if x[0] == s)
            self.seeds[s] = tuple(np.array([x[c] for x in own], d) for c, d in ((0, np.uint64), (1, np.int64), (2, np.int64)))

    def test(self, text: str | None) -> list[dict]:
        get = self.vocabulary.get
        ids = np.array([get(t, 0) for t in tokens(text)], np.uint64)
        covered: dict[int, set[int]] = defaultdict(set)
        for s, (hashes, item, begin) in self.seeds.items():
            at = _free_windows(ids != 0, s)
            if not len(at):
                continue
            found = np.unique(_rolling(ids, s)[at])
            lo, hi = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for k, i in zip(item[x:y].tolist(), begin[x:y].tolist()):
                    covered[k].update(range(i, i + s))
        out = []
        for k, words in sorted(covered.items()):
            item_id, own = self.items[k]
            if len(words) < self.threshold * len(own):  # tiles lie within the seeds: no tiling can cover more
                continue
            tiles = tile(own, ids, min(self.min_match, len(own)))
            matched = sum(t[2] for t in tiles)
            if matched >= self.threshold * len(own):
                out.append(
                    {
                        "item_id": item_id,
                        "coverage": matched / len(own),
                        "matched_words": matched,
                        "item_words": len(own),
                        "n_tiles": len(tiles),
                        "longest_tile": max(t[2] for t in tiles),
                    }
                )
        return out


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Rows of the benchmark in blocks of about ``block_words`` words (one item at least)."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), "text").filter(F.col("text").isNotNull())
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(tokens(text))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((item_id, text))
        n += size
    if block:
        yield block


def passes(
    benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS
) -> Iterator[tuple[Broadcast, bool]]:
    """The blocks of the benchmark, each a shared ``Tester``, and whether it is the last."""
    context = benchmark.sparkSession.sparkContext
    block = None
    for following in chain(blocks(benchmark, block_words), [None]):
        if block is not None:
            yield context.broadcast(Tester(block, min_match, threshold)), following is None
        block = following


def hits(text: Column, tester: Broadcast) -> Column:
    """Array of ``HITS`` for each text: the items of one block that it contains."""

    @F.pandas_udf(HITS)
    def run(texts: pd.Series) -> pd.Series:
        t = tester.value
        return pd.Series([t.test(x) for x in texts], dtype=object)

    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row per document and benchmark item that it contains: doc_id and the fields of ``HITS``."""
    found = []
    for tester, last in passes(benchmark, **options):
        own = _rows(docs, hits(F.col("text"), tester))
        if not last:
            own = stored(own, "decontam-hits")
            tester.destroy()
        found.append(own)
    return reduce(DataFrame.unionByName, found) if found else _rows(docs, F.array().cast(HITS))


def _rows(docs: DataFrame, found: Column) -> DataFrame:
    return docs.select("doc_id", found.alias("h")).select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no benchmark item."""
    for tester, last in passes(benchmark, **options):
        docs = docs.filter(F.size(hits(F.col("text"), tester)) == 0)
        if not last:
            docs = stored(docs, "decontam-clean")
            tester.destroy()
    return docs
