"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: words between ASCII white space of the A-Z-folded text, shingles
of ``SHINGLE`` words with repeats (the whole sequence if there are fewer), XXH64
with seed 42 of each, and bit b set if it is set in over half of the hashes.  A text
without words has fingerprint zero.

Links: two fingerprints that differ in at most two bits.  Equal ones are grouped
first, so the index holds different fingerprints only.

* Upper nodes are masked bit patterns.  Two fingerprints at distance two or less agree on one
  of three blocks of 21 or 22 bits, so three masks deal each fingerprint to three nodes and no link
  is lost.  A node of more than ``NODE_LIMIT`` fingerprints is divided by the six masks of two of four
  blocks of the bits that are still free, and once more in the same way: what is left
  has 13 free bits, so 8,192 fingerprints at most, whatever the input.
* Below a node, of whatever size, fingerprints stand by Gray rank in leaves of ``FAN`` and the leaves
  in a tree.  A tree node keeps the pattern of the bits that its members share; a search starts at the root, adds up
  the differences in the bits that are new on each level and prunes a whole group when they exceed
  two.  Every link comes out of this descent.

A node reports links as (fingerprint, smallest fingerprint it is joined with), not
as pairs.  Connected components follow by hooking to the smallest neighbour and
shortcutting, each round written to the shared checkpoint folder.

Defined results: null texts count as empty; repeated rows and ties carry the same
component; a row with a null doc_id takes part, the component id is the smallest
non-null id (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.llm.common import fresh, stored

SHINGLE, MAX_BITS = 3, 2
NODE_LIMIT, FAN = 20_000, 32

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: Column) -> Column:
    """The fingerprint as a (signed) bigint."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))

    return run(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(bits: list[int]) -> list[int]:
    """Masks of two of four equal blocks of the given bits, as signed 64-bit numbers."""
    n = len(bits) // 4
    parts = [sum(1 << b for b in bits[i * n : (i + 1) * n]) for i in range(4)]
    return [_signed(a | b) for a, b in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# Two fingerprints that differ in two bits agree on one of three blocks, and on two of four blocks of what is left.
LEVEL_1 = [_signed(sum(1 << b for b in range(x, y))) for x, y in ((0, 22), (22, 43), (43, 64))]


def _finer(masks: list[int]) -> dict[int, list[int]]:
    """The masks that divide a node of each mask further."""
    return {m: [_signed((m | s) & (1 << 64) - 1) for s in _masks([b for b in range(64) if not m >> b & 1])] for m in masks}


LEVEL_2 = _finer(LEVEL_1)
LEVEL_3 = _finer([m for subs in LEVEL_2.values() for m in subs])


def _under(masks: Column) -> Column:
    """A row per mask: (mask, pattern of the fingerprint under it)."""
    return F.explode(F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("pattern"))))


def upper_nodes(fps: DataFrame) -> DataFrame:
    """(mask, pattern, fp) for every upper node with two fingerprints or more."""
    rows = fps.select("fp", _under(F.array(*[F.lit(m) for m in LEVEL_1])).alias("n")).select("fp", "n.*")
    out = None
    for finer in (LEVEL_2, LEVEL_3, None):
        sizes = rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        rows = rows.join(sizes, ["mask", "pattern"])
        done = (rows.filter(F.col("size") <= NODE_LIMIT) if finer else rows).select("mask", "pattern", "fp")
        out = done if out is None else out.unionByName(done)
        if finer:
            below = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(m), F.array(*[F.lit(s) for s in subs]))])
            large = rows.filter(F.col("size") > NODE_LIMIT)
            rows = large.select("fp", _under(F.element_at(below, F.col("mask"))).alias("n")).select("fp", "n.*")
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayForest:
    """The trees below many upper nodes: level 0 are the fingerprints by node and Gray rank, each next level groups
    up to ``FAN`` neighbours of one node, until a node is one group.  A group keeps the pattern that its members share."""

    def __init__(self, node: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), node))
        self.fps, node = fps[self.order], node[self.order]
        both, some = self.fps, self.fps  # AND and OR of the members
        self.pattern, self.shared, self.begin, self.up = [both], [np.full(len(both), ~np.uint64(0))], [], []
        while True:
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.empty(0, np.int64)
            inside = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
            if len(self.begin) and len(first) == len(node):
                break  # every tree has one root
            new = np.flatnonzero(inside % FAN == 0)
            self.up.append(np.cumsum(inside % FAN == 0) - 1)
            self.begin.append(np.append(new, len(node)))
            if not len(node):
                break
            both, some, node = np.bitwise_and.reduceat(both, new), np.bitwise_or.reduceat(some, new), node[new]
            self.pattern.append(both)
            self.shared.append(~(both ^ some))  # bits on which all members agree
        self.visits = 0

    def search(self, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position of ``at``, position) within ``bits`` below one upper node, each fingerprint searched from the root of its tree."""
        group = at
        for up in self.up:
            group = up[group]
        q, seen, spent = at, None, np.zeros(len(at), np.int64)
        for level in range(len(self.pattern) - 1, -1, -1):
            new = self.shared[level][group]
            if seen is not None:
                new = new & ~seen
            self.visits += len(group)
            # Differences add up on the way down; a group whose shared bits differ too often goes as a whole.
            spent = spent + np.bitwise_count((self.fps[q] ^ self.pattern[level][group]) & new)
            keep = spent <= bits
            q, group, spent = q[keep], group[keep], spent[keep]
            if level:
                begin, end = self.begin[level - 1][group], self.begin[level - 1][group + 1]
                n = end - begin
                seen = np.repeat(self.shared[level][group], n)
                q, spent = np.repeat(q, n), np.repeat(spent, n)
                group = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return q, group


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position joined with each of ``n`` positions by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


QUERIES, PAIRS = 8192, 1 << 20  # fingerprints searched and pairs held at a time


def links_below(node: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links below upper nodes as (fingerprint, the first of its node in Gray order that it is joined with).

    Every link comes out of the descent: all members are searched in the tree of their node.
    """
    forest = GrayForest(node, fps)
    root, found, n = np.arange(len(fps)), [], 0

    def joined() -> None:
        a, b = (np.concatenate(x) for x in zip(*found))
        a, b = root[a], root[b]
        own, places = np.unique(np.concatenate((a, b)), return_inverse=True)
        least = np.arange(len(root))
        least[own] = own[_roots(len(own), places[: len(a)], places[len(a) :])]
        root[:] = least[root]
        found.clear()

    for i in range(0, len(fps), QUERIES):
        q, m = forest.search(np.arange(i, min(i + QUERIES, len(fps))), bits)
        apart = q > m
        found.append((q[apart], m[apart]))
        n += int(apart.sum())
        if n > PAIRS:
            joined()
            n = 0
    if n:
        joined()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return forest.fps[linked], forest.fps[root[linked]]


def node_links(it: Iterator[pd.DataFrame], bits: int = MAX_BITS) -> Iterator[pd.DataFrame]:
    """Links of all upper nodes of a partition that is sorted by node.  Holds one node at a time."""
    held = None
    for pdf in it:
        m, p, f = (pdf[c].to_numpy(np.int64) for c in ("mask", "pattern", "fp"))
        if held is not None:
            m, p, f = (np.concatenate(x) for x in zip(held, (m, p, f)))
        starts = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (p[1:] != p[:-1]))))
        last = starts[-1]
        held = (m[last:], p[last:], f[last:])
        yield from _links_of(starts[:-1], starts[1:], f, bits)
    if held is not None:
        yield from _links_of(np.array([0]), np.array([len(held[2])]), held[2], bits)


def _links_of(begin: np.ndarray, end: np.ndarray, f: np.ndarray, bits: int) -> Iterator[pd.DataFrame]:
    if len(begin):
        node = np.repeat(np.arange(len(begin)), end - begin)
        a, b = links_below(node, f[begin[0] : end[-1]].view(np.uint64), bits)
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b), a > b: links between different fingerprints that join all at distance ``MAX_BITS`` or less."""
    nodes = upper_nodes(fps).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    raw = nodes.select("mask", "pattern", "fp").mapInPandas(node_links, "a bigint, b bigint")
    return raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint joined with each linked one.

    Each round, every vertex tells its neighbours and its own root the smallest label it sees, then labels
    are replaced by their labels' roots; the number of rounds is logarithmic in practice.
    """
    edges = stored(links, "simhash-links")
    while True:
        # Large star, then small star: every vertex hooks its larger, then its smaller neighbours to the least one.
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "v")
        large = (
            near.join(least, near["a"] == least["v"])
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        large = stored(large, "simhash-large")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        hooked = large.join(low, large["a"] == low["v"])
        small = (
            hooked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        small = stored(small, "simhash-small")
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return small.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "fp")
        edges = small


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp bigint, root (smallest fingerprint of the component), component_id for every row of ``docs``."""
    marked = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint(F.col("text")).alias("fp")), "simhash-fps")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(fingerprint_links(classes.select("fp")))
    rooted = stored(
        classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each component: one of its smallest doc_id,
    or one without an id if no row of it has one."""
    groups = stored(near_duplicates(docs), "simhash-groups")
    counts = groups.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, own, root = (fresh(docs, f"_glean_{x}") for x in ("id", "fp", "root"))
    if counts["n"] == counts["d"]:
        return docs.join(keep.select(F.col("doc_id").alias(key)), docs["doc_id"].cast("bigint") == F.col(key), "left_semi")
    # Ids repeat or are null: rows of one id are told apart by their fingerprints.
    named = keep.select(F.col("doc_id").alias(key), F.col("fp").alias(own), F.col("root").alias(root)).distinct()
    mine = f"{own}_"
    marked = docs.withColumn(mine, fingerprint(F.col("text")))
    rows = marked.join(named, marked["doc_id"].cast("bigint").eqNullSafe(named[key]) & (marked[mine] == named[own]))
    return rows.dropDuplicates([root]).select(*[docs[c] for c in docs.columns])
