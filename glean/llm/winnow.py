"""Document fingerprints by winnowing.

Code points of the text without white space, ASCII letters folded, are cut
into k-grams with a polynomial hash.  Each window of ``w`` consecutive k-grams
contributes its minimum, the rightmost one on ties, and the position of the
k-gram in the text is kept.  Any match of ``w + k - 1`` or more kept code points
shares a fingerprint; matches below ``k`` are never seen.

Defined results: a text with fewer than ``k`` kept code points has one hash,
that of all of them; an empty or null text has none.  Two empty fingerprints
are alike (1.0), an empty and another one are not (0.0).  Rows of one doc_id, or without one, stand by their texts in one range,
hence in one task: it streams them and holds two texts at a time.  Only doc_id and text are read, so extra columns may
have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.plans.strategy import partitions_for

# Any 31 kept code points in common share a fingerprint.
K, WINDOW = 16, 16
MAX_RANGES = 8192  # ranges whose bounds fit into an expression; beyond them a range grows, nothing is left out
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFFFFF)


def winnow(text: str | None, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions int64) in text order; positions are code points from 0."""
    cps = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32)
    keep = np.flatnonzero((cps > 32) & (cps != 0x85) & (cps != 0xA0))
    c = cps[keep].astype(np.uint64)
    if not len(c):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    c += np.where((c >= 65) & (c <= 90), np.uint64(32), np.uint64(0))
    k = min(k, len(c))
    n = len(c) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= _BASE
        h += c[i : i + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h >>= np.uint64(32)
    # One key orders by hash and, on ties, by the later position.
    key = (h << np.uint64(32)) | (_LOW - np.arange(n, dtype=np.uint64))
    width = min(w, n)
    low, span = key, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span :])
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    at = (_LOW - (chosen & _LOW)).astype(np.int64)
    return (chosen >> np.uint64(32)).astype(np.uint32), keep[at].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<bigint>, positions array<bigint>: the selected k-grams of every text."""

    @F.pandas_udf("struct<hashes:array<bigint>,positions:array<bigint>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [winnow(t, k, w) for t in texts]
        return pd.DataFrame({"hashes": [h.astype(np.int64) for h, _ in rows], "positions": [p for _, p in rows]})

    return docs.select("doc_id", run(F.col("text")).alias("f")).select("doc_id", "f.*")


NEAR_SCHEMA = (
    "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_hashes bigint, positions array<int>"
)


def cuts_upto(x: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are ``x`` or less: first among every sqrt(n)-th of them, then in one stretch."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts))
    stretches = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def upto(xs: Column) -> Column:
        return F.size(F.filter(xs, lambda c: c <= x))

    at = upto(F.array(*[F.lit(s[0]) for s in stretches]))
    own = F.get(F.array(*[F.array(*[F.lit(c).cast("bigint") for c in s]) for s in stretches]), at - 1)
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + upto(own))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id (nulls last; ties by text), dealt in order over ranges, each
    range followed by the first row of the next one (``tail``; after the last range the first of all).

    One shuffle of the texts; the range bounds are values of doc_id, so every range has a row.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # About 128 MB a range; beyond MAX_RANGES the ranges grow, which costs a task time but no memory.
    parts = min(max(partitions_for(docs), 2), MAX_RANGES)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000).alias("b")).first()["b"]
    cuts = sorted(set(bounds or []))
    low = rows.agg(F.min("doc_id").alias("m")).first()["m"]
    cuts = [c for c in cuts if c != low]  # each range holds its own lower bound, the first one the least id
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(cuts_upto(F.col("doc_id"), cuts)).cast("int")
    rows = rows.withColumn("part", part)
    # The least id of each range in numbers first; then the texts of those few rows only.
    least = rows.groupBy("part").agg(F.min("doc_id").alias("least")).withColumnRenamed("part", "p")
    first = (
        rows.join(F.broadcast(least), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("least")))
        .groupBy("part", "doc_id")
        .agg(F.min("text").alias("text"))
    )
    tails = first.select(
        "doc_id", "text", F.pmod(F.col("part") - 1, F.lit(len(cuts) + 1)).cast("int").alias("part"), F.lit(True).alias("tail")
    )
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    return both.repartitionByRange(len(cuts) + 1, "part").sortWithinPartitions(
        "part", "tail", F.col("doc_id").asc_nulls_last(), "text"
    )


def near_next(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """For every document: its fingerprint with the places of its hashes, that of its edited text, and how near both and the next
    document's are.

    The rows stream in order through each task, which holds one row and its fingerprint from one to the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (part, doc_id, text, hashes, positions)
        for pdf in batches:
            out = []
            for part, doc_id, text, tail in zip(pdf["part"], pdf["doc_id"], pdf["text"], pdf["tail"]):
                hashes, positions = winnow(text, k, w)
                if held is not None and held[0] == part:
                    out.append(compare(held, text, hashes))
                held = None if tail else (part, doc_id, text, hashes, positions)
            yield pd.DataFrame(out, columns=_COLUMNS)

    def compare(held, after: str, after_hashes: np.ndarray) -> tuple:
        _, doc_id, text, hashes, positions = held
        new = edited(text, after)
        new_hashes = winnow(new, k, w)[0]
        return (
            doc_id,
            len(text),
            hashlib.sha256(new.encode()).hexdigest(),
            as_text(hashes),
            as_text(new_hashes),
            likeness(hashes, new_hashes),
            likeness(hashes, after_hashes),
            len(hashes),
            positions.astype(np.int32),
        )

    # Ids travel as text: pandas would turn a column of integers and nulls into floats.
    rows = with_next(docs).select("part", F.col("doc_id").cast("string").alias("doc_id"), "text", "tail")
    return rows.mapInPandas(run, NEAR_SCHEMA).withColumn("doc_id", F.col("doc_id").cast("bigint"))


_COLUMNS = [c.split()[0] for c in NEAR_SCHEMA.split(", ")]
