"""Mixing sources to target weights by the cube method.

A source of s words with target t takes every document floor(t/s) times and a balanced sample of
inclusion probability t/s - floor(t/s) once more.  Flight: probabilities of three documents at a time
move along the null-space of the two balancing constraints (words and documents taken) until one of them
is 0 or 1; a decided document makes room for the next.  Both totals stay exact.  The flight runs in
chunks of a source side by side; what the chunks leave open is dealt to fewer chunks and flies again, until
what is left of a source is one chunk.
Landing: at most ``HOLD`` + 2 open documents of a source are decided together by the choice that comes
nearest to the open words, then documents.

Chunks, order and random numbers come from hashes of doc_id, so reruns agree.  A task holds one batch of
rows and ``HOLD`` + 3 documents, however large a source is.

Defined results: null and empty texts have size 0 and are taken for 0 words; null is a source of its own;
repeated rows are decided one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glean.llm.common import WORD_PATTERN, fresh, stored

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK_ROWS, HOLD = 8192, 12
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a hash of the text, for every row."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """src (from 0 by code point, null last), source, source_size, rows, target; one row for each source.

    The fixed point of resharing the excess by weight is a common level: target = min(cap, level * weight).
    """
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    own = own.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("src") % len(WEIGHTS) + 1).cast("int")))
    own = own.withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", "src")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    own = own.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - capped) / open_weight)
    final = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "src", "level"))).over(W.partitionBy())["level"]
    return own.select("src", "source", "source_size", "rows", F.least(F.col("cap"), final * F.col("weight")).alias("target"))


class Flight:
    """Moves inclusion probabilities of units (key, size, pi, hash) through the constraints' null-space."""

    def __init__(self) -> None:
        self.open: list[list] = []

    def add(self, unit: list) -> list[list]:
        """Take in a unit; returns the units that are decided, their pi 0.0 or 1.0."""
        if unit[2] < _EPS or unit[2] > 1 - _EPS:
            unit[2] = float(round(unit[2]))
            return [unit]
        self.open.append(unit)
        return self._fly() if len(self.open) == 3 else []

    def _fly(self) -> list[list]:
        x, y, z = self.open
        u = (z[1] - y[1], x[1] - z[1], y[1] - x[1])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1, -1, 0)
        up, down = np.inf, np.inf
        for unit, step in zip(self.open, u):
            if step:
                room = (1 - unit[2]) / abs(step), unit[2] / abs(step)
                up = min(up, room[step < 0])
                down = min(down, room[step > 0])
        chance = (hash((x[3], y[3], z[3])) >> 8 & (1 << 48) - 1) / (1 << 48)
        move = up if chance * (up + down) < down else -down
        done = []
        for unit, step in zip(self.open, u):
            unit[2] += move * step
            if unit[2] < _EPS or unit[2] > 1 - _EPS:
                unit[2] = float(round(unit[2]))
                done.append(unit)
        self.open = [unit for unit in self.open if unit not in done]
        return done


def land(units: list[list]) -> None:
    """Decide the last open units of a source: the choice nearest to the open words, then documents."""
    if not units:
        return
    pi = np.array([u[2] for u in units])
    size = np.array([float(u[1]) for u in units])
    choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1).astype(float)
    words, count = np.abs(choices @ size - pi @ size), np.abs(choices.sum(axis=1) - pi.sum())
    best = choices[np.lexsort((np.arange(len(choices)), count, np.round(words, 6)))[0]]
    for u, s in zip(units, best):
        u[2] = float(s)


def _run(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
    """Flight over rows sorted by chunk.  The last ``HOLD`` units of a chunk stay open, or land if ``last``."""
    chunk, flight, held = None, Flight(), deque()

    def close() -> list[list]:
        rest = [*flight.open, *held]
        if last:
            land(rest)
        return rest

    columns = None
    for pdf in batches:
        columns = list(pdf.columns)
        out: list[list] = []
        keys = zip(pdf["src"].tolist(), pdf["chunk"].tolist())
        units = zip(pdf["size"].tolist(), pdf["pi"].tolist(), pdf["h"].tolist(), pdf.itertuples(index=False, name=None))
        for key, (size, pi, h, row) in zip(keys, units):
            if key != chunk:
                out += close()
                chunk, flight, held = key, Flight(), deque()
            held.append([row, size, pi, h])
            if len(held) > HOLD:
                out += flight.add(held.popleft())
        yield _frame(out, columns)
    if columns:
        yield _frame(close(), columns)


def _frame(units: list[list], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([u[0] for u in units], columns=columns)
    out["pi"] = [float(u[2]) for u in units]
    return out


def _flight(rows: DataFrame, last: bool) -> DataFrame:
    dealt = rows.repartition("src", "chunk").sortWithinPartitions("src", "chunk", "h", "doc_id", "size")
    return dealt.mapInPandas(lambda batches: _run(batches, last), rows.schema)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and text_hash for every row of ``docs``."""
    rows = stored(sizes(docs), "cube-sizes")
    own = stored(targets(rows), "cube-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    # Ids travel as text: pandas would turn a column of integers and nulls into floats.
    rows = (
        rows.withColumnRenamed("source", "s")
        .join(own, F.col("s").eqNullSafe(F.col("source")))
        .select(
            F.col("doc_id").cast("string").alias("doc_id"),
            "size",
            "source_size",
            "target",
            "text_hash",
            "src",
            F.pmod(F.xxhash64(F.lit(1), "doc_id", "text_hash"), F.ceil(F.col("rows") / CHUNK_ROWS)).alias("chunk"),
            F.xxhash64(F.lit(2), "doc_id", "text_hash").alias("h"),
            F.floor(ratio).cast("bigint").alias("base"),
            (ratio - F.floor(ratio)).alias("pi"),
        )
    )
    done = rows.filter("pi = 0 OR size = 0 AND source_size = 0")
    left = rows.filter("NOT (pi = 0 OR size = 0 AND source_size = 0)")
    least = max(CHUNK_ROWS, 8 * (HOLD + 2))  # a chunk leaves HOLD + 2 rows, so every round leaves an eighth at most
    while True:
        flown = stored(_flight(left, last=False), "cube-flight")
        done = done.unionByName(flown.filter("pi = 0 OR pi = 1"))
        left = flown.filter("pi > 0 AND pi < 1").drop("chunk")
        chunks = left.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / least).alias("chunks"))
        if not (chunks.agg(F.max("chunks")).first()[0] or 0) > 1:
            break
        left = left.join(chunks, "src").withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "h"), F.col("chunks"))).drop("chunks")
    done = done.unionByName(_flight(left.withColumn("chunk", F.lit(0).cast("bigint")), last=True))
    copies = F.col("base") + F.round("pi").cast("bigint")
    return done.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "text_hash"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it."""
    plan = stored(mix(docs), "cube-mix")
    counts = plan.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    n, i, h, rn = (fresh(docs, f"_glean_{x}") for x in ("copies", "id", "hash", "row"))
    keys = plan.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("copies").alias(n))
    if counts["n"] == counts["d"]:
        both = docs.join(keys.filter(F.col(n) > 0), docs["doc_id"].cast("bigint") == keys[i])
    else:
        # Ids that repeat or are null: the k-th row of an id and text meets the k-th decision for them.
        keys = keys.withColumn(rn, F.row_number().over(W.partitionBy(i, h).orderBy(F.desc(n))))
        own = docs.withColumn(f"{h}_", F.xxhash64("text"))
        own = own.withColumn(f"{rn}_", F.row_number().over(W.partitionBy("doc_id", f"{h}_").orderBy("source")))
        both = own.join(
            keys.filter(F.col(n) > 0),
            own["doc_id"].cast("bigint").eqNullSafe(keys[i]) & (own[f"{h}_"] == keys[h]) & (own[f"{rn}_"] == keys[rn]),
        )
    return both.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(rn)).drop(rn)
