"""Quality classifier: a factorisation machine.

Inputs of a text are hashed words (counts, square-root damped and scaled to length one),
statistics of its structure and its metadata length, all in one sparse vector x.  The score
is the logistic of  w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so all pairwise interactions cost time linear in the inputs.

Training reads a bounded sample of ``TRAIN_ROWS`` labelled rows; their sparse vectors are
made by the executors and the weights fitted by Adam.  Scores use the text alone (whole) and
its length; labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts have the statistics of an empty text and are scored like
any other; several labels of one id count by their mean; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glean.llm.common import bounded_sample, id_crc

TRAIN_ROWS = 4000
HELD_OUT_MOD, HELD_OUT = 3, 1
BUCKETS, RANK = 1 << 14, 8
EPOCHS, BATCH, STEP, L2 = 12, 64, 0.02, 1e-4
CACHED_WORDS = 200_000  # a worker's memo of word hashes; it is emptied when full

STATS = (
    "chars words word_length longest_word upper digits marks symbols bars bangs lines line_length repeated_lines "
    "distinct_words capitalised listed_words"
).split()
DIM = BUCKETS + len(STATS)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = zlib.crc32(word) % BUCKETS
        return h


_HASHES = _Hashes()


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse input (indices, values) of a text."""
    text = text or ""
    data = text.encode()
    words = data.lower().split()
    n = len(words)
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.int64, n)
    index, count = np.unique(ids, return_counts=True)
    value = np.sqrt(count)
    value /= np.sqrt(max(n, 1))
    b = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    lines = text.split("\n")
    mark = b[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbol = b[[35, 36, 37, 38, 42, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]].sum()
    long = max(map(len, words), default=0)
    stats = [
        np.log1p(len(text)) / 10,
        np.log1p(n) / 10,
        min(size / max(n, 1), 40) / 10,
        np.log1p(long) / 5,
        b[65:91].sum() / size * 4,
        b[48:58].sum() / size * 10,
        mark / size * 10,
        symbol / size * 10,
        b[124] / max(n, 1) * 2,
        b[33] / max(n, 1) * 2,
        np.log1p(len(lines)) / 5,
        np.log1p(len(text) / len(lines)) / 10,
        1 - len(set(lines)) / len(lines),
        len(set(words)) / max(n, 1),
        sum(w[:1].isupper() for w in lines) / len(lines),
        np.log1p(np.count_nonzero(count > 1)) / 10,
    ]
    return np.concatenate((index, np.arange(BUCKETS, DIM))), np.concatenate((value, stats))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # DIM
    factors: np.ndarray  # DIM x RANK
    center: np.ndarray  # of the statistics
    spread: np.ndarray

    def scaled(self, value: np.ndarray) -> np.ndarray:
        value = value.copy()
        value[-len(STATS) :] = np.clip((value[-len(STATS) :] - self.center) / self.spread, -4, 4) / 4
        return value

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        x = self.scaled(value)
        vx = self.factors[index] * x[:, None]
        total = vx.sum(axis=0)
        return self.bias + self.linear[index] @ x + 0.5 * (total @ total - (vx * vx).sum())


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[list[int], list[float], int]]) -> Machine:
    """Fit to (indices, values, label 0 or 1)."""
    stats = np.array([r[1][-len(STATS) :] for r in rows]).reshape(-1, len(STATS))
    center = stats.mean(axis=0) if len(rows) else np.zeros(len(STATS))
    spread = stats.std(axis=0) + 1e-3 if len(rows) else np.ones(len(STATS))
    rng = np.random.default_rng(5)
    m = Machine(0.0, np.zeros(DIM), rng.normal(0, 0.05, (DIM, RANK)), center, spread)
    if not rows:
        m.factors[:] = 0
        return m
    xs = [(np.array(i), m.scaled(np.array(v, float)), y) for i, v, y in rows]
    rate = min(max(np.mean([y for *_, y in xs]), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(rate / (1 - rate)))
    first = [np.zeros(DIM), np.zeros((DIM, RANK))]
    second = [np.zeros(DIM), np.zeros((DIM, RANK))]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for at in range(0, len(xs), BATCH):
            part = [xs[i] for i in order[at : at + BATCH]]
            owner = np.repeat(np.arange(len(part)), [len(i) for i, *_ in part])
            idx = np.concatenate([i for i, *_ in part])
            x = np.concatenate([v for _, v, _ in part])
            y = np.array([y for *_, y in part])
            begin = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            vx = m.factors[idx] * x[:, None]
            total = np.add.reduceat(vx, begin, axis=0)
            z = m.bias + np.add.reduceat(m.linear[idx] * x, begin) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), begin))
            miss = (_logistic(z) - y) / len(part)
            m.bias -= STEP * float(miss.sum())
            touched, back = np.unique(idx, return_inverse=True)
            g_w = np.bincount(back, miss[owner] * x) + L2 * m.linear[touched]
            g = (miss[owner] * x)[:, None] * (total[owner] - vx)
            g_v = np.stack([np.bincount(back, g[:, f]) for f in range(RANK)], axis=1) + L2 * m.factors[touched]
            t += 1
            for p, grad, a, b in ((m.linear, g_w, first[0], second[0]), (m.factors, g_v, first[1], second[1])):
                a[touched] = 0.9 * a[touched] + 0.1 * grad
                b[touched] = 0.999 * b[touched] + 0.001 * grad * grad
                p[touched] -= STEP * (a[touched] / (1 - 0.9**t)) / (np.sqrt(b[touched] / (1 - 0.999**t)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learn from the labelled rows that are not held out, ``TRAIN_ROWS`` of them at most."""
    own = labels.filter(F.col("quality").isNotNull() & (id_crc() % HELD_OUT_MOD != HELD_OUT))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).select(F.col("doc_id").alias("d"), "y")
    picked = bounded_sample(own, "d", TRAIN_ROWS)

    @F.pandas_udf("struct<i:array<int>,v:array<float>>")
    def inputs(texts: pd.Series) -> pd.DataFrame:
        rows = [vector(t) for t in texts]
        return pd.DataFrame({"i": [i.astype(np.int32) for i, _ in rows], "v": [v.astype(np.float32) for _, v in rows]})

    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("d"))
    found = chosen.select("doc_id", "y", inputs("text").alias("x")).orderBy("doc_id", F.hash("x")).limit(TRAIN_ROWS).collect()
    return train([(r["x"]["i"], r["x"]["v"], r["y"]) for r in found])


def score(text: Column, model: Machine, like: DataFrame) -> Column:
    """Score (0 to 1) of each text."""
    shared = like.sparkSession.sparkContext.broadcast(model)  # DIM x (RANK + 1) weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(_logistic(np.array([m.margin(*vector(t)) for t in texts], float)))

    return run(text)


def quality(docs: DataFrame, labels: DataFrame, model: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = model or fit(docs, labels)
    found = docs.select("doc_id", (id_crc() % HELD_OUT_MOD == HELD_OUT).alias("held_out"), score(F.col("text"), model, docs).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
