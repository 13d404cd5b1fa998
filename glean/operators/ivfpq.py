"""Approximate nearest neighbours (C2): inverted lists, residual product codes, exact re-ranking.

**Fit.**  On at most ``SAMPLE`` vectors, chosen by a hash of the id and collected: a coarse
quantiser of about 2 sqrt(n) centroids (Lloyd's iterations), and for every ``SUB`` dimensions of what is left
after subtracting the centroid a codebook of 256 centroids.  Two numbers are read off the same
sample by searching it with some of its own vectors: how many lists a query must probe, and by how
much a code may overstate a distance, for ``target`` of the true neighbours to be found.  On
clustered vectors that is a few lists; on vectors without clusters it is most of them, and the codes
alone keep the work down.

**Index.**  Every vector of the corpus, none left out: its list, its code of one byte for ``SUB``
dimensions, and the vector for re-ranking.

**Search.**  A query goes to the lists with the nearest centroids, the nearest one first, so that the others know a
k-th distance.  Lists longer than ``list_target`` are split by a hash of the id, and where more than ``query_target`` queries have a list
as their nearest, these by a hash of the query.  The other lists are dealt to groups of at most about ``GROUP`` vectors, the queries by a hash to blocks of about as many, and a query is sent
once to each group that holds a list it probes, with a bit for each list: on vectors without clusters a
query probes most lists, and sending it to each would be a shuffle of queries times lists.  Within a list
all codes are compared by table lookups; vectors are measured exactly where the code's distance,
less what it may overstate, is not above the k-th distance known so far, and the k best leave the group.
The sizes of model and sample do not grow with the corpus beyond their bounds.

Defined results: null vectors are neither indexed nor searched; equal vectors tie by id; an empty
corpus has no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glean.operators.knn import DIST_DIGITS, as_double
from glean.plans.strategy import spread
from glean.session import scratch_path

SAMPLE, TEST_QUERIES, MAX_LISTS = 20_000, 200, 1024
SUB, CODES = 4, 256
CHUNK = 128  # queries whose code distances are held at a time
PAIRS = 50_000  # pairs that are measured at a time
GROUP, LEAST_GROUP = 100_000, 500  # most vectors and most queries of a group of lists; fewer vectors are not split for more tasks
PROBED, HELD = 2048, 1_000_000  # queries whose lists are ordered, and hits of a group that are held, at a time


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of every row, some rows at a time."""
    out, c2 = np.empty(len(x), np.int64), (centres * centres).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(c2 - 2.0 * (x[i : i + 4096] @ centres.T), axis=1)
    return out


def _lloyd(x: np.ndarray, k: int, rounds: int, rnd: np.random.Generator) -> np.ndarray:
    """At most ``k`` centres; one that loses all its rows takes the row farthest from its own centre."""
    centres = x[rnd.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        empty = np.flatnonzero(~full)
        if len(empty):
            far = np.argsort(-((x - centres[near]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty] = x[far]
        centres[full] = sums[full] / count[full, None]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids, codebooks (one for each ``SUB`` dimensions) and how far to search."""

    coarse: np.ndarray
    books: list[np.ndarray]
    probes: int = 1
    slack: float = 1.0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of every row."""
        lists = _nearest(x, self.coarse)
        left = x - self.coarse[lists]
        return lists, np.stack([_nearest(left[:, i * SUB : (i + 1) * SUB], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def by_distance(self, q: np.ndarray) -> np.ndarray:
        """Numbers of all lists, the nearest first, for every query."""
        return np.argsort((self.coarse**2).sum(1) - 2.0 * (q @ self.coarse.T), axis=1, kind="stable")

    def approximate(self, q: np.ndarray, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the vectors that the codes of one list stand for."""
        return self.to(q, centre, self.decode(codes))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What is left of a vector after its centroid, as its code tells."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    @staticmethod
    def to(q: np.ndarray, centre: np.ndarray, decoded: np.ndarray) -> np.ndarray:
        left = q - centre
        return np.maximum((left * left).sum(1)[:, None] + (decoded * decoded).sum(1)[None, :] - 2.0 * (left @ decoded.T), 0)


def fit(sample: np.ndarray, n: int, k: int, target: float, seed: int) -> Quantiser:
    """The quantiser of a corpus of ``n`` vectors from a sample of it."""
    rnd = np.random.default_rng(seed)
    lists = max(1, min(MAX_LISTS, round(2 * math.sqrt(n)), len(sample) // 20))
    coarse = _lloyd(sample, lists, 12, rnd)
    left = sample - coarse[_nearest(sample, coarse)]
    books = [_lloyd(left[:, i : i + SUB], CODES, 8, rnd) for i in range(0, sample.shape[1], SUB)]
    model = Quantiser(coarse, books)
    # Search the sample with some of its own vectors.
    at = rnd.permutation(len(sample))[:TEST_QUERIES]
    own, codes = model.encode(sample)
    d = (sample**2).sum(1)[None, :] - 2.0 * (sample[at] @ sample.T)
    d[np.arange(len(at)), at] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return model
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = model.by_distance(sample[at])
    place = np.argsort(order, axis=1)  # rank of every list for every query
    ranks = np.take_along_axis(place, own[true], axis=1)
    # Half of what may be missed is left to each of the two numbers.
    each = 1 - (1 - target) / 2
    model.probes = int(np.quantile(ranks, each, method="higher")) + 1
    over = []
    for i, q in enumerate(at):
        for t in true[i]:
            coded = model.approximate(sample[q][None], model.coarse[own[t]], codes[t][None])[0, 0]
            real = float(((sample[q] - sample[t]) ** 2).sum())
            over.append(math.sqrt(coded / real) if real else 1.0)
    model.slack = max(1.0, float(np.quantile(over, each, method="higher")))
    return model


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _rows(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def approx_knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    exclude_self: bool = False,
    target: float = 0.95,
    list_target: int = 20_000,
    query_target: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest that the probed lists hold."""
    hits = compared(queries, corpus, k, exclude_self, target, list_target, query_target, seed).filter("id IS NOT NULL")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


FOUND = "query_id bigint, id bigint, distance double, scanned bigint, measured bigint"


def _best(m: Quantiser, number: int, names, Q, floors, X, ids, codes, k: int, exclude_self: bool):
    """(query row, vector id, distance) of the k best vectors of one list for each query, and how many were measured."""
    decoded, some, measured = m.decode(codes), min(4 * k, len(X)), 0
    rows, found, far = [], [], []

    def distances(q: np.ndarray, at_q: np.ndarray, at_x: np.ndarray) -> np.ndarray:
        out = np.empty(len(at_q))
        for i in range(0, len(at_q), PAIRS):
            out[i : i + PAIRS] = np.sqrt(((X[at_x[i : i + PAIRS]] - q[at_q[i : i + PAIRS]]) ** 2).sum(1))
        return out

    for i in range(0, len(Q), CHUNK):
        q, floor = Q[i : i + CHUNK], floors[i : i + CHUNK].copy()
        near = np.sqrt(m.to(q, m.coarse[number], decoded))
        if exclude_self:
            near[names[i : i + CHUNK, None] == ids[None, :]] = np.inf
        close = np.zeros(near.shape, bool)
        new = np.flatnonzero(np.isinf(floor))
        if len(new):  # nothing is known of these yet: measure some and take the k-th of them
            first = np.argpartition(near[new], some - 1, axis=1)[:, :some]
            at = np.repeat(new, some)
            d = np.where(np.isfinite(near[at, first.ravel()]), distances(q, at, first.ravel()), np.inf).reshape(len(new), some)
            close[at, first.ravel()] = True
            if some >= k:
                floor[new] = np.partition(d, k - 1, axis=1)[:, k - 1]
        close |= near <= (floor * m.slack + 10.0**-DIST_DIGITS)[:, None]
        at_q, at_x = np.nonzero(close & np.isfinite(near))
        measured += len(at_q)
        d = np.round(distances(q, at_q, at_x), DIST_DIGITS)
        order = np.lexsort((ids[at_x], d, at_q))
        begin = np.searchsorted(at_q, np.arange(len(q)))
        order = order[np.arange(len(order)) - begin[at_q[order]] < k]  # at_q stands in order
        rows.append(i + at_q[order])
        found.append(ids[at_x[order]])
        far.append(d[order])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(far), measured


def _frame(names: np.ndarray, ids: np.ndarray, far: np.ndarray, scanned: int, measured: int) -> pd.DataFrame:
    """Hits, and a last row that tells what a group cost."""
    frame = pd.DataFrame({"query_id": pd.array(np.append(names, -1), "Int64"), "id": pd.array(np.append(ids, -1), "Int64")})
    frame["distance"] = np.append(far, np.nan)
    cost = np.arange(len(frame)) == len(frame) - 1
    frame["scanned"] = pd.array(np.full(len(frame), scanned), "Int64")
    frame["measured"] = pd.array(np.full(len(frame), measured), "Int64")
    frame.loc[cost, "id"] = pd.NA
    frame.loc[~cost, ["scanned", "measured"]] = pd.NA
    return frame


def _nothing() -> pd.DataFrame:
    return _frame(*[np.empty(0, np.int64)] * 2, np.empty(0), 0, 0).iloc[:0]


def searched(m: Quantiser, number: int, ask: pd.DataFrame, have: pd.DataFrame, k: int, exclude_self: bool, kind=np.float64) -> pd.DataFrame:
    """The k best of one group for each of its queries, and the row that tells what the group cost."""
    if not (len(ask) and len(have)):
        return _nothing()
    names, floors = ask["query_id"].to_numpy(np.int64), ask["floor"].to_numpy(np.float64)
    Q, X = (_rows(c, kind).astype(np.float64) for c in (ask["qvec"], have["vec"]))
    rows, ids, far, measured = _best(m, number, names, Q, floors, X, have["id"].to_numpy(np.int64), _rows(have["code"], np.uint8), k, exclude_self)
    return _frame(names[rows], ids, far, len(ask) * len(have), measured)


def gathered(m: Quantiser, ask: pd.DataFrame, have: pd.DataFrame, k: int, exclude_self: bool, kind=np.float64) -> pd.DataFrame:
    """The k best of a group of lists for each of its queries, and the row that tells what the group cost.

    A query's ``mask`` has a bit for each list; only the lists it probes are searched.  Lists come one after the other, in
    parts of ``list`` and ``salt``, and hits are cut to k a query before they are many.
    """
    if not (len(ask) and len(have)):
        return _nothing()
    names, floors = ask["query_id"].to_numpy(np.int64), ask["floor"].to_numpy(np.float64)
    mask, Q = _rows(ask["mask"], np.uint8), _rows(ask["qvec"], kind).astype(np.float64)
    have = have.sort_values(["list", "salt"], kind="stable")
    X, ids, codes = _rows(have["vec"], kind).astype(np.float64), have["id"].to_numpy(np.int64), _rows(have["code"], np.uint8)
    lists, salts = have["list"].to_numpy(np.int64), have["salt"].to_numpy(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (salts[1:] != salts[:-1]))))
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    kept, more, held, scanned, measured = none, [], 0, 0, 0

    def cut():
        rows, found, far = (np.concatenate(x) for x in zip(kept, *more))
        order = np.lexsort((found, far, rows))
        first = np.searchsorted(rows[order], np.arange(len(Q)))
        order = order[np.arange(len(order)) - first[rows[order]] < k]
        return rows[order], found[order], far[order]

    for i, j in zip(begin, np.append(begin[1:], len(have))):
        number = int(lists[i])
        at = np.flatnonzero(mask[:, number >> 3] >> (7 - (number & 7)) & 1)
        if not len(at):
            continue
        rows, found, far, n = _best(m, number, names[at], Q[at], floors[at], X[i:j], ids[i:j], codes[i:j], k, exclude_self)
        scanned, measured, held = scanned + len(at) * int(j - i), measured + n, held + len(rows)
        more.append((at[rows], found, far))
        if held > HELD:
            kept, more, held = cut(), [], 0
    rows, found, far = cut()
    return _frame(names[rows], found, far, scanned, measured)


def _grouped(held: np.ndarray, list_target: int, groups: int) -> list[tuple[int, int, int, int]]:
    """(list, salts, salt, group) of every part of a list: parts in order, groups of about equal numbers of vectors."""
    out, before, total = [], 0.0, float(held.sum())
    for number, n in enumerate(held.tolist()):
        salts = -(-n // list_target)
        for salt in range(salts):
            out.append((number, salts, salt, min(groups - 1, int((before + n / salts / 2) / total * groups))))
            before += n / salts
    return out


def compared(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    exclude_self: bool = False,
    target: float = 0.95,
    list_target: int = 20_000,
    query_target: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """The k best of every group, and a row with a null id for each group that tells what it cost: codes scanned, vectors measured."""
    spark = queries.sparkSession
    # Vectors are written and shuffled as bytes, single ones where the tables hold no others.
    single = all("array<float>" == dict(df.dtypes)["vec"] for df in (queries, corpus))
    kind = np.float32 if single else np.float64
    q = queries.filter(F.col("vec").isNotNull()).select("query_id", as_double(F.col("vec")).alias("vec"))
    c = spread(corpus.filter(F.col("vec").isNotNull()).select("id", as_double(F.col("vec")).alias("vec")))
    n = c.count()
    picked = c.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(SAMPLE).select("vec").toPandas()
    if not n:
        return spark.createDataFrame([], FOUND)
    model = spark.sparkContext.broadcast(fit(_matrix(picked["vec"]), n, k, target, seed))  # bounded by MAX_LISTS and CODES

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vec"])
                lists, codes = model.value.encode(x)
                yield pdf.assign(vec=[v.tobytes() for v in x.astype(kind)], list=lists.astype(np.int32), code=[v.tobytes() for v in codes])

    path = scratch_path(spark, "lists")
    c.mapInPandas(encode, "id bigint, vec binary, list int, code binary").write.parquet(path)
    indexed = spark.read.parquet(path)
    sizes = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))  # one row a list: bounded by MAX_LISTS
    held = np.zeros(len(model.value.coarse), np.int64)
    for r in sizes.collect():
        held[r["list"]] = r["n"]
    # A query goes once to each group of lists, not to each list.
    side = min(math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)), max(1, n // LEAST_GROUP))
    groups = max(side, math.ceil(n / GROUP))
    parts = _grouped(held, list_target, groups)
    member = np.zeros((len(held), groups), np.float32)
    for number, _, _, group in parts:
        member[number, group] = 1

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), PROBED):
                some = pdf.iloc[i : i + PROBED]
                x = _matrix(some["vec"])
                order = model.value.by_distance(x)
                # Never fewer lists than hold k vectors besides the query itself.
                least = (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1) + 1
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
                home, asked = order[:, 0], place < np.maximum(least, model.value.probes)[:, None]
                asked[np.arange(len(x)), home] = False
                to = asked.astype(np.float32) @ member > 0
                yield pd.DataFrame({
                    "query_id": some["query_id"].to_numpy(), "qvec": [v.tobytes() for v in x.astype(kind)], "list": home.astype(np.int32),
                    "mask": [v.tobytes() for v in np.packbits(asked, axis=1)], "groups": [np.flatnonzero(t).astype(np.int32) for t in to],
                })

    to = scratch_path(spark, "probes")
    spread(q).mapInPandas(probe, "query_id bigint, qvec binary, list int, mask binary, groups array<int>").write.parquet(to)
    asked = spark.read.parquet(to)
    every = lambda col: F.explode(F.sequence(F.lit(0), F.col(col) - 1))

    def met(left: DataFrame, right: DataFrame, keys: list[str], search) -> DataFrame:
        to = scratch_path(spark, "found")
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND).write.parquet(to)
        return spark.read.parquet(to)

    # The nearest list of each query.
    blocks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / query_target).cast("int").alias("blocks"))
    dealt = F.broadcast(sizes.select("list", F.ceil(F.col("n") / list_target).cast("int").alias("salts")).join(blocks, "list"))
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    left = asked.join(dealt, "list").select("query_id", "qvec", F.lit(float("inf")).alias("floor"), "list", block, every("salts").alias("salt"))
    right = indexed.join(dealt, "list").select("id", "vec", "code", "list", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), every("blocks").alias("block"))
    home = lambda key, ask, have: searched(model.value, key[0], ask, have, k, exclude_self, kind)
    first = met(left, right, ["list", "salt", "block"], home)

    # The other lists it probes.
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    kth = first.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == k)
    rest = asked.filter(F.size("groups") > 0).join(kth.select("query_id", F.col("distance").alias("floor")), "query_id", "left")
    many = max(side, math.ceil(asked.count() / GROUP))
    block = F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int").alias("block")
    left = rest.select("query_id", "qvec", F.coalesce("floor", F.lit(float("inf"))).alias("floor"), "mask", F.explode("groups").alias("group"), block)
    dealt = F.broadcast(spark.createDataFrame(parts, "list int, salts int, salt int, group int"))  # bounded by MAX_LISTS and n / list_target
    right = indexed.join(dealt, "list").filter(F.pmod(F.xxhash64("id"), F.col("salts")) == F.col("salt"))
    right = right.select("id", "vec", "code", "list", "salt", "group", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"))
    others = lambda key, ask, have: gathered(model.value, ask, have, k, exclude_self, kind)
    return first.unionByName(met(left, right, ["group", "block"], others))
