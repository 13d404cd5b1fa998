"""Nearest-neighbour search.

Exact k-NN without comparing every query with every vector:

1. **Pivots.**  ``C`` corpus vectors, chosen by ``md5(id)`` (deterministic,
   C = n / cell_target and at most ``max_cells``), are collected into a single
   row: a broadcast whose size is bounded by ``C * dim``.
2. **Cells.**  Every corpus vector is assigned to its nearest pivot with
   array expressions over that one row (no row copies).  Per cell: size and
   radius (largest member distance), again one bounded row.
3. **Bounds.**  For each query, the triangle inequality gives, per cell, a
   lower bound ``d(q, p_c) - r_c`` and an upper bound ``d(q, p_c) + r_c`` on
   the distance to any member.  Walking cells by upper bound until they
   hold ``k`` vectors gives ``U >= d_k(q)``; only cells with lower bound
   ``<= U`` can contain a true neighbour.
4. **Blocked search.**  Queries and corpus meet per (cell, salt, query
   block) in a ``cogroup``: a cell of ``n`` vectors is split into
   ``ceil(n / cell_target)`` buckets, its queries into
   ``ceil(q / query_target)`` blocks, so every group is bounded on both
   sides and a cell holding a third of the corpus is spread over many
   tasks.  Each group ranks with a BLAS product, re-measures the best few
   exactly, all that tie with the k-th included, and emits only its
   top-k per query: pairs are never materialised as rows.  The global top-k per query is
   ``row_number() <= k`` (partial ``WindowGroupLimit`` before the
   exchange).

On clustered embeddings the bounds remove most cells.  On uniformly spread
high-dimensional vectors nothing can be pruned exactly (every cell's bound
overlaps); the blocked search then does the full quadratic work, but in
bounded, vectorised blocks with a shuffle of only k rows per query and
block.  ``ivfpq`` is the sub-quadratic alternative.

The result equals brute force: pruning only removes cells that provably
cannot hold one of the k nearest.  Distances are rounded to 6 digits and
ties are broken by id.  ``metric='cosine'`` normalises vectors and ranks by
L2 (identical order).  ``metric='dot'`` ranks by ``-q.x``: by Cauchy-Schwarz
``q.x`` lies within ``|q| r_c`` of ``q.p_c`` and is at most ``|q|`` times the
largest norm of the cell, so cells of short or far-off vectors are pruned
in the same walk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.plans.strategy import spread

DIST_DIGITS = 6
BOUND_SLACK = 1e-6  # keeps rounding ties at the k-th distance


def l2(a: Column, b: Column) -> Column:
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.sqrt(sq)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def normalise(v: Column) -> Column:
    # The length is bound first: inside the lambda it would be summed again for every element.
    by = lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return F.try_element_at(F.transform(F.array(F.sqrt(dot(v, v))), by), F.lit(1))


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _pivots(corpus: DataFrame, n_cells: int) -> DataFrame:
    """One row: ``pivots ARRAY<STRUCT<cell INT, vec ARRAY<DOUBLE>>>``."""
    picked = corpus.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n_cells)
    w = Window.orderBy(F.md5(F.col("id").cast("string")), "id")
    numbered = picked.select((F.row_number().over(w) - 1).cast("int").alias("cell"), "vec")
    return numbered.agg(F.array_sort(F.collect_list(F.struct("cell", "vec"))).alias("pivots"))


def _assign(corpus: DataFrame, pivots: DataFrame) -> DataFrame:
    """corpus + (cell, d_cell): nearest pivot of every vector."""
    j = corpus.crossJoin(F.broadcast(pivots))
    near = F.array_min(F.transform("pivots", lambda p: F.struct(l2(F.col("vec"), p["vec"]).alias("d"), p["cell"].alias("cell"))))
    return j.select("*", near.alias("_n")).select(
        *[c for c in corpus.columns], F.col("_n.cell").alias("cell"), F.col("_n.d").alias("d_cell")
    )


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "l2",
    exclude_self: bool = False,
    max_cells: int = 1024,
    cell_target: int = 20_000,
    query_target: int = 10_000,
) -> DataFrame:
    """k nearest corpus vectors of every query.

    ``queries(query_id, vec)``, ``corpus(id, vec)`` with numeric arrays.
    Returns ``(query_id, rank, id, distance)``.  With ``exclude_self`` a
    query never matches the corpus row of the same id.
    """
    scored = candidates(queries, corpus, k, metric, exclude_self, max_cells, cell_target, query_target)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def probes(q: DataFrame, cells: DataFrame, piv: DataFrame, need: int, metric: str = "l2") -> DataFrame:
    """The cells that may hold one of the ``need`` nearest of a query: (query_id, qvec, cell, salts)."""
    # One row holding every cell with its pivot: bounded by max_cells.
    info = cells.join(piv.select(F.explode("pivots").alias("p")).select("p.cell", "p.vec"), "cell").agg(
        F.collect_list(F.struct("cell", "n", "radius", "norm", "salts", "vec")).alias("cells")
    )
    qc = q.withColumn("qn", F.sqrt(dot(F.col("vec"), F.col("vec")))).crossJoin(F.broadcast(info))

    def bounds(x: Column) -> tuple[Column, Column]:
        """Least and greatest distance to a vector of the cell."""
        if metric != "dot":
            d = l2(F.col("vec"), x["vec"])
            return d - x["radius"], d + x["radius"]
        d, reach = -dot(F.col("vec"), x["vec"]), F.col("qn") * x["radius"]
        most = F.col("qn") * x["norm"]
        return F.greatest(d - reach, -most), F.least(d + reach, most)

    def of(x: Column) -> Column:
        low, high = bounds(x)
        return F.struct(high.alias("ub"), low.alias("lb"), *[x[c].alias(c) for c in ("n", "cell", "salts")])

    qc = qc.select("query_id", "vec", F.array_sort(F.transform("cells", of)).alias("pc"))
    walk = F.aggregate(
        "pc",
        F.struct(F.lit(0).cast("long").alias("cnt"), F.lit(None).cast("double").alias("u")),
        lambda acc, x: F.when(acc["cnt"] >= need, acc).otherwise(F.struct((acc["cnt"] + x["n"]).cast("long").alias("cnt"), x["ub"].alias("u"))),
    )
    slack = BOUND_SLACK * (1 + F.abs(walk["u"]))
    upper = F.when(walk["cnt"] >= need, walk["u"] + slack).otherwise(F.lit(float("inf")))
    found = qc.select("query_id", "vec", F.explode(F.filter("pc", lambda x: x["lb"] <= upper)).alias("x"))
    return found.select("query_id", F.col("vec").alias("qvec"), F.col("x.cell").alias("cell"), F.col("x.salts").alias("salts"))


CANDIDATE_SCHEMA = "query_id long, id long, distance double"
QUERY_CHUNK, VECTOR_CHUNK = 256, 2048  # products that are held at a time
PAIRS_CHUNK = 100_000  # pairs that are measured again at a time
LARGE = 1e15  # longer vectors are multiplied in double precision: squares of single ones overflow


def _block_topk(k: int, metric: str, exclude_self: bool):
    """Top-k of one block: (<= query_target queries) x (<= cell_target vectors).

    A BLAS product, in single precision unless vectors are very long, gives every distance up to a rounding
    that is bounded from the lengths.  Some vectors at a time: those that may be among the k best so far,
    however many tie there, are measured again in double precision with a sequential sum (the same arithmetic
    as the SQL expression), rounded, ordered by distance and id, and cut to k with those kept before.
    """

    def fn(key, qpdf, cpdf):
        import numpy as np
        import pandas as pd

        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "distance": np.empty(0)})
        if qpdf.empty or cpdf.empty:
            return none
        Q = np.stack(qpdf["qvec"].to_numpy()).astype(np.float64)
        X = np.stack(cpdf["vec"].to_numpy()).astype(np.float64)
        qids = qpdf["query_id"].to_numpy(np.int64)
        ids = cpdf["id"].to_numpy(np.int64)
        # Shifting all vectors changes no distance, and short vectors round less.  The product is that of shifted
        # vectors: |x|^2 - 2 q.x, the squared distance less |q|^2; or -q.x with q as it is, less -q.shift.
        shift = X.mean(0)
        off = 0.0 if metric == "dot" else shift
        qq, xx = ((Q - off) ** 2).sum(1), ((X - shift) ** 2).sum(1)
        base = -(Q @ shift) if metric == "dot" else qq
        lengths = np.sqrt((Q * Q).sum(1)) + np.sqrt((X * X).sum(1).max())
        longest = np.sqrt(xx.max())
        real = np.float32 if lengths.max() < LARGE else np.float64
        right = (-(X - shift).T if metric == "dot" else np.vstack([-2.0 * (X - shift).T, xx])).astype(real)
        reach = np.sqrt(qq) * longest * 2 + (0 if metric == "dot" else longest**2)
        slack = 4 * (X.shape[1] + 4) * (float(np.finfo(real).eps) * reach + float(np.finfo(np.float64).eps) * lengths**2)

        def measured(at_q, at_x):
            dist = np.empty(len(at_q))
            for i in range(0, len(at_q), PAIRS_CHUNK):
                u, v = Q[at_q[i : i + PAIRS_CHUNK]], X[at_x[i : i + PAIRS_CHUNK]]
                acc = np.zeros(len(u))
                for j in range(X.shape[1]):
                    if metric == "dot":
                        acc += u[:, j] * v[:, j]
                    else:
                        diff = u[:, j] - v[:, j]
                        acc += diff * diff
                dist[i : i + PAIRS_CHUNK] = -acc if metric == "dot" else np.sqrt(acc)
            return np.round(dist, DIST_DIGITS)

        outs = [none]
        for s in range(0, len(Q), QUERY_CHUNK):
            n = len(Q[s : s + QUERY_CHUNK])
            left = Q[s : s + n] - off
            left = (left if metric == "dot" else np.hstack([left, np.ones((n, 1))])).astype(real)
            own, b, most = qids[s : s + n], base[s : s + n], slack[s : s + n]
            at_q, at_x, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # the k best so far
            kth = np.full(n, np.inf)
            for t in range(0, len(X), VECTOR_CHUNK):
                approx = left @ right[:, t : t + VECTOR_CHUNK]
                some = ids[t : t + VECTOR_CHUNK]
                # A distance is rounded to DIST_DIGITS, the k-th one too.
                bound = kth + 2 * 10.0**-DIST_DIGITS
                bound = (bound if metric == "dot" else bound * bound) - b + most
                if k < len(some) and np.isinf(kth).any():  # no k best yet: the k-th of these bounds them
                    least = np.where(own[:, None] == some[None, :], np.inf, approx) if exclude_self else approx
                    least = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.float64)
                    far = np.sqrt(np.maximum(least + b, 0))
                    bound = np.minimum(bound, least + 2 * most + 4 * 10.0**-DIST_DIGITS * (1 + far))
                new_q, new_x = np.nonzero(approx <= bound.astype(real)[:, None])
                if exclude_self:
                    other = own[new_q] != some[new_x]
                    new_q, new_x = new_q[other], new_x[other]
                if not len(new_q):
                    continue
                new_x = new_x + t
                dist = np.concatenate([dist, measured(new_q + s, new_x)])
                at_q, at_x = np.concatenate([at_q, new_q]), np.concatenate([at_x, new_x])
                order = np.lexsort((ids[at_x], dist, at_q))
                begin = np.searchsorted(at_q[order], np.arange(n))
                order = order[np.arange(len(order)) - begin[at_q[order]] < k]
                at_q, at_x, dist = at_q[order], at_x[order], dist[order]
                count = np.bincount(at_q, minlength=n)
                full = np.flatnonzero(count == k)
                kth[full] = dist[np.cumsum(count)[full] - 1]
            outs.append(pd.DataFrame({"query_id": own[at_q], "id": ids[at_x], "distance": dist}))
        return pd.concat(outs, ignore_index=True)

    return fn


def candidates(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "l2",
    exclude_self: bool = False,
    max_cells: int = 1024,
    cell_target: int = 20_000,
    query_target: int = 10_000,
) -> DataFrame:
    """Per query, the k best of every block it had to search.

    Returns ``(query_id, id, distance)`` with at most k rows per (query,
    block); the global top-k is a ``row_number`` over these.
    """
    q = spread(queries.select("query_id", as_double(F.col("vec")).alias("vec")))
    c = spread(corpus.select("id", as_double(F.col("vec")).alias("vec")))
    if metric == "cosine":
        q = q.withColumn("vec", normalise(F.col("vec")))
        c = c.withColumn("vec", normalise(F.col("vec")))
    n = c.count()
    if n == 0:
        return q.sparkSession.createDataFrame([], CANDIDATE_SCHEMA)
    # As many cells as there are blocks of cell_target vectors: a query is sent once to each block it may need.
    n_cells = max(1, min(max_cells, math.ceil(n / cell_target)))
    piv = _pivots(c, n_cells)
    # The assignment (n x C distances) feeds three consumers; it is written
    # once to the shared checkpoint folder instead of being recomputed.
    assigned = _assign(c, piv).checkpoint(eager=True)
    cells = assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("d_cell").alias("radius"), F.max(F.sqrt(dot(F.col("vec"), F.col("vec")))).alias("norm")
    )
    cells = cells.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("n") / cell_target)).cast("int"))
    cand = probes(q, cells, piv, k + (1 if exclude_self else 0), metric)
    cand = cand.checkpoint(eager=True)  # read twice: block sizes and the search
    # Queries per cell decide how many query blocks a cell is split into
    # (one row per cell: a bounded broadcast).
    qblocks = cand.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / query_target)).cast("int").alias("qblocks"))
    qb = F.broadcast(qblocks)
    left = (
        cand.join(qb, "cell")
        .select("query_id", "qvec", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                F.pmod(F.xxhash64("query_id"), F.col("qblocks")).cast("int").alias("qblock"))
    )
    right = (
        assigned.join(F.broadcast(cells.select("cell", "salts")), "cell").join(qb, "cell")
        .select("id", "vec", "cell", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
                F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"))
    )
    keys = ["cell", "salt", "qblock"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_topk(k, metric, exclude_self), CANDIDATE_SCHEMA)


def render_hits(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Numbered result blocks of each query's hits, in rank order.

    Hits carry ``rank, relative_path, file_type, is_test, test_status,
    description, source_code``; missing metadata takes the defaults.  The
    collected list per query is bounded by k.
    """
    header = F.format_string(
        "--- RESULT %d | FILE: %s | TYPE: %s | IS_TEST: %s | STATUS: %s ---",
        F.col("rank"),
        F.coalesce(F.col("relative_path"), F.lit("Unknown")),
        F.coalesce(F.col("file_type"), F.lit("code")),
        F.when(F.coalesce(F.col("is_test"), F.lit(False)), F.lit("True")).otherwise(F.lit("False")),
        F.coalesce(F.col("test_status"), F.lit("N/A")),
    )
    block = F.concat(header, F.lit("\nDESCRIPTION: "), F.coalesce(F.col("description"), F.lit("")), F.lit("\n"), F.coalesce(F.col("source_code"), F.lit("")))
    per = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return per.select(key, F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n").alias("rendered"))
