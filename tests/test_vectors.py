"""Approximate search by inverted lists and product codes; pruning of the inner product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.operators import ivfpq as A
from glean.operators import knn as N


def frame(spark, x, first=0):
    rows = [(first + i, [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>")


@pytest.mark.parametrize("list_target, query_target", [(20_000, 10_000), (7, 9)])
def test_recall_with_few_pairs_on_clustered_vectors(spark, list_target, query_target):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(150, 16))[rnd.integers(0, 150, 3000)] * 5 + rnd.normal(size=(3000, 16)) * 0.5
    df = frame(spark, x)
    found = A.compared(df.withColumnRenamed("id", "query_id"), df, 5, True, list_target=list_target, query_target=query_target).toPandas()
    assert found.scanned.sum() < 0.05 * len(x) ** 2
    assert found.measured.sum() < found.scanned.sum()
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :5]
    best = found[found.id.notna()].sort_values(["query_id", "distance", "id"]).groupby("query_id").head(5).groupby("query_id").id.agg(set)
    assert np.mean([len(best[i] & set(true[i].tolist())) / 5 for i in range(len(x))]) >= 0.9


def test_approximate_search_on_odd_input(spark):
    same = frame(spark, np.ones((40, 4)))
    q = frame(spark, np.ones((2, 4)), 100).withColumnRenamed("id", "query_id")
    q = q.unionByName(spark.createDataFrame([(7, None)], "query_id bigint, vec array<double>"))
    got = A.approx_knn(q, same.unionByName(spark.createDataFrame([(999, None)], "id bigint, vec array<double>")), 3)
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in got.collect()) == [(i, n + 1, n, 0.0) for i in (100, 101) for n in range(3)]
    assert A.approx_knn(q, same.limit(0), 3).count() == 0
    one = A.approx_knn(q, same.limit(1), 3, exclude_self=True).collect()
    assert len(one) == 2


def test_inner_product_prunes_cells_of_short_vectors(spark):
    rnd = np.random.default_rng(3)
    long = rnd.normal(size=(200, 6)) + 12
    short = rnd.normal(size=(1800, 6)) * 0.3
    x = np.concatenate([long, short])
    corpus = frame(spark, x)
    queries = frame(spark, rnd.normal(size=(50, 6)) + 5, 5000).withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.rank, r.id) for r in N.knn(queries, corpus, 3, metric="dot", cell_target=100).collect()}
    q = np.array([r.vec for r in queries.orderBy("query_id").collect()])
    true = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :3]
    assert got == {(5000 + i, n + 1, int(t)) for i, row in enumerate(true) for n, t in enumerate(row)}
    piv = N._pivots(corpus, 20)
    assigned = N._assign(corpus, piv)
    cells = assigned.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("d_cell").alias("radius"), F.max(F.sqrt(N.dot(F.col("vec"), F.col("vec")))).alias("norm"), F.lit(1).alias("salts")
    )
    searched = N.probes(queries, cells, piv, 3, "dot").join(cells.select("cell", "n"), "cell").agg(F.sum("n")).first()[0]
    assert searched < 0.4 * 50 * len(x)


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_a_block_of_equal_vectors_needs_little_memory(metric):
    import tracemalloc

    import pandas as pd

    q = pd.DataFrame({"query_id": range(300), "qvec": list(np.ones((300, 4)))})
    c = pd.DataFrame({"id": range(20_000), "vec": list(np.ones((20_000, 4)))})
    tracemalloc.start()
    got = N._block_topk(3, metric, True)(None, q, c)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6
    assert [(r.query_id, r.id) for r in got.itertuples()] == [(i, x) for i in range(300) for x in [x for x in range(4) if x != i][:3]]


@pytest.mark.parametrize("shift, scale", [(0, 1), (1e5, 1), (0, 1e20), (0, 1e-7)])
def test_a_block_has_the_nearest_of_far_long_and_short_vectors(shift, scale):
    import pandas as pd

    rnd = np.random.default_rng(5)
    x, y = (rnd.normal(size=(n, 6)) * scale + shift for n in (5000, 300))
    q = pd.DataFrame({"query_id": range(300), "qvec": list(y)})
    c = pd.DataFrame({"id": range(5000), "vec": list(x)})
    for metric in ("l2", "dot"):
        got = N._block_topk(4, metric, True)(None, q, c)
        sums = np.zeros((300, 5000))
        for j in range(6):
            sums += y[:, None, j] * x[None, :, j] if metric == "dot" else (y[:, None, j] - x[None, :, j]) ** 2
        d = np.round(-sums if metric == "dot" else np.sqrt(sums), N.DIST_DIGITS)
        d[np.arange(300), np.arange(300)] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :4]
        assert got["id"].tolist() == best.ravel().tolist()
        assert got["distance"].tolist() == np.take_along_axis(d, best, 1).ravel().tolist()


def test_a_group_of_the_approximate_search_makes_no_frame_for_each_query(monkeypatch):
    import pandas as pd

    rnd = np.random.default_rng(6)
    x, y = rnd.normal(size=(400, 8)), rnd.normal(size=(700, 8))
    m = A.fit(x, 400, 5, 0.95, 1)
    m.coarse = x.mean(0)[None]
    codes = m.encode(x)[1]
    ask = pd.DataFrame({"query_id": range(700), "qvec": [v.tobytes() for v in y], "floor": np.where(np.arange(700) % 2, np.inf, 3.0)})
    have = pd.DataFrame({"id": range(400), "vec": [v.tobytes() for v in x], "code": [c.tobytes() for c in codes]})
    made = []
    whole = pd.DataFrame.__init__
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **b: (made.append(1), whole(self, *a, **b))[1])
    m.slack = 1e9  # nothing is left out
    got = A.searched(m, 0, ask, have, 5, True)
    monkeypatch.undo()
    assert len(made) < 50
    d = np.round(np.sqrt(((y[:, None] - x[None]) ** 2).sum(2)), A.DIST_DIGITS)
    d[np.arange(400), np.arange(400)] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got["id"].tolist()[:-1] == best.ravel().tolist()
    assert got["distance"].tolist()[:-1] == np.take_along_axis(d, best, 1).ravel().tolist()
    cost = got.iloc[-1]
    assert (cost["query_id"], cost["scanned"], cost["measured"]) == (-1, 700 * 400, 700 * 400 - 400) and got["id"].isna().sum() == 1


def test_the_length_of_a_vector_is_summed_once(spark):
    import re

    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0])], "id int, vec array<double>")
    out = odd.select("id", N.normalise(F.col("vec")).alias("n"))
    # What an element is divided by is a value, not the sum itself.
    assert re.search(r"try_divide\([^()]*\)", out._jdf.queryExecution().analyzed().toString())
    assert [r.n for r in out.orderBy("id").collect()] == [[0.0, 0.0], None, [0.6, 0.8]]


def test_a_query_is_sent_once_to_a_group_of_lists(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(2500, 8))
    df = frame(spark, x)
    q = df.withColumnRenamed("id", "query_id")
    want = A.compared(q, df, 5, True).toPandas()
    assert want.query_id.value_counts().drop(-1).max() <= 5 * (1 + 2500 // A.LEAST_GROUP)  # hits of a group, not of a list
    monkeypatch.setattr(A, "GROUP", 150)
    monkeypatch.setattr(A, "HELD", 50)
    got = A.compared(q, df, 5, True).toPandas()
    best = [f[f.id.notna()].sort_values(["query_id", "distance", "id"]).groupby("query_id").head(5)[["query_id", "id", "distance"]].values.tolist() for f in (want, got)]
    assert best[0] == best[1] and len(best[0]) == 5 * 2500
    assert (got.scanned.sum(), got.measured.sum()) == (want.scanned.sum(), want.measured.sum())
