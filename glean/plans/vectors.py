"""Nearest-neighbour queries over ``embeddings``.

Every vector is a query against the whole table (self excluded), so the
work grows with the table.  ``label`` plays the metadata filter column.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glean.operators import ivfpq as A
from glean.operators import knn as N
from glean.plans.registry import register
from glean.session import scratch_path
from glean.sources import tables

FILTER_LABEL = 0


def _sql_knn(k: int, corpus_filter: str = "true", cosine: bool = False) -> str:
    vec = "CAST(embedding AS DOUBLE[])"
    if cosine:
        vec = f"list_transform({vec}, lambda x: x / sqrt(list_reduce(list_transform({vec}, lambda y: y * y), lambda a, b: a + b)))"
    return f"""
WITH e AS (SELECT vec_id, {vec} AS v, label FROM embeddings),
c AS (SELECT * FROM e WHERE {corpus_filter}),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance
  FROM e a, c b WHERE a.vec_id <> b.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p QUALIFY rank <= {k})
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM r"""


def _vectors(spark, sf):
    return tables.read(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vec"), "label")


@register("knn_top10", sql=_sql_knn(10), ids=("C1", "F2", "E1"))
def q_knn_top10(spark, sf):
    v = _vectors(spark, sf)
    return N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("id"), "vec"), k=10, exclude_self=True)


@register("knn_top5", sql=_sql_knn(5), ids=("C1", "F1", "E1"))
def q_knn_top5(spark, sf):
    v = _vectors(spark, sf)
    return N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("id"), "vec"), k=5, exclude_self=True)


@register("knn_filtered", sql=_sql_knn(5, f"label = {FILTER_LABEL}"), ids=("C1", "B7", "F1"))
def q_knn_filtered(spark, sf):
    v = _vectors(spark, sf)
    # The metadata predicate is applied to the corpus before the search.
    corpus = v.filter(F.col("label") == FILTER_LABEL).select(F.col("vec_id").alias("id"), "vec")
    return N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), corpus, k=5, exclude_self=True)


@register("knn_partitioned", sql=_sql_knn(5, f"label = {FILTER_LABEL}"), ids=("B7", "A6", "C1", "F1"))
def q_knn_partitioned(spark, sf):
    """The vector table as A6 writes it (partitioned by ``is_test``); the
    metadata predicate becomes a partition filter, so only that partition's
    files are read."""
    from glean.sources import io as IO

    v = _vectors(spark, sf)
    path = scratch_path(spark, "vector-table")
    IO.append_vectors(v.select(F.col("vec_id").alias("id"), "vec", (F.col("label") == FILTER_LABEL).alias("is_test")), path)
    corpus = IO.read_vectors(spark, path).filter(F.col("is_test")).select("id", "vec")
    return N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), corpus, k=5, exclude_self=True)


@register("knn_cosine", sql=_sql_knn(5, cosine=True), ids=("C1",))
def q_knn_cosine(spark, sf):
    # Cosine order equals the L2 order of the normalised vectors.
    v = _vectors(spark, sf)
    return N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("id"), "vec"), k=5, metric="cosine", exclude_self=True)


# --- L5 over vector hits -------------------------------------------------------
# Truth stand-in: a hit is right if it has the query's label; the label's name
# is the keyword and the text of a hit, its id the path.
@register(
    "retrieval_eval_vectors",
    sql=f"""WITH h AS ({_sql_knn(10)}),
j AS (
  SELECT h.query_id, h.rank, h.id, a.label = b.label AS m
  FROM h JOIN embeddings a ON a.vec_id = h.query_id JOIN embeddings b ON b.vec_id = h.id
),
g AS (
  SELECT query_id, max(CASE WHEN m AND rank <= 5 THEN 1 ELSE 0 END) AS r5, min(rank) FILTER (WHERE m) AS first, arg_min(id, rank) FILTER (WHERE m) AS hit
  FROM j GROUP BY query_id
)
SELECT query_id, 'vector ' || query_id || '...' AS query, 'label<' || label || '>' AS keyword,
       CASE WHEN hit IS NULL THEN 'Not Found' ELSE hit || '.vec' END AS relative_file, CAST(r5 AS INTEGER) AS r_at_5,
       round(coalesce(1.0 / first, 0.0), 3) AS mrr
FROM g JOIN embeddings e ON e.vec_id = g.query_id""",
    ids=("L5", "C1", "C6", "D14", "E2", "E3", "F2"),
)
def q_retrieval_eval_vectors(spark, sf):
    from glean.operators import evalr as E

    v = _vectors(spark, sf)
    hits = N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("id"), "vec"), k=10, exclude_self=True)
    name = F.concat(F.lit("label<"), F.col("label"), F.lit(">"))
    meta = v.select(F.col("vec_id").alias("id"), name.alias("text"), F.concat(F.lit("vectors/"), F.col("vec_id"), F.lit(".vec")).alias("relative_path"))
    truth = v.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("vector "), F.col("vec_id")).alias("query"), name.alias("keyword"))
    return E.evaluate(hits.join(meta, "id"), truth, k=5)


# --- C1 with the inner product ----------------------------------------------------
@register("knn_dot", sql=_sql_knn(5).replace("list_distance(a.v, b.v)", "-list_inner_product(a.v, b.v)"), ids=("C1", "F1"))
def q_knn_dot(spark, sf):
    """Largest inner product first; the distance is its negative."""
    v = _vectors(spark, sf)
    return N.knn(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("id"), "vec"), k=5, metric="dot", exclude_self=True)


@register("knn_approx", ids=("C2",))
def q_knn_approx(spark, sf):
    v = _vectors(spark, sf)
    return A.approx_knn(v.select(F.col("vec_id").alias("query_id"), "vec"), v.select(F.col("vec_id").alias("id"), "vec"), k=5, exclude_self=True)


@register("knn_approx_recall", ids=("C2",))
def q_knn_approx_recall(spark, sf):
    """Recall of the approximate search against the exact one, and the share of all pairs whose codes or vectors it compared."""
    v = _vectors(spark, sf)
    q = v.select(F.col("vec_id").alias("query_id"), "vec")
    c = v.select(F.col("vec_id").alias("id"), "vec")
    exact = N.knn(q, c, k=5, exclude_self=True).select("query_id", "id", F.lit(1).alias("exact"))
    path = scratch_path(spark, "compared")
    A.compared(q, c, 5, exclude_self=True).write.parquet(path)
    found = spark.read.parquet(path)
    cost = found.agg(F.sum("scanned").alias("scanned"), F.sum("measured").alias("measured"))
    best = found.filter("id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    approx = best.filter("rank <= 5").select("query_id", "id", F.lit(1).alias("hit"))
    j = exact.join(approx, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall_at_5"), F.count(F.lit(1)).alias("n_exact"))
    pairs = F.lit(float(max(1, q.count() * c.count())))
    return j.crossJoin(cost).select("recall_at_5", "n_exact", (F.col("scanned") / pairs).alias("share_scanned"), (F.col("measured") / pairs).alias("share_measured"))
