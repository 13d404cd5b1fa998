"""Retrieval evaluation.

Hits are a table ``(query_id, rank, doc_id, ...)``; the truth is a table
``(query_id, keyword)``.  Every measure is a grouped aggregate over
(query_id) after one equi-join, so the whole query set is evaluated in a
single job, with partial aggregation before the one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glean.functions import text as T

QUERY_PREVIEW = 45
NOT_FOUND = "Not Found"
MRR_DIGITS = 3


def truth_join(hits: DataFrame, truth: DataFrame, match_col: str = "text") -> DataFrame:
    """Each hit with ``match`` = keyword found in it, case-insensitive."""
    return hits.join(truth.select("query_id", "keyword"), "query_id").withColumn(
        "match", T.contains_ci(F.col(match_col), F.col("keyword"))
    )


def recall_at_k(judged: DataFrame, k: int = 5) -> F.Column:
    """D14 as an aggregate: 1 when any match has rank <= k."""
    return F.coalesce(F.max(F.when(F.col("match") & (F.col("rank") <= k), 1).otherwise(0)), F.lit(0)).cast("int")


def reciprocal_rank() -> F.Column:
    """E2 as an aggregate: 1/rank of the first match, 0.0 if none, 3 dp."""
    first = F.min(F.when(F.col("match"), F.col("rank")))
    return F.round(F.coalesce(F.lit(1.0) / first, F.lit(0.0)), MRR_DIGITS)


def first_source(path_col: str = "relative_path") -> F.Column:
    """E3 as an aggregate: last path part of the first matching hit."""
    first = F.min_by(F.when(F.col("match"), F.col(path_col)), F.when(F.col("match"), F.col("rank")))
    return F.coalesce(F.substring_index(first, "/", -1), F.lit(NOT_FOUND))


def evaluate(hits: DataFrame, truth: DataFrame, k: int = 5, match_col: str = "text", path_col: str = "relative_path") -> DataFrame:
    """One row per test query (queries without hits score 0).

    ``hits`` must carry ``query_id, rank`` and the ``match_col`` /
    ``path_col`` columns of each hit; ``truth`` carries
    ``query_id, query, keyword``.
    """
    judged = truth_join(hits, truth, match_col)
    per_query = judged.groupBy("query_id").agg(
        recall_at_k(judged, k).alias("r_at_5"),
        reciprocal_rank().alias("mrr"),
        first_source(path_col).alias("relative_file"),
    )
    return truth.join(per_query, "query_id", "left").select(
        "query_id",
        F.concat(F.substring("query", 1, QUERY_PREVIEW), F.lit("...")).alias("query"),
        "keyword",
        F.coalesce("relative_file", F.lit(NOT_FOUND)).alias("relative_file"),
        F.coalesce("r_at_5", F.lit(0)).alias("r_at_5"),
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
    )


def averages(report: DataFrame) -> DataFrame:
    """Mean of the numeric columns, over the already rounded MRR."""
    return report.agg(
        F.round(F.avg(F.col("r_at_5").cast("double")), 6).alias("avg_r_at_5"),
        F.round(F.avg("mrr"), 6).alias("avg_mrr"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def judgment_check(df: DataFrame, scores: list[str], flags: list[str], lo: int = 1, hi: int = 5) -> DataFrame:
    """``valid`` and the list of ``violations`` of each judgment row."""
    problems = [F.when(~F.col(c).between(lo, hi) | F.col(c).isNull(), F.lit(f"{c}_out_of_range")) for c in scores]
    problems += [F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in flags]
    v = F.filter(F.array(*problems), lambda x: x.isNotNull())
    return df.withColumn("violations", F.array_join(v, ",")).withColumn("valid", F.size(v) == 0)


def case_scores(scores: DataFrame, case_col: str = "case_no", question_col: str = "question") -> DataFrame:
    """One row per case: question and the mean of every score column."""
    metric_cols = [c for c, t in scores.dtypes if c not in (case_col, question_col) and t in ("double", "int", "bigint", "float")]
    return scores.groupBy(case_col).agg(
        F.min(question_col).alias(question_col),
        *[F.round(F.avg(c), 6).alias(c) for c in metric_cols],
    )
