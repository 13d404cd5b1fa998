"""Keyword retrieval and its evaluation: the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions import text as T
from glean.operators import blockmax as BM
from glean.operators import evalr as E
from glean.operators import keyword as K
from glean.plans.registry import (
    register,
    sql_first_words,
    sql_normalise_query,
    sql_rel_path,
    sql_strip,
    sql_tokens,
)
from glean.plans.strategy import row_count_at_most
from glean.sources import tables
from glean.sources.io import read_filter

EVAL_K = 10  # hits per query in the evaluation
RECALL_K = 5
TOOL_K = 3  # hits per query of the dependency search


def keyword_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A2 read rule then B6: source documents with text, as the index input."""
    docs = read_filter(tables.corpus(spark, sf))
    return docs.filter(~F.col("is_test") & F.col("text").isNotNull() & (F.col("text") != ""))


def index(spark: SparkSession, sf: str) -> K.KeywordIndex:
    return K.build_index(keyword_docs(spark, sf))


def hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    q = tables.retrieval_queries(spark, sf)
    return K.search(q, index(spark, sf), k=k)


MAX_BROADCAST_HITS = 500_000  # a broadcast is built on the driver


def judged_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Hits with the text and path of each hit document.

    Hits are at most (queries x k) rows: proven small, they are broadcast
    and the document table is streamed past them instead of shuffled.
    """
    docs = keyword_docs(spark, sf).select("doc_id", "relative_path", "text")
    return _bounded(spark, sf, hits(spark, sf, k), k).join(docs, "doc_id")


def _bounded(spark: SparkSession, sf: str, h: DataFrame, k: int) -> DataFrame:
    # The bound is proven on the (small) query table, not by running the
    # search twice: at most k hits per query.
    small = row_count_at_most(tables.retrieval_queries(spark, sf), MAX_BROADCAST_HITS // k)
    return F.broadcast(h) if small else h


# ---------------------------------------------------------------------------
# Oracle SQL: the same index and ranking in DuckDB.
# ---------------------------------------------------------------------------
def _sql_hits(k: int, with_tests: bool = False) -> str:
    k1, b = K.K1, K.B
    src = "true" if with_tests else "source <> 'src0'"
    return f"""
WITH docs AS (
  SELECT doc_id, text, source, {sql_rel_path()} AS relative_path FROM documents
  WHERE length({sql_strip('text')}) >= 10 AND {src} AND text IS NOT NULL AND text <> ''
),
tok AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM docs),
post AS (
  SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(dl) AS INTEGER) AS dl
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY term, doc_id
),
cs AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM tok),
ts AS (
  SELECT term, count(*) AS df, ln(1 + ((SELECT n_docs FROM cs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM post GROUP BY term
),
q AS (SELECT item_id AS query_id, text AS query, {sql_first_words('text')} AS keyword FROM benchmark),
qt AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({sql_tokens(sql_normalise_query('query'))}) AS term FROM q) GROUP BY query_id, term
),
sc AS (
  SELECT qt.query_id, p.doc_id,
         round(sum(qtf * idf * tf * {k1 + 1.0} / (tf + {k1} * ({1.0 - b} + {b} * dl / (SELECT avgdl FROM cs)))), 6) AS score
  FROM qt JOIN ts USING (term) JOIN post p USING (term) GROUP BY qt.query_id, p.doc_id
),
rk AS (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM sc QUALIFY rank <= {k}
),
j AS (
  SELECT rk.query_id, rk.rank, rk.doc_id, rk.score, d.relative_path, d.text, q.keyword,
         contains(lower(d.text), lower(q.keyword)) AS match
  FROM rk JOIN docs d USING (doc_id) JOIN q USING (query_id)
)"""


# --- D10 -------------------------------------------------------------------
@register(
    "postings",
    sql=_sql_hits(EVAL_K) + "\nSELECT term, doc_id, tf, dl FROM post",
    ids=("D10", "A8"),
)
def q_postings(spark, sf):
    return index(spark, sf).postings


@register(
    "term_stats",
    sql=_sql_hits(EVAL_K) + "\nSELECT term, df, round(idf, 6) AS idf FROM ts",
    ids=("D10", "L4"),
)
def q_term_stats(spark, sf):
    ts = index(spark, sf).term_stats
    return ts.select("term", "df", F.round("idf", 6).alias("idf"))


# --- B6 --------------------------------------------------------------------
@register(
    "keyword_input",
    sql=_sql_hits(EVAL_K) + "\nSELECT doc_id, relative_path, CAST(length(text) AS INTEGER) AS n_chars FROM docs",
    ids=("B6",),
)
def q_keyword_input(spark, sf):
    return keyword_docs(spark, sf).select("doc_id", "relative_path", F.length("text").alias("n_chars"))


# --- L4 --------------------------------------------------------------------
@register("bm25", sql=_sql_hits(EVAL_K) + "\nSELECT query_id, doc_id, score FROM sc", ids=("L4", "C3"))
def q_bm25(spark, sf):
    return K.score(tables.retrieval_queries(spark, sf), index(spark, sf))


# --- A8 + C3: search a persisted index ------------------------------------
@register(
    "bm25_persisted",
    sql=_sql_hits(TOOL_K) + "\nSELECT query_id, rank, doc_id, score FROM rk",
    ids=("A8", "C3", "D10"),
)
def q_bm25_persisted(spark, sf):
    """The ingest step writes the index once (term-clustered Parquet);
    searches then read it, as the dependency search reads its index."""
    from glean.session import scratch_path

    stored = index(spark, sf).write(scratch_path(spark, "bm25"))
    return K.search(tables.retrieval_queries(spark, sf), stored, k=TOOL_K)


# --- C3 / F3 / E1 ----------------------------------------------------------
@register(
    "bm25_top3",
    sql=_sql_hits(TOOL_K) + "\nSELECT query_id, rank, doc_id, score FROM rk",
    ids=("C3", "F3"),
)
def q_bm25_top3(spark, sf):
    return hits(spark, sf, TOOL_K)


@register(
    "bm25_blockmax",
    sql=_sql_hits(TOOL_K) + "\nSELECT query_id, rank, doc_id, score FROM rk",
    ids=("C3", "L4", "F3", "A8"),
)
def q_bm25_blockmax(spark, sf):
    """The same hits from written blocks: those below the running third score are skipped."""
    from glean.session import scratch_path

    blocks = BM.build(keyword_docs(spark, sf), scratch_path(spark, "blocks"))
    return BM.search(tables.retrieval_queries(spark, sf), blocks, k=TOOL_K)


@register(
    "hit_rank",
    sql=_sql_hits(EVAL_K) + "\nSELECT query_id, rank, doc_id, score FROM rk",
    ids=("E1", "F2"),
)
def q_hit_rank(spark, sf):
    return hits(spark, sf, EVAL_K)


# --- C6 --------------------------------------------------------------------
@register(
    "truth_join",
    sql=_sql_hits(EVAL_K) + "\nSELECT query_id, rank, doc_id, keyword, match FROM j",
    ids=("C6",),
)
def q_truth_join(spark, sf):
    truth = tables.retrieval_queries(spark, sf)
    return E.truth_join(judged_hits(spark, sf, EVAL_K), truth).select("query_id", "rank", "doc_id", "keyword", "match")


def _sql_per_query() -> str:
    return (
        _sql_hits(EVAL_K)
        + f""",
per AS (
  SELECT query_id,
         CAST(coalesce(max(CASE WHEN match AND rank <= {RECALL_K} THEN 1 ELSE 0 END), 0) AS INTEGER) AS r_at_5,
         round(coalesce(1.0::DOUBLE / min(CASE WHEN match THEN rank END), 0.0), 3) AS mrr,
         coalesce(split_part(arg_min(CASE WHEN match THEN relative_path END, CASE WHEN match THEN rank END), '/', -1), 'Not Found') AS relative_file
  FROM j GROUP BY query_id
),
report AS (
  SELECT q.query_id, substr(q.query, 1, 45) || '...' AS query, q.keyword,
         coalesce(per.relative_file, 'Not Found') AS relative_file,
         coalesce(per.r_at_5, 0) AS r_at_5, coalesce(per.mrr, 0.0) AS mrr
  FROM q LEFT JOIN per USING (query_id)
)"""
    )


def report(spark, sf) -> DataFrame:
    truth = tables.retrieval_queries(spark, sf)
    return E.evaluate(judged_hits(spark, sf, EVAL_K), truth, k=RECALL_K)


# --- D14 / E2 / E3 ---------------------------------------------------------
@register("recall_at_5", sql=_sql_per_query() + "\nSELECT query_id, r_at_5 FROM report", ids=("D14",))
def q_recall(spark, sf):
    return report(spark, sf).select("query_id", "r_at_5")


@register("mrr", sql=_sql_per_query() + "\nSELECT query_id, mrr FROM report", ids=("E2",))
def q_mrr(spark, sf):
    return report(spark, sf).select("query_id", "mrr")


@register("first_source", sql=_sql_per_query() + "\nSELECT query_id, relative_file FROM report", ids=("E3",))
def q_first_source(spark, sf):
    return report(spark, sf).select("query_id", "relative_file")


# --- L5 (flagship) ---------------------------------------------------------
@register(
    "retrieval_eval",
    sql=_sql_per_query() + "\nSELECT query_id, query, keyword, relative_file, r_at_5, mrr FROM report",
    ids=("L5", "C6", "D14", "E2", "E3", "F2"),
)
def q_retrieval_eval(spark, sf):
    return report(spark, sf)


# --- D8 --------------------------------------------------------------------
@register(
    "eval_averages",
    sql=_sql_per_query()
    + "\nSELECT round(avg(CAST(r_at_5 AS DOUBLE)), 6) AS avg_r_at_5, round(avg(mrr), 6) AS avg_mrr, count(*) AS n_queries FROM report",
    ids=("D8",),
)
def q_eval_averages(spark, sf):
    return E.averages(report(spark, sf))


# --- C4 --------------------------------------------------------------------
# Target of each query: the path of the document the benchmark passage was
# taken from would be unknown, so the stand-in target is the path of the
# query's own best hit's *source folder*; a hit under that folder is "self".
@register(
    "exclude_self",
    sql=_sql_hits(TOOL_K)
    + """,
tgt AS (SELECT query_id, split_part(relative_path, '/', 1) AS target_file FROM j WHERE rank = 1),
kept AS (
  SELECT j.query_id, j.rank, j.doc_id, j.relative_path FROM j JOIN tgt USING (query_id)
  WHERE NOT (lower(tgt.target_file) <> '' AND (contains(lower(j.relative_path), lower(tgt.target_file))
             OR contains(lower(tgt.target_file), lower(j.relative_path))))
),
best AS (SELECT query_id, arg_min(doc_id, rank) AS doc_id, arg_min(relative_path, rank) AS relative_path FROM kept GROUP BY query_id)
SELECT tgt.query_id, best.doc_id, best.relative_path, best.doc_id IS NOT NULL AS found
FROM tgt LEFT JOIN best USING (query_id)""",
    ids=("C4", "F3"),
)
def q_exclude_self(spark, sf):
    # The hits (queries x k rows) feed three consumers: materialise once.
    h = judged_hits(spark, sf, TOOL_K).checkpoint(eager=True)
    targets = h.filter(F.col("rank") == 1).select(
        "query_id", F.split("relative_path", "/").getItem(0).alias("target_file")
    )
    return K.exclude_self(h.select("query_id", "rank", "doc_id", "relative_path"), targets)


# --- B18 / H-s14 / H-s15 ---------------------------------------------------
# Hits of a search over the whole collection (seed and source documents, as
# the vector store holds both) rendered as result blocks, then split back
# and filtered to passing-test blocks.
def all_docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_filter(tables.corpus(spark, sf)).filter(F.col("text") != "")


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    from glean.operators import knn as N

    docs = all_docs(spark, sf)
    idx = K.build_index(docs)
    h = K.search(tables.retrieval_queries(spark, sf), idx, k=TOOL_K)
    meta = docs.select(
        "doc_id", "relative_path", "file_type", "is_test",
        F.when(F.col("is_test"), F.lit("passed")).alias("test_status"),
        F.try_element_at(F.split("text", "\n"), F.lit(1)).alias("description"),
        F.col("text").alias("source_code"),
    )
    return N.render_hits(_bounded(spark, sf, h, TOOL_K).join(meta, "doc_id"))


def _sql_rendered() -> str:
    from glean.plans.scalars import sql_file_type

    return (
        _sql_hits(TOOL_K, with_tests=True)
        + f""",
blocks AS (
  SELECT j.query_id, j.rank,
         printf('--- RESULT %d | FILE: %s | TYPE: %s | IS_TEST: %s | STATUS: %s ---', j.rank, d.relative_path,
                {sql_file_type("string_split(d.relative_path, '/')[-1]", "d.source = 'src0'")},
                CASE WHEN d.source = 'src0' THEN 'True' ELSE 'False' END,
                CASE WHEN d.source = 'src0' THEN 'passed' ELSE 'N/A' END)
         || chr(10) || 'DESCRIPTION: ' || string_split(d.text, chr(10))[1] || chr(10) || d.text AS b
  FROM j JOIN docs d USING (doc_id)
),
r AS (SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS rendered FROM blocks GROUP BY query_id)"""
    )


@register(
    "render_hits",
    sql=_sql_rendered() + "\nSELECT query_id, md5(rendered) AS rendered_md5, CAST(length(rendered) AS INTEGER) AS n_chars FROM r",
    ids=("B18", "F1"),
)
def q_render_hits(spark, sf):
    r = rendered(spark, sf)
    return r.select("query_id", F.md5("rendered").alias("rendered_md5"), F.length("rendered").alias("n_chars"))


def _sql_split() -> str:
    blocks = f"list_transform(list_filter(string_split(rendered, '{T.RESULT_MARK}'), lambda p: length({sql_strip('p')}) > 0), lambda p: {sql_strip(f"'{T.RESULT_MARK}' || p")})"
    kept = f"list_filter({blocks}, lambda x: strpos(x, '{T.TEST_MARK}') > 0)"
    return (
        _sql_rendered()
        + f"""
SELECT query_id, CAST(len({blocks}) AS INTEGER) AS n_blocks,
       md5(CASE WHEN rendered IS NULL OR length({sql_strip('rendered')}) = 0 OR strpos(rendered, 'RESULT') = 0 THEN 'No reference tests found.'
                WHEN len({kept}) = 0 THEN ''
                ELSE chr(10) || chr(10) || array_to_string({kept}, chr(10) || chr(10)) END) AS kept_md5
FROM r"""
    )


@register("split_blocks", sql=_sql_split(), ids=("H-s14", "H-s15"))
def q_split_blocks(spark, sf):
    r = rendered(spark, sf)
    return r.select(
        "query_id",
        F.size(T.split_blocks(F.col("rendered"))).alias("n_blocks"),
        F.md5(T.keep_test_blocks(F.col("rendered"))).alias("kept_md5"),
    )


# --- B19 / L6 ----------------------------------------------------------------
# Judgments: documents joined to labels; quality and toxic play the two
# flags, three 1..5 scores are derived from the document.
def judgments(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.read(spark, sf, "documents")
    lab = tables.read(spark, sf, "labels")
    j = d.join(lab, "doc_id")
    return j.select(
        "doc_id",
        "source",
        F.ceil(F.col("n_chars") / 1000).cast("int").alias("logic_coverage_score"),
        F.length("lang").alias("test_discovery_score"),
        (F.size(T.tokens(F.col("source"))) + F.lit(2)).cast("int").alias("risk_alignment_score"),
        F.when(F.col("quality") == 1, F.lit(True)).when(F.col("quality") == 0, F.lit(False)).alias("path_integrity"),
        F.when(F.col("toxic") == 1, F.lit(True)).when(F.col("toxic") == 0, F.lit(False)).alias("forbidden_content_detected"),
    )


SCORES = ["logic_coverage_score", "test_discovery_score", "risk_alignment_score"]
FLAGS = ["path_integrity", "forbidden_content_detected"]

SQL_JUDGMENTS = f"""WITH j AS (
  SELECT d.doc_id, d.source, CAST(ceil(d.n_chars / 1000) AS INTEGER) AS logic_coverage_score,
         CAST(length(d.lang) AS INTEGER) AS test_discovery_score,
         CAST(len({sql_tokens('d.source')}) + 2 AS INTEGER) AS risk_alignment_score,
         CASE WHEN l.quality = 1 THEN true WHEN l.quality = 0 THEN false END AS path_integrity,
         CASE WHEN l.toxic = 1 THEN true WHEN l.toxic = 0 THEN false END AS forbidden_content_detected
  FROM documents d JOIN labels l USING (doc_id)
)"""


def _sql_violations() -> str:
    parts = [f"CASE WHEN NOT ({c} BETWEEN 1 AND 5) OR {c} IS NULL THEN '{c}_out_of_range' END" for c in SCORES]
    parts += [f"CASE WHEN {c} IS NULL THEN '{c}_missing' END" for c in FLAGS]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@register(
    "judgment_check",
    sql=SQL_JUDGMENTS + f"\nSELECT doc_id, array_to_string({_sql_violations()}, ',') AS violations, len({_sql_violations()}) = 0 AS valid FROM j",
    ids=("B19", "DM16"),
)
def q_judgment_check(spark, sf):
    out = E.judgment_check(judgments(spark, sf), SCORES, FLAGS)
    return out.select("doc_id", "violations", "valid")


@register(
    "case_scores",
    sql=SQL_JUDGMENTS
    + "\nSELECT source AS case_no, min(source) AS question, "
    + ", ".join(f"round(avg({c}), 6) AS {c}" for c in SCORES)
    + " FROM j GROUP BY source",
    ids=("L6", "D8"),
)
def q_case_scores(spark, sf):
    j = judgments(spark, sf).select(F.col("source").alias("case_no"), F.col("source").alias("question"), *SCORES)
    return E.case_scores(j)
