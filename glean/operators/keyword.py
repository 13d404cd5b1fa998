"""Keyword index and Okapi BM25 retrieval.

The index is three plain tables:

* ``postings(term, doc_id, tf, dl)``: one row per (term, document).  The
  document length travels with the posting, so scoring never joins the
  (very large) document table back in.
* ``term_stats(term, df, idf)``: one row per term.
* ``corpus_stats(n_docs, avgdl)``: one row.

Term frequencies are computed *inside* each document row (sort the token
array, find run starts, take run lengths), so building postings needs no
shuffle at all; only ``term_stats`` aggregates across documents, and that
aggregation is partial-then-final, so a term present in a third of all
documents costs one row per input partition before the exchange.

Search explodes the query set into (query, term, qtf) rows, joins them to
``term_stats`` and then to ``postings``.  The query side is small and is
broadcast behind a checked row bound, so the postings table is streamed
once, never shuffled; a query set too large for that falls back to a
shuffle join on ``term``.  Partial scores are summed per (query, doc) with
map-side combine, and the top-k per query is a ``row_number() <= k``
window, which Spark executes as a partial ``WindowGroupLimit`` before the
exchange, so a query matching most of the corpus never sends all its
candidates to one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.functions import paths as P
from glean.functions import text as T
from glean.plans.strategy import partitions_for, row_count_at_most, spread
from glean.session import scratch_path

# Okapi BM25 constants (the published defaults).
K1 = 1.5
B = 0.75
SCORE_DIGITS = 6
# A broadcast is built on the driver: more query terms than these are joined in a shuffle.
MAX_BROADCAST_TERMS = 200_000


@dataclass
class KeywordIndex:
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    # True when the tables are read from files (a written index): searches
    # then push a literal term filter into the postings scan.
    persisted: bool = False
    # One row with the number of documents, where the statistics can be taken from written postings.
    n_docs: DataFrame | None = None

    def write(self, path: str, buckets: int | None = None) -> "KeywordIndex":
        """Persist the three tables as Parquet below ``path``.

        Postings are range-clustered by term and document (partition count
        from the estimated size unless ``buckets`` is given), so that a hot
        term spans several files and a later search reads
        only the row groups of the queried terms (min/max statistics on
        ``term`` let the scan skip the rest).
        """
        post = self.postings
        post = post.repartitionByRange(buckets or partitions_for(post), "term", "doc_id")
        post.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        per_term, corpus = self.term_stats, self.corpus_stats
        if self.n_docs is not None:  # texts are tokenised once: the statistics read the written postings
            per_term, corpus = _statistics(post.sparkSession.read.parquet(f"{path}/postings"), self.n_docs)
        per_term.write.mode("overwrite").parquet(f"{path}/term_stats")
        corpus.write.mode("overwrite").parquet(f"{path}/corpus_stats")
        return KeywordIndex.read(self.postings.sparkSession, path)

    @staticmethod
    def read(spark, path: str) -> "KeywordIndex":
        return KeywordIndex(
            spark.read.parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/term_stats"),
            spark.read.parquet(f"{path}/corpus_stats"),
            persisted=True,
        )


def write_increment(docs: DataFrame, path: str, epoch: int, id_col: str = "doc_id", text_col: str = "text", tokenizer=T.tokens) -> None:
    """Append one batch of documents to an incremental index below ``path``.

    Each increment holds the batch's postings, per-term document-frequency
    deltas and a (documents, total length) delta, written to its own
    ``epoch=N`` folder in overwrite mode (safe to replay).
    """
    inc = build_index(docs, id_col, text_col, tokenizer)
    inc.postings.write.mode("overwrite").parquet(f"{path}/postings/epoch={epoch}")
    df = inc.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df.write.mode("overwrite").parquet(f"{path}/term_df/epoch={epoch}")
    tok = docs.select(F.size(tokenizer(F.col(text_col))).alias("dl"))
    tok.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").cast("double").alias("sum_dl")).write.mode("overwrite").parquet(
        f"{path}/corpus/epoch={epoch}"
    )


def read_increments(spark, path: str) -> "KeywordIndex":
    """The index over every increment: deltas summed, idf recomputed."""
    postings = spark.read.parquet(f"{path}/postings").drop("epoch")
    corpus = spark.read.parquet(f"{path}/corpus").agg(
        F.sum("n_docs").alias("n_docs"), (F.sum("sum_dl") / F.sum("n_docs")).alias("avgdl")
    )
    df = spark.read.parquet(f"{path}/term_df").groupBy("term").agg(F.sum("df").alias("df"))
    term_stats = df.crossJoin(F.broadcast(corpus.select("n_docs"))).select(
        "term",
        "df",
        F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    )
    return KeywordIndex(postings, term_stats, corpus, persisted=True)


def keyword_input(chunks: DataFrame, text_col: str = "source_code") -> DataFrame:
    """Source chunks only (``is_test`` false) with non-empty code as text."""
    return (
        chunks.filter(~F.coalesce(F.col("is_test"), F.lit(False)))
        .filter(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
        .withColumn("text", F.col(text_col))
        .drop(text_col)
    )


def term_frequencies(token_array: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of a token array, computed within the row."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: (n > 0) & ((i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, F.greatest(i - 1, F.lit(1))))),
        )
        nxt = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n + 1))
        return F.zip_with(
            starts,
            nxt,
            lambda a, b: F.struct(F.try_element_at(s, a).alias("term"), (b - a).cast("int").alias("tf")),
        )

    return F.try_element_at(F.transform(F.array(F.array_sort(token_array)), runs), F.lit(1))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer=T.tokens) -> KeywordIndex:
    """Postings, term statistics and corpus statistics of a corpus.

    The corpus statistics need no tokenising pass of their own: the number
    of documents is a plain count, and the total token count is the sum of
    the terms' collection frequencies, taken from the term statistics.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    tok = spread(ids).select("doc_id", tokenizer(F.col("_t")).alias("toks"))
    postings = tok.select(
        "doc_id",
        F.size("toks").cast("int").alias("dl"),
        F.explode(term_frequencies(F.col("toks"))).alias("p"),
    ).select(F.col("p.term").alias("term"), "doc_id", F.col("p.tf").alias("tf"), "dl")
    n_docs = ids.agg(F.count(F.lit(1)).alias("n_docs"))
    return KeywordIndex(postings, *_statistics(postings, n_docs), n_docs=n_docs)


def _statistics(postings: DataFrame, n_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term statistics and the one-row corpus statistics of postings."""
    per_term = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    total = per_term.agg(F.sum("cf").cast("double").alias("_tokens"))
    corpus_stats = n_docs.crossJoin(total).select(
        "n_docs", F.coalesce(F.try_divide(F.col("_tokens"), F.col("n_docs")), F.lit(0.0)).alias("avgdl")
    )
    term_stats = per_term.crossJoin(F.broadcast(n_docs)).select(
        "term",
        "df",
        F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    )
    return term_stats, corpus_stats


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", tokenizer=T.tokens) -> DataFrame:
    """(query_id, term, qtf) after H-s4 normalisation and tokenising."""
    return (
        queries.select(
            F.col(id_col).alias("query_id"),
            F.explode(tokenizer(T.normalise_query(F.col(text_col)))).alias("term"),
        )
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("qtf"))
    )


def weighted_terms(queries: DataFrame, index: KeywordIndex, id_col="query_id", text_col="query", tokenizer=T.tokens, max_broadcast_rows: int = MAX_BROADCAST_TERMS):
    """(query_id, term, qtf, df, idf) and whether it is proven small.

    At most one row per query term: when the query terms are proven small
    (a bounded ``limit`` count), so is this table.
    """
    qt = query_terms(queries, id_col, text_col, tokenizer)
    small = row_count_at_most(qt, max_broadcast_rows)
    side = F.broadcast(qt) if small else qt.hint("merge")  # the planner sees the texts' size, not the terms'
    # The one-row corpus statistics ride along, so scoring needs nothing else.
    stats = F.broadcast(index.corpus_stats.select("n_docs", "avgdl"))
    return side.join(index.term_stats.select("term", "df", "idf"), "term").crossJoin(stats), small


def score_weighted(weighted: DataFrame, index: KeywordIndex, small: bool, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of every (query, document) pair sharing a term, from weighted terms.

    A proven-small weighted side is broadcast, so the postings are streamed
    past it without a shuffle; any other is joined in a shuffle.
    """
    w = F.broadcast(weighted) if small else weighted.hint("merge")
    hits = w.join(index.postings, "term")
    tf = F.col("tf").cast("double")
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * tf * F.lit(k1 + 1.0) / norm
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))


def score(
    queries: DataFrame,
    index: KeywordIndex,
    id_col: str = "query_id",
    text_col: str = "query",
    k1: float = K1,
    b: float = B,
    tokenizer=T.tokens,
    max_broadcast_rows: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """L4: BM25 score of every (query, document) sharing at least one term."""
    weighted, small = weighted_terms(queries, index, id_col, text_col, tokenizer, max_broadcast_rows)
    return score_weighted(weighted, index, small, k1, b)


def _staged(index: KeywordIndex) -> KeywordIndex:
    """The index over its postings written once, where every table of it would tokenise all texts again."""
    if index.persisted or index.n_docs is None:
        return index
    spark = index.postings.sparkSession
    path = scratch_path(spark, "postings")
    index.postings.write.parquet(path)
    postings = spark.read.parquet(path)
    return KeywordIndex(postings, *_statistics(postings, index.n_docs), n_docs=index.n_docs)


MAX_LITERAL_TERMS = 10_000


def _restricted(index: KeywordIndex, weighted: DataFrame) -> KeywordIndex:
    """Postings limited to the query terms by a literal ``IN`` filter.

    On a persisted, term-clustered postings table the filter is pushed into
    the Parquet scan, whose min/max statistics then skip every row group
    without a query term.  Only a bounded set of distinct terms is turned
    into a literal; a larger query vocabulary keeps the join alone.
    """
    if not index.persisted:  # computed postings: the join filters as early
        return index
    terms = weighted.select("term").distinct()
    if not row_count_at_most(terms, MAX_LITERAL_TERMS):
        return index
    vocab = [r["term"] for r in terms.collect()]
    return KeywordIndex(index.postings.filter(F.col("term").isin(vocab)), index.term_stats, index.corpus_stats, True)


def rank(hits: DataFrame, k: int, key: str = "query_id", score_col: str = "score", id_col: str = "doc_id", descending: bool = True) -> DataFrame:
    """E1 + F3: rank 1..k per query, ties broken by document id."""
    order = F.col(score_col).desc() if descending else F.col(score_col).asc()
    w = Window.partitionBy(key).orderBy(order, F.col(id_col).asc())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(
    queries: DataFrame,
    index: KeywordIndex,
    k: int = 3,
    prune: bool | str = "auto",
    rare_fraction: float = 0.01,
    max_lookup_rows: int = 20_000_000,
    exhaustive_rows: int = 50_000_000,
    **kw,
) -> DataFrame:
    """Top-k BM25 hits per query: (query_id, rank, doc_id, score).

    ``prune="auto"`` decides from an exact statistic: exhaustive scoring
    produces one partial score per (query term, posting), i.e. the sum of
    the query terms' document frequencies.  Up to ``exhaustive_rows`` that
    join is cheapest; beyond it (common terms over a huge corpus) the
    pruned search below is used.  Both give the same hits.

    With pruning, common terms are not scored against every document that
    holds them (MaxScore-style, exact):

    1. A query term is *rare* when its document frequency is at most
       ``rare_fraction`` of the corpus.  Documents holding a rare query term
       are the candidates; their exact scores (all query terms) come from a
       shuffle join of candidates and postings by document.  Candidates grow
       with the corpus, so they are written and never broadcast.
    2. A document without a rare term scores less than the sum of the
       common terms' upper bounds ``qtf * idf * (k1 + 1)``.  When that sum
       is below the k-th candidate score, the query is finished.
    3. Queries that fail the bound (or all of them, where the candidates
       hold more than ``max_lookup_rows`` query terms) are scored exhaustively.

    Texts are tokenised once: the postings of an index that is not read from
    files are written before statistics and scores read them.
    """
    k1, b = kw.get("k1", K1), kw.get("b", B)
    id_col, text_col = kw.get("id_col", "query_id"), kw.get("text_col", "query")
    tokenizer = kw.get("tokenizer", T.tokens)
    index = _staged(index)
    weighted, small = weighted_terms(queries, index, id_col, text_col, tokenizer, kw.get("max_broadcast_rows", MAX_BROADCAST_TERMS))
    out = ["query_id", "rank", "doc_id", "score"]
    if not small:  # a huge query set: plain shuffle joins
        return rank(score_weighted(weighted, index, False, k1, b), k).select(*out)
    # Bounded (one row per query term), reused by every path below.
    weighted = weighted.cache()
    index = _restricted(index, weighted)
    if prune == "auto":
        est = weighted.agg(F.sum("df").alias("n")).first()["n"] or 0
        prune = est > exhaustive_rows
    if not prune:
        return rank(score_weighted(weighted, index, True, k1, b), k).select(*out)
    w = weighted
    w = w.withColumn("ub", F.col("qtf") * F.col("idf") * F.lit(k1 + 1.0)).withColumn(
        "rare", F.col("df") <= F.col("n_docs") * rare_fraction
    )
    w = F.broadcast(w)
    cand = w.filter("rare").select("query_id", "term").join(index.postings.select("term", "doc_id"), "term")
    path = scratch_path(queries.sparkSession, "candidates")
    cand.select("query_id", "doc_id").distinct().write.parquet(path)
    cand = queries.sparkSession.read.parquet(path)
    n_terms = F.broadcast(weighted.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms")))
    held = cand.groupBy("query_id").agg(F.count(F.lit(1)).alias("docs")).join(n_terms, "query_id")
    if (held.agg(F.sum(F.col("docs") * F.col("terms")).alias("n")).first()["n"] or 0) > max_lookup_rows:
        return rank(score_weighted(weighted, index, True, k1, b), k).select(*out)
    tf = F.col("tf").cast("double")
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * tf * F.lit(k1 + 1.0) / norm
    asked = index.postings.join(F.broadcast(weighted.select("term").distinct()), "term", "left_semi")
    found = cand.withColumnRenamed("doc_id", "_doc").hint("merge").join(asked, F.col("_doc").eqNullSafe(F.col("doc_id")))
    exact = found.join(w.select("query_id", "term", "qtf", "idf", "avgdl"), ["query_id", "term"])
    phase1 = exact.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    top1 = rank(phase1, k).checkpoint(eager=True)  # k rows for each query, read three times
    theta = top1.filter(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    bound = w.groupBy("query_id").agg(F.sum(F.when(~F.col("rare"), F.col("ub")).otherwise(F.lit(0.0))).alias("u"))
    # Finished: no common term at all (other documents score 0 and are not
    # hits), or the common terms cannot lift an outside document to theta.
    ok = bound.join(theta, "query_id", "left").filter(
        (F.col("u") == 0) | (F.col("theta").isNotNull() & (F.col("u") + F.lit(10.0 ** -SCORE_DIGITS) < F.col("theta")))
    ).select("query_id")
    ok = F.broadcast(ok)  # one row per query
    done = top1.join(ok, "query_id", "left_semi")
    rest = weighted.join(ok, "query_id", "left_anti")
    tail = rank(score_weighted(rest, index, True, k1, b), k)
    return done.select(*out).unionByName(tail.select(*out))


def search_excluding(queries: DataFrame, index: KeywordIndex, targets: DataFrame, paths: DataFrame, k: int = 3, exclude: str = "after", **kw) -> DataFrame:
    """C4 with both orders: ``after`` (the faithful default) ranks the top k
    first and drops self hits afterwards, which can leave nothing;
    ``before`` drops self documents first and ranks the rest.

    ``targets(query_id, target_file)``; ``paths(doc_id, relative_path)``.
    """
    if exclude == "after":
        hits = search(queries, index, k=k, **kw).join(paths, "doc_id")
        return exclude_self(hits, targets)
    scored = score(queries, index, **kw).join(paths, "doc_id").join(targets, "query_id")
    t = P.normalise(F.col("target_file"), lower=True)
    h = P.normalise(F.col("relative_path"), lower=True)
    keep = ~((t != "") & ((F.instr(h, t) > 0) | (F.instr(t, h) > 0)))
    ranked = rank(scored.filter(keep), 1)
    best = ranked.select("query_id", "doc_id", "relative_path")
    return targets.select("query_id").join(best, "query_id", "left").select(
        "query_id", "doc_id", "relative_path", F.col("doc_id").isNotNull().alias("found")
    )


def exclude_self(hits: DataFrame, targets: DataFrame, hit_path: str = "relative_path", target_path: str = "target_file") -> DataFrame:
    """C4: drop hits whose normalised path and the target contain one another.

    Applied to already-ranked hits (the reference filters *after* its
    top-k).  An empty hit path is always dropped; an empty target drops
    nothing.  Returns the first surviving hit per query, or a row with a
    null ``doc_id`` and ``found = false`` when none survives.
    """
    t = P.normalise(F.col(target_path), lower=True)
    h = P.normalise(F.col(hit_path), lower=True)
    joined = hits.join(targets, "query_id", "inner")
    overlap = (t != "") & ((F.instr(h, t) > 0) | (F.instr(t, h) > 0))
    kept = joined.filter(~overlap)
    best = kept.groupBy("query_id").agg(
        F.min_by(F.struct("doc_id", hit_path), F.col("rank")).alias("best")
    )
    return targets.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.col("best.doc_id").alias("doc_id"),
        F.col(f"best.{hit_path}").alias(hit_path),
        F.col("best").isNotNull().alias("found"),
    )
