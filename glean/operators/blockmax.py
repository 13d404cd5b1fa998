"""Block-max BM25 (C3, L4): exact top-k for query sets of any size, whole files as queries included.

``keyword.search`` emits a row for each (query term, posting), which a large query set
cannot afford: the rows of a common term are its queries times its documents.  Here
documents and queries meet in bounded blocks and only the best k of a block leave it.

**Index.**  Documents stand in order of (their most frequent term, length, id), so that like
documents stand together, and are cut into *slabs* of about ``slab_entries`` distinct
(document, term) entries by a balanced running total.  A slab carries the idf of its own terms: a
term stands once in each slab, so the join with the term statistics has no hot key.

**Search.**  Queries in chunks meet slabs in a ``cogroup``.  Inside, the entries of a term are ordered by
block of ``block_docs`` documents and by impact, and each (term, block) keeps its largest impact.
The sum of a query's largest impacts bounds every score of a block: the most promising
blocks are scored first, and a block whose bound is below the running k-th score is skipped.

Two rounds share that score between slabs.  Every query first visits its home slab, the one
where a document like it would stand; then the other slabs, with the k-th score of
the first round as its floor.

Both are exact: a skipped block cannot hold a hit.  What remains quadratic are the bounds; with
short or rare queries nearly all blocks are skipped, with whole files as queries those that
share only common words with the query and have them often enough stay.

Defined results: documents without tokens are in no block; queries without tokens have no hits;
documents with no term of the query are no hits; ties by document id; rows with a null id are neither indexed nor
searched (they count in the corpus statistics, as in ``keyword``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions import text as T
from glean.operators import keyword as K
from glean.operators.ordered import running_total
from glean.plans.strategy import spread
from glean.session import scratch_path

SLAB_ENTRIES = 1 << 20
LEAST_SLAB_ENTRIES = 1 << 15
BLOCK_DOCS = 8
QUERY_CHUNK = 4096
SCORE_SLACK = 2 * 10.0**-K.SCORE_DIGITS


@dataclass
class BlockIndex:
    """Tables: ``documents(slab, doc_id, dl, lead, terms, tfs)``, ``vocabulary(slab, term, idf)``, and ``slabs`` with the first document of each."""

    documents: DataFrame
    vocabulary: DataFrame
    slabs: DataFrame
    n_slabs: int
    avgdl: float

    @staticmethod
    def read(spark: SparkSession, path: str) -> "BlockIndex":
        head = spark.read.parquet(f"{path}/head").first()
        docs, vocabulary, slabs = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "vocabulary", "slabs"))
        return BlockIndex(docs, vocabulary, slabs, head["n_slabs"], head["avgdl"])


def _bags(df: DataFrame, id_col: str, text, tokenizer, out: str, path: str) -> DataFrame:
    """``out``, dl, terms, tfs and lead (the most frequent term, the least of equals) of every text with tokens.

    The bags are written before anything is read off them, so a text is tokenised once.
    """
    toks = spread(df.select(F.col(id_col).cast("bigint").alias(out), text.alias("t"))).select(out, tokenizer(F.col("t")).alias("toks"))
    toks.select(out, K.term_frequencies(F.col("toks")).alias("b")).write.parquet(path)
    bags = df.sparkSession.read.parquet(path).filter(F.get("b", F.lit(0))["term"].isNotNull())
    # Terms stand in order, so the first of the largest is the least of them.
    most = F.aggregate("b", F.get("b", F.lit(0)), lambda acc, x: F.when(x["tf"] > acc["tf"], x).otherwise(acc))
    length = F.aggregate("b", F.lit(0), lambda acc, x: acc + x["tf"])
    return bags.select(out, length.alias("dl"), most["term"].alias("lead"), F.col("b.term").alias("terms"), F.col("b.tf").alias("tfs"))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer=T.tokens, slab_entries: int | None = None) -> BlockIndex:
    """Write the block index of ``docs`` below ``path``.  Texts are tokenised once."""
    spark = docs.sparkSession
    bags = _bags(docs.filter(F.col(id_col).isNotNull()), id_col, F.col(text_col), tokenizer, "doc_id", f"{path}/bags")
    bags = bags.withColumn("all", F.lit(0))
    order = [F.col("lead"), F.col("dl"), F.col("doc_id")]
    ranked = running_total(bags, "all", order, F.size("terms"), "upto").drop("all")
    staged = f"{path}/staged"
    ranked.write.parquet(staged)
    ranked = spark.read.parquet(staged)
    sums = ranked.agg(F.max("upto").alias("n"), F.sum("dl").cast("double").alias("tokens")).first()
    # Small inputs get a slab for each core, large ones slabs of bounded size.
    wide = math.ceil((sums["n"] or 0) / spark.sparkContext.defaultParallelism)
    size = slab_entries or min(SLAB_ENTRIES, max(LEAST_SLAB_ENTRIES, wide))
    slab = F.floor((F.col("upto") - 1) / size).cast("int")
    total, tokens = docs.count(), sums["tokens"] or 0.0  # texts without tokens count as documents
    ranked.withColumn("slab", slab).drop("upto").write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    entries = documents.select("slab", F.explode("terms").alias("term")).groupBy("slab", "term").agg(F.count(F.lit(1)).alias("n"))
    entries.write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    counts.join(df.select("term", idf.alias("idf")), "term").select("slab", "term", "idf").write.parquet(f"{path}/vocabulary")
    first = documents.groupBy("slab").agg(F.min(F.struct("lead", "dl", "doc_id")).alias("first"))
    first.write.parquet(f"{path}/slabs")
    n_slabs = math.ceil((sums["n"] or 0) / size)
    spark.createDataFrame([(n_slabs, tokens / total if total else 0.0)], "n_slabs int, avgdl double").write.parquet(f"{path}/head")
    return BlockIndex.read(spark, path)


class Slab:
    """The entries of one slab, by term, block and impact."""

    def __init__(self, docs, vocabulary, avgdl: float, k1: float, b: float, block_docs: int) -> None:
        import numpy as np

        docs = docs.sort_values(["lead", "dl", "doc_id"])
        self.ids = docs["doc_id"].to_numpy(np.int64)
        self.number = dict(zip(vocabulary["term"], range(len(vocabulary))))
        idf = vocabulary["idf"].to_numpy(np.float64)
        sizes = np.array([len(t) for t in docs["terms"]], np.int64)
        term = np.fromiter((self.number[t] for terms in docs["terms"] for t in terms), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(docs)), sizes)
        tf = np.concatenate([np.asarray(t, np.float64) for t in docs["tfs"]]) if len(docs) else np.empty(0)
        dl = np.repeat(docs["dl"].to_numpy(np.float64), sizes)
        part = idf[term] * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))
        block = doc // block_docs
        order = np.lexsort((-part, block, term))
        self.doc, self.part, term, block = doc[order], part[order], term[order], block[order]
        # One group for each (term, block): its first entry has the largest impact.
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.empty(0, np.int64)
        self.group_begin = np.append(new, len(term))
        self.group_block, self.group_top = block[new], self.part[new]
        self.term_begin = np.searchsorted(term[new], np.arange(len(vocabulary) + 1))
        self.block_docs, self.n_blocks = block_docs, -(-len(docs) // block_docs)

    def best(self, terms, weights, k: int, floor: float):
        """(places, scores, documents scored): the k best, equal scores by id."""
        import numpy as np

        at = [(i, w) for t, w in zip(terms, weights) if (i := self.number.get(t)) is not None]
        none = np.empty(0, np.int64), np.empty(0), 0
        if not at:
            return none
        number, weight = np.array([a[0] for a in at]), np.array([float(a[1]) for a in at])
        groups, of = _ranges(self.term_begin[number], self.term_begin[number + 1])
        weight = weight[of]
        bound = np.bincount(self.group_block[groups], weight * self.group_top[groups], self.n_blocks)
        first = np.argsort(-bound, kind="stable")[: max(1, -(-2 * k // self.block_docs))]
        chosen = np.zeros(self.n_blocks, bool)
        chosen[first] = bound[first] + SCORE_SLACK >= floor
        scores = self._scores(groups, weight, chosen)
        if np.count_nonzero(scores) >= k:
            floor = max(floor, float(np.partition(scores, -k)[-k]))
        rest = (bound + SCORE_SLACK >= floor) & (bound > 0)
        rest[first] = False
        if rest.any():
            scores += self._scores(groups, weight, rest)
        chosen |= rest
        scores = np.round(scores, K.SCORE_DIGITS)
        hit = np.flatnonzero(scores > 0)
        hit = hit[np.lexsort((self.ids[hit], -scores[hit]))][:k]
        return hit, scores[hit], int(chosen.sum()) * self.block_docs

    def _scores(self, groups, weight, blocks):
        import numpy as np

        use = blocks[self.group_block[groups]]
        g = groups[use]
        entries, of = _ranges(self.group_begin[g], self.group_begin[g + 1])
        return np.bincount(self.doc[entries], weight[use][of] * self.part[entries], len(self.ids))


def _ranges(begin, end):
    """(begin[0], ..., end[0]-1, begin[1], ...) and which range each number is of."""
    import numpy as np

    n = end - begin
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    return np.repeat(begin - upto + n, n) + np.arange(total), np.repeat(np.arange(len(n)), n)


HITS = "query_id bigint, doc_id bigint, score double, scored bigint"


def _kernel(k: int, avgdl: float, k1: float, b: float, block_docs: int):
    def run(key, queries, slab):
        import pandas as pd

        out = []
        if len(queries) and len(slab):
            s = Slab(slab[slab["term"].isna()], slab[slab["term"].notna()], avgdl, k1, b, block_docs)
            for q, terms, qtfs, floor in zip(queries["query_id"], queries["terms"], queries["tfs"], queries["floor"]):
                places, scores, scored = s.best(terms, qtfs, k, floor)
                # The first row of a query and slab carries the number of documents scored, also where none is a hit.
                out += [(q, s.ids[p], x, scored if i == 0 else 0) for i, (p, x) in enumerate(zip(places, scores))] or [(q, -1, 0.0, scored)]
        frame = pd.DataFrame(out, columns=["query_id", "doc_id", "score", "scored"])
        return frame.astype({"query_id": "int64", "doc_id": "int64", "score": "float64", "scored": "int64"})

    return run


def scored_blocks(
    queries: DataFrame,
    index: BlockIndex,
    k: int = 3,
    id_col: str = "query_id",
    text_col: str = "query",
    k1: float = K.K1,
    b: float = K.B,
    tokenizer=T.tokens,
    block_docs: int = BLOCK_DOCS,
    query_chunk: int = QUERY_CHUNK,
) -> DataFrame:
    """At most k rows for each query and slab, and what it cost: query_id, doc_id, score, scored (documents scored for the
    query in the slab, on its first row; doc_id -1 and score 0 where there is no hit)."""
    spark = queries.sparkSession
    bags = _bags(queries.filter(F.col(id_col).isNotNull()), id_col, T.normalise_query(F.col(text_col)), tokenizer, "query_id", scratch_path(spark, "bags"))
    if index.n_slabs == 0:
        return spark.createDataFrame([], HITS)
    chunks = max(1, -(-bags.count() // query_chunk))
    # Slabs are numbered in order, so a query's home is the number of slabs that begin at or before it.
    marks = index.slabs.select(F.col("first.lead").alias("lead"), F.col("first.dl").alias("dl"), F.lit(0).cast("bigint").alias("query_id"), F.lit(1).alias("mark"))
    asked = bags.select("lead", "dl", "query_id", F.lit(0).alias("mark"))
    order = [F.col("lead"), F.col("dl"), F.col("mark").desc(), F.col("query_id")]
    homes = running_total(marks.unionByName(asked).withColumn("all", F.lit(0)), "all", order, "mark", "begun").filter("mark = 0")
    homes = homes.select("query_id", F.greatest(F.col("begun") - 1, F.lit(0)).cast("int").alias("home"))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")
    bags = bags.join(homes, "query_id").select("query_id", "terms", "tfs", "home", chunk)
    path = scratch_path(spark, "homes")
    bags.write.parquet(path)
    bags = spark.read.parquet(path)

    docs = index.documents.select("slab", "doc_id", "dl", "lead", "terms", "tfs", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("idf"))
    # Rows with a term are the slab's vocabulary.  Their ids are 0, not null: pandas would turn the column into floats.
    empty = [F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).alias("dl"), F.lit("").alias("lead")]
    empty += [F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<int>").alias("tfs")]
    sides = docs.unionByName(index.vocabulary.select("slab", *empty, "term", "idf"))
    sides = sides.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kernel = _kernel(k, index.avgdl, k1, b, block_docs)

    def met(asked: DataFrame) -> DataFrame:
        hits = asked.groupBy("slab", "chunk").cogroup(sides.groupBy("slab", "chunk")).applyInPandas(kernel, HITS)
        to = scratch_path(spark, "hits")
        hits.write.parquet(to)
        return spark.read.parquet(to)

    first = met(bags.select("query_id", "terms", "tfs", F.col("home").alias("slab"), "chunk", F.lit(0.0).alias("floor")))
    kth = K.rank(first.filter("doc_id >= 0"), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = bags.join(kth, "query_id", "left").withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(index.n_slabs - 1))))
    others = others.filter("slab <> home").select("query_id", "terms", "tfs", "slab", "chunk", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    return first.unionByName(met(others))


def search(queries: DataFrame, index: BlockIndex, k: int = 3, **kw) -> DataFrame:
    """Top-k BM25 hits per query: (query_id, rank, doc_id, score), equal to ``keyword.search``."""
    hits = scored_blocks(queries, index, k, **kw).filter("doc_id >= 0")
    return K.rank(hits.select("query_id", "doc_id", "score"), k).select("query_id", "rank", "doc_id", "score")
