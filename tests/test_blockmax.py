"""Block-max search against exhaustive scoring, on slabs and chunks of every size and on odd input."""

import random

import pytest
from pyspark.sql import functions as F

from glean.operators import blockmax as BM
from glean.operators import keyword as K
from glean.plans import retrieval as RT
from glean.session import scratch_path

SF = "/root/testdata/sf0.001"


def rows(hits):
    return {(r.query_id, r.rank, r.doc_id, r.score) for r in hits.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(6)]
    texts = []
    for i in range(400):
        words = ["hot"] * rnd.randint(0, 30) + rnd.choices(common, k=rnd.randint(1, 60)) + [f"r{rnd.randint(0, 900)}" for _ in range(rnd.randint(0, 25))]
        rnd.shuffle(words)
        texts.append((i, " ".join(words)))
    texts += [(1000 + i, texts[7][1]) for i in range(5)]  # equal documents tie
    texts += [(2000, None), (2001, ""), (2002, " ?! "), (None, "hot c1 r1")]
    return spark.createDataFrame(texts, "doc_id bigint, text string")


@pytest.mark.parametrize("slab_entries, chunk", [(300, 64), (10**6, 10_000)])
def test_equals_exhaustive_scoring(spark, corpus, slab_entries, chunk):
    named = corpus.filter("doc_id IS NOT NULL")
    index = BM.build(named, scratch_path(spark, "bm"), slab_entries=slab_entries)
    assert index.n_slabs > 10 or slab_entries > 300
    queries = named.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    for k in (1, 5):
        want = rows(K.search(queries, K.build_index(named), k=k, prune=False))
        assert rows(BM.search(queries, index, k, query_chunk=chunk)) == want


def test_blocks_that_cannot_win_are_skipped(spark):
    """Rare words decide, so few of the documents that share the common word are scored."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("concat('common word', id % 100, ' only', id div 2, ' x', id % 7)").alias("text"))
    queries = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    index = BM.build(docs, scratch_path(spark, "bm"), slab_entries=2000)
    hits = BM.scored_blocks(queries, index, 2)
    scored = hits.agg(F.sum("scored")).first()[0]
    assert 0 < scored < 0.25 * 200 * 2000
    assert rows(BM.search(queries, index, 2)) == rows(K.search(queries, K.build_index(docs), k=2, prune=False))


def test_odd_input(spark, corpus):
    index = BM.build(corpus, scratch_path(spark, "bm"))
    queries = spark.createDataFrame([(1, None), (2, ""), (3, "unknown words"), (None, "hot"), (4, "hot c1")], "query_id bigint, query string")
    got = rows(BM.search(queries, index, 3))
    assert {q for q, *_ in got} == {4} and len(got) == 3
    empty = BM.build(corpus.limit(0), scratch_path(spark, "bm"))
    assert BM.search(queries, empty, 3).count() == 0
    assert BM.search(queries.limit(0), index, 3).count() == 0


def test_files_as_queries_at_the_smallest_scale(spark):
    docs = RT.keyword_docs(spark, SF)
    files = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    index = BM.build(docs, scratch_path(spark, "bm"), slab_entries=10_000)
    assert rows(BM.search(files, index, 3)) == rows(K.search(files, RT.index(spark, SF), k=3, prune=False))
