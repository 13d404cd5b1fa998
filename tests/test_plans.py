"""Physical-plan checks: pruning, pushdown, no Cartesian products, skew-safe windows."""

import pytest

from glean.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("key", sorted(k for k in load_all() if not k.startswith("stream_")))
def test_no_cartesian_product(spark, key):
    assert "CartesianProduct" not in plan(load_all()[key].fn(spark, SF))


def test_flagship_prunes_and_pushes_down(spark):
    text = formatted(load_all()["retrieval_eval"].fn(spark, SF))
    assert "PushedFilters: [IsNotNull(source), IsNotNull(text), Not(EqualTo(source,src0))" in text
    for line in text.splitlines():
        if line.startswith("ReadSchema") and "text:string" in line:
            assert "n_chars" not in line  # unused column not read
    assert "BroadcastHashJoin" in text and "WindowGroupLimit" in text


def test_history_windows_are_split_by_range(spark):
    """Windows over rows are keyed by the stored range and the key, so a hot key is many tasks."""
    for key in ("trim_history", "tool_context"):
        p = plan(load_all()[key].fn(spark, SF))
        assert "hashpartitioning(_range" in p and "Python" not in p and "Pandas" not in p
    assert "WindowGroupLimit" in plan(load_all()["attempts"].fn(spark, SF))


def test_exact_quantiles_sort_nothing(spark):
    from pyspark.sql import functions as F

    from glean.operators import risk as R

    assert "rangepartitioning" not in plan(load_all()["describe"].fn(spark, SF))
    # A pass shuffles counts (combined before the exchange), and its window runs over buckets.
    long = R.unpivot(spark.range(1000).select(F.rand(1).alias("x")), ["x"])
    p = plan(R._counted(long, ["column_name"], R._binade(F.col("value")), "value"))
    assert "rangepartitioning" not in p and "partial_count" in p


def test_hot_term_spans_several_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from glean.operators import keyword as K

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.col("id")).alias("text"))
    stored = K.build_index(docs).write(str(tmp_path / "idx"), buckets=8)
    files = stored.postings.filter("term = 'common'").select(F.input_file_name()).distinct().count()
    assert files > 1 and stored.term_stats.filter("term = 'common'").first()["df"] == 4000


def test_knn_has_no_all_pairs_join(spark):
    p = plan(load_all()["knn_top10"].fn(spark, SF))
    assert "FlatMapCoGroupsInPandas" in p
    assert "CartesianProduct" not in p


def test_persisted_search_pushes_query_terms_into_scan(spark, tmp_path):
    from glean.operators import keyword as K
    from glean.plans import retrieval as RT
    from glean.sources import tables

    stored = RT.index(spark, SF).write(str(tmp_path / "idx"), buckets=4)
    text = formatted(K.search(tables.retrieval_queries(spark, SF), stored, k=3))
    assert "PushedFilters: [In(term," in text or "PushedFilters: [IsNotNull(term), In(term," in text
