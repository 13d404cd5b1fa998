"""Driver tables and the stand-in views derived from them (FIXTURES.md §3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions import paths as P

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Stand-in rules (fixed values of the fixtures).
TEST_SOURCE = "src0"  # documents of this source play the seed/test side
ROLE_TYPES = {"user": "human", "assistant": "ai", "system": "system"}
EVENT_STATUS = {"error": "failed", "purchase": "passed"}  # others: pending


# Text and vector tables, whose per-row work (regular expressions,
# tokenizing, distances) should use every core.  Catalyst pushes filters and
# column pruning through the round-robin repartition of ``spread``, so scans
# still read only what the query needs; inputs that already arrive in many
# partitions are not repartitioned at all.  Numeric tables are not spread:
# their work after the scan is light or range-partitioned anyway (measured).
SPREAD = frozenset({"documents", "pages", "conversations", "embeddings"})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from glean.plans.strategy import spread

    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in SPREAD else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as DM2 rows: path, name, service, type and test flag."""
    d = read(spark, sf_dir, "documents")
    rel = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return (
        d.withColumn("relative_path", rel)
        .withColumn("is_test", F.col("source") == F.lit(TEST_SOURCE))
        .withColumn("file_name", P.basename(F.col("relative_path")))
        .withColumn("service", P.service(F.col("relative_path")))
        .withColumn("file_type", P.file_type(F.col("file_name"), F.col("is_test")))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message histories with a message ``type``."""
    c = read(spark, sf_dir, "conversations")
    m = F.create_map(*[F.lit(x) for kv in ROLE_TYPES.items() for x in kv])
    return c.withColumn("type", F.coalesce(F.try_element_at(m, F.col("role")), F.col("role")))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a test-status log keyed by ``user_id``."""
    e = read(spark, sf_dir, "events")
    m = F.create_map(*[F.lit(x) for kv in EVENT_STATUS.items() for x in kv])
    return e.withColumn("status", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("pending")))


def retrieval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM13 stand-in: benchmark text is the query, its first four words the keyword."""
    from glean.functions.text import first_words

    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        first_words(F.col("text"), 4).alias("keyword"),
    )
