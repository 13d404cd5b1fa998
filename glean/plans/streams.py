"""Streaming queries (I1-I3): driven to completion with ``availableNow``.

Each query streams one driver table file, writes through ``foreachBatch``
to a table below the shared checkpoint folder and returns that table, so
the final state can be compared with the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glean.functions import text as T
from glean.operators import keyword as K
from glean.plans.corpus import SQL_STRIDE
from glean.plans.history import SQL_STATUS
from glean.plans.registry import register, sql_rel_path
from glean.sources import tables
from glean.streaming import incremental as S


def _stream(spark, sf, name):
    """The table as a stream, be it one Parquet file or a folder of them.

    The path is a pattern that only the table matches: a file given by its plain path is no base path for a stream.
    """
    schema = tables.read(spark, sf, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{sf.rstrip('/')}/{name}.parque[t]")
    )


@register(
    "stream_index",
    sql=f"""WITH {SQL_STRIDE.replace('FROM documents)', "FROM documents WHERE source = 'src0')")}
SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5 FROM k""",
    ids=("I1", "A6"),
)
def q_stream_index(spark, sf):
    docs = _stream(spark, sf, "documents")
    rel = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = docs.withColumn("relative_path", rel).withColumn(
        "status", F.when(F.col("source") == tables.TEST_SOURCE, F.lit("passed")).otherwise(F.lit("pending"))
    ).select("doc_id", "relative_path", "text", "status")
    out, ckpt = S.scratch(spark, "self-feed")
    S.self_feed(docs, out, ckpt)
    return spark.read.parquet(out).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@register(
    "stream_keyword_index",
    sql=f"""WITH {SQL_STRIDE.replace('FROM documents)', "FROM documents WHERE source = 'src0')")},
t AS (SELECT (doc_id, chunk_no) AS chunk_id, unnest(regexp_extract_all(lower(chunk), '{T.TOKEN_PATTERN}', 0)) AS term FROM k)
SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    ids=("I1", "A8", "D10"),
)
def q_stream_keyword_index(spark, sf):
    """Self-feeding keyword index: every micro-batch of passing files adds
    postings and df deltas; the summed index equals a batch build."""
    docs = _stream(spark, sf, "documents")
    docs = docs.withColumn(
        "status", F.when(F.col("source") == tables.TEST_SOURCE, F.lit("passed")).otherwise(F.lit("pending"))
    ).withColumn("relative_path", F.lit("")).select("doc_id", "relative_path", "text", "status")
    out, ckpt = S.scratch(spark, "self-feed-index")
    idx_path = S.scratch(spark, "incremental-index")[0]
    S.self_feed(docs, out, ckpt, index_path=idx_path)
    idx = K.read_increments(spark, idx_path)
    cf = idx.postings.groupBy("term").agg(F.sum("tf").cast("bigint").alias("cf"))
    return idx.term_stats.select("term", "df").join(cf, "term")


@register(
    "stream_attempts",
    sql=f"""
WITH s AS (
  SELECT user_id, {SQL_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events
),
a AS (
  SELECT user_id, min(CASE WHEN status = 'passed' OR attempt >= 3 THEN attempt END) AS stop_at, max(attempt) AS last_at
  FROM s GROUP BY user_id
)
SELECT a.user_id, coalesce(stop_at, last_at) AS attempts, s.status,
       CASE WHEN stop_at IS NOT NULL THEN 'finish' ELSE 'fix_code' END AS route
FROM a JOIN s ON s.user_id = a.user_id AND s.attempt = coalesce(stop_at, last_at)""",
    ids=("I2", "E8"),
)
def q_stream_attempts(spark, sf):
    ev = _stream(spark, sf, "events")
    m = F.create_map(*[F.lit(x) for kv in tables.EVENT_STATUS.items() for x in kv])
    ev = ev.withColumn("status", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("pending")))
    state = S.attempt_state(ev.select("user_id", "ts", "event_id", "status"), "user_id", ["ts", "event_id"])
    out, ckpt = S.scratch(spark, "attempts")
    S.run_to_table(state, out, ckpt)
    t = spark.read.parquet(out)
    last = t.groupBy("user_id").agg(F.max(F.struct("epoch", "attempts", "status", "route")).alias("m"))
    return last.select("user_id", "m.attempts", "m.status", "m.route")


@register(
    "stream_changes",
    sql="""SELECT user_id, epoch_us(max(ts)) AS ts_us, max(event_type) FILTER (WHERE r = 1) AS event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) GROUP BY user_id""",
    ids=("I3", "E6"),
)
def q_stream_changes(spark, sf):
    ev = _stream(spark, sf, "events")
    feed = S.change_feed(ev, "user_id", "event_type")
    out, ckpt = S.scratch(spark, "changes")
    S.run_to_table(feed, out, ckpt)
    # The feed holds one row per key and trigger that changed it; the last one counts.
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max(F.struct("epoch", "ts", "event_type")).alias("m"))
    return last.select("user_id", F.unix_micros(F.col("m.ts").cast("timestamp")).alias("ts_us"), "m.event_type")


@register(
    "stream_history",
    sql="""
WITH e AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type <> ''),
l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e),
c AS (SELECT * FROM l WHERE prev IS NULL OR prev <> event_type)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM c""",
    ids=("I3", "E6"),
)
def q_stream_history(spark, sf):
    """The history that a stream of events recorded step by step, read back after its last step."""
    order = ["ts", "event_id"]
    out, ckpt = S.scratch(spark, "history")
    S.record_history(_stream(spark, sf, "events"), "user_id", order, "event_type", out, ckpt)
    return S.history_at(spark, out, "user_id", order, "event_type").select("user_id", "event_id", "event_type", "version")
