"""Message-history and status-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glean.functions import text as T
from glean.operators import history as H
from glean.plans.registry import register, sql_strip
from glean.sources import tables

SP = T.PY_SPACE
TRIM_BUDGET = 100  # words; small enough that trimming bites on this data
TRIGGER = ","


def _tool_messages(spark, sf):
    """Conversations with assistant messages playing the tool messages."""
    m = tables.messages(spark, sf)
    return m.withColumn("type", F.when(F.col("role") == "assistant", F.lit("tool")).otherwise(F.col("type")))


def _line_blocks(spark, sf):
    # A tool message mentioning "No reference" contributes no blocks.
    m = _tool_messages(spark, sf).filter((F.col("type") == "tool") & (F.instr("text", T.NO_REFERENCE) == 0))
    return m.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "block"))


SQL_LINE_BLOCKS = """
b AS (
  SELECT conv_id, turn, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS block
  FROM conversations WHERE role = 'assistant' AND strpos(text, 'No reference') = 0
)"""


# --- E4 --------------------------------------------------------------------
@register(
    "trim_history",
    sql=f"""
WITH m AS (
  SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^{SP}]+', 0)) AS INTEGER) AS n_words
  FROM conversations WHERE role <> 'system'
),
r AS (
  SELECT conv_id, turn, n_words,
         CAST(sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS suffix_words
  FROM m
)
SELECT conv_id, turn, n_words, suffix_words FROM r WHERE suffix_words <= {TRIM_BUDGET}""",
    ids=("E4",),
)
def q_trim_history(spark, sf):
    return H.trim(tables.messages(spark, sf), TRIM_BUDGET).select("conv_id", "turn", "n_words", "suffix_words")


# --- E5 --------------------------------------------------------------------
@register(
    "first_seen",
    sql=f"""
WITH {SQL_LINE_BLOCKS.strip()},
s AS (SELECT conv_id, turn, pos, {sql_strip('block')} AS block FROM b),
f AS (SELECT conv_id, block, min((turn, pos)) AS o FROM s GROUP BY conv_id, block)
SELECT conv_id, o[1] AS turn, CAST(o[2] AS INTEGER) AS pos, block FROM f""",
    ids=("E5",),
)
def q_first_seen(spark, sf):
    return H.first_seen(_line_blocks(spark, sf))


# --- D13 -------------------------------------------------------------------
@register(
    "distinct_blocks",
    sql=f"""
WITH {SQL_LINE_BLOCKS.strip()},
s AS (SELECT conv_id, turn, pos, {sql_strip('block')} AS block FROM b WHERE length({sql_strip('block')}) > 0),
f AS (SELECT conv_id, block, min((turn, pos)) AS o FROM s GROUP BY conv_id, block),
q AS (SELECT conv_id, block, row_number() OVER (PARTITION BY conv_id ORDER BY o[1], o[2]) AS seq FROM f)
SELECT conv_id, seq, CASE WHEN seq = 1 THEN block ELSE chr(10) || chr(10) || block END AS piece FROM q""",
    ids=("D13", "H-s14", "E5"),
)
def q_distinct_blocks(spark, sf):
    return H.distinct_blocks(_line_blocks(spark, sf))


# --- E6 --------------------------------------------------------------------
@register(
    "change_log",
    sql="""
WITH e AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type <> ''),
l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e),
c AS (SELECT * FROM l WHERE prev IS NULL OR prev <> event_type)
SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM c""",
    ids=("E6", "I3"),
)
def q_change_log(spark, sf):
    e = tables.read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    out = H.changes(e, "user_id", [F.col("ts"), F.col("event_id")], "event_type")
    return out.select("user_id", "event_id", "event_type", "version")


# --- E7 --------------------------------------------------------------------
@register(
    "latest_match",
    sql=f"""
SELECT conv_id, coalesce({sql_strip("arg_max(text, turn) FILTER (WHERE role = 'assistant' AND strpos(text, '" + TRIGGER + "') > 0)")}, '') AS message
FROM conversations GROUP BY conv_id""",
    ids=("E7",),
)
def q_latest_match(spark, sf):
    return H.latest(tables.messages(spark, sf), TRIGGER, "ai")


# --- E8 --------------------------------------------------------------------
SQL_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'passed' ELSE 'pending' END"


@register(
    "attempts",
    sql=f"""
WITH s AS (
  SELECT user_id, {SQL_STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events
),
a AS (
  SELECT user_id, min(CASE WHEN status = 'passed' OR attempt >= {H.MAX_ATTEMPTS} THEN attempt END) AS stop_at, max(attempt) AS last_at
  FROM s GROUP BY user_id
)
SELECT a.user_id, coalesce(stop_at, last_at) AS attempts, s.status,
       CASE WHEN stop_at IS NOT NULL THEN 'finish' ELSE 'fix_code' END AS route
FROM a JOIN s ON s.user_id = a.user_id AND s.attempt = coalesce(stop_at, last_at)""",
    ids=("E8", "B12"),
)
def q_attempts(spark, sf):
    return H.attempts(tables.status_log(spark, sf))


# --- D12 -------------------------------------------------------------------
@register(
    "tool_context",
    sql="""
WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations WHERE role = 'assistant')
SELECT conv_id, seq, CASE WHEN seq = 1 THEN text ELSE chr(10) || chr(10) || text END AS piece FROM t""",
    ids=("D12",),
)
def q_tool_context(spark, sf):
    return H.tool_context(_tool_messages(spark, sf))


# --- D16 -------------------------------------------------------------------
@register(
    "has_tool",
    sql="SELECT conv_id, coalesce(bool_or(role = 'assistant' AND strpos(text, 'the') > 0), false) AS has_tool FROM conversations GROUP BY conv_id",
    ids=("D16",),
)
def q_has_tool(spark, sf):
    m = _tool_messages(spark, sf)
    return H.has_message(m, (F.col("type") == "tool") & (F.instr("text", "the") > 0))


# --- B17 -------------------------------------------------------------------
@register(
    "tool_success",
    sql="""
SELECT conv_id, arg_max(role, turn) = 'assistant' AND conv_id % 2 = 0 AS success
FROM conversations GROUP BY conv_id""",
    ids=("B17",),
)
def q_tool_success(spark, sf):
    # Stand-in text: messages of every second conversation report success, in small letters.
    report = F.when(F.col("conv_id") % 2 == 0, F.lit(" success")).otherwise(F.lit(" failure"))
    m = _tool_messages(spark, sf)
    return H.tool_success(m.withColumn("text", F.concat("text", report)), "tool", ("SUCCESS",))


# --- B20 -------------------------------------------------------------------
@register(
    "last_message",
    sql="SELECT conv_id, CASE WHEN arg_max(role, turn) = 'user' THEN 'continue' ELSE 'finish' END AS route FROM conversations GROUP BY conv_id",
    ids=("B20",),
)
def q_last_message(spark, sf):
    m = tables.messages(spark, sf)
    return H.should_continue(m, F.col("type") == "human")
