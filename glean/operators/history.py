"""Message histories and status logs.

Histories are tables ``(conv_id, turn, type, text)``; one conversation may
be arbitrarily long.  Running totals and positions come from
:mod:`glean.operators.ordered` (balanced even for one huge key); per-key
"latest" / "first" questions are grouped ``max``/``min`` aggregates over
structs, which combine map-side.  Collected outputs are returned as
ordered rows ``(key, seq, piece)`` rather than one array per key, so no
group is ever gathered into a single value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.functions import text as T
from glean.operators.ordered import ordinal, ordinal_lag, running_total

# Message budgets of the agents and the default.
BUDGET_AGENT = 10_000
BUDGET_RESEARCHER = 50_000
BUDGET_DEFAULT = 3_000
MAX_ATTEMPTS = 3
CONTEXT_SEPARATOR = "\n\n"


def word_count(col: Column) -> Column:
    """Pluggable size of a message: white-space separated words."""
    return F.size(F.regexp_extract_all(col, F.lit(f"[^{T.PY_SPACE}]+"), 0))


def trim(df: DataFrame, budget: int = BUDGET_DEFAULT, key: str = "conv_id", order: str = "turn", size=word_count) -> DataFrame:
    """Drop system messages, keep the longest suffix of whole messages
    whose total size fits ``budget``."""
    msgs = df.filter(F.col("type") != "system").withColumn("n_words", size(F.col("text")))
    run = running_total(msgs, key, [F.col(order).desc()], "n_words", "suffix_words")
    return run.filter(F.col("suffix_words") <= budget)


def first_seen(blocks: DataFrame, key: str = "conv_id", text_col: str = "block", order: tuple[str, ...] = ("turn", "pos")) -> DataFrame:
    """E5: first occurrence of every stripped block text within a key.

    A grouped ``min`` over (order...) per (key, text): combines map-side, so
    many copies of one block never meet in one task.
    """
    stripped = T.py_strip(F.col(text_col))
    first = blocks.withColumn("_s", stripped).groupBy(key, "_s").agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("_o")
    )
    return first.select(key, *[F.col(f"_o.{c}").alias(c) for c in order], F.col("_s").alias(text_col))


def result_blocks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """H-s14 as rows: one row per result block with its position."""
    return df.select("*", F.posexplode(T.split_blocks(F.col(text_col))).alias("pos", "block")).drop(text_col)


def changes(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Versions of ``value``: non-empty and different from the previous
    emitted one, numbered from 1 per key."""
    non_empty = df.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    with_prev = ordinal_lag(non_empty, key, order, [value], "_pos")
    changed = with_prev.filter(F.col("prev_" + value).isNull() | (F.col("prev_" + value) != F.col(value)))
    return ordinal(changed.drop("prev_" + value), key, [F.col("_pos")], "version").drop("_pos")


def latest(df: DataFrame, trigger: str, msg_type: str = "ai", key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Newest message of ``msg_type`` containing ``trigger``, stripped; '' if none."""
    hit = (F.col("type") == msg_type) & (F.instr(F.col("text"), trigger) > 0)
    agg = df.groupBy(key).agg(F.max(F.when(hit, F.struct(F.col(order), F.col("text")))).alias("_m"))
    return agg.select(key, F.coalesce(T.py_strip(F.col("_m.text")), F.lit("")).alias("message"))


def attempts(log: DataFrame, key: str = "user_id", order: list[Column] | None = None, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One execution per row; stop at the first ``passed`` or when the
    attempt count reaches ``max_attempts`` (floored at 1).

    Returns per key: attempts used, the last status and the route
    (``finish`` when stopped, ``fix_code`` when still retrying).
    """
    max_attempts = max(1, int(max_attempts))
    order = order or [F.col("ts"), F.col("event_id")]
    # Only the first rows of a key can matter: the rank limit is applied before the shuffle.
    first = Window.partitionBy(key).orderBy(*order)
    pos = log.withColumn("attempt", F.row_number().over(first)).filter(F.col("attempt") <= max_attempts)
    pos = pos.withColumn("attempt", F.col("attempt").cast("long"))
    stop = (F.col("status") == "passed") | (F.col("attempt") >= max_attempts)
    agg = pos.groupBy(key).agg(
        F.min(F.when(stop, F.struct(F.col("attempt"), F.col("status")))).alias("_stop"),
        F.max(F.struct(F.col("attempt"), F.col("status"))).alias("_last"),
    )
    final = F.coalesce(F.col("_stop"), F.col("_last"))
    return agg.select(
        key,
        final["attempt"].alias("attempts"),
        final["status"].alias("status"),
        F.when(F.col("_stop").isNotNull(), F.lit("finish")).otherwise(F.lit("fix_code")).alias("route"),
    )


def tool_context(df: DataFrame, key: str = "conv_id", order: str = "turn", tool_type: str = "tool", sep: str = CONTEXT_SEPARATOR) -> DataFrame:
    """D12 as ordered pieces: the context text is the concatenation of
    ``piece`` in ``seq`` order (the separator is carried by the piece)."""
    tools = df.filter(F.col("type") == tool_type)
    seq = ordinal(tools, key, [F.col(order)], "seq")
    piece = F.when(F.col("seq") == 1, F.col("text")).otherwise(F.concat(F.lit(sep), F.col("text")))
    return seq.select(key, "seq", piece.alias("piece"))


def distinct_blocks(blocks: DataFrame, key: str = "conv_id", text_col: str = "block", sep: str = CONTEXT_SEPARATOR) -> DataFrame:
    """First-seen distinct blocks in first-seen order, as ordered pieces."""
    fs = first_seen(blocks.filter(F.length(T.py_strip(F.col(text_col))) > 0), key, text_col)
    seq = ordinal(fs, key, [F.col("turn"), F.col("pos")], "seq")
    piece = F.when(F.col("seq") == 1, F.col(text_col)).otherwise(F.concat(F.lit(sep), F.col(text_col)))
    return seq.select(key, "seq", piece.alias("piece"))


def has_message(df: DataFrame, cond: Column, key: str = "conv_id", out: str = "has_tool") -> DataFrame:
    """Whether any message of the key satisfies ``cond``."""
    return df.groupBy(key).agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(out))


def last_message(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest message of each key as a struct column ``last``."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(order), F.col("type"), F.col("text"))).alias("last"))


def tool_success(df: DataFrame, tool_type: str = "tool", marks=("SUCCESS",), key: str = "conv_id") -> DataFrame:
    """The newest message is a tool message whose upper-cased text
    contains one of ``marks``."""
    last = last_message(df, key)
    up = F.upper(F.col("last.text"))
    hit = None
    for m in marks:
        c = F.instr(up, m) > 0
        hit = c if hit is None else (hit | c)
    return last.select(key, ((F.col("last.type") == tool_type) & hit).alias("success"))


def should_continue(df: DataFrame, pending: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``continue`` when the newest message carries a pending call."""
    flagged = df.withColumn("_p", pending)
    last = flagged.groupBy(key).agg(F.max(F.struct(F.col(order), F.col("_p"))).alias("last"))
    return last.select(key, F.when(F.col("last._p"), F.lit("continue")).otherwise(F.lit("finish")).alias("route"))
