"""Chat formatting with cumulative-snapshot collapse.  DataFrame operations only.

A log may hold a conversation many times, once after each turn.  Every turn has a rolling hash of the turns up
to it: the exclusive-or of hashes of place and (role, text), two of 64 bits.  A logged conversation whose whole hash
is the rolling hash of a longer one at the same place is a prefix of it, and an anti-join removes it.  Of equal
conversations the one with the smallest id stays, with the number of copies.  What is left is rendered in
parts of ``PART_TURNS`` turns, so that a conversation of any length fits.

Turns stand by turn number, ties by role, then a hash of the text.  Places and rolling hashes are taken within stretches of
``PART_TURNS`` turn numbers and joined by prefix sums over stretches, so one long conversation spreads over tasks.

Defined results: null roles render as ``unknown`` and null texts as empty, yet differ from those for the hashes;
a repeated row is one more turn; rows with a null conv_id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glean.llm.common import stored

PART_TURNS = 256


# A conversation's key without nulls, so that joins and windows on it share one exchange.
KEY = ("key", "no_id")


def _keyed(turns: DataFrame) -> DataFrame:
    """The key, turn, stretch, role, text and two hashes of (role, text) of every row."""
    parts = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]
    return turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("key"),
        F.col("conv_id").isNull().alias("no_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.floor(F.coalesce("turn", F.lit(0)) / PART_TURNS).alias("stretch"),
        "role",
        "text",
        *[F.xxhash64(F.lit(seed), *parts).alias(f"t{seed}") for seed in (1, 2)],
    )


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_keyed`` with place (from 1) and n, the turns of the conversation."""
    counts = rows.groupBy(*KEY, "stretch").agg(F.count(F.lit(1)).alias("own"))
    earlier = W.partitionBy(*KEY).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(
        *KEY, "stretch", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("start"), F.sum("own").over(W.partitionBy(*KEY)).alias("n")
    )
    within = W.partitionBy(*KEY, "stretch").orderBy("turn", "role", "t1", "t2")
    both = rows.join(counts, [*KEY, "stretch"])
    return both.withColumn("place", F.col("start") + F.row_number().over(within)).drop("start", "turn")


def prefixes(turns: DataFrame) -> DataFrame:
    """The key, conv_id, place, n, p1, p2: the rolling hashes of every turn."""
    rows = stored(_places(_keyed(turns).drop("text")).drop("role"), "chat-hashes")
    rows = rows.select(*KEY, "stretch", "place", "n", *[F.xxhash64(F.lit(3), "place", t).alias(t) for t in ("t1", "t2")])
    earlier = W.partitionBy(*KEY).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*KEY, "stretch").agg(*[F.bit_xor(t).alias(t) for t in ("t1", "t2")])
    before = before.select(*KEY, "stretch", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(f"before_{t}") for t in ("t1", "t2")])
    within = W.partitionBy(*KEY, "stretch").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    both = rows.join(before, [*KEY, "stretch"])
    rolling = [F.bit_xor(t).over(within).bitwiseXOR(F.col(f"before_{t}")) for t in ("t1", "t2")]
    return both.select(F.when(~F.col("no_id"), F.col("key")).alias("conv_id"), "place", "n", rolling[0].alias("p1"), rolling[1].alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n, copies of the conversations that are no prefix of a longer one."""
    rows = stored(prefixes(turns), "chat-prefixes")
    whole = rows.filter("place = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = rows.filter("place < n").select(F.col("place").alias("n"), "p1", "p2").distinct()
    return whole.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", "n", "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, chat: the maximal conversations, a row for each ``PART_TURNS`` turns."""
    left = stored(maximal(turns), "chat-maximal")
    left = left.select(F.coalesce("conv_id", F.lit(0)).alias("key"), F.col("conv_id").isNull().alias("no_id"), "copies")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    kept = _keyed(turns).join(left.drop("copies"), list(KEY), "left_semi")
    parts = (
        _places(kept)
        .groupBy(*KEY, F.floor((F.col("place") - 1) / PART_TURNS).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("place", turn.alias("t")))).alias("turns"), F.max("n").alias("n_turns"))
    )
    conv_id = F.when(~F.col("no_id"), F.col("key")).alias("conv_id")
    return parts.join(left, list(KEY)).select(conv_id, "part", "n_turns", "copies", F.array_join(F.col("turns.t"), "").alias("chat"))


ORACLE_SQL = f"""
WITH logged AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id
), whole AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM logged GROUP BY turns
), inner_prefix AS (
  SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM whole)
), kept AS (
  SELECT * FROM whole WHERE turns NOT IN (SELECT turns FROM inner_prefix)
), placed AS (
  SELECT conv_id, copies, len(turns) AS n_turns, unnest(turns) AS turn, unnest(range(len(turns))) AS place FROM kept
)
SELECT conv_id, place // {PART_TURNS} AS part, n_turns, copies,
  string_agg('<|' || coalesce(turn.r, 'unknown') || '|>' || chr(10) || coalesce(turn.t, '') || '<|end|>' || chr(10), '' ORDER BY place) AS chat
FROM placed GROUP BY conv_id, place // {PART_TURNS}, n_turns, copies
"""
