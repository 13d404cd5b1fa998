"""Ordered per-key computations that stay balanced when one key is huge.

``Window.partitionBy(key)`` sends every row of a key to one task.  When a
single key can hold a third of all rows that task is the whole job, so the
running totals here use a distributed prefix sum instead:

1. ``repartitionByRange(key, order...)``: the sampled range bounds split a
   hot key across many partitions (its rows differ in the order columns).
   The partition count follows the input's estimated size (about 128 MB
   per partition), since a range partition is never split later.
2. The ranged rows are written once to the shared checkpoint folder with
   the number of their range, so every later step sees the same ranges.
3. Windows over (range, key) give the totals within a range, and a window
   per key over one row for each (range, key) what stands before it.

The result equals ``sum(value) OVER (PARTITION BY key ORDER BY order ROWS
BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)`` for integral values; null is
a key like any other.  Ties in ``order`` must be broken by the caller (make
the order unique) for the result to be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glean.plans.strategy import partitions_for
from glean.session import scratch_path

RANGE = "_range"


def _ranged(df: DataFrame, key: str, order: list[Column], partitions: int | None) -> DataFrame:
    """``df`` with the number of its range, written once.  Rows of a key stand in ascending ranges."""
    n = partitions or partitions_for(df)
    ranged = df.repartitionByRange(n, F.col(key), *order).withColumn(RANGE, F.spark_partition_id())
    path = scratch_path(df.sparkSession, "ranged")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def _carried(ends: DataFrame, key: str, local: DataFrame) -> DataFrame:
    """``local`` with the columns of ``ends`` (one row for each range and key)."""
    e = ends.withColumnsRenamed({key: "_k", RANGE: "_r"})
    return local.join(e, F.col(key).eqNullSafe(F.col("_k")) & (F.col(RANGE) == F.col("_r")), "left").drop("_k", "_r")


def running_total(
    df: DataFrame,
    key: str,
    order: list[Column],
    value: Column | str,
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Running ``sum(value)`` per ``key`` along ``order`` (integral values)."""
    val = value if isinstance(value, Column) else F.col(value)
    rows = _ranged(df.withColumn("_v", val.cast("long")), key, order, partitions)
    sums = rows.groupBy(key, RANGE).agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.select(key, RANGE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(RANGE, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("_v").over(within))
    return _carried(ends, key, local).withColumn(out, F.col("_before") + F.col("_local")).drop(RANGE, "_v", "_local", "_before")


def ordinal(df: DataFrame, key: str, order: list[Column], out: str = "pos", partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its key along ``order``."""
    return running_total(df, key, order, F.lit(1), out, partitions)


def ordinal_lag(df: DataFrame, key: str, order: list[Column], cols: list[str], out: str = "pos", prefix: str = "prev_", partitions: int | None = None) -> DataFrame:
    """Position along ``order`` within ``key`` and the previous row's
    ``cols`` (``lag``) in one pass, with no self-join.

    The first row of a key in a range takes the last row of the key's range
    before.
    """
    rows = _ranged(df, key, order, partitions)
    within = Window.partitionBy(RANGE, key).orderBy(*order)
    local = rows.select(
        "*",
        F.row_number().over(within).alias("_local"),
        *[F.lag(c).over(within).alias(f"_lag_{c}") for c in cols],
        F.lead(F.lit(1)).over(within).isNull().alias("_last"),
    )
    last = local.filter("_last").select(key, RANGE, "_local", *[F.col(c).alias(f"_end_{c}") for c in cols])
    ranges = Window.partitionBy(key).orderBy(RANGE)
    ends = last.select(
        key,
        RANGE,
        F.coalesce(F.sum("_local").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *[F.lag(f"_end_{c}").over(ranges).alias(f"_end_{c}") for c in cols],
    )
    j = _carried(ends, key, local)
    prev = [F.when(F.col("_local") == 1, F.col(f"_end_{c}")).otherwise(F.col(f"_lag_{c}")).alias(prefix + c) for c in cols]
    return j.select(*df.columns, (F.col("_before") + F.col("_local")).alias(out), *prev)
