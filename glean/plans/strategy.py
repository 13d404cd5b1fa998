"""Join-strategy helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows, so the check itself stays bounded
    however large the input is.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint when ``df`` is proven small; otherwise leave the choice
    to the planner (shuffle join, adaptive re-planning on runtime sizes)."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy work at least one partition per core.

    Inputs read from a few large row groups arrive as very few partitions;
    a round-robin repartition then spreads the work.  Large inputs already
    have many partitions and pass through untouched (no extra shuffle).
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access (e.g. Spark Connect)
        return df
    return df.repartition(target) if current < target else df


TARGET_PARTITION_BYTES = 128 * 1024 * 1024
MAX_PARTITIONS = 200_000


def estimated_bytes(df: DataFrame) -> int | None:
    """Bytes of the data a plan reads: the summed size estimates of its leaf
    relations (file sizes for scans).  Join estimates are not used: without
    cost-based statistics Spark multiplies the sides, which says nothing
    about the rows an operator really sees.  None when unknown."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            size = int(str(leaves.apply(i).stats().sizeInBytes()))
            if size >= (1 << 62):  # "unknown"
                return None
            total += size
        return total
    except Exception:  # noqa: BLE001 - e.g. sessions without JVM access
        return None


def partitions_for(df: DataFrame, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partition count for an explicit repartition of ``df``: at least the
    session's shuffle partitions, and enough that each holds about
    ``target_bytes`` (AQE can merge small partitions later, but it never
    splits a range partition)."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    if not size:
        return base
    return int(min(MAX_PARTITIONS, max(base, -(-size // target_bytes))))
