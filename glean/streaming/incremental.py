"""Incremental operators on Structured Streaming.

* :func:`self_feed` (I1): passing test files are chunked and appended to
  the chunk table in ``foreachBatch``; every epoch writes its own folder in
  overwrite mode, so a replayed micro-batch cannot duplicate rows.
* :func:`attempt_state` (I2): keyed state per test target with
  ``transformWithStateInPandas``: attempts in event order, last status,
  route, and a timer that drops old keys.
* :func:`change_feed` (I3): per-step changed values in ``update`` mode;
  :func:`record_history` and :func:`history_at` read a past step back.

Checkpoints go below the session's shared checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from glean.operators import chunk as C
from glean.operators import history as H
from glean.session import scratch_path


def _run(writer, available_now: bool = True):
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    q.awaitTermination()
    return q


def self_feed(stream: DataFrame, out_path: str, checkpoint: str, status_col: str = "status", index_path: str | None = None) -> None:
    """Rows with ``status = 'passed'`` are tagged ``is_test``,
    ``test_status = 'passed'``, chunked and appended to ``out_path``; with
    ``index_path`` the chunks also become a keyword-index increment."""
    from glean.operators import keyword as K

    passed = stream.filter(F.col(status_col) == "passed").withColumn("is_test", F.lit(True)).withColumn(
        "test_status", F.lit("passed")
    )
    chunks = C.split_stride(passed).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_no"))
    write_chunks = _idempotent(out_path, ["is_test"])

    def write(batch: DataFrame, epoch: int) -> None:
        write_chunks(batch, epoch)
        if index_path is not None:
            K.write_increment(batch, index_path, epoch, id_col="chunk_id", text_col="chunk")

    _run(chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "attempts long, status string, route string"


class _Attempts(StatefulProcessor):
    """First ``max_attempts`` rows of a key in event order, whatever trigger brings them.

    Only those rows can matter, so the state of a key is one short list and
    a row that arrives late takes its place in it.  A timer drops the list
    when the watermark passes the key's newest event.
    """

    def __init__(self, key: str, order: list[str], types: dict[str, str], max_attempts: int, expire: bool, zone: str):
        self.key, self.order, self.max_attempts = key, order, max_attempts
        self.columns = [*order, "status"]
        self.schema = ", ".join(f"`{c}` {types[c]}" for c in self.columns)
        self.expire, self.zone = expire, zone

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def _result(self, key, first: pd.DataFrame) -> pd.DataFrame:
        statuses = list(first["status"])
        done = statuses.index("passed") + 1 if "passed" in statuses else self.max_attempts
        n = min(done, len(statuses))
        route = "finish" if len(statuses) >= done else "fix_code"
        return pd.DataFrame({self.key: [key[0]], "attempts": [n], "status": [statuses[n - 1]], "route": [route]})

    def handleInputRows(self, key, rows, timerValues):
        stored = [tuple(r) for r in self.rows.get()]
        keep = pd.DataFrame(stored, columns=self.columns) if stored else None
        newest = None
        for batch in rows:
            # Cut after each Arrow batch, so that a key of any size stays small.
            part = batch[self.columns] if keep is None else pd.concat([keep, batch[self.columns]], ignore_index=True)
            keep = part.sort_values(self.order, na_position="first", kind="stable").head(self.max_attempts)
            if self.expire:
                at = batch[self.order[0]].max()
                newest = at if at is not pd.NaT and (newest is None or at > newest) else newest
        kept = [tuple(_plain(x) for x in r) for r in keep.itertuples(index=False)]
        if kept != stored:
            self.rows.put(kept)
        if newest is not None:
            self._renew(int(newest.tz_localize(self.zone).timestamp() * 1000) + 1)
        yield self._result(key, keep)

    def _renew(self, at_ms: int) -> None:
        """One timer a key, just after its newest event."""
        timers = [int(t[0]) if isinstance(t, (tuple, list)) else int(t) for t in self.handle.listTimers()]
        if at_ms > max(timers, default=at_ms - 1):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.rows.clear()
        return iter([])

    def close(self) -> None:
        pass


def _plain(x):
    """A pandas cell as the Python value that the state encodes."""
    if x is None or x is pd.NaT or x != x:
        return None
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x.item() if hasattr(x, "item") else x


def attempt_state(
    stream: DataFrame,
    key: str,
    order_cols: list[str],
    max_attempts: int = 3,
    expire: str | None = None,
) -> DataFrame:
    """Streaming form of E8; one output row per key and trigger that brought rows for it.

    Rows may come late and in any trigger: the answer is that of all rows
    seen so far in the order of ``order_cols`` (nulls first).  A null key is
    a key.  With ``expire`` (an interval such as ``"2 days"``) the first
    order column is the event time: rows further than that behind the
    stream's newest event are too late and left out, and a key that had no
    event for as long loses its state and, should it return, begins anew.
    Without it state is kept for good: at most ``max_attempts`` short rows a
    key.

    State lies in RocksDB, which ``transformWithStateInPandas`` needs and
    which is set here, with its changes in the query's checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = dict(stream.dtypes)
    rows = stream.select(*dict.fromkeys([key, *order_cols, "status"]))
    if expire is not None:
        rows = rows.withWatermark(order_cols[0], expire)
    # Event times reach Python in the session's time zone, those without a zone as they are.
    zone = "UTC" if types[order_cols[0]] == "timestamp_ntz" else spark.conf.get("spark.sql.session.timeZone")
    processor = _Attempts(key, list(order_cols), types, max(1, int(max_attempts)), expire is not None, zone)
    return rows.groupBy(key).transformWithStateInPandas(
        processor, f"`{key}` {types[key]}, {RESULT}", "update", "EventTime" if expire is not None else "None"
    )


def _idempotent(out_path: str, partition_by: list[str] | None = None):
    """``foreachBatch`` writer that is safe to replay: each epoch owns the
    folder ``epoch=N`` and overwrites it, so a micro-batch re-run after a
    failure replaces its own output instead of appending it twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        w = batch.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{out_path}/epoch={epoch}")

    return write


def run_to_table(df: DataFrame, out_path: str, checkpoint: str, mode: str = "update") -> None:
    """Drive a streaming frame to completion; each trigger's rows land in
    ``out_path/epoch=N`` (read back with an ``epoch`` column)."""
    _run(df.writeStream.outputMode(mode).foreachBatch(_idempotent(out_path)).option("checkpointLocation", checkpoint))


def change_feed(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Latest value per key, emitted only for keys changed by a trigger."""
    return stream.groupBy(key).agg(F.max(F.struct(F.col("ts"), F.col(value))).alias("_m")).select(
        key, F.col("_m.ts").alias("ts"), F.col(f"_m.{value}").alias(value)
    )


def record_history(stream: DataFrame, key: str, order_cols: list[str], value: str, out_path: str, checkpoint: str) -> None:
    """Keep what every step (trigger) brought, so that any past step can be read back.

    A step appends its own ``epoch=N`` folder of (key, order, value) and
    rewrites nothing; a step that is run again replaces its own folder.
    """
    rows = stream.select(*dict.fromkeys([key, *order_cols, value]))
    run_to_table(rows, out_path, checkpoint, "append")


def history_at(spark: SparkSession, path: str, key: str, order_cols: list[str], value: str, step: int | None = None) -> DataFrame:
    """The change log (E6) as it stood after ``step``, or after the last one.

    Folders of later steps are not read.  Rows that came late stand where
    their order puts them, from the step that brought them on.
    """
    rows = spark.read.parquet(path)
    if step is not None:
        rows = rows.filter(F.col("epoch") <= step)
    return H.changes(rows.drop("epoch"), key, [F.col(c) for c in order_cols], value)


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
