"""Keyed streaming state over several triggers: late rows, expiry, hot and null keys."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from glean.session import scratch_path
from glean.streaming import incremental as S

SCHEMA = "target string, ts timestamp, event_id long, status string"
DAY0 = dt.datetime(2024, 1, 1)


def _source(spark, batches, name):
    """One file, hence one trigger, for each batch of rows."""
    folder = scratch_path(spark, name)
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            path = os.path.join(folder, f)
            if f.endswith(".parquet") and os.path.getmtime(path) > 2_000_000:
                os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(spark, state, name):
    out, ckpt = S.scratch(spark, name)
    S.run_to_table(state, out, ckpt)
    return spark.read.parquet(out)


def test_late_rows_across_triggers_equal_the_batch_result(spark):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    rows = [
        (rng.choice(keys), DAY0 + dt.timedelta(minutes=rng.randint(0, 40)), i, rng.choice(["failed", "failed", "pending", "passed"]))
        for i in range(300)
    ]
    rng.shuffle(rows)  # every trigger brings rows that stand before earlier ones
    stream = _source(spark, [rows[:60], rows[60:90], rows[90:200], rows[200:]], "late")
    t = _run(spark, S.attempt_state(stream, "target", ["ts", "event_id"]), "late-run")
    assert t.select("epoch").distinct().count() == 4
    last = t.groupBy("target").agg(F.max(F.struct("epoch", "attempts", "status", "route")).alias("m"))
    got = {r.target: (r.attempts, r.status, r.route) for r in last.select("target", "m.*").collect()}
    want = {}
    for k in set(keys):
        mine = [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])][:3]
        n = mine.index("passed") + 1 if "passed" in mine else len(mine)
        want[k] = (n, mine[n - 1], "finish" if "passed" in mine or n == 3 else "fix_code")
    assert got == want


def test_idle_keys_expire_and_busy_ones_stay(spark):
    day = lambda d, h=0: DAY0 + dt.timedelta(days=d, hours=h)
    batches = [
        [("idle", day(0), 1, "failed"), ("idle", day(0, 1), 2, "failed"), ("busy", day(0), 3, "failed")],
        [("busy", day(1), 4, "failed"), ("other", day(1), 5, "failed")],
        [("busy", day(2), 6, "failed"), ("other", day(4), 7, "failed")],
        [("busy", day(4), 8, "failed"), ("other", day(4, 1), 9, "failed")],
        [("idle", day(4, 2), 10, "failed"), ("busy", day(4, 2), 11, "passed"), ("gone", day(0, 5), 12, "failed")],
    ]
    kept = _run(spark, S.attempt_state(_source(spark, batches, "kept"), "target", ["ts", "event_id"]), "kept-run")
    bounded = _run(spark, S.attempt_state(_source(spark, batches, "idle"), "target", ["ts", "event_id"], expire="2 days"), "idle-run")

    def last(t):
        m = t.groupBy("target").agg(F.max(F.struct("epoch", "attempts", "route")).alias("m"))
        return {r.target: (r.attempts, r.route) for r in m.select("target", "m.*").collect()}

    assert last(kept) == {"idle": (3, "finish"), "busy": (3, "finish"), "other": (3, "finish"), "gone": (1, "fix_code")}
    # "idle" begins anew after four days; a row four days late is left out.
    assert last(bounded) == {"idle": (1, "fix_code"), "busy": (3, "finish"), "other": (3, "finish")}


def test_every_past_step_can_be_read_back(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice(["hot", "hot", "a", None]), DAY0 + dt.timedelta(minutes=rng.randint(0, 30)), i, rng.choice(["x", "y", "", None]))
        for i in range(120)
    ]
    steps = [rows[:50], rows[50:70], rows[70:]]
    out, ckpt = S.scratch(spark, "history-steps")
    order = ["ts", "event_id"]
    S.record_history(_source(spark, steps, "history-in"), "target", order, "status", out, ckpt)
    # A step that runs again replaces its own rows.
    S._idempotent(out)(spark.createDataFrame(steps[1], SCHEMA).select("target", "ts", "event_id", "status"), 1)

    def log(seen):
        want = set()
        for key in {r[0] for r in seen}:
            last, version = None, 0
            for _, _, event, status in sorted((r for r in seen if r[0] == key and r[3]), key=lambda r: r[1:3]):
                if status != last:
                    last, version = status, version + 1
                    want.add((key, event, status, version))
        return want

    for step in (0, 1, 2, None):
        got = S.history_at(spark, out, "target", order, "status", step)
        seen = sum(steps[: 3 if step is None else step + 1], [])
        assert {tuple(r) for r in got.select("target", "event_id", "status", "version").collect()} == log(seen), step
    past = spark.read.parquet(out).filter(F.col("epoch") <= 0)
    assert "PartitionFilters: [isnotnull(epoch" in past._jdf.queryExecution().toString()


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from pyspark.sql import functions as F

    from glean.plans.registry import load_all

    rows = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id")).alias("text"),
        F.concat(F.lit("src"), F.col("id") % 2).alias("source"), F.lit("en").alias("lang"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "file" / "documents.parquet")
    for name in ("stream_index", "stream_keyword_index"):
        folder, file = (sorted(map(tuple, load_all()[name].fn(spark, str(tmp_path / d)).collect())) for d in ("folder", "file"))
        assert len(folder) > 20 / 2 and folder == file
