"""Session helpers: one place for the settings every job relies on.

On a cluster the session is created by the platform; ``configure`` only
fills in settings that are unset, so a cluster's own choices win (but for
the two in ``_NEEDED``).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that keep results exact and plans adaptive.  Applied only when
# the session has no value of its own.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # map_concat: the right-hand map wins, as dict.update does.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # The balanced prefix sum reads one range exchange from two branches.
    "spark.sql.exchange.reuse": "true",
}

# Results depend on these two, so they are set even over a cluster's value.
_NEEDED = ("spark.sql.mapKeyDedupPolicy", "spark.sql.exchange.reuse")


def configure(spark: SparkSession) -> SparkSession:
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        try:
            current = conf.get(key, None)
        except Exception:  # pragma: no cover - unknown key on old runtimes
            current = None
        if current is None or key in _NEEDED:
            conf.set(key, value)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context: they import it to run its functions."""
    sc = spark.sparkContext
    if getattr(sc, "_glean_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="glean-"), "glean-package")
    sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._glean_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master,
    whose executors share the driver's disk, gets a folder made here.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="glean-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder; Spark's writers create it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "glean") -> SparkSession:
    """Session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("GLEAN_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
