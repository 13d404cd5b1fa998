"""A1 / A3: source-tree scan, listed and read by Spark tasks from any store.

The built-in file sources drop every file whose name starts with ``_`` or
``.``, even when named explicitly, while the scan must keep ``_utils.py``
or ``.conf.py`` and skip only ``__init__.py``.  So the tree is walked here:

* one Spark job for each level of the tree lists the folders of that level,
  dealt over the tasks; a level is written to the shared scratch folder, so
  nothing but the number of folders reaches the driver and a lost executor
  lists its folders again;
* a folder whose *name* is ignored is pruned at any depth (not entered);
* a file is kept when its case-sensitive suffix is allowed and its name is
  not ``__init__.py``;
* the files of all levels are dealt by a hash of their path over tasks of
  about ``TASK_BYTES``, however deep or lopsided the tree is, and read there;
* rows are ``(relative_path STRING, content BINARY)``; decoding is left to
  :func:`glean.sources.io.to_documents` (strict UTF-8, unreadable -> dropped).

A root is a folder or a URI of a store that ``pyarrow.fs`` opens (``file``,
``hdfs`` and ``viewfs`` by the cluster's libhdfs, ``s3``, ``gs``, ``abfs``);
``store`` takes a function of the root for any other.  Links to folders are
not followed.  Files and folders that vanish or may not be read give null
content or no rows; any other failure of the store fails the task, which
Spark runs again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions.paths import IGNORED_DIRS, METRICS_SKIP, SKIPPED_FILE
from glean.session import scratch_path

DEFAULT_EXTENSIONS = (".py", ".md")
TASK_BYTES = 64 << 20  # file contents of one reading task, about
TASK_FILES = 5_000  # files of one reading task and folders of one listing task, about
BATCH_BYTES = 16 << 20  # contents that a task hands over at a time

Store = Callable[[str], tuple[pafs.FileSystem, str]]


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and the root's path in it."""
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/")
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _suffix(name: str) -> str:
    # pathlib's suffix: the last '.' that is not the first character.
    i = name.rfind(".")
    return name[i:] if 0 < i < len(name) - 1 else ""


def _join(base: str, rel: str) -> str:
    return f"{base.rstrip('/')}/{rel}" if rel else base


def _lister(root: str, store: Store, extensions, ignored, skip_substrings, skip_init):
    """Folders -> their kept files and the folders to enter."""

    def list_folders(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store(root)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in batches:
            for folder in batch["relative_path"]:
                try:
                    children = fs.get_file_info(pafs.FileSelector(_join(base, folder)))
                except (FileNotFoundError, PermissionError):
                    if not folder:
                        raise
                    continue
                skipped = any(x in _join(base, folder) for x in skip_substrings)
                rows = []
                for c in children:
                    name = c.base_name
                    if c.type == pafs.FileType.Directory:
                        if name not in ignored and not (local and os.path.islink(c.path)):
                            rows.append((_join(folder, name) if folder else name, 0, True))
                    elif not skipped and _suffix(name) in extensions and not (skip_init and name == SKIPPED_FILE):
                        rows.append((_join(folder, name) if folder else name, c.size or 0, False))
                if rows:
                    yield pd.DataFrame(rows, columns=["relative_path", "size", "is_folder"])

    return list_folders


def _reader(root: str, store: Store):
    def read_files(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store(root)
        for batch in batches:
            paths, contents, held = [], [], 0
            for rel in batch["relative_path"]:
                try:
                    with fs.open_input_stream(_join(base, rel), compression=None) as f:
                        data = f.read()
                except (FileNotFoundError, PermissionError):
                    data = None
                paths.append(rel)
                contents.append(data)
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame({"relative_path": paths, "content": contents})
                    paths, contents, held = [], [], 0
            if paths:
                yield pd.DataFrame({"relative_path": paths, "content": contents})

    return read_files


def list_files(
    spark: SparkSession,
    root: str,
    extensions=DEFAULT_EXTENSIONS,
    ignored=IGNORED_DIRS,
    skip_substrings=(),
    skip_init: bool = True,
    store: Store = open_store,
) -> DataFrame:
    """``(relative_path, size)`` of every kept file under ``root``, one job a level.

    A file is also left out when its folder's path, root included, contains
    one of ``skip_substrings``; such a folder is entered all the same.
    """
    schema = "relative_path string, size long, is_folder boolean"
    lister = _lister(root, store, frozenset(extensions), frozenset(ignored), tuple(skip_substrings), bool(skip_init))
    width = spark.sparkContext.defaultParallelism
    folders, n, levels = spark.createDataFrame([("",)], "relative_path string"), 1, []
    while n:
        dealt = folders.repartition(max(1, min(n, max(width, n // TASK_FILES))), "relative_path") if n > 1 else folders.coalesce(1)
        path = scratch_path(spark, f"tree-level-{len(levels)}")
        dealt.mapInPandas(lister, schema).write.parquet(path)
        level = spark.read.schema(schema).parquet(path)
        levels.append(level.filter("NOT is_folder").select("relative_path", "size"))
        folders = level.filter("is_folder").select("relative_path")
        n = folders.count()
    return reduce(DataFrame.unionAll, levels)


def scan(
    spark: SparkSession,
    root: str,
    extensions=DEFAULT_EXTENSIONS,
    ignored=IGNORED_DIRS,
    skip_substrings=(),
    skip_init: bool = True,
    store: Store = open_store,
) -> DataFrame:
    """A1: ``(relative_path, content)`` of every kept file under ``root``."""
    files = list_files(spark, root, extensions, ignored, skip_substrings, skip_init, store)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // TASK_FILES, size // TASK_BYTES)))
    dealt = files.select("relative_path").repartition(tasks, "relative_path")
    return dealt.mapInPandas(_reader(root, store), "relative_path string, content binary")


def metrics_walk(spark: SparkSession, root: str, store: Store = open_store) -> DataFrame:
    """A3: ``*.py`` files whose directory path contains none of the skip
    substrings (no directory is pruned by name)."""
    return scan(spark, root, extensions=(".py",), ignored=(), skip_substrings=METRICS_SKIP, skip_init=False, store=store)


def write_tree(files: DataFrame, root: str, store: Store = open_store) -> None:
    """Write ``files(relative_path, text)`` as a tree below ``root``, each task its own files; a task run again overwrites them."""

    def write(rows) -> None:
        fs, base = store(root)
        made = set()
        for r in rows:
            path = _join(base, r.relative_path)
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(path, compression=None) as f:
                f.write((r.text or "").encode("utf-8"))

    files.select("relative_path", "text").foreachPartition(write)
