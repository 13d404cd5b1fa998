"""Reads and writes of corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from glean.functions import paths as P
from glean.functions import text as T

MIN_CHARS = 10  # documents shorter than this after stripping are skipped


def read_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A2: drop unreadable rows and rows under ``MIN_CHARS`` after stripping."""
    return docs.filter(F.col(text_col).isNotNull() & (F.length(T.py_strip(F.col(text_col))) >= MIN_CHARS))


def to_documents(files: DataFrame, is_test: bool | F.Column = False, extra: F.Column | None = None) -> DataFrame:
    """A2 + DM2: ``files(relative_path, content)`` -> document rows.

    ``content`` may be binary (decoded strictly) or string.  ``extra`` is a
    ``MAP<STRING,STRING>`` merged into ``metadata`` with the right side
    winning (B5).
    """
    is_test_col = is_test if isinstance(is_test, F.Column) else F.lit(bool(is_test))
    content = F.col("content")
    if dict(files.dtypes).get("content") == "binary":
        content = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else content.cast("string")
    out = (
        files.withColumn("text", content)
        .transform(read_filter)
        .withColumn("is_test", is_test_col)
        .withColumn("file_name", P.basename(F.col("relative_path")))
        .withColumn("service", P.service(F.col("relative_path")))
        .withColumn("file_type", P.file_type(F.col("file_name"), F.col("is_test")))
    )
    base = F.create_map(
        F.lit("file_name"), F.col("file_name"),
        F.lit("relative_path"), F.col("relative_path"),
        F.lit("service"), F.col("service"),
        F.lit("file_type"), F.col("file_type"),
        F.lit("is_test"), F.when(F.col("is_test"), F.lit("True")).otherwise(F.lit("False")),
    )
    meta = merge_metadata(base, extra) if extra is not None else base
    return out.withColumn("metadata", meta).drop("content")


def merge_metadata(base: F.Column, extra: F.Column) -> F.Column:
    """``dict.update``: keys of ``extra`` override ``base``.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by ``configure``).
    """
    return F.map_concat(base, F.coalesce(extra, F.create_map().cast("map<string,string>")))


def both_modes(seed: DataFrame, source: DataFrame) -> DataFrame:
    """A9 + G1: seed rows tagged ``is_test``, source rows not, in one table."""
    return seed.withColumn("is_test", F.lit(True)).unionByName(
        source.withColumn("is_test", F.lit(False)), allowMissingColumns=True
    )


TRAINING_SCHEMA = Ty.StructType(
    [Ty.StructField(c, Ty.DoubleType()) for c in ("loc", "v(g)", "v", "d", "e", "b")]
    + [Ty.StructField("defects", Ty.BooleanType())]
)


def read_training_csv(spark, path: str, schema: Ty.StructType = TRAINING_SCHEMA) -> DataFrame:
    """A4: CSV with header and an explicit schema (no inference); ``v(g)`` -> ``vg``."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumnRenamed("v(g)", "vg").withColumn("defects", F.col("defects").cast("int"))


METRICS_COLUMNS = ("file_name", "loc", "v(g)", "v", "d", "e", "b", "file_path")


def write_metrics(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A5: fixed column order; CSV (with header) or Parquet."""
    out = df.withColumnRenamed("vg", "v(g)").select(*[F.col(f"`{c}`") for c in METRICS_COLUMNS])
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path.replace("(", "").replace(")", ""))


def append_vectors(chunks: DataFrame, path: str, dedup_key: str | None = None) -> bool:
    """Append chunks to a vector table partitioned by ``is_test``.

    Empty input returns False and writes nothing.  The default is a plain
    append (re-ingest duplicates rows, as the reference does); with
    ``dedup_key`` rows whose key is already stored are left out.
    """
    if chunks.isEmpty():
        return False
    spark = chunks.sparkSession
    out = chunks
    if dedup_key is not None:
        out = out.dropDuplicates([dedup_key])
        if table_exists(spark, path):
            out = out.join(spark.read.parquet(path).select(dedup_key), dedup_key, "left_anti")
    out.write.mode("append").partitionBy("is_test").parquet(path)
    return True


def table_exists(spark, path: str) -> bool:
    """Whether the folder of a table, in whatever store the path names, holds a data file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(where):
        return False
    files = store.listFiles(where, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def read_vectors(spark, path: str) -> DataFrame:
    """Read a vector table back; the ``is_test`` partition column as boolean."""
    return spark.read.parquet(path).withColumn("is_test", F.col("is_test").cast("boolean"))


def index_count(spark, path: str) -> int:
    """Number of stored rows (0 when the table does not exist)."""
    return spark.read.parquet(path).count() if table_exists(spark, path) else 0


def clear_index(spark, path: str, schema: Ty.StructType) -> None:
    """Overwrite with an empty table of the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("is_test").parquet(path)
