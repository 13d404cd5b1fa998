"""Sharding along a Hilbert curve.  DataFrame operations only.

Source, language and size of a document are quantised to ``2**BITS`` cells each at quantiles of all
rows; up to ``2**BITS`` whole values of source or language have a cell each, more share cells in the order of values.  The cells are numbered along a Hilbert curve, and the documents in that order are cut into
``SHARDS`` runs whose row counts differ by one at most (law ``rows``).  Neighbouring cells of the
curve touch, so a run covers a compact box of every dimension and readers can skip files by any of them.

The place of a row is: rows in earlier cells + rows in earlier runs of its cell + its number in its
run.  Cells are at most ``2**(3*BITS)`` rows of counts; a cell of more than ``RUN_ROWS`` rows is dealt to
runs by a hash of the row, so no window meets a whole hot cell.

Defined results: a null text has no bytes (size 8) and the crc32 of the empty text; null source or lang
sort first; repeated rows get places of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glean.llm.common import fresh, stored
from glean.operators.ordered import ordinal, running_total

SHARDS, BITS, RUN_ROWS = 24, 5, 16_384
DIMENSIONS = ("source", "lang", "bytes")


def curve_index(axes: list[Column], bits: int) -> Column:
    """Hilbert index of integer coordinates below ``2**bits``: the transposed-axes construction in array functions."""
    n = len(axes)
    flip = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def at(x: Column, i: Column | int) -> Column:
        return F.get(x, i if isinstance(i, Column) else F.lit(i))

    def undo(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - F.lit(1)
        t = at(x, 0).bitwiseXOR(at(x, i)).bitwiseAND(low)
        invert = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swap = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(t)).otherwise(v))
        return F.when(at(x, i).bitwiseAND(q) != 0, invert).otherwise(swap)

    steps = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in flip])
    x = F.aggregate(steps, F.array(*[a.cast("int") for a in axes]), undo) if flip else F.array(*[a.cast("int") for a in axes])

    def number(x: Column) -> Column:
        gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
        return F.get(F.transform(F.array(gray), twist), F.lit(0))

    def twist(g: Column) -> Column:
        qs = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
        t = F.aggregate(
            qs, F.lit(0), lambda a, q: F.when(at(g, n - 1).bitwiseAND(q) != 0, a.bitwiseXOR(q - F.lit(1))).otherwise(a)
        )
        order = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(
            order,
            F.lit(0).cast("bigint"),
            lambda a, s: a * F.lit(2) + F.when(at(g, s["i"]).bitwiseXOR(t).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        )

    return F.get(F.transform(F.array(x), number), F.lit(0))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def dimensions() -> dict[str, Column]:
    """The dimensions of a document: two whole values and a number."""
    return {
        "source": F.col("source").cast("string"),
        "lang": F.col("lang").cast("string"),
        "bytes": F.octet_length(_text()).cast("bigint"),
    }


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions, for every row."""
    return docs.select(
        "doc_id",
        (F.octet_length(_text()) + 8).cast("bigint").alias("size"),
        F.crc32(_text()).alias("text_crc32"),
        *[c.alias(d) for d, c in dimensions().items()],
    )


def _value_cuts(meta: DataFrame, name: str) -> list[tuple[int, str]]:
    """The cells of a dimension of values and the first value of each, ascending; null has cell 0.

    A value's cell comes from the rows of smaller values.  Up to ``2**BITS`` values are a cell apart at least.
    """
    n = 1 << BITS
    counts = stored(meta.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).withColumn("all", F.lit(0)), "hilbert-values")
    values, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # The running totals stay balanced however many values there are.
    order = [F.col(name).asc_nulls_first()]
    upto = running_total(counts, "all", order, "rows", "upto")
    spread = n
    if values <= n:
        upto, spread = ordinal(upto, "all", order, "nth"), n - values
    else:
        upto = upto.withColumn("nth", F.lit(1))
    level = F.expr(f"(upto - rows) * {spread} DIV {max(total, 1)}") + F.col("nth") - 1
    # At most 2**BITS rows.
    first = upto.select(name, level.cast("int").alias("level")).filter(F.col(name).isNotNull()).groupBy("level").agg(F.min(name).alias("value"))
    return sorted((r.level, r.value) for r in first.collect())


def cell_of(meta: DataFrame, dims: dict[str, Column]) -> Column:
    """The quantised dimensions in one number; the quantiles are those of ``meta``."""
    n = 1 << BITS
    cell = F.lit(0)
    for d in DIMENSIONS:
        if d == "bytes":
            cuts = meta.agg(F.percentile_approx(d, [i / n for i in range(1, n)], 10_000)).first()[0]
            own = sorted(set(cuts or []))
            level = F.size(F.filter(F.array(*[F.lit(c) for c in own]), lambda c: dims["bytes"] > c)) if own else F.lit(0)
        else:
            level = F.when(dims[d].isNull(), 0)
            for at, value in reversed(_value_cuts(meta, d)):
                level = level.when(dims[d] >= F.lit(value), at)
            level = level.otherwise(0)
        cell = cell * F.lit(n) + level
    return cell.cast("int")


def _axes(cell: str) -> list[Column]:
    n = 1 << BITS
    return [F.floor(F.col(cell) / F.lit(n ** (len(DIMENSIONS) - 1 - i))) % n for i in range(len(DIMENSIONS))]


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert for every row of ``docs``."""
    meta = stored(metadata(docs), "hilbert-meta")
    rows = meta.withColumn("cell", cell_of(meta, {d: F.col(d) for d in DIMENSIONS}))
    # At most 2**(3*BITS) rows of counts from here to the broadcast.
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).withColumn("hilbert", curve_index(_axes("cell"), BITS))
    before = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)
    cells = counts.select(
        "cell",
        "hilbert",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("cell_start"),
        F.ceil(F.col("rows") / RUN_ROWS).alias("runs"),
        F.sum("rows").over(W.partitionBy()).alias("total"),
    )
    placed = rows.join(F.broadcast(cells), "cell")
    placed = placed.withColumn("run", F.pmod(F.xxhash64("text_crc32", "doc_id"), F.col("runs")))
    runs = placed.groupBy("cell", "run").agg(F.count(F.lit(1)).alias("rows"))
    earlier = W.partitionBy("cell").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("cell", "run", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("run_start"))
    own = W.partitionBy("cell", "run").orderBy("text_crc32", "doc_id", "size")
    ranked = placed.withColumn("number", F.row_number().over(own) - 1).join(runs, ["cell", "run"])
    rank = F.col("cell_start") + F.col("run_start") + F.col("number")
    return (
        ranked.withColumn("rank", rank)
        .withColumn("shard", F.expr(f"CAST(rank * {count} DIV total AS INT)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("rank") - F.expr(f"(shard * total + {count - 1}) DIV {count}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "hilbert",
        )
    )


def write_files(docs: DataFrame, path: str, files: int = SHARDS) -> None:
    """Write ``docs``, all columns as they are, as files cut from the Hilbert order, so that readers can skip files."""
    cell, curve, tie = (fresh(docs, f"_glean_{x}") for x in ("cell", "curve", "hash"))
    of = cell_of(stored(metadata(docs), "hilbert-meta"), dimensions())
    rows = docs.withColumn(cell, of).withColumn(tie, F.xxhash64("doc_id", "text"))
    # At most 2**(3*BITS) cells; a hot one is spread over files by the hash of its rows.
    index = rows.select(F.col(cell).alias(f"{cell}_")).distinct().withColumn(curve, curve_index(_axes(f"{cell}_"), BITS))
    both = rows.join(F.broadcast(index), F.col(cell) == F.col(f"{cell}_")).repartitionByRange(files, curve, tie)
    both.sortWithinPartitions(curve, tie).select(*[docs[c] for c in docs.columns]).write.parquet(path)
