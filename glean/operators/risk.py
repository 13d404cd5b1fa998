"""Defect-risk features, statistics, models and scoring (groups B, D, K).

All statistics are single-pass grouped aggregates (partial, then final);
exact quantiles come from counting passes that narrow, the stratified split
from counts by hash prefix, so no column is collected into one task.
Models are Spark ML estimators trained on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The risk feature set, in order, and policy defaults.
FEATURES = ("loc", "vg", "v", "d", "e", "complexity_density", "volume_per_line")
DEFAULT_THRESHOLD = 0.2
HIGH_RISK_CUTOFF = 0.2  # label rule of the risk text, independent of the gate
FALLBACK_FEATURE = "metrics_extractor"
# Header of the risk text block.
RISK_HEADER = "🚨 ML RISK ANALYSIS: Score %.2f (%s RISK)"
NO_FACTORS = "ML RISK ANALYSIS: No specific risk factors identified."
FACTORS_TITLE = "Top Risk Factors to investigate:"
TOP_REASONS = 3


def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, non_null) per column, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c}', '{t}', c{i}" for i, (c, t) in enumerate(df.dtypes))
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, dtype, non_null)")


def unpivot(df: DataFrame, cols: list[str], name: str = "column_name", value: str = "value") -> DataFrame:
    ids = [c for c in df.columns if c not in cols]
    return df.unpivot(ids, [F.col(c).cast("double").alias(c) for c in cols], name, value)


# --- B9 / B10 --------------------------------------------------------------
def clean(c: Column) -> Column:
    """Null, NaN and +-infinity become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def density(df: DataFrame, mode: str = "serve") -> DataFrame:
    """``complexity_density`` and ``volume_per_line``.

    ``serve`` divides by ``max(loc, 1)``; ``train`` divides by ``loc`` and
    turns the resulting infinities (here: nulls of ``try_divide``) into 0.
    """
    if mode == "serve":
        den = F.greatest(F.col("loc"), F.lit(1.0))
        return df.withColumn("complexity_density", F.col("vg") / den).withColumn("volume_per_line", F.col("v") / den)
    return df.withColumn("complexity_density", clean(F.try_divide(F.col("vg"), F.col("loc")))).withColumn(
        "volume_per_line", clean(F.try_divide(F.col("v"), F.col("loc")))
    )


# --- D1 ----------------------------------------------------------------------
SLOTS = 4096  # slices of an interval in one counting pass


def _binade(v: Column) -> Column:
    """A bucket number that never falls as a double grows: its sign and power of two, with 0, infinities and NaN apart."""
    power = F.floor(F.log2(F.abs(v))) + 1100  # 26 to 2,124: the exponent of the smallest double is -1,074
    sign = F.signum(v).cast("long")
    return (
        F.when(F.isnan(v), F.lit(3000).cast("long"))
        .when(F.abs(v) == float("inf"), sign * 2500)
        .when(v == 0, F.lit(0).cast("long"))
        .otherwise(sign * power)
    )


def _counted(rows: DataFrame, keys: list[str], bucket: Column, value: str) -> DataFrame:
    """Rows of each bucket, their smallest and largest value, and the rows up to its end within ``keys``."""
    b = rows.groupBy(*keys, bucket.alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max")
    )
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("_end", F.sum("_n").over(w))


def exact_quantiles(long: DataFrame, qs=(0.25, 0.5, 0.75), name: str = "column_name", value: str = "value") -> DataFrame:
    """Linear-interpolation quantiles of every column of a long table, by counting passes that narrow.

    The first pass counts each column's values by power of two (at most
    4,249 buckets) and keeps, for every wanted position, the bucket that
    holds it.  Each further pass cuts the open buckets between their
    smallest and largest value into ``SLOTS`` equal slices, counts only the
    values inside, and keeps one slice a position; a position is found once
    its bucket holds a single value.  A slice never holds both ends of its
    bucket, so every pass narrows, and the 52 bits below a power of two are
    gone after five.  Passes combine map-side and shuffle counts only; no
    value is sorted and none gathered.

    Columns are those of a schema: what reaches the driver between passes
    is two rows for each column and quantile.  Nulls are left out; a column
    of nulls has no row; NaN stands above infinity; ``value`` is a double.
    """
    spark = long.sparkSession
    v = long.select(F.col(name).alias("_name"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    first = _counted(v, ["_name"], _binade(F.col("_v")), "_v")
    total = F.sum("_n").over(Window.partitionBy("_name"))
    points = F.array(*[F.struct(F.lit(float(q)).alias("q"), ((F.col("_total") - 1) * F.lit(float(q))).alias("h")) for q in qs])
    ends = F.explode(F.array(F.floor("h"), F.ceil("h")))
    wanted = first.withColumn("_total", total).withColumn("_p", F.explode(points)).select("*", "_p.q", "_p.h")
    held = wanted.select("*", ends.alias("_at")).filter((F.col("_end") - F.col("_n") <= F.col("_at")) & (F.col("_at") < F.col("_end")))
    found = held.select("_name", "q", "h", "_at", (F.col("_at") - F.col("_end") + F.col("_n")).alias("rank"), "_min", "_max").distinct().collect()

    done, state = [], f"_name {dict(long.dtypes)[name]}, q double, h double, _at long, rank long, _lo double, _hi double"
    while True:
        done += [r for r in found if _single(r)]
        todo = [tuple(r) for r in found if not _single(r)]
        if not todo:
            break
        # Two rows for each column and quantile: a bounded broadcast.
        open_ = spark.createDataFrame(todo, state)
        parts = F.broadcast(open_.select("_name", "_lo", "_hi").distinct())
        inside = v.join(parts, v["_name"].eqNullSafe(parts["_name"]) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).drop(v["_name"])
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        slots = _counted(inside, ["_name", "_lo", "_hi"], F.least(F.floor(share * SLOTS), F.lit(SLOTS - 1)), "_v")
        s, o = slots.alias("s"), F.broadcast(open_).alias("o")
        same = F.col("s._name").eqNullSafe(F.col("o._name")) & (F.col("s._lo") == F.col("o._lo")) & (F.col("s._hi") == F.col("o._hi"))
        holds = (F.col("_end") - F.col("_n") <= F.col("rank")) & (F.col("rank") < F.col("_end"))
        found = s.join(o, same & holds).select("o._name", "q", "h", "_at", (F.col("rank") - F.col("_end") + F.col("_n")).alias("rank"), "_min", "_max").collect()

    ends_of: dict = {}
    for r in done:
        ends_of.setdefault((r["_name"], r["q"], r["h"]), {})[r["_at"]] = r["_min"]
    rows = []
    for (column, q, h), at in ends_of.items():
        lo, hi = at[min(at)], at[max(at)]
        rows.append((column, q, lo if lo == hi else lo + (h - min(at)) * (hi - lo)))
    return spark.createDataFrame(rows, f"{name} {dict(long.dtypes)[name]}, q double, quantile double")


def _single(r) -> bool:
    """Whether a bucket holds one value (NaN is one)."""
    return r["_min"] == r["_max"] or r["_min"] != r["_min"]


def describe(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column."""
    long = unpivot(df.select(*cols), cols)
    stats = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(long).groupBy("column_name").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("quantile"))
    q = q.toDF("column_name", "q25", "q50", "q75")
    out = stats.join(q, "column_name", "left")
    r = [F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return out.select("column_name", "count", *r)


# --- D2 / D3 / D4 ------------------------------------------------------------
def target_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(label).cast("double")) * 100, 6).alias("target_rate"))


def correlation(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """D3: Pearson correlation of every ordered pair, in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    items = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    long = agg.selectExpr(f"stack({len(pairs)}, {items}) AS (col_a, col_b, r)")
    return long.withColumn("r", F.round("r", digits))


def drop_collinear(df: DataFrame, cols: list[str], t: float = 0.999) -> DataFrame:
    """(column_name, kept): a column is dropped when it correlates at
    ``|r| >= t`` with an earlier column."""
    corr = correlation(df, cols, 12)
    idx = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in idx.items() for x in (F.lit(c), F.lit(i))])
    earlier = corr.filter(F.try_element_at(order, F.col("col_a")) < F.try_element_at(order, F.col("col_b")))
    dropped = earlier.groupBy("col_b").agg(F.max(F.abs("r") >= t).alias("dropped"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(dropped, names.column_name == dropped.col_b, "left").select(
        "column_name", (~F.coalesce(F.col("dropped"), F.lit(False))).alias("kept")
    )


# --- D5 ----------------------------------------------------------------------
def histogram(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """Equal-width bins: ``least(bins-1, floor((x-min)/(max-min)*bins))``."""
    long = unpivot(df.select(*cols), cols).filter(F.col("value").isNotNull())
    rng = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per column: a bounded broadcast.
    b = long.join(F.broadcast(rng), "column_name")
    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width * bins))
    ).cast("int")
    return b.groupBy("column_name", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# --- D6 / D7 / K5 / K6 -------------------------------------------------------
def threshold(score: Column, t: float = DEFAULT_THRESHOLD) -> Column:
    """K5: ``(p >= t)`` as 0/1."""
    return (score >= t).cast("int")


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _report_from_counts(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def prf(tp_, fp_, fn_):
        p = F.coalesce(F.try_divide(tp_, tp_ + fp_), F.lit(0.0))
        r = F.coalesce(F.try_divide(tp_, tp_ + fn_), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    def row(label, p, r, f, support):
        return F.struct(
            F.lit(label).alias("label"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1"),
            support.cast("double").alias("support"),
        )

    none = F.lit(None)
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", none, none, (tp + tn) / n, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n),
    )
    out = c.select(F.inline(rows))
    return out.select(
        "label",
        *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")],
        F.col("support").cast("bigint").alias("support"),
    )


def counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    a, p = F.col(label).cast("int"), F.col(pred).cast("int")

    def n(cond):
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")

    return df.agg(
        n((a == 1) & (p == 1)).alias("tp"),
        n((a == 0) & (p == 1)).alias("fp"),
        n((a == 1) & (p == 0)).alias("fn"),
        n((a == 0) & (p == 0)).alias("tn"),
    )


def report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1, support per class, accuracy, macro and
    weighted averages; from one aggregate of conditional sums."""
    return _report_from_counts(counts(df, label, pred))


def sweep(df: DataFrame, label: str, score: str, thresholds=(0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """K6: confusion counts for many thresholds in one pass (no row copies)."""
    a = F.col(label).cast("int")
    aggs = []
    for i, t in enumerate(thresholds):
        p = F.col(score) >= t
        for name, cond in (("tp", (a == 1) & p), ("fp", (a == 0) & p), ("fn", (a == 1) & ~p), ("tn", (a == 0) & ~p)):
            aggs.append(F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(f"{name}{i}"))
    wide = df.agg(*aggs)
    items = ", ".join(f"{float(t)}D, tp{i}, fp{i}, fn{i}, tn{i}" for i, t in enumerate(thresholds))
    return wide.selectExpr(f"stack({len(thresholds)}, {items}) AS (threshold, tp, fp, fn, tn)")


# --- K1 ----------------------------------------------------------------------
PREFIX = 4  # hex digits: 65,536 prefixes for each class


def stratified_split(df: DataFrame, label: str, id_col: Column, test_size: float = 0.2) -> DataFrame:
    """K1: exact per-class proportions; a row is in the test split when its
    rank by ``md5(id)`` within its class is at most ``ceil(test_size * n)``.

    Rows are counted by class and hash prefix; only the rows of the prefix in
    which a class's cut falls are ranked.  A null id counts as the empty text.
    """
    keyed = df.withColumn("_h", F.md5(F.coalesce(id_col.cast("string"), F.lit("")))).withColumn("_p", F.substring("_h", 1, PREFIX))
    counts = keyed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_c"))  # 16**PREFIX rows for each class at most
    run = F.sum("_c").over(Window.partitionBy(label).orderBy("_p"))
    size = F.ceil(F.sum("_c").over(Window.partitionBy(label)) * test_size)
    cut = counts.select(F.col(label).alias("_l"), F.col("_p").alias("_cut"), (run - F.col("_c")).alias("_before"), run.alias("_to"), size.alias("_size"))
    cut = cut.filter("_before < _size AND _size <= _to").drop("_to")
    # One row per class: bounded broadcast.
    j = keyed.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("_l")), "left")
    clear = F.when(F.col("_p") < F.col("_cut"), "test").otherwise("train")
    outside = j.filter("_cut IS NULL OR _p <> _cut").withColumn("split", clear)
    rank = F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h"))
    inside = j.filter("_p = _cut").withColumn("split", F.when(F.col("_before") + rank <= F.col("_size"), "test").otherwise("train"))
    return outside.unionByName(inside).drop("_h", "_p", "_l", "_cut", "_before", "_size")


# --- K2 ----------------------------------------------------------------------
def fit_scaler(train: DataFrame, cols: list[str], ddof: int = 0) -> DataFrame:
    """K2: one row of (mean, std) per column; population std by default."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), std(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """Standardise with a fitted scaler row (broadcast: one row)."""
    j = df.crossJoin(F.broadcast(scaler))
    for c in cols:
        z = F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__std")), F.lit(0.0))
        j = j.withColumn(c, z)
    return j.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "std")])


# --- C7 ----------------------------------------------------------------------
def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (k * n_c)`` per class (the 'balanced' rule)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(tot)).select(label, (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def with_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Join the class weight back as a weight column (one row per class)."""
    return df.join(F.broadcast(class_weights(df, label).withColumnRenamed("weight", out)), label)


# --- E9 / B13 / B14 ----------------------------------------------------------
def top_reasons(df: DataFrame, importances: DataFrame, cols: list[str], n: int = TOP_REASONS) -> DataFrame:
    """The ``n`` features of highest *global* importance with this row's
    values, as ``ARRAY<STRUCT<feature, impact, value>>`` (same features on
    every row; ties broken by feature name)."""
    order = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in cols]))
    top = importances.select(F.slice(order, 1, n).alias("_top"))  # one row: sorted once
    values = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    reasons = F.transform(
        "_top", lambda s: F.struct(s["feature"].alias("feature"), s["impact"].alias("impact"), F.col("_values")[s["feature"]].alias("value"))
    )
    j = df.withColumn("_values", values).crossJoin(F.broadcast(top))
    return j.withColumn("reasons", reasons).drop("_top", "_values")


def fallback(score: Column, features_present: Column) -> tuple[Column, Column]:
    """No features -> score 1.0 and one reason ``metrics_extractor``."""
    reason = F.array(F.struct(F.lit(FALLBACK_FEATURE).alias("feature"), F.lit(1.0).alias("impact"), F.lit(0.0).alias("value")))
    return F.when(features_present, score).otherwise(F.lit(1.0)), reason


def risk_label(score: Column, cutoff: float = HIGH_RISK_CUTOFF) -> Column:
    return F.when(score >= cutoff, F.lit("HIGH")).otherwise(F.lit("LOW"))


def risk_text(score: Column, reasons: Column, cutoff: float = HIGH_RISK_CUTOFF) -> Column:
    """The risk text block: header, then one line per reason."""
    header = F.concat(F.format_string(RISK_HEADER, score, risk_label(score, cutoff)), F.lit("\n"))
    lines = F.array_join(
        F.transform(
            reasons,
            lambda r: F.format_string("- %s: Impact %.2f (Current Value: %s)", F.upper(r["feature"]), r["impact"], r["value"].cast("string")),
        ),
        "\n",
    )
    none = F.lit(NO_FACTORS)
    return F.when(F.size(reasons) == 0, none).otherwise(F.concat(header, F.lit(FACTORS_TITLE + "\n"), lines, F.lit("\n")))


def gate(df: DataFrame, task: Column, score: Column, t: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Drop blank tasks, keep ``score >= t``."""
    from glean.functions.text import is_blank

    return df.filter(~is_blank(task) & (score >= t))


# --- K3 / K4 / K7 / K8 / A10 -------------------------------------------------
def fit_logistic(df: DataFrame, cols: list[str], label: str, weight: str | None = "weight", max_iter: int = 100, c: float = 1.0):
    """K3: standard scaling + balanced logistic regression, fitted together.

    ``c`` is the inverse strength of the L2 penalty on the standardised
    features: the loss is summed over rows there and averaged by Spark.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, maxIter=max_iter,
                           regParam=1.0 / (c * max(df.count(), 1)), standardization=False),
    ]
    return Pipeline(stages=stages).fit(df)


ML_DRAWS = 100_000  # trees x rows that Spark ML fits


def fit_forest(df: DataFrame, cols: list[str], label: str, trees: int = 800, depth: int = 20, seed: int = 42, weight: str | None = "weight"):
    """K4: balanced random forest of all rows (Spark caps depth at 30).

    Spark ML keeps all nodes on the driver, so beyond ``ML_DRAWS`` (trees x
    rows) trees are grown on the executors; such a forest scores and has
    importances, but is not saved.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from glean.operators import forest

    if trees and df.limit(ML_DRAWS // trees + 1).count() * trees > ML_DRAWS:
        if (model := forest.grown(df, list(cols), label, trees, min(depth, 30), seed, weight)) is not None:
            return model
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(
            featuresCol="features", labelCol=label, weightCol=weight, numTrees=trees, maxDepth=min(depth, 30), seed=seed
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def importances(model, cols: list[str]) -> DataFrame:
    """K7 + F4: importances (forest) or coefficients (logistic), sorted desc."""
    from pyspark.sql import SparkSession

    from glean.operators import forest

    if isinstance(model, forest.Grown):
        vals = model.importances()
    else:
        last = model.stages[-1]
        vals = last.featureImportances.toArray() if hasattr(last, "featureImportances") else last.coefficients.toArray()
    spark = SparkSession.getActiveSession()
    rows = [(c, float(v)) for c, v in zip(cols, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def score(df: DataFrame, model, prob_col: str = "risk_score") -> DataFrame:
    """K8: positive-class probability for every row (model shipped once per
    executor).  A forest scores whole batches of rows, others ``transform``."""
    from pyspark.ml.functions import vector_to_array

    from glean.operators import forest

    if isinstance(model, forest.Grown):
        return model.score(df, prob_col)
    first, last = model.stages[0], model.stages[-1]
    if len(model.stages) == 2 and first.getHandleInvalid() == "keep":
        cols = first.getInputCols()
        if (m := forest.masks(last, len(cols))) is not None:
            return df.withColumn(prob_col, forest.score(m, [F.col(c) for c in cols]))
    out = model.transform(df)
    return out.withColumn(prob_col, vector_to_array(F.col("probability"))[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def save_model(model, path: str) -> None:
    """A10: model and scaler persist together as one Spark ML model."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
