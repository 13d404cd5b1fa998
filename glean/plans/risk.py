"""Risk statistics, split, scaling, thresholds and models over ``lineitem``.

Stand-in (FIXTURES §3): lineitem rows are the defect table; the label is
``l_returnflag = 'R'``.  Feature mapping (fixed): loc = quantity,
vg = round(discount * 100), v = extended price, d = tax * 100, e = v * d.
The fixed linear risk score is ``discount * 10`` (0..1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glean.operators import risk as R
from glean.plans.registry import register
from glean.sources import tables
from glean.session import scratch_path

STAT_COLS = ["loc", "vg", "v", "d", "e"]
MODEL_COLS = list(R.FEATURES)
THRESHOLDS = (0.2, 0.3, 0.4, 0.5)
GATE_T = 0.4
LOGISTIC_T = 0.4  # probability threshold of the logistic model

SQL_FEATURES = """f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         l_quantity AS loc, round(l_discount * 100) AS vg, l_extendedprice AS v, l_tax * 100 AS d,
         l_extendedprice * (l_tax * 100) AS e, l_discount * 10 AS p,
         CAST(l_returnflag = 'R' AS INTEGER) AS defects
  FROM lineitem
)"""


def features(spark, sf):
    li = tables.read(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.col("l_quantity").alias("loc"),
        F.round(F.col("l_discount") * 100).alias("vg"),
        F.col("l_extendedprice").alias("v"),
        (F.col("l_tax") * 100).alias("d"),
        (F.col("l_extendedprice") * (F.col("l_tax") * 100)).alias("e"),
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("defects"),
    )


def _id():
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SQL_ID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


# --- D1 ----------------------------------------------------------------------
@register(
    "describe",
    sql=f"""
WITH {SQL_FEATURES},
long AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in STAT_COLS)} FROM f) ON {', '.join(STAT_COLS)} INTO NAME column_name VALUE value)
SELECT column_name, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
       round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max
FROM long GROUP BY column_name""",
    ids=("D1",),
)
def q_describe(spark, sf):
    return R.describe(features(spark, sf), STAT_COLS)


# --- D2 ----------------------------------------------------------------------
@register("target_rate", sql="SELECT round(avg(CAST(quality AS DOUBLE)) * 100, 6) AS target_rate FROM labels", ids=("D2",))
def q_target_rate(spark, sf):
    return R.target_rate(tables.read(spark, sf, "labels"), "quality")


# --- D3 / D4 -----------------------------------------------------------------
@register(
    "correlation",
    sql=f"WITH {SQL_FEATURES}\n"
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM f" for a in STAT_COLS for b in STAT_COLS
    ),
    ids=("D3",),
)
def q_correlation(spark, sf):
    return R.correlation(features(spark, sf), STAT_COLS)


COLLINEAR_COLS = ["loc", "v", "d", "e", "b"]


def _sql_collinear(t: float = 0.999) -> str:
    cols = COLLINEAR_COLS
    checks = []
    for j, b in enumerate(cols):
        earlier = cols[:j]
        if not earlier:
            checks.append(f"SELECT '{b}' AS column_name, true AS kept")
            continue
        cond = " OR ".join(f"abs(corr({a}, {b})) >= {t}" for a in earlier)
        checks.append(f"SELECT '{b}' AS column_name, NOT coalesce(({cond}), false) AS kept FROM g")
    return f"WITH {SQL_FEATURES}, g AS (SELECT *, v / 3000 AS b FROM f)\n" + " UNION ALL ".join(checks)


@register("drop_collinear", sql=_sql_collinear(), ids=("D4", "B8"))
def q_drop_collinear(spark, sf):
    f = features(spark, sf).withColumn("b", F.col("v") / 3000)
    return R.drop_collinear(f, COLLINEAR_COLS)


# --- D5 ----------------------------------------------------------------------
@register(
    "histogram",
    sql=f"""
WITH {SQL_FEATURES},
long AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in STAT_COLS)} FROM f) ON {', '.join(STAT_COLS)} INTO NAME column_name VALUE value),
rng AS (SELECT column_name, min(value) AS lo, max(value) AS hi FROM long GROUP BY column_name)
SELECT column_name, CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(49, floor((value - lo) / (hi - lo) * 50)) END AS INTEGER) AS bin,
       count(*) AS n
FROM long JOIN rng USING (column_name) GROUP BY ALL""",
    ids=("D5",),
)
def q_histogram(spark, sf):
    return R.histogram(features(spark, sf), STAT_COLS, 50)


# --- D6 / K5 -----------------------------------------------------------------
@register(
    "confusion",
    sql=f"WITH {SQL_FEATURES}\nSELECT defects AS actual, CAST(p >= {GATE_T} AS INTEGER) AS predicted, count(*) AS n FROM f GROUP BY ALL",
    ids=("D6", "K5"),
)
def q_confusion(spark, sf):
    f = features(spark, sf).withColumn("pred", R.threshold(F.col("p"), GATE_T))
    return R.confusion(f, "defects", "pred")


@register(
    "threshold",
    sql=f"""WITH {SQL_FEATURES}
SELECT t AS threshold, CAST(p >= t AS INTEGER) AS pred, count(*) AS n FROM f, (VALUES (0.2::DOUBLE), (0.4::DOUBLE)) v(t) GROUP BY ALL""",
    ids=("K5",),
)
def q_threshold(spark, sf):
    f = features(spark, sf)
    # Two thresholds evaluated in one pass, then unpivoted (no row copies).
    agg = f.groupBy(R.threshold(F.col("p"), 0.2).alias("p02"), R.threshold(F.col("p"), 0.4).alias("p04")).agg(
        F.count(F.lit(1)).alias("n")
    )
    long = agg.selectExpr("stack(2, 0.2D, p02, n, 0.4D, p04, n) AS (threshold, pred, n)")
    return long.groupBy("threshold", "pred").agg(F.sum("n").alias("n"))


# --- D7 ----------------------------------------------------------------------
def _sql_report() -> str:
    return f"""WITH {SQL_FEATURES},
c AS (
  SELECT CAST(sum(CASE WHEN defects = 1 AND p >= {GATE_T} THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
         CAST(sum(CASE WHEN defects = 0 AND p >= {GATE_T} THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN defects = 1 AND p < {GATE_T} THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
         CAST(sum(CASE WHEN defects = 0 AND p < {GATE_T} THEN 1 ELSE 0 END) AS DOUBLE) AS tn
  FROM f
),
m AS (
  SELECT *, tp + fp + fn + tn AS n,
         coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
         coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0
  FROM c
),
k AS (
  SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
         tp + fn AS s1, tn + fp AS s0 FROM m
)
SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM k
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / n, 6), CAST(n AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6), round((f0 * s0 + f1 * s1) / n, 6), CAST(n AS BIGINT) FROM k"""


@register("class_report", sql=_sql_report(), ids=("D7",))
def q_class_report(spark, sf):
    f = features(spark, sf).withColumn("pred", R.threshold(F.col("p"), GATE_T))
    return R.report(f, "defects", "pred")


# --- K6 ----------------------------------------------------------------------
@register(
    "sweep",
    sql=f"""WITH {SQL_FEATURES}
SELECT t AS threshold,
       CAST(sum(CASE WHEN defects = 1 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN defects = 0 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN defects = 1 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN defects = 0 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM f, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) v(t) GROUP BY t""",
    ids=("K6",),
)
def q_sweep(spark, sf):
    return R.sweep(features(spark, sf), "defects", "p", THRESHOLDS)


# --- K1 / K2 -----------------------------------------------------------------
SQL_SPLIT = f"""s AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY defects ORDER BY md5({SQL_ID}))
                      <= ceil(count(*) OVER (PARTITION BY defects) * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM f
)"""


def split(spark, sf):
    return R.stratified_split(features(spark, sf), "defects", _id(), 0.2)


@register(
    "split_counts",
    sql=f"WITH {SQL_FEATURES}, {SQL_SPLIT}\nSELECT defects, split, count(*) AS n FROM s GROUP BY ALL",
    ids=("K1",),
)
def q_split_counts(spark, sf):
    return split(spark, sf).groupBy("defects", "split").agg(F.count(F.lit(1)).alias("n"))


@register(
    "scale",
    sql=f"WITH {SQL_FEATURES}, {SQL_SPLIT}\n"
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM s WHERE split = 'train'"
        for c in STAT_COLS
    ),
    ids=("K2",),
)
def q_scale(spark, sf):
    train = split(spark, sf).filter(F.col("split") == "train")
    sc = R.fit_scaler(train, STAT_COLS)
    items = ", ".join(f"'{c}', round(`{c}__mean`, 4), round(`{c}__std`, 4)" for c in STAT_COLS)
    return sc.selectExpr(f"stack({len(STAT_COLS)}, {items}) AS (column_name, mean, std)")


@register(
    "scaled_outliers",
    sql=f"""WITH {SQL_FEATURES}, {SQL_SPLIT},
sc AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in STAT_COLS)} FROM s WHERE split = 'train')
SELECT {', '.join(f'CAST(sum(CASE WHEN abs(({c} - {c}_m) / {c}_s) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS {c}_gt2' for c in STAT_COLS)}
FROM s, sc WHERE split = 'test'""",
    ids=("K2",),
)
def q_scaled_outliers(spark, sf):
    sp = split(spark, sf).checkpoint(eager=True)  # fit on train, apply to test
    sc = R.fit_scaler(sp.filter(F.col("split") == "train"), STAT_COLS)
    z = R.apply_scaler(sp.filter(F.col("split") == "test"), sc, STAT_COLS)
    return z.agg(*[F.sum(F.when(F.abs(F.col(c)) > 2, 1).otherwise(0)).cast("bigint").alias(f"{c}_gt2") for c in STAT_COLS])


# --- C7 ----------------------------------------------------------------------
@register(
    "class_weights",
    sql="""WITH c AS (SELECT quality, count(*) AS n_c FROM labels GROUP BY quality)
SELECT quality, round((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c), 6) AS weight FROM c""",
    ids=("C7",),
)
def q_class_weights(spark, sf):
    w = R.class_weights(tables.read(spark, sf, "labels"), "quality")
    return w.select("quality", F.round("weight", 6).alias("weight"))


# --- E9 ----------------------------------------------------------------------
def _importance_row(f):
    """Data-derived global importances: |corr(feature, label)| normalised."""
    r = f.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("defects").cast("double"))).alias(c) for c in STAT_COLS])
    tot = sum((F.col(c) for c in STAT_COLS[1:]), F.col(STAT_COLS[0]))
    return r.select(*[F.round(F.col(c) / tot, 6).alias(c) for c in STAT_COLS])


@register(
    "top_reasons",
    sql=f"""WITH {SQL_FEATURES},
r AS (SELECT {', '.join(f'abs(corr({c}, defects)) AS {c}' for c in STAT_COLS)} FROM f),
i AS (SELECT {', '.join(f"round({c} / ({' + '.join(STAT_COLS)}), 6) AS {c}" for c in STAT_COLS)} FROM r),
l AS (UNPIVOT i ON {', '.join(STAT_COLS)} INTO NAME feature VALUE impact),
t AS (SELECT list(feature ORDER BY impact DESC, feature)[1:3] AS top FROM l)
SELECT l_orderkey, l_linenumber, array_to_string(top, ',') AS reasons,
       CASE top[1] {' '.join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in STAT_COLS)} END AS top_value
FROM f, t""",
    ids=("E9",),
)
def q_top_reasons(spark, sf):
    f = features(spark, sf)
    out = R.top_reasons(f, _importance_row(f), STAT_COLS)
    return out.select(
        "l_orderkey",
        "l_linenumber",
        F.array_join(F.transform("reasons", lambda r: r["feature"]), ",").alias("reasons"),
        F.col("reasons")[0]["value"].alias("top_value"),
    )


# --- B12 / B13 / B14 ---------------------------------------------------------
@register(
    "risk_gate",
    sql=f"""WITH {SQL_FEATURES}
SELECT l_returnflag, count(*) AS n_kept FROM f
WHERE NOT (l_linestatus = 'F') AND p >= {GATE_T} GROUP BY l_returnflag""",
    ids=("B12",),
)
def q_risk_gate(spark, sf):
    f = features(spark, sf)
    task = F.when(F.col("l_linestatus") == "F", F.lit("   ")).otherwise(F.concat(F.lit("Write tests for "), F.col("l_orderkey")))
    return R.gate(f, task, F.col("p"), GATE_T).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_kept"))


@register(
    "risk_label",
    sql=f"""WITH {SQL_FEATURES}
SELECT printf('{R.RISK_HEADER}', p, CASE WHEN p >= {R.HIGH_RISK_CUTOFF} THEN 'HIGH' ELSE 'LOW' END) AS header,
       count(*) AS n
FROM f GROUP BY ALL""",
    ids=("B13",),
)
def q_risk_label(spark, sf):
    f = features(spark, sf)
    header = F.format_string(R.RISK_HEADER, F.col("p"), R.risk_label(F.col("p")))
    return f.groupBy(header.alias("header")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "fallback_score",
    sql=f"""WITH {SQL_FEATURES}
SELECT l_linestatus, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE p END AS score,
       CASE WHEN l_linestatus = 'O' THEN '{R.FALLBACK_FEATURE}' ELSE 'model' END AS reason, count(*) AS n
FROM f GROUP BY ALL""",
    ids=("B14",),
)
def q_fallback_score(spark, sf):
    f = features(spark, sf)
    # Features are missing (injected) for open lines.
    present = F.col("l_linestatus") != "O"
    s, reason = R.fallback(F.col("p"), present)
    r = F.when(present, F.lit("model")).otherwise(reason[0]["feature"])
    return f.groupBy("l_linestatus", s.alias("score"), r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- K3 / K4 / K7 / K8 / A10 (rows only: no SQL model) ------------------------
def _train_test(spark, sf):
    # Training and scoring both read the split: written once, in columns (a
    # checkpoint would compute it twice and keep whole rows).  Class weights
    # come from the training rows alone.
    path = scratch_path(spark, "split")
    R.density(split(spark, sf)).write.parquet(path)
    sp = spark.read.parquet(path)
    train, test = (sp.filter(F.col("split") == x) for x in ("train", "test"))
    return R.with_weights(train, "defects"), test


def _forest(train):
    # The reference's 800 trees of depth 20, of all training rows.
    return R.fit_forest(train, MODEL_COLS, "defects")


@register("logistic_scores", ids=("K3", "K8"))
def q_logistic_scores(spark, sf):
    train, test = _train_test(spark, sf)
    model = R.fit_logistic(train, MODEL_COLS, "defects")
    scored = R.score(test, model).withColumn("pred", R.threshold(F.col("risk_score"), LOGISTIC_T))
    return scored.select("l_orderkey", "l_linenumber", "defects", "risk_score", "pred")


@register("forest_scores", ids=("K4", "K8"))
def q_forest_scores(spark, sf):
    train, test = _train_test(spark, sf)
    model = _forest(train)
    scored = R.score(test, model)
    return scored.withColumn("pred", R.threshold(F.col("risk_score"), R.DEFAULT_THRESHOLD)).select(
        "l_orderkey", "l_linenumber", "defects", "risk_score", "pred"
    )


@register("forest_report", ids=("K4", "K5", "D6", "D7"))
def q_forest_report(spark, sf):
    """Holdout report of the balanced forest at the gate threshold: the
    four confusion counts plus defect-class precision, recall and F1 (the
    shape of the published baseline, on the stand-in table)."""
    train, test = _train_test(spark, sf)
    model = _forest(train)
    pred = R.score(test, model).withColumn("pred", R.threshold(F.col("risk_score"), R.DEFAULT_THRESHOLD))
    c = R.counts(pred, "defects", "pred")
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return c.select(
        "tp", "tn", "fp", "fn",
        F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"),
        (F.col("tp") + F.col("fp")).alias("kept_by_gate"),
    )


@register("importances", ids=("K7", "F4"))
def q_importances(spark, sf):
    train, _ = _train_test(spark, sf)
    model = _forest(train)
    return R.importances(model, MODEL_COLS)


@register("model_roundtrip", ids=("A10", "K8"))
def q_model_roundtrip(spark, sf):
    train, test = _train_test(spark, sf)
    model = R.fit_logistic(train, MODEL_COLS, "defects")
    path = scratch_path(spark, "risk-model")
    R.save_model(model, path)
    return R.score(test, R.load_model(path)).select("l_orderkey", "l_linenumber", "risk_score")


# --- B9 / B10 ----------------------------------------------------------------
# ``loc - 1`` as the line count makes loc = 0 occur, where the two density
# rules differ.
@register(
    "density",
    sql=f"""WITH {SQL_FEATURES}, g AS (SELECT l_orderkey, l_linenumber, loc - 1 AS loc, vg, v FROM f)
SELECT l_orderkey, l_linenumber,
       vg / greatest(loc, 1.0) AS cd_serve, v / greatest(loc, 1.0) AS vpl_serve,
       CASE WHEN loc = 0 THEN 0.0 ELSE vg / loc END AS cd_train,
       CASE WHEN loc = 0 THEN 0.0 ELSE v / loc END AS vpl_train
FROM g""",
    ids=("B9",),
)
def q_density(spark, sf):
    f = features(spark, sf).select("l_orderkey", "l_linenumber", (F.col("loc") - 1).alias("loc"), "vg", "v")
    served = R.density(f, "serve").withColumnRenamed("complexity_density", "cd_serve").withColumnRenamed(
        "volume_per_line", "vpl_serve"
    )
    both = R.density(served, "train")
    # Single IEEE divisions: identical in both engines, so not rounded (a
    # rounding rule would differ on exact binary halves).
    return both.select(
        "l_orderkey", "l_linenumber", "cd_serve", "vpl_serve",
        F.col("complexity_density").alias("cd_train"), F.col("volume_per_line").alias("vpl_train"),
    )


@register(
    "clean_non_finite",
    sql="""SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END, 6) AS tax_per_discount
FROM lineitem""",
    ids=("B10",),
)
def q_clean_non_finite(spark, sf):
    li = tables.read(spark, sf, "lineitem")
    # Division by zero as Python computes it: +inf, or NaN for 0/0.
    raw = (
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(float("nan")))
        .when(F.col("l_discount") == 0, F.lit(float("inf")))
        .otherwise(F.col("l_tax") / F.col("l_discount"))
    )
    return li.select("l_orderkey", "l_linenumber", F.round(R.clean(raw), 6).alias("tax_per_discount"))
