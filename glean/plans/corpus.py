"""Chunking, code metrics, patches and table sinks over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from glean.functions import text as T
from glean.operators import chunk as C
from glean.operators import keyword as K
from glean.operators import metrics as M
from glean.operators import patch as PT
from glean.plans.registry import register, sql_rel_path, sql_strip
from glean.plans.scalars import sql_file_type
from glean.session import scratch_path
from glean.sources import io as IO
from glean.sources import tables

SP = T.PY_SPACE
STEP = C.CHUNK_SIZE - C.CHUNK_OVERLAP

SQL_STRIDE = f"""c AS (
  SELECT doc_id, {sql_rel_path()} AS relative_path, unnest(range(len(s))) AS chunk_no, unnest(s) AS st, text
  FROM (SELECT *, range(1, greatest(length(text) - {C.CHUNK_OVERLAP}, 1) + 1, {STEP}) AS s FROM documents)
),
k AS (SELECT doc_id, relative_path, CAST(chunk_no AS INTEGER) AS chunk_no, substr(text, st, {C.CHUNK_SIZE}) AS chunk FROM c WHERE length(substr(text, st, {C.CHUNK_SIZE})) > 0)"""


def stride_chunks(spark, sf):
    return C.split_stride(tables.corpus(spark, sf).select("doc_id", "relative_path", "text"))


# --- L1 ----------------------------------------------------------------------
@register(
    "chunk_stride",
    sql=f"WITH {SQL_STRIDE}\nSELECT doc_id, chunk_no, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM k",
    ids=("L1",),
)
def q_chunk_stride(spark, sf):
    ch = stride_chunks(spark, sf)
    return ch.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@register("chunk_recursive", ids=("L1", "J4"))
def q_chunk_recursive(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id", "text")
    ch = C.split_recursive(d)
    return ch.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


# --- D15 ---------------------------------------------------------------------
@register(
    "chunk_summary",
    sql=f"""WITH {SQL_STRIDE},
f AS (SELECT relative_path, count(*) AS n_chunks, arg_min(chunk, chunk_no) AS first FROM k GROUP BY relative_path)
SELECT relative_path, n_chunks, substr(replace(first, chr(10), ' '), 1, 200) AS description_200,
       array_to_string(string_split(first, chr(10))[1:3], chr(10) || '       ') AS code_preview
FROM f""",
    ids=("D15",),
)
def q_chunk_summary(spark, sf):
    ch = stride_chunks(spark, sf).withColumn("description", F.col("chunk")).withColumn("source_code", F.col("chunk"))
    return C.summary(ch)


# --- J3 ----------------------------------------------------------------------
@register(
    "enrich",
    sql=f"""WITH {SQL_STRIDE}
SELECT doc_id, chunk_no, md5(string_split({sql_strip('chunk')}, chr(10))[1]) AS description_md5, CAST(length(chunk) AS INTEGER) AS code_chars FROM k""",
    ids=("J3", "DM3"),
)
def q_enrich(spark, sf):
    """The declared default hook: the first line of a chunk describes it."""
    ch = stride_chunks(spark, sf)
    return C.enrich(ch).select("doc_id", "chunk_no", F.md5("description").alias("description_md5"), F.length("source_code").alias("code_chars"))


# --- D11 ---------------------------------------------------------------------
@register(
    "halstead",
    sql=f"""WITH t AS (
  SELECT doc_id, regexp_extract_all(text, '{M.OPERAND_PATTERN}', 0) AS opd, regexp_extract_all(text, '{M.OPERATOR_PATTERN}', 0) AS opr
  FROM documents
),
c AS (SELECT doc_id, len(list_distinct(opr)) AS a, len(list_distinct(opd)) AS b, len(opr) AS ta, len(opd) AS tb FROM t),
h AS (
  SELECT doc_id, a, b, ta, tb, CASE WHEN a + b > 0 THEN (ta + tb) * log2(a + b) ELSE 0.0 END AS volume,
         coalesce(a / 2.0 * tb / nullif(CAST(b AS DOUBLE), 0), 0.0) AS difficulty
  FROM c
)
SELECT doc_id, CAST(a AS INTEGER) AS n1, CAST(b AS INTEGER) AS n2, CAST(ta AS INTEGER) AS big_n1, CAST(tb AS INTEGER) AS big_n2,
       round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(difficulty * volume, 4) AS effort,
       round(volume / {M.BUG_DIVISOR}, 6) AS bugs
FROM h""",
    ids=("D11", "L2"),
)
def q_halstead(spark, sf):
    d = tables.read(spark, sf, "documents")
    h = d.select("doc_id", M.halstead(F.col("text")).alias("h"))
    return h.select(
        "doc_id",
        F.col("h.n1").alias("n1"), F.col("h.n2").alias("n2"), F.col("h.big_n1").alias("big_n1"), F.col("h.big_n2").alias("big_n2"),
        F.round("h.volume", 6).alias("volume"), F.round("h.difficulty", 6).alias("difficulty"),
        F.round("h.effort", 4).alias("effort"), F.round("h.bugs", 6).alias("bugs"),
    )


# --- D9 ----------------------------------------------------------------------
@register(
    "mean_complexity",
    sql=f"""WITH b AS (
  SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: length({sql_strip('x')}) > 0) AS blocks FROM documents
),
c AS (SELECT doc_id, list_transform(blocks, lambda x: 1.0 + len(regexp_extract_all(x, '[.!?]', 0))) AS cx FROM b)
SELECT doc_id, round(CASE WHEN len(cx) > 0 THEN list_sum(cx) / len(cx) ELSE 1.0 END, 6) AS mean_complexity FROM c""",
    ids=("D9",),
)
def q_mean_complexity(spark, sf):
    d = tables.read(spark, sf, "documents")
    return d.select("doc_id", F.round(M.mean_complexity(M.block_complexity(F.col("text"))), 6).alias("mean_complexity"))


# --- L2 / J1 -----------------------------------------------------------------
def _python_string(text):
    """The inside of a Python string literal of ``text``, on as many lines; null is the empty text."""
    escaped = F.coalesce(text, F.lit(""))
    for c, e in (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\x00"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(c), F.lit(e))
    return escaped


@register(
    "code_metrics",
    sql="""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, s, i, len(list_filter(string_split(s, ' '), lambda x: x <> '')) % 3 AS k FROM l),
c AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE k = 1) AS ifs, count(*) FILTER (WHERE k = 2) AS whiles,
         count(DISTINCT s) AS texts, max(k = 1) AS has_if, max(k = 2) AS has_while
  FROM w GROUP BY doc_id
),
h AS (
  SELECT doc_id, n, ifs, whiles,
         -- operators: def ( ) : return, and for every line = or if in : or while and :
         5 + (n - ifs - whiles) + 3 * ifs + 3 * whiles AS ops,
         5 + CAST(n > ifs + whiles AS INTEGER) + 2 * CAST(has_if AS INTEGER) + 2 * CAST(has_while AS INTEGER) AS op_kinds,
         -- operands: f x x, and for every line x and its text, once more x below if and while
         3 + 2 * (n - ifs - whiles) + 3 * ifs + 3 * whiles AS opnds, 2 + texts AS opnd_kinds
  FROM c
),
m AS (
  SELECT *, CAST(ops + opnds AS DOUBLE) * log2(CAST(op_kinds + opnd_kinds AS DOUBLE)) AS volume,
         (op_kinds / 2.0::DOUBLE) * (CAST(opnds AS DOUBLE) / opnd_kinds) AS difficulty
  FROM h
)
SELECT doc_id, CAST(2 + n + ifs + whiles AS DOUBLE) AS loc, CAST(1 + ifs + 2 * whiles AS DOUBLE) AS vg,
       round(volume, 6) AS v, round(difficulty, 6) AS d, round(difficulty * volume, 3) AS e
FROM m""",
    ids=("L2", "B9", "B11"),
)
def q_code_metrics(spark, sf):
    """Metrics of a function with a statement for every line of the text: an assignment, a branch or a loop by its words."""
    docs = tables.read(spark, sf, "documents")

    def statement(line):
        words = F.size(F.filter(F.split(line, " "), lambda w: w != "")) % 3
        text = F.concat(F.lit("'"), _python_string(line), F.lit("'"))
        return (
            F.when(words == 1, F.concat(F.lit("    if x in "), text, F.lit(":\n        x\n")))
            .when(words == 2, F.concat(F.lit("    while x and "), text, F.lit(":\n        x\n")))
            .otherwise(F.concat(F.lit("    x = "), text, F.lit("\n")))
        )

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), statement)
    code = F.concat(F.lit("def f(x):\n"), F.array_join(lines, ""), F.lit("    return x\n"))
    found = M.code_metrics(docs.select("doc_id", code.alias("text")))
    return found.select("doc_id", "loc", "vg", *[F.round(c, 6).alias(c) for c in ("v", "d")], F.round("e", 3).alias("e"))


@register(
    "code_metrics_lines",
    sql="""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
c AS (
  SELECT doc_id, len(ls) AS n,
         -- def ( ) : return (5 of 5 differ); f x x and every line (f, x and the different lines differ)
         CAST(5 + 3 + len(ls) AS DOUBLE) AS len, log2(CAST(5 + 2 + len(list_distinct(ls)) AS DOUBLE)) AS bits,
         5 / 2.0::DOUBLE * (3 + len(ls)) / (2 + len(list_distinct(ls))) AS d
  FROM l
)
SELECT doc_id, CAST(2 + n AS DOUBLE) AS loc, 1.0::DOUBLE AS vg, round(len * bits, 6) AS v, round(d, 6) AS d, round(d * len * bits, 4) AS e FROM c""",
    ids=("L2", "B9", "B11"),
)
def q_code_metrics_lines(spark, sf):
    """Metrics of a function with every line of the text as a statement, so that they depend on the whole text."""
    docs = tables.read(spark, sf, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("    '"), _python_string(x), F.lit("'\n")))
    code = F.concat(F.lit("def f(x):\n"), F.array_join(lines, ""), F.lit("    return x\n"))
    found = M.code_metrics(docs.select("doc_id", code.alias("text")))
    return found.select("doc_id", "loc", "vg", *[F.round(c, 6).alias(c) for c in ("v", "d")], F.round("e", 4).alias("e"))


def _word_metrics(code: str) -> dict:
    words = code.split()
    return {"loc": float(len(code.splitlines())), "v": float(len(words)), "d": float(len(set(words)))}


@register(
    "metrics_extractor",
    sql=f"""WITH w AS (
  SELECT doc_id, CAST(len(string_split(rtrim(text, chr(10)), chr(10))) AS DOUBLE) AS loc, regexp_extract_all(text, '[^{SP}]+', 0) AS ws, text
  FROM documents
)
SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE loc END AS loc, CAST(len(ws) AS DOUBLE) AS v, CAST(len(list_distinct(ws)) AS DOUBLE) AS d,
       0.0::DOUBLE AS vg, 0.0::DOUBLE AS e, 0.0::DOUBLE AS complexity_density, 0.0::DOUBLE AS volume_per_line
FROM w""",
    ids=("J1", "B11", "B10"),
)
def q_metrics_extractor(spark, sf):
    return M.extract(tables.read(spark, sf, "documents"), _word_metrics)


# --- L3 / C8 -----------------------------------------------------------------
def _patches(docs):
    second = F.coalesce(F.try_element_at(F.split("text", "\n"), F.lit(2)), F.lit(""))
    patch = F.concat(
        F.lit(PT.SEARCH_MARK + "\n"), second, F.lit("\n" + PT.DIVIDER + "\n"), second, F.lit(" [patched]\n" + PT.REPLACE_MARK)
    )
    return docs.select("relative_path", patch.alias("patch"))


@register(
    "patch_exact",
    sql=f"""WITH d AS (
  SELECT {sql_rel_path()} AS relative_path, text, coalesce(string_split(text, chr(10))[2], '') AS s FROM documents
),
p AS (
  SELECT relative_path, text, regexp_replace(regexp_replace(s, '^[\\r\\n]+|[\\r\\n]+$', '', 'g'), '[ \\t]+$', '') AS search,
         regexp_replace(s || ' [patched]', '^[\\r\\n]+|[\\r\\n]+$', '', 'g') AS repl
  FROM d
),
m AS (
  SELECT *, CASE WHEN search <> '' AND strpos(text, search) > 0 THEN 'exact'
                 WHEN repl <> '' THEN 'error' ELSE 'fallback' END AS mode
  FROM p
)
SELECT relative_path, mode,
       md5(CASE WHEN mode = 'exact' THEN left(text, strpos(text, search) - 1) || repl || substr(text, strpos(text, search) + length(search))
                WHEN mode = 'fallback' THEN text END) AS content_md5,
       CASE WHEN mode = 'error' THEN 'Error: None of the lines in the SEARCH block were found in the file.' || chr(10)
                                     || 'AI tried to find lines from:' || chr(10) || search END AS error
FROM m""",
    ids=("L3", "C8", "H-s16"),
)
def q_patch_exact(spark, sf):
    docs = tables.corpus(spark, sf)
    out = PT.apply(docs, _patches(docs))
    return out.select("relative_path", "mode", F.md5("content").alias("content_md5"), "error")


# Every path of L3 on texts that end in ``q = 'v' end``: by doc_id, an exact
# block, a line in other quotes, a line out of its block, a second divider, a
# block that is not there, and a patch without markers.
FORM_TAIL = "q = 'v' end"
FORMS = [
    ("q = 'v'", "q = 1"),
    ('q = "v"', "q = 2"),
    ("no such line\n  q = 'v'  ", "first\nsecond"),
    ("q = 'v'", f"q = 3\n{PT.DIVIDER}\nlost"),
    ("no such line", "q = 4"),
]


def _patch(search: str, replace: str) -> str:
    return f"{PT.SEARCH_MARK}\n{search}\n{PT.DIVIDER}\n{replace}\n{PT.REPLACE_MARK}"


@register(
    "patch_forms",
    sql=f"""SELECT {sql_rel_path()} AS relative_path,
       CASE doc_id % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'fallback' WHEN 2 THEN 'fallback' WHEN 3 THEN 'exact' ELSE 'error' END AS mode,
       md5(text || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'q = 1 end' WHEN 1 THEN 'q = 2 end' WHEN 2 THEN 'second end' WHEN 3 THEN 'q = 3 end' END) AS content_md5,
       CASE doc_id % 6
         WHEN 4 THEN 'Error: None of the lines in the SEARCH block were found in the file.' || chr(10)
                     || 'AI tried to find lines from:' || chr(10) || 'no such line'
         WHEN 5 THEN 'Error: Invalid patch format. Missing <<<<<<< SEARCH, =======, or >>>>>>> REPLACE.' END AS error
FROM documents""",
    ids=("L3", "C8", "H-s16"),
)
def q_patch_forms(spark, sf):
    docs = tables.corpus(spark, sf).withColumn("text", F.concat("text", F.lit("\n" + FORM_TAIL)))
    form = F.array(*[F.lit(_patch(*f)) for f in FORMS], F.lit("no markers"))
    patches = docs.select("relative_path", F.element_at(form, (F.col("doc_id") % 6 + 1).cast("int")).alias("patch"))
    return PT.apply(docs, patches).select("relative_path", "mode", F.md5("content").alias("content_md5"), "error")


@register(
    "patch_sequence",
    sql=f"""SELECT {sql_rel_path()} AS relative_path, 'exact,error,fallback' AS modes,
       md5(text || chr(10) || 'done') AS content_md5 FROM documents""",
    ids=("L3", "C8"),
)
def q_patch_sequence(spark, sf):
    """Patches of one file one after another, each on what the one before left."""
    docs = tables.corpus(spark, sf).withColumn("text", F.concat("text", F.lit("\n" + FORM_TAIL)))
    queue = [_patch("q = 'v'", "q = 7"), _patch("q = 'v' end", "lost"), _patch("  q = 7 end\nzzz", "done")]
    patches = docs.select("relative_path", F.posexplode(F.array(*[F.lit(p) for p in queue])).alias("seq", "patch"))
    out = PT.apply_in_order(docs, patches, "seq")
    return out.select("relative_path", F.array_join("modes", ",").alias("modes"), F.md5("content").alias("content_md5"))


@register(
    "patch_join",
    sql=f"""WITH d AS (
  SELECT {sql_rel_path()} AS relative_path, text, coalesce(string_split(text, chr(10))[2], '') AS s FROM documents
),
p AS (SELECT relative_path, s FROM d WHERE length({sql_strip('s')}) > 0)
SELECT d.relative_path, p.relative_path IS NOT NULL AS has_patch,
       CASE WHEN p.relative_path IS NULL THEN 'none' ELSE 'exact' END AS mode,
       md5(CASE WHEN p.relative_path IS NULL THEN d.text
                ELSE left(d.text, strpos(d.text, regexp_replace(p.s, '[ \\t]+$', '')) - 1) || p.s || ' [patched]'
                     || substr(d.text, strpos(d.text, regexp_replace(p.s, '[ \\t]+$', '')) + length(regexp_replace(p.s, '[ \\t]+$', ''))) END) AS content_md5
FROM d LEFT JOIN p USING (relative_path)""",
    ids=("C8", "L3"),
)
def q_patch_join(spark, sf):
    """Patches keyed by path, left-joined to every document."""
    docs = tables.corpus(spark, sf)
    second = F.coalesce(F.try_element_at(F.split("text", "\n"), F.lit(2)), F.lit(""))
    patches = _patches(docs.filter(F.length(T.py_strip(second)) > 0))
    applied = PT.apply(docs, patches)
    out = docs.select("relative_path", "text").join(applied, "relative_path", "left")
    return out.select(
        "relative_path",
        F.col("mode").isNotNull().alias("has_patch"),
        F.coalesce("mode", F.lit("none")).alias("mode"),
        F.md5(F.coalesce("content", "text")).alias("content_md5"),
    )


# --- A5 ----------------------------------------------------------------------
# One metrics row per file, in the export's fixed column order, written as
# CSV and read back: loc = lines, v(g) = mean block complexity, Halstead
# volume / difficulty / effort and b = v / 3000.
@register(
    "metrics_sink",
    sql=f"""WITH t AS (
  SELECT doc_id, {sql_rel_path()} AS p, text,
         regexp_extract_all(text, '{M.OPERAND_PATTERN}', 0) AS opd, regexp_extract_all(text, '{M.OPERATOR_PATTERN}', 0) AS opr
  FROM documents
),
c AS (SELECT *, len(list_distinct(opr)) AS a, len(list_distinct(opd)) AS b2, len(opr) AS ta, len(opd) AS tb FROM t),
h AS (
  SELECT *, CASE WHEN a + b2 > 0 THEN (ta + tb) * log2(a + b2) ELSE 0.0 END AS vol,
         coalesce(a / 2.0 * tb / nullif(CAST(b2 AS DOUBLE), 0), 0.0) AS dif,
         list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda x: length({sql_strip('x')}) > 0),
                        lambda x: 1.0 + len(regexp_extract_all(x, '[.!?]', 0))) AS cx
  FROM c
)
SELECT string_split(p, '/')[-1] AS file_name, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS loc,
       round(CASE WHEN len(cx) > 0 THEN list_sum(cx) / len(cx) ELSE 1.0 END, 6) AS "v(g)",
       round(vol, 6) AS v, round(dif, 6) AS d, round(dif * vol, 4) AS e, round(vol / {M.BUG_DIVISOR}, 6) AS b, p AS file_path
FROM h""",
    ids=("A5", "DM8", "D11", "D9"),
)
def q_metrics_sink(spark, sf):
    d = tables.corpus(spark, sf)
    h = M.halstead(F.col("text"))
    m = d.select(
        F.col("file_name"),
        F.size(F.split("text", "\n")).cast("double").alias("loc"),
        F.round(M.mean_complexity(M.block_complexity(F.col("text"))), 6).alias("vg"),
        F.round(h["volume"], 6).alias("v"), F.round(h["difficulty"], 6).alias("d"),
        F.round(h["effort"], 4).alias("e"), F.round(h["bugs"], 6).alias("b"),
        F.col("relative_path").alias("file_path"),
    )
    path = scratch_path(spark, "metrics-csv")
    IO.write_metrics(m, path)
    return spark.read.option("header", True).schema(
        "file_name string, loc double, `v(g)` double, v double, d double, e double, b double, file_path string"
    ).csv(path)


# --- A4 ----------------------------------------------------------------------
@register(
    "csv_training",
    sql="""SELECT CAST(l_returnflag = 'R' AS INTEGER) AS defects, count(*) AS n, round(sum(l_quantity), 4) AS loc_sum FROM lineitem GROUP BY ALL""",
    ids=("A4", "DM7"),
)
def q_csv_training(spark, sf):
    li = tables.read(spark, sf, "lineitem")
    out = li.select(
        F.col("l_quantity").alias("loc"), F.col("l_discount").alias("v(g)"), F.col("l_extendedprice").alias("v"),
        F.col("l_tax").alias("d"), F.lit(0.0).alias("e"), (F.col("l_extendedprice") / 3000).alias("b"),
        (F.col("l_returnflag") == "R").alias("defects"),
    )
    path = scratch_path(spark, "train-csv")
    out.write.mode("overwrite").option("header", True).csv(path)
    back = IO.read_training_csv(spark, path)
    return back.groupBy("defects").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loc"), 4).alias("loc_sum"))


# --- A6 / A7 -----------------------------------------------------------------
@register(
    "vector_append",
    sql="SELECT label = 0 AS is_test, 2 * count(*) AS n_plain, count(*) AS n_dedup FROM embeddings GROUP BY ALL",
    ids=("A6", "A7", "DM4"),
)
def q_vector_append(spark, sf):
    e = tables.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", (F.col("label") == 0).alias("is_test")
    )
    plain, dedup = scratch_path(spark, "vectors"), scratch_path(spark, "vectors-dedup")
    for _ in range(2):
        IO.append_vectors(e, plain)
        IO.append_vectors(e, dedup, dedup_key="chunk_id")
    a = IO.read_vectors(spark, plain).groupBy("is_test").agg(F.count(F.lit(1)).alias("n_plain"))
    b = IO.read_vectors(spark, dedup).groupBy("is_test").agg(F.count(F.lit(1)).alias("n_dedup"))
    return a.join(b, "is_test")


# --- A8 ----------------------------------------------------------------------
@register(
    "index_persist",
    sql=f"""WITH d AS (SELECT doc_id, text FROM documents WHERE length({sql_strip('text')}) >= 10 AND source <> 'src0'),
t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.TOKEN_PATTERN}', 0)) AS term FROM d)
SELECT count(*) AS n_terms, (SELECT count(*) FROM d) AS n_docs FROM t""",
    ids=("A8", "DM5"),
)
def q_index_persist(spark, sf):
    from glean.plans.retrieval import keyword_docs

    idx = K.build_index(keyword_docs(spark, sf)).write(scratch_path(spark, "bm25-index"))
    return idx.term_stats.agg(F.count(F.lit(1)).alias("n_terms")).crossJoin(idx.corpus_stats.select("n_docs"))


# --- A1 ----------------------------------------------------------------------
# The documents are written out as a source tree (seed documents under an
# ignored ``tests/`` folder) in the shared store, then scanned back.
def _tree_files(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    folder = F.when(F.col("source") == tables.TEST_SOURCE, F.concat(F.lit("tests/"), F.col("source"))).otherwise(F.col("source"))
    name = F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(F.concat(folder, F.lit("/"), name).alias("relative_path"), "text")


@register(
    "tree_scan",
    sql=f"""WITH d AS (SELECT {sql_rel_path()} AS relative_path, source, text FROM documents
           WHERE source <> 'src0' AND length({sql_strip('text')}) >= 10)
SELECT relative_path, source AS service,
       {sql_file_type("string_split(relative_path, '/')[-1]", 'false')} AS file_type,
       CAST(length(text) AS INTEGER) AS n_chars
FROM d""",
    ids=("A1", "A2", "B1", "B2"),
)
def q_tree_scan(spark, sf):
    from glean.sources import tree

    root = scratch_path(spark, "tree")
    tree.write_tree(_tree_files(spark, sf), root)
    files = tree.scan(spark, root, extensions=(".md",))
    docs = IO.to_documents(files, is_test=False)
    return docs.select("relative_path", "service", "file_type", F.length("text").alias("n_chars"))
