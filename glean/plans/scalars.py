"""Scalar Column functions over whole tables (groups A, B, F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glean.functions import logs as LG
from glean.functions import paths as P
from glean.functions import text as T
from glean.plans.registry import register, sql_rel_path, sql_strip, sql_tokens
from glean.sources import io as IO
from glean.sources import tables

URL_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/?([^?#]*)"
SP = T.PY_SPACE


def url_path(c):
    return F.regexp_extract(c, URL_PATH, 1)


def sql_url_path(x="url"):
    return f"regexp_extract({x}, '{URL_PATH}', 1)"


def _case_map(expr: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {default} END)"


def sql_language_id(x: str) -> str:
    key = f"lower({sql_strip(x)})"
    canon = _case_map(key, P.LANGUAGE_ALIASES, key)
    known = ", ".join(f"'{k}'" for k in P.EXTENSIONS_BY_LANGUAGE)
    return f"(CASE WHEN {canon} IN ({known}) THEN {canon} ELSE '{P.DEFAULT_LANGUAGE}' END)"


def sql_basename(x: str) -> str:
    return f"string_split({x}, '/')[-1]"


def sql_dirname(x: str) -> str:
    return f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"


def sql_suffix(x: str) -> str:
    return f"regexp_extract({sql_basename(x)}, '[^.](\\.[^.]*)$', 1)"


def sql_file_type(name: str, is_test: str) -> str:
    n = f"lower({name})"
    parts = [f"WHEN {is_test} OR starts_with({n}, 'test_') THEN '{P.UNIT_TEST}'"]
    for needles, label in P.FILE_TYPE_RULES:
        cond = " OR ".join(f"strpos({n}, '{x}') > 0" for x in needles)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return f"(CASE {' '.join(parts)} ELSE '{P.DEFAULT_FILE_TYPE}' END)"


def sql_normalise(x: str, lower: bool = False) -> str:
    out = sql_strip(f"replace({x}, '\\', '/')")
    out = f"lower({out})" if lower else out
    return f"coalesce({out}, '')"


# --- B1 --------------------------------------------------------------------
@register(
    "file_type",
    sql=f"""
WITH f AS (
  SELECT doc_id, source = 'src0' AS is_test,
         array_to_string({sql_tokens('text')}[1:3], '_') || '.py' AS file_name FROM documents
)
SELECT doc_id, file_name, {sql_file_type('file_name', 'is_test')} AS file_type FROM f""",
    ids=("B1",),
)
def q_file_type(spark, sf):
    d = tables.corpus(spark, sf)
    name = F.concat(F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), "_"), F.lit(".py"))
    return d.select("doc_id", name.alias("file_name"), "is_test").select(
        "doc_id", "file_name", P.file_type(F.col("file_name"), F.col("is_test")).alias("file_type")
    )


# --- B2 --------------------------------------------------------------------
@register(
    "service",
    sql=f"""
WITH p AS (SELECT page_id, {sql_url_path()} AS path FROM pages)
SELECT page_id, path, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[1] ELSE 'root' END AS service FROM p""",
    ids=("B2",),
)
def q_service(spark, sf):
    p = tables.read(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return p.select("page_id", "path", P.service(F.col("path")).alias("service"))


# --- B4 --------------------------------------------------------------------
@register(
    "language_id",
    sql=f"SELECT doc_id, lang, {sql_language_id('lang')} AS lang_id FROM documents",
    ids=("B4",),
)
def q_language_id(spark, sf):
    d = tables.read(spark, sf, "documents")
    return d.select("doc_id", "lang", P.language_id(F.col("lang")).alias("lang_id"))


# --- B5 --------------------------------------------------------------------
@register(
    "merge_metadata",
    sql="""
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'base') AS k, event_type,
       CAST(3 AS INTEGER) AS n_keys
FROM events""",
    ids=("B5",),
)
def q_merge_metadata(spark, sf):
    e = tables.read(spark, sf, "events")
    base = F.create_map(
        F.lit("event_type"), F.col("event_type"), F.lit("k"), F.lit("base"), F.lit("user"), F.col("user_id").cast("string")
    )
    extra = F.from_json(F.col("props"), "map<string,string>")
    m = IO.merge_metadata(base, extra)
    return e.select(
        "event_id",
        F.try_element_at(m, F.lit("k")).alias("k"),
        F.try_element_at(m, F.lit("event_type")).alias("event_type"),
        F.size(m).alias("n_keys"),
    )


# --- B3 / G2 / C5 ----------------------------------------------------------
def _sql_extensions(lang: str, is_test: str) -> str:
    lid = sql_language_id(lang)
    cases = " ".join(
        f"WHEN {lid} = '{k}' THEN [{', '.join(repr(e) for e in v)}]" for k, v in P.EXTENSIONS_BY_LANGUAGE.items()
    )
    code = f"(CASE {cases} END)"
    docs = "[" + ", ".join(repr(e) for e in P.SOURCE_DOC_EXTENSIONS) + "]"
    return (
        f"array_to_string(list_sort(CASE WHEN NOT {is_test} AND {lid} <> 'markdown' "
        f"THEN list_distinct(list_concat({code}, {docs})) ELSE list_distinct({code}) END), ',')"
    )


@register(
    "extensions",
    sql=f"SELECT doc_id, {_sql_extensions('lang', "source = 'src0'")} AS extensions FROM documents",
    ids=("G2", "B3"),
)
def q_extensions(spark, sf):
    d = tables.corpus(spark, sf)
    return d.select("doc_id", F.array_join(P.extensions_col(F.col("lang"), F.col("is_test")), ",").alias("extensions"))


@register(
    "lookup_suffix",
    sql=f"""
WITH p AS (SELECT page_id, {sql_url_path()} AS path FROM pages)
SELECT page_id, path FROM p WHERE {sql_suffix('path')} IN ('.html', '.htm')""",
    ids=("C5", "B3"),
)
def q_lookup_suffix(spark, sf):
    p = tables.read(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    dim = P.language_frame(spark).filter(F.col("lang_id") == "html").select("suffix")
    # The language dimension is a fixed table of a few dozen rows.
    return p.withColumn("suffix", P.suffix(F.col("path"))).join(F.broadcast(dim), "suffix", "left_semi").select(
        "page_id", "path"
    )


# --- H-s1 / H-s3 -----------------------------------------------------------
@register(
    "tokens",
    sql=f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)""",
    ids=("H-s1", "J2"),
)
def q_tokens(spark, sf):
    d = tables.read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register(
    "fallback_tokens",
    sql=f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower('def ' || text), '{T.WORD_PATTERN}', 0) AS w FROM documents),
t AS (
  SELECT doc_id, list_concat(w, list_filter(list_transform(range(1, len(w)),
         lambda i: CASE WHEN w[i] IN ('def', 'class') THEN w[i] || '_' || w[i + 1] END), lambda x: x IS NOT NULL)) AS t
  FROM w
)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""",
    ids=("H-s3",),
)
def q_fallback_tokens(spark, sf):
    d = tables.read(spark, sf, "documents").select(
        "doc_id", T.fallback_tokens(F.concat(F.lit("def "), F.col("text"))).alias("t")
    )
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("code_tokens", ids=("H-s2", "J2"))
def q_code_tokens(spark, sf):
    from glean.functions.code import tokenizer_for

    tok = tokenizer_for("python")
    d = tables.read(spark, sf, "documents").select("doc_id", tok(F.concat(F.lit("def "), F.col("text"))).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# --- H-s4 ------------------------------------------------------------------
def _prefixed_query():
    return F.concat(
        F.when(F.col("role") == "user", F.lit("def  ")).when(F.col("role") == "system", F.lit(" Class ")).otherwise(F.lit("")),
        F.col("text"),
    )


@register(
    "normalise_query",
    sql=f"""
SELECT conv_id, turn,
  regexp_replace({sql_strip("lower((CASE WHEN role = 'user' THEN 'def  ' WHEN role = 'system' THEN ' Class ' ELSE '' END) || text)")},
                 '^(def|class)[{SP}]+([{T.WORD}]+)', '\\1_\\2') AS query
FROM conversations""",
    ids=("H-s4",),
)
def q_normalise_query(spark, sf):
    c = tables.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.normalise_query(_prefixed_query()).alias("query"))


# --- H-s5 ------------------------------------------------------------------
@register(
    "extract_path",
    sql=f"""
WITH t AS (SELECT doc_id, 'Please test ./' || {sql_rel_path()} || ' and more' AS task FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(task, '{P.extract_pattern("markdown")}')
  THEN ltrim({sql_strip(f"regexp_extract(task, '{P.extract_pattern('markdown')}', 1)")}, './')
  ELSE '{P.placeholder("markdown")}' END AS path
FROM t""",
    ids=("H-s5",),
)
def q_extract_path(spark, sf):
    d = tables.corpus(spark, sf)
    task = F.concat(F.lit("Please test ./"), F.col("relative_path"), F.lit(" and more"))
    return d.select("doc_id", P.extract(task, "markdown").alias("path"))


# --- H-s6 ------------------------------------------------------------------
@register(
    "normalise_path",
    sql=f"""
WITH p AS (SELECT page_id, '  ' || replace({sql_url_path()}, '/', '\\') || ' ' AS raw FROM pages)
SELECT page_id, {sql_normalise('raw')} AS path, {sql_normalise('raw', True)} AS path_lower FROM p""",
    ids=("H-s6",),
)
def q_normalise_path(spark, sf):
    p = tables.read(spark, sf, "pages")
    raw = F.concat(F.lit("  "), F.replace(url_path(F.col("url")), F.lit("/"), F.lit("\\")), F.lit(" "))
    return p.select("page_id", P.normalise(raw).alias("path"), P.normalise(raw, lower=True).alias("path_lower"))


# --- H-s7 / H-s8 -----------------------------------------------------------
def _sql_test_path(x: str, lang: str) -> str:
    name = sql_basename(x)
    folder = sql_dirname(x)
    ext = f"regexp_extract({name}, '[^.](\\.[^.]*)$', 1)"
    stem = f"left({name}, length({name}) - length({ext}))"
    if lang == "python":
        tn = f"'test_' || {name}"
    elif lang in P.DOT_TEST_LANGUAGES:
        tn = f"{stem} || '.test' || {ext}"
    else:
        tn = f"'test_' || {stem} || {ext}"
    return f"(CASE WHEN {folder} <> '' THEN 'tests/' || {folder} || '/' || {tn} ELSE 'tests/' || {tn} END)"


@register(
    "test_path",
    sql=f"""
WITH d AS (SELECT doc_id, {sql_normalise(sql_rel_path())} AS p, {sql_normalise("'x' || CAST(doc_id AS VARCHAR) || '.ts'")} AS top FROM documents)
SELECT doc_id, {_sql_test_path('p', 'python')} AS python_test, {_sql_test_path('p', 'js')} AS js_test,
       {_sql_test_path('p', 'go')} AS go_test, {_sql_test_path('top', 'ts')} AS ts_top_test FROM d""",
    ids=("H-s7",),
)
def q_test_path(spark, sf):
    d = tables.corpus(spark, sf)
    top = F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(".ts"))
    return d.select(
        "doc_id",
        P.test_path(F.col("relative_path"), "python").alias("python_test"),
        P.test_path(F.col("relative_path"), "js").alias("js_test"),
        P.test_path(F.col("relative_path"), "go").alias("go_test"),
        P.test_path(top, "ts").alias("ts_top_test"),
    )


@register(
    "import_path",
    sql=f"""
WITH d AS (SELECT doc_id, {sql_normalise("'./' || " + sql_rel_path())} AS p FROM documents),
e AS (SELECT doc_id, p, regexp_extract({sql_basename('p')}, '[^.](\\.[^.]*)$', 1) AS ext FROM d)
SELECT doc_id, regexp_replace(replace(left(p, length(p) - length(ext)), '/', '.'), '^\\.+|\\.+$', '', 'g') AS import_path FROM e""",
    ids=("H-s8",),
)
def q_import_path(spark, sf):
    d = tables.corpus(spark, sf)
    return d.select("doc_id", P.import_path(F.concat(F.lit("./"), F.col("relative_path")), "python").alias("import_path"))


# --- H-s9 ------------------------------------------------------------------
def _sql_join(base: str, rel: str) -> str:
    clean = f"regexp_replace(regexp_replace({sql_strip(rel)}, '^''+|''+$', '', 'g'), '^\"+|\"+$', '', 'g')"
    joined = (
        f"(CASE WHEN starts_with({clean}, '/') THEN {clean} "
        f"WHEN ends_with({base}, '/') OR {base} = '' THEN {base} || {clean} ELSE {base} || '/' || {clean} END)"
    )
    return joined


@register(
    "join_path",
    sql=f"""
WITH d AS (
  SELECT doc_id, '/repo' AS base,
         CASE WHEN source = 'src0' THEN '../' || {sql_rel_path()} ELSE ' ''' || source || '/./x/../' || lang || '_' || CAST(doc_id AS VARCHAR) || '.md''' END AS rel
  FROM documents
),
j AS (SELECT doc_id, base, rel, {_sql_join('base', 'rel')} AS joined FROM d),
n AS (
  SELECT doc_id, base, rel, starts_with(joined, '/') AS absolute,
         list_reduce(list_prepend('', string_split(joined, '/')), lambda acc, p:
           CASE WHEN p = '' OR p = '.' THEN acc
                WHEN p = '..' THEN (CASE WHEN len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1]
                                         WHEN starts_with(joined, '/') THEN acc ELSE list_append(acc, '..') END)
                ELSE list_append(acc, p) END, []::VARCHAR[]) AS parts
  FROM j
),
r AS (
  SELECT doc_id, base, rel,
         CASE WHEN absolute THEN '/' || array_to_string(parts, '/')
              WHEN array_to_string(parts, '/') = '' THEN '.' ELSE array_to_string(parts, '/') END AS path
  FROM n
)
SELECT doc_id, path, NOT (path = regexp_replace(base, '/+$', '') OR starts_with(path, regexp_replace(base, '/+$', '') || '/')) AS escapes_root FROM r""",
    ids=("H-s9",),
)
def q_join_path(spark, sf):
    d = tables.corpus(spark, sf)
    rel = F.when(F.col("is_test"), F.concat(F.lit("../"), F.col("relative_path"))).otherwise(
        F.concat(F.lit(" '"), F.col("source"), F.lit("/./x/../"), F.col("file_name"), F.lit("'"))
    )
    j = P.join(F.lit("/repo"), rel)
    return d.select("doc_id", j["path"].alias("path"), j["escapes_root"].alias("escapes_root"))


# --- H-s10 -----------------------------------------------------------------
@register(
    "flatten_blocks",
    sql="SELECT conv_id, turn, md5(replace(text, chr(10), ' ')) AS text_md5 FROM conversations",
    ids=("H-s10",),
)
def q_flatten_blocks(spark, sf):
    c = tables.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(T.flatten_blocks(T.lines_as_blocks(F.col("text")))).alias("text_md5"))


# --- H-s11 -----------------------------------------------------------------
# Plan text per message (no per-conversation collection): a heading, the
# message's own lines numbered, then the next heading.
@register(
    "count_cases",
    sql=f"""
WITH plan AS (
  SELECT conv_id, turn, '# Plan' || chr(10) || '## Test cases' || chr(10) ||
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CAST(i AS VARCHAR) || '. ' || l), chr(10)) ||
         chr(10) || '## Review Notes' || chr(10) || '1. done' AS plan
  FROM conversations
),
parts AS (SELECT conv_id, turn, string_split_regex(plan, '(?im)^#+.*test cases.*$') AS parts FROM plan)
SELECT conv_id, turn, CASE WHEN len(parts) < 2 THEN 0 ELSE
  CAST(len(regexp_extract_all(string_split_regex(parts[2], '(?m)^#+')[1], '(?m)^[{SP}]*[0-9]+\\.[{SP}]+', 0)) AS INTEGER) END AS n_cases
FROM parts""",
    ids=("H-s11",),
)
def q_count_cases(spark, sf):
    c = tables.read(spark, sf, "conversations")
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line))
    plan = F.concat(F.lit("# Plan\n## Test cases\n"), F.array_join(numbered, "\n"), F.lit("\n## Review Notes\n1. done"))
    return c.select("conv_id", "turn", T.count_cases(plan).alias("n_cases"))


# --- H-s12 -----------------------------------------------------------------
def _summary_spark(d):
    first = F.try_element_at(F.split("text", "\n"), F.lit(1))
    second = F.coalesce(F.try_element_at(F.split("text", "\n"), F.lit(2)), F.lit(""))
    return F.concat(
        F.lit("Component: "), F.col("service"),
        F.lit("\nFile:   "), F.col("relative_path"),
        F.lit("\nGeneral Description: "), first,
        F.when(F.col("is_test"), F.lit("")).otherwise(F.lit("\nDependencies: none")),
        F.lit("\n--- REFERENCE TEST PATTERN (Golden Example) ---\n"), second,
        F.lit("\n--- end"),
    )


def _sql_summary() -> str:
    return (
        "'Component: ' || source || chr(10) || 'File:   ' || " + sql_rel_path() + " || chr(10) || 'General Description: ' || "
        "string_split(text, chr(10))[1] || (CASE WHEN source = 'src0' THEN '' ELSE chr(10) || 'Dependencies: none' END) || "
        "chr(10) || '--- REFERENCE TEST PATTERN (Golden Example) ---' || chr(10) || coalesce(string_split(text, chr(10))[2], '') || "
        "chr(10) || '--- end'"
    )


def _sql_sections() -> str:
    cols = []
    for name, label in T.SECTION_LABELS:
        esc = T._re_escape(label)
        cols.append(
            f"CASE WHEN regexp_matches(s, '{esc}') THEN {sql_strip(f'regexp_extract(s, {chr(39)}{esc}[{SP}]*(.*){chr(39)}, 1)')} END AS {name}"
        )
    g = T._re_escape(T.GOLDEN_HEADER)
    cols.append(
        f"CASE WHEN regexp_matches(s, '(?s){g}\\n') THEN {sql_strip(f'regexp_extract(s, {chr(39)}(?s){g}\\n(.*?)(?:\\n✅|\\n---|$){chr(39)}, 1)')} END AS golden_example"
    )
    return ", ".join(cols)


@register(
    "parse_sections",
    sql=f"SELECT doc_id, {_sql_sections()} FROM (SELECT doc_id, {_sql_summary()} AS s FROM documents)",
    ids=("H-s12",),
)
def q_parse_sections(spark, sf):
    d = tables.corpus(spark, sf)
    s = T.parse_sections(_summary_spark(d))
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.*")


# --- H-s13 -----------------------------------------------------------------
def _answer_spark():
    k = F.get_json_object(F.col("props"), "$.k")
    num = F.when(F.col("event_type") == "click", F.concat(k, F.lit("."), k, F.lit(".1"))).otherwise(
        F.concat(F.lit("0."), F.lpad(k, 2, "0"))
    )
    body = F.when(F.col("event_type") == "error", F.lit("none ")).otherwise(
        F.concat(F.lit("Answer for "), F.col("event_type"), F.lit(" "))
    )
    return F.concat(body, F.lit("CONFIDENCE_SCORE: "), num)


SQL_ANSWER = (
    "(CASE WHEN event_type = 'error' THEN 'none ' ELSE 'Answer for ' || event_type || ' ' END) || 'CONFIDENCE_SCORE: ' || "
    "(CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') || '.' || json_extract_string(props, '$.k') || '.1' "
    "ELSE '0.' || lpad(json_extract_string(props, '$.k'), 2, '0') END)"
)


@register(
    "confidence",
    sql=f"""
WITH a AS (SELECT event_id, {SQL_ANSWER} AS a FROM events),
p AS (
  SELECT event_id, regexp_matches(a, '{T.CONFIDENCE_PATTERN}') AS has,
         TRY_CAST(regexp_extract(a, '{T.CONFIDENCE_PATTERN}', 1) AS DOUBLE) AS score,
         CASE WHEN regexp_matches(a, '{T.CONFIDENCE_PATTERN}')
              THEN {sql_strip(f"regexp_replace(a, 'CONFIDENCE_SCORE:[{SP}]*[0-9.]+', '', 'g')")} ELSE a END AS txt
  FROM a
)
SELECT event_id,
       CASE WHEN txt IS NULL OR length({sql_strip('txt')}) = 0 OR lower(txt) = 'none' THEN 0.0 WHEN has THEN score ELSE 0.0 END AS score,
       CASE WHEN txt IS NULL OR length({sql_strip('txt')}) = 0 OR lower(txt) = 'none' THEN 'None' ELSE txt END AS text
FROM p""",
    ids=("H-s13",),
)
def q_confidence(spark, sf):
    e = tables.read(spark, sf, "events")
    c = T.confidence(_answer_spark())
    return e.select("event_id", c["score"].alias("score"), c["text"].alias("text"))


# --- H-s16 -----------------------------------------------------------------
@register(
    "fix_lines",
    sql="""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10))) AS text_md5
FROM documents""",
    ids=("H-s16",),
)
def q_fix_lines(spark, sf):
    d = tables.read(spark, sf, "documents")
    raw = F.replace(F.col("text"), F.lit("\n"), F.lit(" \u00a0\t\f\r\n"))
    return d.select("doc_id", F.md5(T.fix_lines(raw)).alias("text_md5"))


# --- H-s17 -----------------------------------------------------------------
@register(
    "parse_or",
    sql=f"""
WITH r AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN 'abc' WHEN event_type = 'view' THEN '  ' ELSE ' 0.' || json_extract_string(props, '$.k') END AS t,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) - 50 AS VARCHAR) AS a
  FROM events
)
SELECT event_id, coalesce(TRY_CAST({sql_strip('t')} AS DOUBLE), 0.2) AS threshold,
       coalesce(greatest(TRY_CAST({sql_strip('a')} AS BIGINT), 1), 3) AS max_attempts
FROM r""",
    ids=("H-s17",),
)
def q_parse_or(spark, sf):
    e = tables.read(spark, sf, "events")
    k = F.get_json_object(F.col("props"), "$.k")
    t = F.when(F.col("event_type") == "error", F.lit("abc")).when(F.col("event_type") == "view", F.lit("  ")).otherwise(
        F.concat(F.lit(" 0."), k)
    )
    a = (k.cast("int") - 50).cast("string")
    return e.select(
        "event_id",
        T.parse_or(t, 0.2).alias("threshold"),
        T.parse_or(a, 3, floor=1, integral=True).alias("max_attempts"),
    )


# --- H-s18 -----------------------------------------------------------------
@register(
    "first_non_blank",
    sql=f"""
SELECT conv_id, turn, coalesce(nullif({sql_strip("CASE WHEN role = 'system' THEN text END")}, ''),
                               nullif({sql_strip("CASE WHEN role = 'user' THEN '   ' END")}, ''),
                               nullif({sql_strip('text')}, '')) AS value
FROM conversations""",
    ids=("H-s18",),
)
def q_first_non_blank(spark, sf):
    c = tables.read(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        T.first_non_blank(
            F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "user", F.lit("   ")), F.col("text")
        ).alias("value"),
    )


# --- F6 --------------------------------------------------------------------
def _sql_log_tail(x: str, lines: int, chars: int) -> str:
    lb = T.LINE_BREAK
    ls = f"string_split_regex(regexp_replace({x}, '(?:{lb})\\z', ''), '{lb}')"
    tail = f"(CASE WHEN len({ls}) > {lines} THEN array_to_string({ls}[-{lines}:], chr(10)) ELSE {x} END)"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN length({tail}) > {chars} THEN right({tail}, {chars}) ELSE {tail} END)"


@register(
    "log_tail",
    sql=f"""
SELECT conv_id, turn, {_sql_log_tail('text', 3, 200)} AS tail_short, md5({_sql_log_tail('text', 30, 2000)}) AS tail_md5
FROM conversations""",
    ids=("F6",),
)
def q_log_tail(spark, sf):
    c = tables.read(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        T.log_tail(F.col("text"), 3, 200).alias("tail_short"),
        F.md5(T.log_tail(F.col("text"))).alias("tail_md5"),
    )


# --- F7 --------------------------------------------------------------------
@register(
    "preview",
    sql="""
SELECT doc_id,
       md5(CASE WHEN len(string_split(text, chr(10))) > 10
                THEN array_to_string(string_split(text, chr(10))[1:10], chr(10)) || chr(10) || '...' ELSE text END) AS preview_md5,
       substr(text, 1, 200) AS first_200,
       array_to_string(string_split(text, chr(10))[1:3], chr(10) || '       ') AS first_3_lines,
       substr(text, 1, 45) AS first_45
FROM documents""",
    ids=("F7",),
)
def q_preview(spark, sf):
    d = tables.read(spark, sf, "documents")
    t = F.col("text")
    return d.select(
        "doc_id",
        F.md5(T.preview_lines(t, 10)).alias("preview_md5"),
        T.first_chars(t, 200).alias("first_200"),
        T.first_lines(t, 3).alias("first_3_lines"),
        T.first_chars(t, 45).alias("first_45"),
    )


# --- B15 -------------------------------------------------------------------
def _log_text():
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    return (
        F.when(k < 20, F.lit("E   IndentationError: unexpected indent"))
        .when(k < 30, F.lit("E   ModuleNotFoundError: No module named 'app.core'"))
        .when(k < 40, F.lit("E   ModuleNotFoundError: No module named 'vendor'"))
        .when(k < 55, F.lit("E   AssertionError: expected call rollback()"))
        .when(k < 70, F.concat(F.lit("captured = capsys.readouterr() for "), F.col("event_type")))
        .otherwise(F.concat(F.lit("ZeroDivisionError in "), F.col("event_type")))
    )


SQL_LOG = """(CASE WHEN k < 20 THEN 'E   IndentationError: unexpected indent'
  WHEN k < 30 THEN 'E   ModuleNotFoundError: No module named ''app.core'''
  WHEN k < 40 THEN 'E   ModuleNotFoundError: No module named ''vendor'''
  WHEN k < 55 THEN 'E   AssertionError: expected call rollback()'
  WHEN k < 70 THEN 'captured = capsys.readouterr() for ' || event_type
  ELSE 'ZeroDivisionError in ' || event_type END)"""


def _sql_failure(logs: str, root: str) -> str:
    def has(s):
        return f"strpos({logs}, '{s}') > 0"

    return f"""(CASE WHEN {has(LG.SYNTAX_MARKS[0])} OR {has(LG.SYNTAX_MARKS[1])} THEN '{LG.LABEL_SYNTAX}'
  WHEN {has(LG.MODULE_MARK)} AND '{root}' <> '' AND strpos({logs}, '{root}') > 0 THEN '{LG.LABEL_MODULE_ROOT}'
  WHEN {has(LG.MODULE_MARK)} THEN '{LG.LABEL_MODULE}'
  WHEN {has(LG.ROLLBACK_MARKS[0])} AND {has(LG.ROLLBACK_MARKS[1])} THEN '{LG.LABEL_ROLLBACK}'
  WHEN {has(LG.CAPTURE_MARKS[0])} OR {has(LG.CAPTURE_MARKS[1])} OR {has(LG.CAPTURE_MARKS[2])} THEN '{LG.LABEL_CAPTURE}'
  ELSE '{LG.LABEL_GENERAL}' END)"""


@register(
    "failure_class",
    sql=f"""
WITH l AS (SELECT event_id, {SQL_LOG} AS logs FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
SELECT event_id, {_sql_failure('logs', 'app')} AS failure_class FROM l""",
    ids=("B15",),
)
def q_failure_class(spark, sf):
    e = tables.read(spark, sf, "events")
    return e.select("event_id", LG.failure_class(_log_text(), "app").alias("failure_class"))


# --- B16 -------------------------------------------------------------------
REVIEW_MARKS = ("Review Notes", "Final Test Plan")


@register(
    "review_done",
    sql="SELECT conv_id, turn, conv_id % 4 IN (1, 2) AS review_done FROM conversations",
    ids=("B16",),
)
def q_review_done(spark, sf):
    # Stand-in text: by conversation, no mark, either mark, or a mark in other letters.
    marks = F.array(*[F.lit(x) for x in ("", *REVIEW_MARKS, REVIEW_MARKS[0].upper())])
    c = tables.read(spark, sf, "conversations")
    c = c.withColumn("text", F.concat("text", F.lit(" "), F.get(marks, (F.col("conv_id") % 4).cast("int"))))
    flag = (F.instr("text", REVIEW_MARKS[0]) > 0) | (F.instr("text", REVIEW_MARKS[1]) > 0)
    return c.select("conv_id", "turn", flag.alias("review_done"))


# --- A2 --------------------------------------------------------------------
@register(
    "read_filter",
    sql=f"SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND length({sql_strip('text')}) >= 10",
    ids=("A2",),
)
def q_read_filter(spark, sf):
    return IO.read_filter(tables.read(spark, sf, "documents")).select("doc_id", "source")


# --- A1 / A3 filter logic over page paths ----------------------------------
@register(
    "tree_filter",
    sql=f"""
WITH p AS (SELECT page_id, {sql_url_path()} AS path FROM pages),
f AS (
  SELECT page_id, path, string_split(path, '/') AS parts FROM p
)
SELECT page_id, path FROM f
WHERE NOT list_has_any(parts[1:len(parts) - 1], [{', '.join(repr(x) for x in P.IGNORED_DIRS)}])
  AND {sql_suffix('path')} IN ({', '.join(repr(x) for x in P.extensions('html', False))})
  AND {sql_basename('path')} <> '{P.SKIPPED_FILE}'""",
    ids=("A1",),
)
def q_tree_filter(spark, sf):
    p = tables.read(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return p.filter(P.scan_keep(F.col("path"), P.extensions("html", False)))


@register(
    "metrics_walk",
    sql=f"""
WITH p AS (SELECT page_id, {sql_url_path()} AS path FROM pages)
SELECT page_id, path FROM p
WHERE NOT ({' OR '.join(f"strpos({sql_dirname('path')}, '{s}') > 0" for s in P.METRICS_SKIP)}) AND ends_with(path, '.html')""",
    ids=("A3",),
)
def q_metrics_walk(spark, sf):
    p = tables.read(spark, sf, "pages").select("page_id", url_path(F.col("url")).alias("path"))
    return p.filter(P.metrics_keep(F.col("path"), ".html"))


# --- G3 / G4 / A9 / A7 / F5 / D17 ------------------------------------------
@register("distinct_sources", sql="SELECT DISTINCT source FROM documents", ids=("G3",))
def q_distinct_sources(spark, sf):
    return tables.read(spark, sf, "documents").select("source").distinct()


REQUIRED_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_weight", "l_volume")
LINEITEM_COLS_FOR_CHECK = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


@register(
    "missing_cols",
    sql="WITH present AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name WHERE (SELECT count({c}) FROM lineitem) > 0" for c in LINEITEM_COLS_FOR_CHECK)
    + ") SELECT column_name FROM (VALUES "
    + ", ".join(f"('{c}')" for c in REQUIRED_FEATURES)
    + ") t(column_name) EXCEPT SELECT column_name FROM present",
    ids=("G4", "B11"),
)
def q_missing_cols(spark, sf):
    """Required feature columns minus the columns present with data: one
    aggregate pass over the table (a column that exists but holds no value
    counts as missing)."""
    li = tables.read(spark, sf, "lineitem")
    counts = li.agg(*[F.count(c).alias(c) for c in li.columns])
    present = counts.unpivot([], li.columns, "column_name", "n").filter(F.col("n") > 0).select("column_name")
    req = spark.createDataFrame([(c,) for c in REQUIRED_FEATURES], "column_name string")
    return req.exceptAll(present).distinct()


@register(
    "union_modes",
    sql="SELECT source = 'src0' AS is_test, count(*) AS n_docs FROM documents GROUP BY 1",
    ids=("A9", "G1"),
)
def q_union_modes(spark, sf):
    d = tables.read(spark, sf, "documents")
    seed = d.filter(F.col("source") == tables.TEST_SOURCE)
    src = d.filter(F.col("source") != tables.TEST_SOURCE)
    return IO.both_modes(seed, src).groupBy("is_test").agg(F.count(F.lit(1)).alias("n_docs"))


@register("index_count", sql="SELECT count(*) AS n_vectors, count(*) = 0 AS is_empty FROM embeddings", ids=("A7",))
def q_index_count(spark, sf):
    e = tables.read(spark, sf, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("n_vectors")).withColumn("is_empty", F.col("n_vectors") == 0)


@register(
    "head5",
    sql="SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 5",
    ids=("F5",),
)
def q_head5(spark, sf):
    li = tables.read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").limit(5)


LINEITEM_COLS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


@register(
    "profile",
    sql=" UNION ALL ".join(f"SELECT '{c}' AS column_name, replace(replace(replace(lower(typeof(any_value({c}))), 'varchar', 'string'), 'integer', 'int'), 'timestamp', 'timestamp_ntz') AS dtype, count({c}) AS non_null FROM lineitem" for c in LINEITEM_COLS),
    ids=("D17",),
)
def q_profile(spark, sf):
    from glean.operators import risk as R

    return R.profile(tables.read(spark, sf, "lineitem"))
