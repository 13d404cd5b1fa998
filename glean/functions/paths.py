"""Column functions over repository paths (H-s5..H-s9, B1..B4, C5, G2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glean.functions.text import PY_SPACE, WORD, py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched).
# ---------------------------------------------------------------------------
# File suffixes per language id.
EXTENSIONS_BY_LANGUAGE = {
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".h"),
    "csharp": (".cs",),
    "cobol": (".cob", ".cbl", ".cpy"),
    "elixir": (".ex", ".exs"),
    "go": (".go",),
    "haskell": (".hs", ".lhs"),
    "html": (".html", ".htm"),
    "java": (".java",),
    "js": (".js", ".mjs", ".cjs"),
    "kotlin": (".kt", ".kts"),
    "latex": (".tex", ".latex"),
    "lua": (".lua",),
    "markdown": (".md", ".markdown"),
    "perl": (".pl", ".pm"),
    "php": (".php",),
    "powershell": (".ps1", ".psm1", ".psd1"),
    "proto": (".proto",),
    "python": (".py",),
    "r": (".r", ".R"),
    "rst": (".rst",),
    "ruby": (".rb",),
    "rust": (".rs",),
    "scala": (".scala", ".sc"),
    "sol": (".sol",),
    "swift": (".swift",),
    "ts": (".ts", ".tsx"),
    "visualbasic6": (".bas", ".frm", ".cls", ".vb"),
}
# Accepted spellings of language ids.
LANGUAGE_ALIASES = {
    "typescript": "ts",
    "javascript": "js",
    "c#": "csharp",
    "c-sharp": "csharp",
    "cpp": "cpp",
    "c++": "cpp",
    "golang": "go",
    "vb6": "visualbasic6",
    "visualbasic": "visualbasic6",
}
DEFAULT_LANGUAGE = "python"
# Documentation suffix added to source-mode ingest.
SOURCE_DOC_EXTENSIONS = (".md",)
# Directory names pruned at any depth by the tree scan (A1).
IGNORED_DIRS = ("__pycache__", ".venv", "venv", ".git", "tests", ".pytest_cache", "seed_data")
# Substrings that make the metrics walk skip a directory (A3).
METRICS_SKIP = ("venv", ".git", "__pycache__", "node_modules")
SKIPPED_FILE = "__init__.py"
# File-type rules, in order, on the lower-cased file name (B1).
FILE_TYPE_RULES = (
    (("api", "route"), "api_endpoint"),
    (("model", "schema"), "data_model"),
    (("repo", "db"), "database_access"),
)
UNIT_TEST = "unit_test"
DEFAULT_FILE_TYPE = "logic_component"
ROOT_SERVICE = "root"
# Languages whose tests are named <stem>.test<ext>.
DOT_TEST_LANGUAGES = ("js", "ts")


def language_frame(spark: SparkSession) -> DataFrame:
    """DM18: ``(lang_id, suffix)`` rows; small and fixed, so broadcastable."""
    rows = [(lang, ext) for lang, exts in EXTENSIONS_BY_LANGUAGE.items() for ext in exts]
    return spark.createDataFrame(rows, "lang_id string, suffix string")


def alias_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGE_ALIASES.items()), "alias string, lang_id string")


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# --- B4 --------------------------------------------------------------------
def language_id(col: Column) -> Column:
    """trim, lower, alias map; unknown ids become ``python``."""
    key = F.lower(py_strip(col))
    canonical = F.coalesce(F.try_element_at(_map_lit(LANGUAGE_ALIASES), key), key)
    known = F.array(*[F.lit(k) for k in EXTENSIONS_BY_LANGUAGE])
    return F.when(F.array_contains(known, canonical), canonical).otherwise(F.lit(DEFAULT_LANGUAGE))


# --- B3 / G2 ---------------------------------------------------------------
def extensions(lang: str, is_test: bool) -> list[str]:
    """Allowed suffixes for a language; source mode adds ``.md``."""
    lid = lang if lang in EXTENSIONS_BY_LANGUAGE else LANGUAGE_ALIASES.get(lang, DEFAULT_LANGUAGE)
    lid = lid if lid in EXTENSIONS_BY_LANGUAGE else DEFAULT_LANGUAGE
    allowed = set(EXTENSIONS_BY_LANGUAGE[lid])
    if not is_test and lid != "markdown":
        allowed |= set(SOURCE_DOC_EXTENSIONS)
    return sorted(allowed)


def extensions_col(lang: Column, is_test: Column) -> Column:
    """Column form of :func:`extensions` (``array_union`` of suffix sets)."""
    lid = language_id(lang)
    table = F.create_map(
        *[x for k, v in EXTENSIONS_BY_LANGUAGE.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))]
    )
    code = F.try_element_at(table, lid)
    docs = F.array(*[F.lit(e) for e in SOURCE_DOC_EXTENSIONS])
    return F.array_sort(
        F.when(~is_test & (lid != "markdown"), F.array_union(code, docs)).otherwise(F.array_distinct(code))
    )


def suffix(col: Column) -> Column:
    """Case-sensitive suffix of the last path part (``Path.suffix``)."""
    return F.regexp_extract(basename(col), "[^.](\\.[^.]*)$", 1)


# --- H-s6 ------------------------------------------------------------------
def normalise(col: Column, lower: bool = False) -> Column:
    """Backslashes to slashes, strip; optional lower; null -> ''."""
    out = py_strip(F.replace(col, F.lit("\\"), F.lit("/")))
    out = F.lower(out) if lower else out
    return F.coalesce(out, F.lit(""))


def basename(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def dirname(col: Column) -> Column:
    return F.regexp_extract(col, "^(.*)/[^/]*$", 1)


# --- B2 --------------------------------------------------------------------
def service(rel_path: Column) -> Column:
    """First path part when there is more than one part, else ``root``."""
    parts = F.split(rel_path, "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(1))).otherwise(F.lit(ROOT_SERVICE))


# --- B1 --------------------------------------------------------------------
def file_type(file_name: Column, is_test: Column) -> Column:
    name = F.lower(file_name)
    out = F.when(is_test | name.startswith("test_"), F.lit(UNIT_TEST))
    for needles, label in FILE_TYPE_RULES:
        cond = None
        for n in needles:
            c = F.instr(name, n) > 0
            cond = c if cond is None else (cond | c)
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(DEFAULT_FILE_TYPE))


# --- H-s5 ------------------------------------------------------------------
def placeholder(lang: str = DEFAULT_LANGUAGE) -> str:
    """``unknown_file<ext>`` with the alphabetically smallest suffix."""
    lid = lang if lang in EXTENSIONS_BY_LANGUAGE else DEFAULT_LANGUAGE
    return "unknown_file" + sorted(EXTENSIONS_BY_LANGUAGE[lid])[0]


def extract_pattern(lang: str = DEFAULT_LANGUAGE) -> str:
    lid = lang if lang in EXTENSIONS_BY_LANGUAGE else DEFAULT_LANGUAGE
    exts = sorted({e.lstrip(".") for e in EXTENSIONS_BY_LANGUAGE[lid]}, key=lambda e: (-len(e), e))
    alts = "|".join(e.replace(".", "\\.") for e in exts)
    return f"(?i)([{WORD}/.$-]+\\.(?:{alts}))"


def extract(col: Column, lang: str = DEFAULT_LANGUAGE) -> Column:
    """First file path in free text, leading '.' and '/' characters removed."""
    pat = extract_pattern(lang)
    found = F.regexp_extract(col, pat, 1)
    cleaned = F.ltrim(py_strip(found), F.lit("./"))
    ok = F.coalesce(F.regexp_like(col, F.lit(pat)), F.lit(False))
    return F.when(ok, cleaned).otherwise(F.lit(placeholder(lang)))


# --- H-s7 ------------------------------------------------------------------
def split_ext(name: Column) -> tuple[Column, Column]:
    """``os.path.splitext`` of a file name: (stem, ext)."""
    ext = F.regexp_extract(name, "[^.](\\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return stem, ext


def test_path(col: Column, lang: str = DEFAULT_LANGUAGE) -> Column:
    clean = normalise(col)
    folder = dirname(clean)
    name = basename(clean)
    if lang == "python":
        test_name = F.concat(F.lit("test_"), name)
    else:
        stem, ext = split_ext(name)
        test_name = (
            F.concat(stem, F.lit(".test"), ext) if lang in DOT_TEST_LANGUAGES else F.concat(F.lit("test_"), stem, ext)
        )
    return F.when(folder != "", F.concat(F.lit("tests/"), folder, F.lit("/"), test_name)).otherwise(
        F.concat(F.lit("tests/"), test_name)
    )


# --- H-s8 ------------------------------------------------------------------
def import_path(col: Column, lang: str = DEFAULT_LANGUAGE) -> Column:
    if lang != "python":
        return F.lit("")
    clean = normalise(col)
    _, ext = split_ext(basename(clean))
    no_ext = F.substring(clean, F.lit(1), F.length(clean) - F.length(ext))
    dotted = F.replace(no_ext, F.lit("/"), F.lit("."))
    out = F.regexp_replace(dotted, "^\\.+|\\.+$", "")
    return F.when(col.isNull() | (col == ""), F.lit("")).otherwise(out)


# --- H-s9 ------------------------------------------------------------------
def join(base: Column, rel: Column) -> Column:
    """Struct(path, escapes_root): ``os.path.join`` + ``normpath``.

    Quotes are stripped from the relative part first.  An absolute relative
    part replaces the base, as in Python.  ``escapes_root`` is true when the
    result is not inside ``base`` (the reference does not check this).
    """
    clean = F.regexp_replace(F.regexp_replace(py_strip(rel), "^'+|'+$", ""), '^"+|"+$', "")
    joined = F.when(clean.startswith("/"), clean).otherwise(
        F.when(base.endswith("/") | (base == ""), F.concat(base, clean)).otherwise(F.concat(base, F.lit("/"), clean))
    )
    absolute = joined.startswith("/")
    parts = F.split(joined, "/")
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(
            p == "..",
            F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(absolute, acc)
            .otherwise(F.concat(acc, F.array(F.lit("..")))),
        )
        .otherwise(F.concat(acc, F.array(p))),
    )
    body = F.array_join(stack, "/")
    path = F.when(absolute, F.concat(F.lit("/"), body)).otherwise(F.when(body == "", F.lit(".")).otherwise(body))
    nbase = F.regexp_replace(base, "/+$", "")
    inside = (path == nbase) | path.startswith(F.concat(nbase, F.lit("/")))
    empty = rel.isNull() | (rel == "")
    return F.struct(
        F.when(empty, F.lit("")).otherwise(path).alias("path"),
        F.when(empty, F.lit(False)).otherwise(~inside).alias("escapes_root"),
    )


# --- A1 / A3 predicates ----------------------------------------------------
def in_ignored_dir(rel_path: Column, ignored=IGNORED_DIRS) -> Column:
    """True when any directory part of the path is an ignored name."""
    dirs = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ignored]))


def scan_keep(rel_path: Column, allowed: list[str]) -> Column:
    """A1: not under an ignored dir, allowed suffix, not ``__init__.py``."""
    return (
        ~in_ignored_dir(rel_path)
        & suffix(rel_path).isin(*allowed)
        & (basename(rel_path) != SKIPPED_FILE)
    )


def metrics_keep(rel_path: Column, ext: str = ".py") -> Column:
    """A3: directory path contains none of the skip substrings; ``*.py``."""
    d = dirname(rel_path)
    skip = None
    for s in METRICS_SKIP:
        c = F.instr(d, s) > 0
        skip = c if skip is None else (skip | c)
    return ~skip & rel_path.endswith(ext)
