"""Column functions over text (H-s1..H-s4, H-s10..H-s18, F6, F7).

Every function takes and returns a ``Column`` and is built only from
built-in Spark expressions, so it runs inside whole-stage code generation
on the executors.  Regular expressions are written with explicit Unicode
classes (``\\p{L}``, ``\\p{N}``) because Java's ``\\w`` and ``\\s`` are
ASCII-only while Python's are Unicode; the same pattern text is valid in
Java and in RE2, which keeps the DuckDB oracle honest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched).
# ---------------------------------------------------------------------------
# Characters Python's str.strip() removes: Unicode White_Space plus the
# four information separators U+001C..U+001F.
PY_SPACE = (
    "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
# A Unicode "word" character in Python's sense.
WORD = "\\p{L}\\p{N}_"
# Generic code tokenizer: lower-cased runs of word characters, joined by
# inner runs of '$' (equal to Python's \b[\w$]+\b).
TOKEN_PATTERN = f"[{WORD}]+(?:\\$+[{WORD}]+)*"
# Fallback tokenizer: plain word runs (Python's \b\w+\b).
WORD_PATTERN = f"[{WORD}]+"
# Keywords that start a definition and form the def_/class_ bigram.
DEFINITION_KEYWORDS = ("def", "class")
# Confidence marker in a model answer.
CONFIDENCE_PATTERN = "CONFIDENCE_SCORE:[" + PY_SPACE + "]*([0-9.]+)"
# Result-block marker of rendered search hits.
RESULT_MARK = "--- RESULT"
# Marker of a passing test block.
TEST_MARK = "IS_TEST: True"
# Text that makes a whole tool message count as empty.
NO_REFERENCE = "No reference"
# Log tail defaults.
LOG_TAIL_LINES = 30
LOG_TAIL_CHARS = 2000


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# The same set as literal characters, for the (linear, code-generated)
# ``btrim`` / ``rtrim`` with a trim-character argument.
PY_SPACE_CHARS = (
    "\t\n\x0b\x0c\r" + "".join(chr(c) for c in range(0x1C, 0x20)) + " \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode space."""
    return F.btrim(col, F.lit(PY_SPACE_CHARS))


def py_rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(PY_SPACE_CHARS))


def is_blank(col: Column) -> Column:
    """True when the text is null or only white space."""
    return col.isNull() | (F.length(py_strip(col)) == 0)


# --- H-s1 ------------------------------------------------------------------
def tokens(col: Column) -> Column:
    """Generic code tokenizer: ``ARRAY<STRING>`` of lower-cased tokens."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), 0)


# --- H-s3 ------------------------------------------------------------------
def _bigrams(w: Column) -> Column:
    n = F.size(w)
    idx = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    pairs = F.transform(
        idx,
        lambda i: F.when(
            (n > 1) & F.try_element_at(w, i).isin(*DEFINITION_KEYWORDS),
            F.concat(F.try_element_at(w, i), F.lit("_"), F.try_element_at(w, i + 1)),
        ),
    )
    return F.filter(pairs, lambda x: x.isNotNull())


def fallback_tokens(col: Column) -> Column:
    """Word tokens, then every ``def_x`` / ``class_x`` bigram at the end."""
    words = F.regexp_extract_all(F.lower(col), F.lit(WORD_PATTERN), 0)
    # A one-element transform binds the word array once for both uses.
    return F.try_element_at(F.transform(F.array(words), lambda w: F.concat(w, _bigrams(w))), F.lit(1))


# --- H-s4 ------------------------------------------------------------------
def normalise_query(col: Column) -> Column:
    """lower, strip, then ``def foo`` -> ``def_foo`` at the start."""
    kw = "|".join(DEFINITION_KEYWORDS)
    return F.regexp_replace(
        py_strip(F.lower(col)),
        F.lit(f"^({kw})[{PY_SPACE}]+([{WORD}]+)"),
        F.lit("$1_$2"),
    )


# --- keyword of a retrieval query (stand-in rule) --------------------------
def first_words(col: Column, n: int = 4) -> Column:
    """First ``n`` white-space separated words, original spacing kept."""
    sp = "\\t\\n\\x0b\\x0c\\r "
    pattern = f"^[{sp}]*([^{sp}]+(?:[{sp}]+[^{sp}]+){{0,{n - 1}}})"
    return F.regexp_extract(col, pattern, 1)


def contains_ci(text: Column, needle: Column) -> Column:
    """Case-insensitive substring test (Python ``a.lower() in b.lower()``)."""
    return F.instr(F.lower(text), F.lower(needle)) > 0


# --- H-s10 -----------------------------------------------------------------
def flatten_blocks(blocks: Column) -> Column:
    """Join the ``text`` of every block carrying one, separated by a space."""
    return F.array_join(
        F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]),
        " ",
    )


def text_blocks(blocks: Column) -> Column:
    """As :func:`flatten_blocks` but only blocks of ``type = 'text'``."""
    return F.array_join(
        F.transform(
            F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()),
            lambda b: b["text"],
        ),
        " ",
    )


def lines_as_blocks(col: Column) -> Column:
    """Stand-in block form of a message: one ``text`` block per line."""
    return F.transform(
        F.split(col, "\n"), lambda line: F.struct(F.lit("text").alias("type"), line.alias("text"))
    )


# --- H-s11 -----------------------------------------------------------------
def count_cases(col: Column) -> Column:
    """Numbered lines between the first 'test cases' heading and the next heading."""
    after = F.try_element_at(F.split(col, "(?imd)^#+.*test cases.*$", 2), F.lit(2))
    block = F.try_element_at(F.split(after, "(?md)^#+", 2), F.lit(1))
    n = F.regexp_count(block, F.lit(f"(?md)^[{PY_SPACE}]*[0-9]+\\.[{PY_SPACE}]+"))
    return F.when(F.size(F.split(col, "(?imd)^#+.*test cases.*$", 2)) < 2, F.lit(0)).otherwise(n).cast("int")


# --- H-s12 -----------------------------------------------------------------
# Labelled fields of an architecture summary, in their fixed order.
SECTION_LABELS = (
    ("component", "Component:"),
    ("file", "File:"),
    ("description", "General Description:"),
    ("logic", "Technical Logic:"),
    ("elements", "Key Elements:"),
    ("dependencies", "Dependencies:"),
)
GOLDEN_HEADER = "--- REFERENCE TEST PATTERN (Golden Example) ---"


def parse_sections(col: Column) -> Column:
    """Struct of the seven labelled fields; a missing field is null."""
    fields = []
    for name, label in SECTION_LABELS:
        pattern = "(?d)" + _re_escape(label) + f"[{PY_SPACE}]*(.*)"
        raw = F.regexp_extract(col, pattern, 1)
        present = F.regexp_like(col, F.lit("(?d)" + _re_escape(label)))
        fields.append(F.when(present, py_strip(raw)).alias(name))
    golden_pat = "(?s)" + _re_escape(GOLDEN_HEADER) + "\\n(.*?)(?:\\n✅|\\n---|$)"
    g_present = F.regexp_like(col, F.lit("(?s)" + _re_escape(GOLDEN_HEADER) + "\\n"))
    fields.append(F.when(g_present, py_strip(F.regexp_extract(col, golden_pat, 1))).alias("golden_example"))
    return F.struct(*fields)


def _re_escape(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in ".^$*+?()[]{}|\\-" else ch)
    return "".join(out)


# --- H-s13 -----------------------------------------------------------------
def confidence(col: Column) -> Column:
    """Struct(score DOUBLE, text STRING): parsed score and the text without it.

    The marker sets the score and is removed; text that is then blank or
    ``none`` becomes ``None`` with score 0.0.  An unparseable number such as
    ``1.2.3`` gives a null score.
    """
    has = F.regexp_like(col, F.lit(CONFIDENCE_PATTERN))
    score = F.regexp_extract(col, CONFIDENCE_PATTERN, 1).try_cast("double")
    rest = py_strip(F.regexp_replace(col, F.lit("CONFIDENCE_SCORE:[" + PY_SPACE + "]*[0-9.]+"), F.lit("")))
    text = F.when(has, rest).otherwise(col)
    empty = is_blank(text) | (F.lower(text) == "none")
    return F.struct(
        F.when(empty, F.lit(0.0)).when(has, score).otherwise(F.lit(0.0)).alias("score"),
        F.when(empty, F.lit("None")).otherwise(text).alias("text"),
    )


# --- H-s14 / H-s15 ---------------------------------------------------------
def split_blocks(col: Column) -> Column:
    """Blocks of a rendered result string, each re-prefixed with the marker."""
    parts = F.split(col, _re_escape(RESULT_MARK))
    kept = F.filter(parts, lambda p: F.length(py_strip(p)) > 0)
    return F.transform(kept, lambda p: py_strip(F.concat(F.lit(RESULT_MARK), p)))


def keep_test_blocks(col: Column) -> Column:
    """Only the passing-test blocks; sentinel text when there is no marker."""
    blocks = F.filter(split_blocks(col), lambda b: F.instr(b, TEST_MARK) > 0)
    joined = F.concat(F.lit("\n\n"), F.array_join(blocks, "\n\n"))
    return (
        F.when(is_blank(col) | (F.instr(col, "RESULT") == 0), F.lit("No reference tests found."))
        .when(F.size(blocks) == 0, F.lit(""))
        .otherwise(joined)
    )


# --- H-s16 -----------------------------------------------------------------
def fix_lines(col: Column) -> Column:
    """CRLF -> LF, then right-strip the white space of every LF line."""
    lines = F.split(F.regexp_replace(col, "\r\n", "\n"), "\n")
    return F.array_join(F.transform(lines, py_rstrip), "\n")


# --- H-s17 -----------------------------------------------------------------
def parse_or(col: Column, default: float, floor: float | None = None, integral: bool = False) -> Column:
    """Parse a number; blank or unparseable -> ``default``; optional floor."""
    parsed = py_strip(col).try_cast("bigint" if integral else "double")
    if floor is not None:
        parsed = F.greatest(parsed, F.lit(floor))
    return F.coalesce(parsed, F.lit(default))


# --- H-s18 -----------------------------------------------------------------
def first_non_blank(*cols: Column) -> Column:
    """First argument that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(py_strip(_lit(c)), F.lit("")) for c in cols])


# --- F6 --------------------------------------------------------------------
# Line boundaries of Python's str.splitlines().
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def log_tail(col: Column, max_lines: int = LOG_TAIL_LINES, max_chars: int = LOG_TAIL_CHARS) -> Column:
    """Last ``max_lines`` lines, then the last ``max_chars`` characters.

    Text with at most ``max_lines`` lines keeps its own line breaks.
    """
    lines = F.split(F.regexp_replace(col, F.lit(f"(?:{LINE_BREAK})$"), F.lit("")), LINE_BREAK)
    tail = F.when(F.size(lines) > max_lines, F.array_join(F.slice(lines, -max_lines, max_lines), "\n")).otherwise(col)
    cut = F.when(F.length(tail) > max_chars, F.substring(tail, -max_chars, max_chars)).otherwise(tail)
    return F.when(col.isNull() | (col == ""), F.lit("")).otherwise(cut)


# --- F7 --------------------------------------------------------------------
def preview_lines(col: Column, n: int = 10) -> Column:
    """First ``n`` lines plus ``\\n...`` when the text has more lines."""
    lines = F.split(col, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n..."))).otherwise(col)


def first_lines(col: Column, n: int = 3, sep: str = "\n       ") -> Column:
    return F.array_join(F.slice(F.split(col, "\n"), 1, n), sep)


def first_chars(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)
