"""Chunking and chunk enrichment.

The fixed-stride chunker is pure Spark SQL (``sequence`` + ``substring``)
and runs in whole-stage code generation.  The recursive, separator-aware
chunker is an Arrow-batched ``pandas_udf`` returning the chunk list of each
document (one row in, many out through ``posexplode``): per-row Python is
limited to splitting one text.
"""


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from glean.functions import text as T

# Sizes of the reference splitter.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
# Default ordered separators: blank line, newline, space, any character.
SEPARATORS = ("\n\n", "\n", " ", "")
# What opens a unit of each language, tried before the default separators: definitions first, then statements.
UNITS = {
    "python": ("class ", "def ", "\tdef "),
    "ts": ("enum ", "interface ", "namespace ", "type ", "class ", "function ", "const ", "let ", "if ", "for ", "switch "),
    "js": ("class ", "function ", "const ", "let ", "if ", "for ", "switch "),
    "java": ("class ", "interface ", "enum ", "public ", "protected ", "private ", "if ", "for ", "switch "),
    "csharp": ("namespace ", "interface ", "enum ", "class ", "public ", "private ", "if ", "for ", "switch "),
    "cpp": ("namespace ", "class ", "struct ", "void ", "int ", "if ", "for ", "switch "),
    "go": ("type ", "func ", "var ", "const ", "if ", "for ", "switch "),
    "markdown": ("# ", "## ", "### ", "#### "),
}


def separators_for(language: str | None) -> tuple[str, ...]:
    """Ordered separators of a language id; unknown ones take the default."""
    return tuple(f"\n{u}" for u in UNITS.get(language or "", ())) + SEPARATORS


def stride_starts(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """1-based chunk starts: every ``size - overlap`` characters, stopping
    once a chunk reaches the end of the text."""
    step = size - overlap
    last = F.greatest(length - overlap, F.lit(1))
    return F.sequence(F.lit(1), last, F.lit(step))


def split_stride(df: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """L1 (stride mode): ``chunk_no`` (0-based) and ``chunk`` per document."""
    t = F.col(text_col)
    starts = stride_starts(F.length(t), size, overlap)
    out = df.select("*", F.posexplode(starts).alias("chunk_no", "_start"))
    out = out.withColumn("chunk", F.substring(t, F.col("_start"), F.lit(size))).drop("_start")
    return out.filter(F.length("chunk") > 0)


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Greedy merge of pieces (each <= size) into chunks of at most ``size``;
    consecutive chunks share a tail of at most ``overlap`` characters."""
    chunks: list[str] = []
    window: list[str] = []
    total = 0  # == len(sep.join(window))
    for p in pieces:
        if window and total + len(sep) + len(p) > size:
            chunks.append(sep.join(window))
            while window and (total > overlap or total + len(sep) + len(p) > size):
                total -= len(window[0]) + (len(sep) if len(window) > 1 else 0)
                window.pop(0)
        total += len(p) + (len(sep) if window else 0)
        window.append(p)
    if window:
        chunks.append(sep.join(window))
    return [c for c in chunks if c.strip()]


def split_recursive_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS) -> list[str]:
    """Split on the first separator present; pieces still too long are split
    with the next separators; pieces are merged back up to ``size``."""
    if not text:
        return []
    sep = separators[-1]
    rest: tuple = ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, tuple(separators[i + 1 :])
            break
    parts = list(text) if sep == "" else text.split(sep)
    pieces: list[str] = []
    for p in parts:
        if not p:
            continue
        if len(p) <= size:
            pieces.append(p)
        elif rest:
            pieces.extend(split_recursive_text(p, size, overlap, rest))
        else:
            pieces.extend(p[i : i + size] for i in range(0, len(p), size))
    return _merge(pieces, sep, size, overlap)


def recursive_udf(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS):
    import pandas as pd

    @F.pandas_udf(Ty.ArrayType(Ty.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive_text(t, size, overlap, separators))

    return split


def split_recursive(
    df: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS, language_col: str | None = None
) -> DataFrame:
    """L1 (recursive mode) / J4: one row per chunk; with ``language_col`` each row's language chooses its separators."""
    if language_col is None:
        chunks = recursive_udf(size, overlap, separators)(F.col(text_col))
    else:
        chunks = by_language_udf(size, overlap)(F.col(text_col), F.col(language_col))
    return df.select("*", F.posexplode(chunks).alias("chunk_no", "chunk"))


def by_language_udf(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    import pandas as pd

    @F.pandas_udf(Ty.ArrayType(Ty.StringType()))
    def split(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([split_recursive_text(t, size, overlap, separators_for(la)) for t, la in zip(texts, languages)], dtype=object)

    return split



def summary(chunks: DataFrame, path_col: str = "relative_path", text_col: str = "description", code_col: str = "source_code") -> DataFrame:
    """Per file: number of chunks, first 200 characters of the first
    chunk's description and the first three lines of its code."""
    first = F.min(F.struct(F.col("chunk_no"), F.col(text_col).alias("t"), F.col(code_col).alias("c")))
    agg = chunks.groupBy(path_col).agg(F.count(F.lit(1)).alias("n_chunks"), first.alias("_f"))
    return agg.select(
        path_col,
        "n_chunks",
        T.first_chars(F.replace(F.col("_f.t"), F.lit("\n"), F.lit(" ")), 200).alias("description_200"),
        T.first_lines(F.col("_f.c"), 3).alias("code_preview"),
    )


def _first_line(code: str) -> str:
    return code.strip().split("\n", 1)[0] if code else ""


def enrich(chunks: DataFrame, fn=_first_line, code_col: str = "chunk") -> DataFrame:
    """``description = fn(code)``; the code moves to ``source_code``.

    On an exception the chunk is kept with its code as the description.
    Runs as ``mapInPandas`` so ``fn`` sees one row at a time but rows travel
    in Arrow batches.
    """
    schema = Ty.StructType(
        [f for f in chunks.schema.fields if f.name != code_col]
        + [Ty.StructField("description", Ty.StringType()), Ty.StructField("source_code", Ty.StringType())]
    )
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            codes = pdf[code_col]

            def safe(c):
                try:
                    return fn(c)
                except Exception:  # noqa: BLE001 - the reference keeps the chunk
                    return c

            pdf = pdf.assign(description=codes.map(safe), source_code=codes).drop(columns=[code_col])
            yield pdf[names]

    return chunks.mapInPandas(run, schema)
