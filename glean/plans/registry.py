"""Name -> (Spark query, oracle SQL) registry.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.
The optional SQL is the same computation in ANSI SQL for DuckDB, over
views named after the tables; output column names are identical.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from glean.functions import text as T

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ids: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills the registry.
    from glean.plans import corpus, history, retrieval, risk, scalars, streams, tasks, vectors  # noqa: F401

    return REGISTRY


# ---------------------------------------------------------------------------
# SQL fragments shared by the oracle strings (DuckDB dialect).  They use the
# same pattern text as the Spark side; DuckDB needs the 'g' flag to replace
# every match, as Spark does.
# ---------------------------------------------------------------------------
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.PY_SPACE}]+|[{T.PY_SPACE}]+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{T.TOKEN_PATTERN}', 0)"


def sql_normalise_query(x: str) -> str:
    kw = "|".join(T.DEFINITION_KEYWORDS)
    return f"regexp_replace({sql_strip(f'lower({x})')}, '^({kw})[{T.PY_SPACE}]+([{T.WORD}]+)', '\\1_\\2')"


def sql_first_words(x: str, n: int = 4) -> str:
    sp = "\\t\\n\\x0b\\x0c\\r "
    return f"regexp_extract({x}, '^[{sp}]*([^{sp}]+(?:[{sp}]+[^{sp}]+){{0,{n - 1}}})', 1)"


def sql_rel_path(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return f"({a}source || '/' || {a}lang || '_' || CAST({a}doc_id AS VARCHAR) || '.md')"
