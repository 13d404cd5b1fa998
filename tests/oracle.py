"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: ``python -m tests.oracle [sf_dir] [key ...]``.  Prints one line per
query and exits non-zero on any mismatch.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from glean.sources.tables import TABLES

DIGITS = 6
# Spark type name -> DuckDB type name, for the schema comparison.
TYPE_NAMES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, DIGITS)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    out = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, keys=None, verbose=True):
    from glean.plans.registry import load_all

    reg = load_all()
    con = duck(sf_dir)
    results = {}
    for name, q in reg.items():
        if keys and name not in keys:
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, sf_dir)
            s_rows = [tuple(r) for r in sdf.collect()]
            s_cols, s_can = canon(sdf.columns, s_rows)
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:24s} SPARK_ERROR {results[name][1]}", flush=True)
            continue
        ts = time.time() - t0
        if not q.sql:
            results[name] = ("ROWS_ONLY", len(s_rows))
            if verbose:
                print(f"{name:24s} ROWS_ONLY rows={len(s_rows)} {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(q.sql)
            d_names = list(rel.columns)
            d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            d_rows = rel.fetchall()
            d_cols, d_can = canon(d_names, d_rows)
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:24s} SQL_ERROR {results[name][1]}", flush=True)
            continue
        if s_cols != d_cols:
            results[name] = ("COLUMNS", f"spark={s_cols} duck={d_cols}")
        elif s_can != d_can:
            sd = set(s_can)
            dd = set(d_can)
            only_s = [r for r in s_can if r not in dd][:3]
            only_d = [r for r in d_can if r not in sd][:3]
            results[name] = ("VALUES", f"rows {len(s_can)} vs {len(d_can)}; spark-only {only_s}; duck-only {only_d}")
        else:
            s_types = {c: TYPE_NAMES.get(t, t) for c, t in sdf.dtypes}
            wrong = {c: (s_types[c], d_types.get(c)) for c in s_types if s_types[c] != d_types.get(c)}
            results[name] = ("TYPES", str(wrong)) if wrong else ("OK", len(s_can))
        if verbose:
            print(f"{name:24s} {results[name][0]} {str(results[name][1])[:600]} {ts:.1f}s", flush=True)
    return results


def main(argv):
    from glean.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = set(argv[2:]) or None
    spark = local_session(8)
    res = compare(spark, sf_dir, keys)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")}
    print(f"ok={sum(v[0] == 'OK' for v in res.values())} rows_only={sum(v[0] == 'ROWS_ONLY' for v in res.values())} bad={len(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
