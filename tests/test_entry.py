"""The driver contract of __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_runs_on_smallest_tables(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "query", "keyword", "relative_file", "r_at_5", "mrr"]
    assert df.count() > 0


def test_registry_contract():
    q = E.queries()
    sql = E.oracle_sql()
    assert len(q) >= 100 and set(sql) <= set(q)
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s.strip() for s in sql.values())
