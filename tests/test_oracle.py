"""Every query with oracle SQL matches DuckDB on the smallest tables."""

import pytest

from glean.plans.registry import load_all
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
KEYS = sorted(load_all())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    status, detail = compare(spark, SF, {key}, verbose=False)[key]
    assert status in ("OK", "ROWS_ONLY"), detail
