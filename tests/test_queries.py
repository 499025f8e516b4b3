"""Every core query runs at the smallest scale and agrees with its SQL."""

import pytest

from edumill.plans import registry
from oracle import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        compare(df, sf, SQL[name])
    else:  # nothing in SQL to hold it against: the tests of its operator do that; here it must give rows, the same ones twice
        rows = sorted(map(repr, df.collect()))
        assert rows and rows == sorted(map(repr, QUERIES[name](spark, sf).collect()))


def test_entry_runs_without_the_llm_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
