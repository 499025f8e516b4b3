"""Every query of the subpackage runs at the smallest scale; those with SQL agree with it."""

import pytest

from edumill.llm import queries as Q
from oracle import compare


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    if name in Q.SQL:
        compare(df, sf, Q.SQL[name])
    else:
        assert df.columns and df.count() > 0 or name.startswith("p9")
