"""Plans of the llm queries: no cross joins, no row-at-a-time Python, the columns they need and no others."""

import re

import pytest
from edumill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_cross_join_and_no_row_python(spark, sf, name):
    p = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", p)


def test_only_needed_columns_are_read(spark, sf):
    p = Q.p9_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in p and "text" in p and "loaded_at" not in p and "n_chars" not in p
