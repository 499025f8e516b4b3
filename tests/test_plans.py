"""Plans stay what they should be: no cross joins, no row-at-a-time Python, filters and columns reach the scan."""

import re

import pytest

from edumill.plans import registry

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", p)


def test_columns_and_filters_reach_the_scan(spark, sf):
    p = plan(QUERIES["a01_weighted_mean"](spark, sf))
    assert "PushedFilters" in p and "l_quantity" in p and "l_shipdate" not in p
    p = plan(QUERIES["j15_semi_membership"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in p and "o_totalprice" not in p
    assert "payload" in plan(QUERIES["p6_found"](spark, sf)) and "received_at" not in plan(QUERIES["p6_found"](spark, sf))
