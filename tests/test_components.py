import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from edumill.operators.components import components


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e}


def check(spark, edges):
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_path_star_and_random(spark):
    check(spark, [(k, k + 1) for k in range(40)])
    check(spark, [(500, k) for k in range(200)] + [(7, 7)])
    rng = random.Random(2)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(180)])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_any_graph(spark, edges):
    check(spark, edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
