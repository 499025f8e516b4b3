import math
import random

from edumill.operators import survey as S


def test_pooling_of_known_draws(spark):
    """Ten draws with published pooled results are not at hand here; the formula is checked on fixed numbers."""
    theta = [0.29, 0.30, 0.31, 0.28, 0.295]
    u = [0.0009, 0.001, 0.00095, 0.0011, 0.0008]
    df = spark.createDataFrame([("a", i, t, v) for i, (t, v) in enumerate(zip(theta, u))] + [("b", 0, 0.5, 0.04)], "k string, draw int, theta double, u double")
    got = {r["k"]: r for r in S.rubin_pool(df, ["k"]).collect()}
    m = sum(theta) / 5
    b = sum((t - m) ** 2 for t in theta) / 4
    t = sum(u) / 5 + 1.2 * b
    assert math.isclose(got["a"]["mean"], m) and math.isclose(got["a"]["t"], t) and math.isclose(got["a"]["ci_lo"], m - 1.96 * math.sqrt(t))
    assert got["b"]["b"] == 0.0 and math.isclose(got["b"]["se"], 0.2)


def test_jackknife_equals_weight_copies(spark):
    rng = random.Random(3)
    rows = [("g", rng.uniform(1, 9), rng.uniform(100, 200), rng.randrange(4), rng.choice([0, 1, None])) for _ in range(60)] + [("g", 0.0, 5.0, 1, 1), ("g", 2.0, None, 1, 0)]
    df = spark.createDataFrame(rows, "k string, w double, y double, zone int, half int")
    got = S.jackknife_zones(df, ["k"], "y", "w", "zone", "half").first()
    data = [r for r in rows if r[1] > 0 and r[2] is not None]
    mean = lambda ws: sum(w * r[2] for w, r in zip(ws, data)) / sum(ws)
    theta, u = mean([r[1] for r in data]), 0.0
    for z in {r[3] for r in data}:
        for h in (0, 1):
            ws = [r[1] * (1 if r[3] != z else 2 if r[4] == h else 0) for r in data]
            u += (mean(ws) - theta) ** 2
    assert math.isclose(got["theta"], theta) and math.isclose(got["u"], u / 2)


def test_means_leave_out_null_rows_and_zero_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 2.0), ("a", 3.0, 0.0), ("a", 5.0, 2.0), ("b", None, 1.0)], "k string, v double, w double")
    got = S.weighted_mean(df, ["k"], "v", "w").collect()
    assert [(r["k"], r["mean"], r["n"]) for r in got] == [("a", 3.0, 2)]
    assert S.weighted_mean(df.limit(0), ["k"], "v", "w").count() == 0


def test_t_distribution():
    assert math.isclose(S.t_two_sided(2.262157, 9), 0.05, rel_tol=1e-5)
    assert math.isclose(S.t_two_sided(0.0, 5), 1.0)
    assert math.isclose(S.t_two_sided(12.7062, 1), 0.05, rel_tol=1e-4)
