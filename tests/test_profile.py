import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from edumill.operators.profile import profile, shifts, violations


def brute(values_by_load):
    out, before = {}, None
    for load in sorted(values_by_load):
        values = values_by_load[load]
        real = [v for v in values if v is not None]
        row = {"n_rows": len(values), "n_null": len(values) - len(real), "n_distinct": len(set(real))}
        if real and not isinstance(real[0], str):
            row |= {"q25": np.percentile(real, 25), "q50": np.percentile(real, 50), "q75": np.percentile(real, 75)}
        if real and before:
            every = sorted(set(real) | set(before))
            cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
            row["ks"] = max(abs(cdf(real, v) - cdf(before, v)) for v in every)
            a, b = Counter(before), Counter(real)
            row["share"] = max(abs(b[v] / len(real) - a[v] / len(before)) for v in every)
        out[load] = row
        before = real
    return out


def test_profile_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(k % 3, None if rng.random() < 0.1 else rng.choice([7, 7, 7, rng.randrange(50)]), rng.choice(["a", "b", "", None, " ", rng.choice("cdef") * 3]), "noise") for k in range(900)]
    rows += [(None, 1, "a", "noise")]
    df = spark.createDataFrame(rows, "load_no int, num int, str string, load string")
    got = profile(df, "t", "load_no", {"num": (F.col("num"), "number"), "str": (F.col("str"), "string")}, partitions=5).collect()
    for column, at in (("num", 1), ("str", 2)):
        clean = lambda v: None if isinstance(v, str) and not v.strip() else v
        want = brute({k: [clean(r[at]) for r in rows if r[0] == k] for k in range(3)})
        for r in (r for r in got if r["column_name"] == column):
            w = want[r["load_no"]]
            assert (r["n_rows"], r["n_null"], r["n_distinct"]) == (w["n_rows"], w["n_null"], w["n_distinct"])
            for a, b in (("q25", "q25"), ("q50", "q50"), ("q75", "q75"), ("ks_previous", "ks"), ("share_change_previous", "share")):
                assert (r[a] is None) == (b not in w) and (r[a] is None or abs(r[a] - w[b]) < 1e-9), (column, a)


def test_hot_value_empty_table_and_all_null_column(spark):
    df = spark.createDataFrame([(1, 5.0)] * 500 + [(2, None)] * 20 + [(3, float("nan"))], "load_no int, v double")
    got = {r["load_no"]: r for r in profile(df, "t", "load_no", {"v": (F.col("v"), "number")}).collect()}
    assert got[1]["q50"] == 5.0 and got[1]["n_distinct"] == 1 and got[2]["n_null"] == 20 and got[2]["q50"] is None and got[3]["n_null"] == 1 and got[3]["ks_previous"] is None
    assert profile(df.limit(0), "t", "load_no", {"v": (F.col("v"), "number")}).count() == 0


def test_shift_and_violations(spark):
    rows = [(1, k) for k in range(100)] + [(2, 3 * k) for k in range(100)] + [(4, 3 * k if k % 2 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "load_no int, v int")
    found = shifts(profile(df, "t", "load_no", {"v": (F.col("v"), "number")}), medians_of={"v": "v"}).collect()
    assert sorted(r["ref_id"] for r in found) == [2, 4]
    bad = violations(df, "t", "load_no", [("v", "range", F.col("v") > 290)]).collect()
    assert len(bad) == 5 and bad[0]["finding"] == "range"


def test_whole_numbers_of_any_size_and_many_loads(spark, monkeypatch):
    big = 2**60
    df = spark.createDataFrame([(1, big), (1, big + 1), (1, big + 2), (1, -big), (1, -big - 1), (1, 7), (2, big + 1)], "load_no int, v long")
    got = {r["load_no"]: r for r in profile(df, "t", "load_no", {"v": (F.col("v"), "whole")}, partitions=3).collect()}
    assert got[1]["n_distinct"] == 6 and got[2]["n_distinct"] == 1 and got[1]["max_value"] == str(big + 2) and got[2]["max_value"] == str(big + 1) and got[1]["min_value"] == str(-big - 1)
    assert abs(got[2]["ks_previous"] - 4 / 6) < 1e-9
    monkeypatch.setattr("edumill.operators.profile.COUNTERS", 60)  # many loads: few partitions, the same profile
    many = spark.createDataFrame([(k % 40, k) for k in range(4000)], "load_no int, v int")
    assert {(r["n_rows"], r["n_distinct"]) for r in profile(many, "t", "load_no", {"v": (F.col("v"), "whole")}).collect()} == {(100, 100)}
