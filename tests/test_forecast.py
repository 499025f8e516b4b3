"""The model queries against plain numpy versions written anew: closed-form ridge, loops over folds."""

import math

import numpy as np
import pytest
from edumill.plans import forecasting as P
from edumill.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def panel(spark, sf):
    rows = [r.asDict() for r in P.pairs(spark, sf).collect()]
    return sorted(rows, key=lambda r: (r["program"], r["cycle"], r["country"]))


def folds(rows):
    for program in sorted({r["program"] for r in rows}):
        mine = [r for r in rows if r["program"] == program]
        for cycle in sorted({r["cycle"] for r in mine})[1:]:
            yield program, cycle, [r for r in mine if r["cycle"] < cycle], [r for r in mine if r["cycle"] == cycle]


def matrix(rows, cols):
    x = np.array([[np.nan if r["x"][c] is None else r["x"][c] for c in cols] for r in rows], dtype=float)
    return x, np.array([r["y"] for r in rows])


def solve(z, y, alpha):
    """Ridge by an augmented least-squares problem instead of the normal equations."""
    m = z.mean(0)
    a = np.vstack([z - m, math.sqrt(alpha) * np.eye(z.shape[1])])
    b = np.linalg.lstsq(a, np.concatenate([y - y.mean(), np.zeros(z.shape[1])]), rcond=None)[0]
    return lambda q: (q - m) @ b + y.mean(), b


def model(xt, yt, x, weights=None):
    ok = ~np.isnan(xt).all(0)
    xt, x = xt[:, ok], x[:, ok]
    fill = np.nanmean(xt, axis=0)
    xt, x = np.where(np.isnan(xt), fill, xt), np.where(np.isnan(x), fill, x)
    sd = xt.std(0)
    sd[sd == 0] = 1
    w = np.ones(xt.shape[1]) if weights is None else np.sqrt(np.array(weights)[ok])
    zt, z = (xt - xt.mean(0)) / sd * w, (x - xt.mean(0)) / sd * w
    best = None
    for alpha in (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0):
        got = []
        for part in np.array_split(np.arange(len(yt)), min(5, len(yt))):
            rest = [i for i in range(len(yt)) if i not in set(part)]
            p = solve(zt[rest], yt[rest], alpha)[0](zt[part])
            total = ((yt[part] - yt[part].mean()) ** 2).sum()
            got.append(1 - ((yt[part] - p) ** 2).sum() / total if total else float("nan"))
        if best is None or np.mean(got) > best[0]:
            best = (np.mean(got), alpha)
    predict, coef = solve(zt, yt, best[1])
    return predict(z), coef, z


def near(a, b):
    return (a is None or b is None or math.isnan(a) or math.isnan(b)) or abs(a - b) <= 1e-6 * max(1, abs(a), abs(b))


def test_model_hierarchy_equals_plain_version(spark, sf, panel):
    got = {(r["program"], r["test_cycle"], r["model"]): r for r in Q["m03_model_hierarchy"](spark, sf).collect()}
    seen = 0
    for program, cycle, train, test in folds(panel):
        x, y = matrix(test, [0])
        assert near(got[program, cycle, "M2"]["rmse"], float(np.sqrt(((y - x[:, 0]) ** 2).mean())))
        if len(train) < 3:
            continue
        for name, cols, w in (("M0A", [0, 1], None), ("M0", [0, 1, 2, 3], None), ("M1", [0, 1, 2, 3], P.WEIGHTS)):
            (xt, yt), (x, y) = matrix(train, cols), matrix(test, cols)
            p, _, _ = model(xt, yt, x, w)
            r = got[program, cycle, name]
            assert near(r["rmse"], float(np.sqrt(((y - p) ** 2).mean()))) and near(r["mae"], float(np.abs(y - p).mean())), (program, cycle, name)
            seen += 1
    assert seen >= 6


def test_attributions_and_hold_out_equal_plain_version(spark, sf, panel):
    got = {(r["program"], r["test_cycle"], r["feature"]): r for r in Q["m08_attributions"](spark, sf).collect()}
    last = {r["country"]: r for r in Q["m13_hold_out"](spark, sf).collect()}
    every = list(folds(panel))
    for program, cycle, train, test in every:
        if len(train) < 3:
            continue
        (xt, yt), (x, _) = matrix(train, [0, 1, 2, 3]), matrix(test, [0, 1, 2, 3])
        _, coef, z = model(xt, yt, x, P.WEIGHTS)
        kept = [n for n, k in zip(P.FEATURES, ~np.isnan(xt).all(0), strict=True) if k]
        shap = np.abs(z * coef).mean(0)
        for n, s in zip(kept, shap, strict=True):
            r = got[program, cycle, n]
            assert near(r["mean_abs"], float(s)) and near(r["share"], float(s / shap.sum())) and r["rank"] == 1 + sum(o > s * (1 + 1e-9) for o in shap)
    end = max(c for _, c, _, _ in every)
    inside = {r["country"]: r["predicted"] for r in Q["m13_in_sample"](spark, sf).collect()}
    x, y = matrix([r for r in panel if r["cycle"] == end], [0, 1, 2, 3])
    assert all(near(inside[r["country"]], float(p)) for r, p in zip((r for r in panel if r["cycle"] == end), model(x, y, x)[0], strict=True))
    for _, _, train, test in (f for f in every if f[1] == end):
        (xt, yt), (x, _) = matrix(train, [0, 1, 2, 3]), matrix(test, [0, 1, 2, 3])
        for r, p in zip(test, model(xt, yt, x)[0], strict=True):
            assert near(last[r["country"]]["predicted"], float(p))


def test_means_alignments_and_subgroups(spark, sf):
    import pandas as pd

    m08 = pd.DataFrame([r.asDict() for r in Q["m08_attributions"](spark, sf).collect()])
    mean = {r["feature"]: r["mean_abs"] for r in Q["a24_mean_attribution"](spark, sf).collect()}
    for f, v in m08.groupby("feature")["mean_abs"].mean().items():
        assert near(mean[f], float(v))
    w = dict(zip(P.FEATURES, P.WEIGHTS, strict=True))
    for r in Q["m16_rank_alignment"](spark, sf).collect():
        part = m08[m08.test_cycle == r["test_cycle"]]
        a, b = part["mean_abs"].rank(), part["feature"].map(w).rank()
        assert near(r["rho"], float(np.corrcoef(a, b)[0, 1])) and r["n"] == len(part)
    hold = pd.DataFrame([r.asDict() for r in Q["m13_hold_out"](spark, sf).collect()])
    hold["inside"] = hold["country"].isin([f"NATION_{k}" for k in range(12)])
    for r in Q["m18_subgroups"](spark, sf).collect():
        part = hold[hold.inside == r["inside"]]
        assert r["n"] == len(part) and near(r["rmse"], float(np.sqrt(((part["y"] - part["predicted"]) ** 2).mean())))
