"""Small rule fixtures: input -> expected."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edumill.functions import ontology as O
from edumill.functions import text as T
from edumill.operators import forecast as M


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_coercion(spark):
    assert values(spark, ["true", "Yes", "1.0", "0", "NO", "n/a", "maybe", None, " "], T.tri_bool) == [True, True, True, False, False, None, None, None, None]
    assert values(spark, [None, " ", "nan", "x"], T.is_blank) == [True, True, True, False]
    assert values(spark, ["Economic and education indicators", "  TF-IDF start!", "", None], T.slug) == ["economic_and_education_indicators", "tf_idf_start", "unnamed", "unnamed"]


def test_doi_forms(spark):
    text = "see https://doi.org/10.1007/s10639-023-11908-0, and DOI: 10.1080/09500693.2024.2359099."
    assert values(spark, [text, "none", None], T.doi_candidates) == [["10.1007/s10639-023-11908-0", "10.1080/09500693.2024.2359099"], [], None]
    assert values(spark, ["https://dx.doi.org/10.1/x", "doi:10.2/y"], T.doi_bare) == ["10.1/x", "10.2/y"]


def test_numbers_in_text(spark):
    assert values(spark, ["N = 5,211 students", "about 12 students", None], T.sample_size) == [5211, None, None]
    assert values(spark, ["R2: 0.15, RMSE=3.2", "0.4", "nothing"], T.metrics) == ["R2=0.15; RMSE=3.2", "0.4", "Not Reported"]
    assert values(spark, ["report 2009 and 2015", "1850"], T.year_of) == [2009, None]


def test_sections(spark):
    text = "Title\nAbstract\nx\n1 Introduction\ny\nMethods\nz\nReferences\nq"
    assert [s["name"] for s in values(spark, [text], T.section_starts)[0]] == ["abstract", "introduction", "methods", "references"]
    assert values(spark, [text, "a"], T.has_sections) == [True, False]
    assert values(spark, [text], T.before_references)[0].endswith("z\n")


@pytest.mark.parametrize(("label", "want"), [("Expected electoral participation (ELECPART)", "Civic_Engagement"), ("Social segregation across schools (Dissimilarity Index D)", "School_Efficiency_Climate"), ("Q-matrix recovery rate (QRR)", "Assessment_Methodology"), ("Log hourly wages", "Labor_Market_Outcomes"), ("Automation risk (individual-level, 0–1)", "Labor_Market_Outcomes"), ("Boredom (ATM scale)", "Wellbeing_Psychological"), ("Political knowledge", "Civic_Engagement"), ("Literature synthesis outcome (not student-level prediction)", O.META), ("Mathematics achievement (PV1MATH)", "Math_Achievement"), ("Self-efficacy in TALIS profession", "Teacher_Efficacy_Workforce"), ("Algebra items", "Math_Achievement"), ("No such thing", O.UNCATEGORIZED), ("  ", O.IGNORE), ("knowledge", O.META), ("Primary study outcome (heuristic migration)", O.META), ("N/A: none", O.IGNORE), (None, O.IGNORE)])
def test_variable_families(spark, label, want):
    assert values(spark, [label], O.variable) == [want]


def test_trend_and_roles(spark):
    assert values(spark, ["predicted higher scores", "was negatively related and lower", "no effect", None, "higher and lower"], O.trend) == ["Positive", "Negative", "Null", "Null", "Null"]
    df = spark.createDataFrame([("W_FSTURWT7", "PISA"), ("JKREP1", "TIMSS"), ("PV1MATH", "PISA"), ("PV1MATH", "ICCS")], "n string, p string")
    assert [r[0] for r in df.select(O.variable_role(F.col("n"), F.col("p"))).collect()] == ["replicate", "replicate", "pv:math", "other"]


def test_ridge_and_metrics():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.1, size=40)
    coef, c = M.ridge(x, y, 1e-9)
    assert np.allclose(coef, [1, -2, 0.5], atol=0.1) and abs(c - 2) < 0.1
    gaps = x.copy()
    gaps[3, 1] = np.nan
    m = M.Fitted(np.hstack([gaps, np.full((40, 1), np.nan)]), y)
    assert m.keep.tolist() == [True, True, True, False] and M.r2(y, m.predict(np.hstack([gaps, np.zeros((40, 1))]))) > 0.9
    assert math.isnan(M.r2(np.ones(3), np.ones(3))) and math.isnan(M.spearman(np.array([1.0, 2]), np.array([1.0, 2])))
    assert M.spearman(np.array([1.0, 2, 2, 3]), np.array([1.0, 2, 2, 3])) == pytest.approx(1)
    s, p = M.diebold_mariano(np.array([3.0, 2, 4, 3, 5]), np.array([1.0, 1, 2, 1, 1]))
    assert s > 0 and 0 < p < 0.2 and all(map(math.isnan, M.diebold_mariano(np.ones(2), np.ones(2))))


NAN = float("nan")
# fixed values: (previous score, two lagged covariates, score) of a published civic fold
TRAIN = [(576.3772, 0.0, 3.9049, 586.2504), (525.3077, 0.0, 3.9631, 546.4239), (554.1034, -0.0, 2.8815, 515.2757), (564.8232, -0.0, 3.9247, 551.2297), (505.1585, 0.0, 3.8093, 517.7571), (481.6134, -0.0, 3.9873, 492.1515), (493.6078, -0.0, 3.6401, 522.8688), (514.5604, -0.0, 4.2347, 563.6634), (515.9222, -0.0, 3.9242, 532.1036), (558.7338, 0.0, 3.451, 581.148)]
TEST = [(518.5446, 0.0002, 2.2774, 524.4767), (546.4239, -0.0001, 3.0016, 545.1539), (531.2111, -0.0001, 2.7025, 531.3191), (517.7571, -0.0002, 3.2023, 508.8804), (492.1515, -0.0, 3.126, 490.1111), (522.8688, -0.0001, 2.8118, 508.2892), (563.6634, -0.002, 3.4281, 529.1304), (532.1036, -0.0001, 3.0382, 504.0589), (581.148, -0.0002, 2.7444, 583.06)]


def test_a_published_fold():
    """The closed form gives the published errors of this fold to four places."""
    train, test = np.array(TRAIN), np.array(TEST)
    m = M.Fitted(train[:, :3], train[:, 3])
    s = M.scores_of(test[:, 3], m.predict(test[:, :3]))
    assert m.alpha == 0.01 and round(s["mae"], 4) == 20.6715 and round(s["rmse"], 4) == 25.6402


def test_average_ranks(spark):
    from edumill.operators.panel import average_ranks

    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = sorted((r["k"], r["v"] or -1, r["r"]) for r in average_ranks(df, ["k"], "v", "r").collect())
    assert got == [("a", -1, None), ("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 5.0, 3.0), ("b", 2.0, 1.0)]


def test_techniques_are_found_inside_values(spark):
    terms = spark.createDataFrame([("Neural Network", None), ("Convolutional Neural Network", "CNN"), ("Ridge Regression", None)], "canonical_name string, short_form string")
    given = ["Convolutional Neural Network (CNN)", "ridge regression (main model)", "neural network;", "cnn", "Delphi panel", "cnnx", " ", None]
    want = ["Convolutional Neural Network", "Ridge Regression", "Neural Network", "Convolutional Neural Network", "Delphi panel", "cnnx", "Not Reported", "Not Reported"]
    assert values(spark, given, lambda c: O.canonical_technique(c, terms)) == want


def test_payload_joins_the_informative_sections(spark):
    text = "Title page\nAbstract\nx\nResults\nr\n\nMethods\nm\nAbstract\nagain\nReferences\nq"
    got = values(spark, [text, "Title\nMethods\nm\nReferences\nq", " plain ", None], T.payload)
    assert [g and tuple(g) for g in got] == [(True, "Abstract\nx\n\nMethods\nm\nAbstract\nagain\n\nResults\nr"), (False, "Title\nMethods\nm"), (False, "plain"), None]


def folds(n_train, n_test=4, program="P"):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n_train + n_test, 4))
    y = x @ [2.0, 1.0, 0.5, 0.0] + rng.normal(size=len(x))
    df = pd.DataFrame({"program": program, "x": list(x), "y": y})
    return df[:n_train].copy(), df[n_train:].copy()


def test_hierarchy_has_five_models_and_says_why_a_fold_has_none():
    fit = M.hierarchy(["A", "B", "C", "C"], 2, least_by_program=M.LEAST_TRAIN)
    train, test = folds(20)
    got = {r[0]: r for r in fit(train, test)}
    assert [*got] == ["M2", "M0A", "M0B", "M1A", "M1B"] and [r[3] for r in got.values()] == [1, 1, 2, 2, 4] and all(r[9] is None for r in got.values())
    x, y = np.array(train["x"].tolist()), train["y"].to_numpy()
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0) * [1.0, 0.5]
    b, c = M.ridge(z, y, got["M1A"][4])
    p = (np.array(test["x"].tolist())[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0) * [1.0, 0.5] @ b + c
    assert got["M1A"][5] == pytest.approx(np.sqrt(((test["y"] - p) ** 2).mean()))
    assert [(r[0], r[9]) for r in fit(*folds(9))] == [("diagnostic", "n_train=9 < 10")]
    assert len(fit(*folds(9, program="ICCS"))) == 5 and fit(*folds(20, 2))[0][9] == "n_test=2 < 3"
    train["x"] = [[*v[:2], float("nan"), v[3]] if i < 12 else v for i, v in enumerate(train["x"])]
    assert {r[0]: (r[1], r[9]) for r in fit(train, test)}["M1B"] == (8, "n_train=8 < 10")  # rows with gaps are left out


def test_audit_has_tiers_and_change_of_error():
    rows = M.tier_audit(list("abcd"), ["A", "B", "C", "C"], 3)(*folds(20))
    got = [dict(zip([p.split()[0] for p in M.AUDIT.split(", ")], r, strict=True)) for r in rows]
    assert [(r["model"], r["feature"], r["weight"]) for r in got] == [("M0B", "a", 1), ("M0B", "b", 1), ("M0B", "c", 1), ("M1A", "a", 1), ("M1A", "b", 0.5), ("M1A", "c", 0.25)]
    assert {(r["n_tier_a"], r["n_tier_b"], r["n_tier_c"]) for r in got} == {(1, 1, 1)} and [r["n_below_1"] for r in got] == [0, 0, 0, 2, 2, 2]
    assert {r["delta_rmse"] for r in got} == {got[3]["rmse"] - got[0]["rmse"]}


def test_weights_are_permuted_against_importance(spark):
    data = [("P", f, m, w) for f, m, w in (("a", 4.0, 1.0), ("b", 3.0, 0.7), ("c", 2.0, 0.5), ("d", 1.0, 0.2))] + [("Q", f, m, 0.5) for f, m in (("a", 1.0), ("b", 2.0))]
    got = {r["program"]: r for r in M.weight_permutation(spark.createDataFrame(data, "program string, feature string, mean_abs double, weight double"), ["program"]).collect()}
    r = got["P"]
    assert r["rho"] == 1 and r["p_left"] == 1 and r["rounds"] == 1000 and r["n_features"] == 4
    assert abs(r["p_right"] - 1 / 24) < 0.02 and abs(r["p_two"] - 2 / 24) < 0.03 and abs(r["null_mean"]) < 0.06  # of 24 orders one has rho 1 and one -1
    assert got["Q"]["rho"] is None or math.isnan(got["Q"]["rho"])


def test_permutation_query_has_the_rho(spark, sf):
    from edumill.plans import forecasting

    r = forecasting.m18(spark, sf).where("kind = 'rho'").collect()
    assert r and all(x["rounds"] == 1000 and x["n_features"] == 3 and 0 < x["p_two"] <= 1 for x in r)


def test_all_signals_of_a_text(spark):
    text = "TIMSS Grade 4: books at home predict reading; national sample"
    names = ("programs", "construct", "outcome", "effect_type", "analysis_level")
    got = {n: values(spark, [text, "nothing"], lambda c, n=n: O.signals(F.lower(c))[n]) for n in names}
    assert got == {"programs": ["TIMSS_G4|TIMSS", ""], "construct": ["HOME_RESOURCES", "UNMATCHED"], "outcome": ["reading_achievement", "unspecified"], "effect_type": ["predictive", "associative"], "analysis_level": ["country", "student"]}


def test_synthesis_labels_by_text_and_by_context(spark):
    framework, study = F.lit("Technical/Assessment Framework"), F.lit("Empirical Traditional")
    label = "how TIMSS 2019 sampling weights are applied in national reports"
    assert values(spark, [label], lambda c: O.variable(c, study_filter=framework)) == [O.META]
    assert values(spark, ["Mathematics achievement (PV1MATH)"], lambda c: O.variable(c, study_filter=study)) == ["Math_Achievement"]
    assert values(spark, ["83% of between-school variance and 33% of between-student variance achievement", "plain", None, " "], O.meta_label) == [True, False, False, False]
    long = "x" * 60
    assert values(spark, [long, "short"], lambda c: O.meta_label(c, document_class=F.lit("technical_report"))) == [True, False]
    assert values(spark, [long, "short", "how so"], lambda c: O.meta_label(c, source_category=F.lit("review_article"))) == [True, False, True]
    assert values(spark, [O.META, "SES", O.IGNORE], O.filter_flag) == ["theoretical_meta_synthesis", "empirical_finding", "excluded"]
