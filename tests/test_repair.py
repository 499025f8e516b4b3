"""Repair rules on small inputs."""

import pytest
from pyspark.sql import functions as F

from edumill.functions import repair as X


def rows(spark, data, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + schema)
    return [r[0] for r in df.select("i", column.alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize(("code", "name", "want"), [("N/A", "TF-IDF start behavior weight", "tf_idf_start_behavior_weight"), (None, "Gender", "gender"), ("N/A", "Socioeconomic status (ESCS)", "ESCS"), ("N/A", "Economic and education indicators", "economic_and_education_indicators"), ("ESCS", "anything", "ESCS"), ("meta_cognition", "Metacognition: understanding", "UNDREM"), ("a b", "Class size", "class_size")])
def test_codes(spark, code, name, want):
    assert rows(spark, [(code, name)], "c string, n string", X.repaired_code(F.col("c"), F.col("n"))) == [want]


def test_micro_features_and_weights(spark):
    micro = [("word2vec", "1_0_0"), ("x", "start"), ("x", "reset"), ("tfidf score", "a"), ("economic status", "ESCS"), ("strategy", "VOTAT"), ("total time on slider", "t"), (None, None)]
    assert rows(spark, micro, "n string, c string", X.is_micro_feature(F.col("n"), F.col("c"))) == [True, True, True, True, False, False, False, False]
    assert rows(spark, [("x", "TOTWGT"), ("x", "w_stu"), ("senate weight", "S"), ("senate weight", None), ("x", "ESCS")], "n string, c string", X.is_weight_variable(F.col("n"), F.col("c"))) == [True, True, True, False, False]


def test_labels_and_titles(spark):
    assert rows(spark, [("the sense of belonging",), ("Status (ESCS",), ("a b c d e f g h i j",), (None,)], "t string", X.condensed(F.col("t"))) == ["sense of belonging", "Status (ESCS)", "a b c d e f g h", None]
    assert rows(spark, [("Smith (2019). A long enough title.pdf",), ("short.pdf",), ("9789264012345678-en.pdf",), (None,)], "t string", X.title_from_file_name(F.col("t"))) == ["A long enough title", None, "OECD publication 9789264012345678-en", None]
    text = "http://x\nA title that is long enough\nA much longer title that is long enough\nAbstract\nA line that is even longer than all of the others before it"
    assert rows(spark, [(text,), ("no head",)], "t string", X.title_from_text(F.col("t"))) == ["A much longer title that is long enough", None]


def test_categories_vocabularies_and_countries(spark):
    c = [("nonsense", "Homework hours", "X1"), ("teacher", "whatever", "X1"), (None, "x", "ESCS"), (None, "unknown thing", None)]
    assert rows(spark, c, "c string, n string, k string", X.confounder_category(F.col("c"), F.col("n"), F.col("k"))) == ["student_behavior", "teacher", "socioeconomic", "student_behavior"]
    assert rows(spark, [("Rubin's rules",), ("PV1 only",), ("wle",), ("10 PVs",), ("nothing",), (None,)], "t string", X.literal(F.col("t"), X.PV_WORDS, X.PV_SIGNS)) == ["rubin_rules", "single_pv", "wle", "all_pv", "not_reported", "not_reported"]
    df = spark.createDataFrame([(1, "data for Germany, Finland, and Norway."), (2, "fin de siecle"), (3, None), (4, "FIN and New Zealand")], "i int, t string")
    names = spark.createDataFrame([("Germany", "DEU"), ("Finland", "FIN"), ("Norway", "NOR"), ("New Zealand", "NZL")], "name string, code string")
    assert {r["i"]: r["codes"] for r in X.countries_in(df, "i", "t", names).collect()} == {1: ["DEU", "FIN", "NOR"], 4: ["FIN", "NZL"]}


def test_findings(spark):
    schema = "f array<struct<dataset_used string, target_variable string, top_predictors array<string>, performance_metrics string, standardized_conclusion string>>"
    data = [([(None, "reading", ["a", None, "b", "c", "d", "e", "f"], " ", None), ("PISA 2018", None, [], "R2: 0.1", "x")],), ([],), (None,)]
    got = rows(spark, data, schema, X.normalised_findings(F.col("f")))
    assert len(got[0]) == 1 and got[0][0]["top_predictors"] == ["a", "b", "c", "d", "e"] and got[0][0]["performance_metrics"] == "Not reported" and got[1] == [] and got[2] is None
    assert got[0][0]["standardized_conclusion"].startswith("Using ILSA dataset not specified in manuscript data, the study leveraged a, b, c to predict reading") and "This indicates" in got[0][0]["standardized_conclusion"]


def test_long_country_names(spark):
    df = spark.createDataFrame([(1, "in the United Arab Emirates, and Hong Kong (SAR)"), (2, "Republic of Korea"), (3, "united arab")], "i int, t string")
    names = spark.createDataFrame([("United Arab Emirates", "ARE"), ("Hong Kong (SAR)", "HKG"), ("Republic of Korea", "KOR")], "name string, code string")
    assert {r["i"]: r["codes"] for r in X.countries_in(df, "i", "t", names).collect()} == {1: ["ARE", "HKG"], 2: ["KOR"]}
    assert {r["i"]: r["codes"] for r in X.countries_in(df, "i", "t", names, 1).collect()}[1] == ["ARE"]


def test_conclusions(spark):
    given = ["finding that ESCS mattered.", "With PISA 2018 process the study saw gains. This indicates that equity counts.", "Using logs, data, the study predicted scores", None, "N/A", "The study found that teachers shape practice and equity in many of the schools that were looked at"]
    got = rows(spark, [(g,) for g in given], "g string", X.conclusion(F.lit("PISA 2018"), F.array(F.lit("ESCS"), F.lit("age")), F.lit("reading"), F.col("g")))
    start = "Using PISA 2018 data, the study leveraged ESCS, age to predict reading, finding that "
    assert got[0] == start + "ESCS mattered. This indicates that " + X.NO_MEANING + "."
    assert got[1] == "With PISA 2018 process data, the study saw gains. This indicates that equity counts."
    assert got[2].startswith("Using logs, the study predicted scores. This indicates that ")
    assert got[3] == got[4] == start + X.NO_NARRATIVE + ". This indicates that " + X.NO_MEANING + "."
    assert got[5] == start + "teachers shape practice and equity in many of the schools that were looked at. This indicates that " + given[5] + "."
    own = X.conclusion(F.lit("TIMSS process data"), F.array().cast("array<string>"), F.lit("x"), F.lit("It rose. This indicates that more is better. Then it fell."))
    assert rows(spark, [(1,)], "g int", own) == ["Using TIMSS process data, the study leveraged the reported predictors to predict x, finding that It rose. This indicates that more is better. Then it fell."]


def test_titles_before_abstract_and_affiliation(spark):
    text = "ILSA\nA capital title that is long enough\nshort\nAna Bel\nDepartment of X\nmore"
    cases = [(None, text), ("A &amp; B in all schools", text), ("short", "x\ny"), (None, None)]
    assert rows(spark, cases, "g string, t string", X.document_title(F.col("g"), F.col("t"))) == ["A capital title that is long enough", "A & B in all schools", None, None]


def test_context_of_a_record(spark):
    from edumill.operators import records as R

    body = '''{"metadata": {"title": "Reading in TIMSS 2019 grade four", "source_category": "review_article"}, "data": {"outcome_summary": "The model predicts math scores well, AUC = 0.81 and AUC = 0.81, accuracy: 70%.",
     "confounders_identified": [{"variable_name": "Gender"}, {"variable_name": "n/a"}, {"variable_code": "ESCS"}], "main_findings": [{"target_variable": "reading", "top_predictors": "a, b,, c"}]}}'''
    r = R.parsed(spark.createDataFrame([(1, body.replace("\n", " "))], "record_id int, payload string"))
    blob, out = X.context(F.col("r")), F.col("r.data.outcome_summary")
    got = r.select(X.inferred_dataset(blob, F.lit(None).cast("string")), X.inferred_target(out, blob, F.lit("review_article"), F.lit(False)), X.inferred_predictors(F.col("r.data.confounders_identified")), X.metrics_in(out), F.col("r.data.main_findings")[0]["top_predictors"]).first()
    assert got[0] == "TIMSS 2019 grade four" and got[1] == "predicts math scores well" and got[2] == ["Gender", "ESCS"] and got[3] == "AUC = 0.81; accuracy: 70%" and got[4] == ["a", "b", "c"]
    none = r.select(X.inferred_dataset(F.lit("OECD - 2015 only"), F.lit("x")), X.inferred_dataset(F.lit(""), F.lit("review_article")), X.inferred_target(F.lit(None).cast("string"), F.lit(""), F.lit("x"), F.lit(True)), X.metrics_in(F.lit(""))).first()
    assert tuple(none) == ("OECD 2015", X.SYNTHESIS_DATA, X.MODEL_TARGET, "Not reported")
