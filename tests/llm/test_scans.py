import numpy as np

from edumill.llm import scans as S

WORDS = {w: 100 for w in "the school children were similar among pupils reading tables report of in grade study and their results differ low-stakes fifteen-year-olds testing modern schools about between".split()}
ONE, OTHER = np.array([1.0, 0.0]), np.array([-1.0, 0.2])
FIX = S.Corrector(WORDS, {w: ONE for w in WORDS})
TITLE = "Reading among pupils in grade four"


def findings(text, title=TITLE, fix=FIX):
    return S.repaired(text, title, fix)


def test_kinds_and_repair():
    text = f"{TITLE}\nAna Bel\nAbstract\nThe sch-\nool children were sim1lar arnong\nREADING AMONG PUPILS\nPage 4\npupils of low-\nstakes testing. Scbool\nLetters on Surveys, Vol. 3 | 12\nresults differ.\n\nReferences\nBel, A. (1999). Reading. Review.\n- 5 -"
    found, clean = findings(text)
    assert (4, "hyphen", "school") in found and (5, "char", "similar") in found and (5, "char", "among") in found and (6, "header", "") in found and (7, "page_no", "") in found
    assert (8, "hyphen", "low-stakes") in found and (9, "char", "School") in found and (10, "header", "") in found and (15, "page_no", "") in found and len(found) == 9
    assert "The school children were similar among pupils of low-stakes testing. School results differ." in clean and "Page 4" not in clean


def test_division_over_furniture_and_misread_heads():
    found, clean = findings(f"{TITLE}\n\nthe resu-\n9 / 11\n\nAna et al. | Rcading among\nlts differ in 2003.\n2004.")
    assert found == [(3, "hyphen", "results"), (4, "page_no", ""), (6, "header", "")] and clean.endswith("the results differ in 2003. 2004.")


def test_letter_case_and_unknown_words():
    assert S.cased("SCBOOL", "school", False) == "SCHOOL" and S.cased("5chool", "school", True) == "School" and S.cased("5chool", "school", False) == "school" and S.cased("Scbool", "school", False) == "School"
    found, _ = findings("x\n\nthe Zorvak study of Scbool and qwxz.\nends with a divi-")
    assert found == []
    assert findings("")[0] == [] and findings("\n\n")[0] == []


def test_context_decides_single_candidates():
    words = {w: 1000 for w in "my friend bought a for the farm clear form modern sky answer an question".split()}
    farm = {w: ONE for w in "my friend bought a for the farm".split()} | {w: OTHER for w in "clear form modern sky answer an question".split()}
    text = "My dear friend bought a modem for the farm"
    for vectors in ({}, farm):  # rare valid words stay, without any proof and against the proof
        found, clean = findings(f"t\n\n{text}", fix=S.Corrector(words, vectors))
        assert found == [] and clean.endswith(text)
    fix = S.Corrector(words, farm)
    assert findings("t\n\nan answer dear question", fix=fix)[0] == [(3, "char", "clear")]
    assert findings("t\n\nbought a c1ear friend", fix=S.Corrector(words, {}))[0] == [(3, "char", "clear")]  # no word has a digit


def test_bound_of_the_vocabulary_does_not_move_with_the_corpus(spark):
    body = "the school children were reading tables about the school"
    small, large = ("\n".join([body] * n) for n in (8, 800))
    for text in (small, large):
        df = spark.createDataFrame([(1, f"T\n\n{text}\nthe schoo1 children", None)], "file_id long, raw_text string, extraction_text string")
        assert [r["fixed"] for r in S.repair(df).where("kind = 'char'").collect()] == ["school"]


def test_repeats_count_once_and_long_texts():
    found, _ = findings("t\n\nscbool and scbool and scbool")
    assert found == [(3, "char", "school")]
    found, clean = findings("t\n\n" + "\n".join(["the scbool report"] * 4000))
    assert len(found) == 4000 and clean.count("school") == 4000


def test_operator_edge_cases(spark):
    body = "\n".join(["the school children were reading tables about the school"] * 8)
    rows = [(1, f"T\n\n{body}\nthe schoo1 children", None, "x"), (2, None, "", "x"), (3, "", None, "x"), (None, "a", "b", "x"), (1, f"T\n\n{body}\nthe schoo1 children", None, "x"), (4, None, "U\n\nthe schoo1", "x")]
    df = spark.createDataFrame(rows, "file_id long, raw_text string, extraction_text string, fixed string")
    got = [(r["file_id"], r["field_name"], r["line_no"], r["kind"], r["fixed"]) for r in S.repair(df).where("kind != 'text'").collect()]
    assert sorted(got) == [(1, "raw_text", 11, "char", "school"), (1, "raw_text", 11, "char", "school"), (4, "extraction_text", 3, "char", "school")]
    assert S.repair(df.limit(0)).count() == 0
