import json

from edumill.operators.shred import article_children, article_levels, article_of, article_rows, assemble, index_vectors, read_payload, shred


def payload(authors=None, countries=None, text=None):
    return {"metadata": {"authors": authors}, "data": {"survey_design": {"weight_fields_interpretation": text}, "sample_details": {"countries": countries}}}


def test_levels_rebuild_nested_groups():
    nested = [{"country_code": "AAA"}, {"countries": [{"country_code": "BBB", "n_students": "1,200"}, {"country_code": "CCC"}]}, {"subgroups": [{"countries": [{"country_code": "DDD", "n_students": 7}]}]}]
    root = article_of(payload(countries=nested))
    cols = shred(payload(countries=nested), root)
    leaf = "record.data.sample_details.countries.countries.country_code"
    assert [e[:1] for e in cols[leaf]] == [(0,), (1,), (2,), (1,)]
    assert index_vectors(cols[leaf], 2) == [(1, 1), (2, 1), (2, 2), (3, 1)]
    rows = assemble(cols, root, [leaf, leaf.replace("country_code", "n_students")])
    assert (("2" and (2, 1)), {"country_code": "BBB", "n_students": "1,200"}) in rows
    got = article_rows(json.dumps(payload(countries=nested)))
    assert got == [("countries.country_code", 1, "AAA"), ("countries.country_code", 2, "BBB"), ("countries.n_students", 2, "1200"), ("countries.country_code", 3, "CCC"), ("countries.country_code", 4, "DDD"), ("countries.n_students", 4, "7")]


def test_shapes_of_authors_and_texts():
    names = lambda a: [r[2] for r in article_rows(json.dumps(payload(authors=a))) if r[0] == "authors"]
    want = ["Ana Bel", "Cid Dor"]
    assert names(["Ana Bel", " ", None, "Cid Dor"]) == names("Ana Bel;Cid Dor") == names([{"name": "Ana Bel"}, {"name": {"given": "Cid", "family": "Dor"}}]) == want
    assert names('["Ana Bel", "Cid Dor"]') == want and names("N/A") == names(None) == names([]) == []
    texts = lambda t: [(r[1], r[2]) for r in article_rows(json.dumps(payload(text=t)))]
    assert texts("One.") == [(1, "One.")] and texts({"b": "One.", "a": "", "c": "Two."}) == [(1, "One."), (2, "Two.")] == texts(["One.", "not available", "Two."])
    assert article_rows(json.dumps(payload(countries={"FIN": 12, "SWE": None}))) == [("countries.country_code", 1, "FIN"), ("countries.n_students", 1, "12"), ("countries.country_code", 2, "SWE")]


def test_wrapped_damaged_and_odd_payloads(spark):
    p = json.dumps(payload(authors=["Ana Bel"]))
    forms = [p, "﻿" + p, json.dumps(p), f"[{p}]", json.dumps({"record": json.loads(p), "version": 2})]
    assert all(read_payload(f) == json.loads(p) for f in forms)
    bad = [None, "", "  ", p[:-9], "[]", "7", "null", '"text"']
    rows = [(i, f, "x") for i, f in enumerate(forms + bad + [forms[0]])] + [(None, p, "x")]
    df = spark.createDataFrame(rows, "record_id long, payload string, leaf_path string")
    got = sorted((r["record_id"], r["leaf_value"]) for r in article_children(df).collect())
    assert got == [(i, "Ana Bel") for i in (0, 1, 2, 3, 4, len(forms + bad))]
    assert article_children(df.limit(0)).count() == 0 and article_levels(df.limit(0)).count() == 0


def test_long_lists():
    p = json.dumps(payload(authors=[f"A{k} B" for k in range(5000)]))
    rows = article_rows(p)
    assert len(rows) == 5000 and rows[-1] == ("authors", 5000, "A4999 B")


def test_groups_and_wrappers_of_any_depth():
    for depth in (1, 4, 7, 60):
        inner = [{"country_code": f"C{depth}"}]
        for k in range(depth - 1, 0, -1):
            inner = [{"country_code": f"C{k}", "n_students": k, ("countries", "subgroups")[k % 2]: inner}]
        rows = article_rows(json.dumps(payload(countries=inner)))
        assert [r[1:] for r in rows if r[0] == "countries.country_code"] == [(k, f"C{k}") for k in range(1, depth + 1)]
        assert [r[1:] for r in rows if r[0] == "countries.n_students"] == [(k, str(k)) for k in range(1, depth)]
    wrapped = payload(authors=["Ana Bel"])
    for k in range(25):
        wrapped = {"record": wrapped} if k % 3 else [json.dumps(wrapped)]
    assert article_rows(json.dumps(wrapped)) == [("authors", 1, "Ana Bel")]


def test_too_deep_to_read():
    assert article_rows("[" * 200_000) == [] == article_rows("[" * 200_000 + "]" * 200_000)
