import random

from pyspark.sql import functions as F

from edumill.llm import canon as C


def token_set(form):
    s = f"^{form}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def test_join_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(30)})
    for lost in (0, 3, 5):
        a = spark.createDataFrame([("k", x, lost) for x in left], "kind string, l string, lost int").withColumn("toks", C.pairs(F.col("l")))
        b = spark.createDataFrame([("k", x, lost) for x in right], "kind string, r string, lost int").withColumn("toks", C.pairs(F.col("r")))
        got = {(r["l"], r["r"]): round(r["jaccard"], 9) for r in C.set_similarity_join(a, b).collect()}
        want = {}
        for x in left:
            for y in right:
                both = token_set(x) & token_set(y)
                if both and len(both) >= max(len(token_set(x)), len(token_set(y))) - lost:
                    want[x, y] = round(len(both) / len(token_set(x) | token_set(y)), 9)
        assert got == want


def test_no_edited_name_is_missed(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 26))) for _ in range(60)})
    terms = spark.createDataFrame([(k, "k", n, None) for k, n in enumerate(names, 1)], "term_id int, kind string, canonical_name string, short_form string")
    values = set()
    for n in names:
        for _ in range(12):
            v = n
            for _ in range(rng.randrange(1, 5)):
                i = rng.randrange(len(v))
                v = rng.choice([v[:i] + v[i + 1 :], v[:i] + "q" + v[i:], v[:i] + "z" + v[i + 1 :], v[:i] + v[i : i + 2][::-1] + v[i + 2 :]]) or "q"
            values.add(v)
    df = spark.createDataFrame([("k", v) for v in sorted(values)], "kind string, value string")
    got = {r["value"]: r["term_id"] for r in C.map_values(df, terms).collect()}
    for v in values:
        near = {k for k, n in enumerate(names, 1) if C.edits(v, n, C.allowed_edits(len(n))) <= C.allowed_edits(len(n))}
        assert got[v] in near if near else got[v] == 0, (v, got[v], near)


def test_edit_distance():
    assert C.edits("abcd", "abdc", 3) == 1 and C.edits("abcd", "abcd", 3) == 0 and C.edits("abc", "xyzabc", 2) == 3 and C.edits("", "ab", 3) == 2


def test_readings_and_edge_cases(spark):
    terms = spark.createDataFrame([(1, "technique", "Random Forest", "RF"), (2, "technique", "Logistic Regression", None), (3, "technique", "Graph Attention Model", "GAT"), (4, "weight", "W_STUFIN", None), (5, "technique", "Hidden Markov Model", "HMM")], "term_id int, kind string, canonical_name string, short_form string")
    cases = {
        "random forest": 1, "RF": 1, "rf model": 1, "Forest, Random": 1, "RANDOMFOREST": 1, "Randon Forset": 1, "RF (random forest)": 1, "the Random Forest with cross-validation": 1, "tuned Graph Attention Model": 3, "Logistic Rgression;": 2, "Logistic Regression v2": 2,
        "Probit Regression": 0, "R": 0, "none": 0, "???": 0, "HLM": 0, "x" * 20000: 0,
    }
    rows = [("f", i, "technique", v, "z") for i, v in enumerate(cases)] + [("f", 90, "technique", None, "z"), ("f", 91, "technique", "  ", "z"), ("f", 92, "technique", "Random Forest", "z"), ("w", 93, "weight", "W-STUFIN (final)", "z"), ("w", 94, "weight", "[w_stufn]", "z"), ("f", 0, "technique", "random forest", "z")]
    df = spark.createDataFrame(rows, "field_name string, row_id long, kind string, value string, term_id string").drop("term_id")
    got = sorted((r["row_id"], r["term_id"]) for r in C.mapped_rows(df, terms).collect())
    assert got == sorted([(i, t) for i, t in enumerate(cases.values())] + [(93, 4), (94, 4), (0, 1)])
    assert C.mapped_rows(df.limit(0), terms).count() == 0
    assert {r["term_id"] for r in C.mapped_rows(df, terms.limit(0)).collect()} == {0}
