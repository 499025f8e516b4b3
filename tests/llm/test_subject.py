import duckdb

from edumill.llm import queries as Q
from edumill.llm import subject as S

MATH = "Results suggest that work with fractions matters. Progress in geometry and mental calculation was measured."
READ = "Pupils with more reading fluency and a wider vocabulary did well, and retelling a story improved."

#: Written for this test, about each area in words of everyday prose.
WRITTEN = {
    1: ["Most pupils added the numerators and the denominators of both fractions, and few could tell why the equation had no solution.", "Die Aufgaben verlangten, einfache Gleichungen zu lösen und den Flächeninhalt eines Dreiecks zu bestimmen."],
    2: ["After the novel was finished in class, readers discussed its narrator; weaker readers needed help with the vocabulary.", "Les élèves lisent un récit puis répondent à des questions sur la compréhension du texte."],
    3: ["In the laboratory each group planned an experiment on how fast sugar dissolves and wrote down a hypothesis first.", "Os alunos estudaram a fotossíntese e a cadeia alimentar de um ecossistema."],
    4: ["Young people who follow elections and know how parliament passes a law say more often that they will vote.", "Los jóvenes valoran la democracia, los derechos humanos y la participación ciudadana."],
    5: ["Students checked whether a website could be trusted and formatted a spreadsheet on their computer.", "Öğrenciler bilgisayar ve internet kullanarak çevrim içi kaynaklarda bilgi aradı."],
    6: ["Teachers asked for more professional development and said that their workload and salaries made the profession less attractive.", "Lehrkräfte berichten von hoher Arbeitszufriedenheit, wenn die Schulleitung sie bei der Fortbildung unterstützt."],
    7: ["Children of immigrants and of families with a low income are segregated into disadvantaged schools.", "La desigualdad entre familias pobres y ricas explica la ventaja del origen social."],
    8: ["Lonely pupils who had been bullied reported more anxiety, less sleep and a weaker sense of belonging.", "O bem-estar dos alunos melhora com o sentimento de pertença e diminui com a ansiedade."],
    9: ["Standard errors were computed with replicate weights and five plausible values from the item response model.", "La varianza de muestreo se estimó con pesos replicados y el modelo de respuesta al ítem."],
}


def test_terms_are_found_longest_first_at_word_starts():
    terms = S.term_list()
    machine = S.automaton(terms)
    hit = lambda t: [terms[k][1] for _, _, ks in S.paragraph_hits(t, machine) for k in ks]
    assert hit("Reading\nFluency is hard") == ["reading fluency"] and hit("xfractions") == [] and hit("nothing here") == []
    assert hit("Mathematics") == ["mathemati"] and hit("maths") == ["maths$"] and hit("mathsy") == []
    assert len({(s, t) for s, t, _ in terms}) == len(terms) and {w for _, _, w in terms} == {2, 3}


def test_written_paragraphs(spark):
    docs = spark.createDataFrame([(10 * s + k, t) for s, ts in WRITTEN.items() for k, t in enumerate(ts)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["subject_id"]) for r in S.subjects(docs, spark.createDataFrame([], "doc_id long, subject_id int")).collect())
    assert got == [(10 * s + k, s) for s, ts in WRITTEN.items() for k in range(len(ts))]


def test_main_matter_and_passing_mention(spark):
    docs = spark.createDataFrame([(1, MATH, "z"), (2, f"{MATH}\n\n{READ}", "z"), (3, MATH + " A word on anxiety.", "z"), (4, None, "z"), (5, "", "z"), (6, "Only plain words here.", "z"), (1, MATH, "z"), (7, (MATH + "\n\n") * 2000, "z")], "doc_id long, text string, share string")
    labels = spark.createDataFrame([], "doc_id long, subject_id int")
    got = {(r["doc_id"], r["subject_id"]) for r in S.subjects(docs, labels).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1), (7, 1)}
    assert S.subjects(docs.limit(0), labels).count() == 0


def test_agrees_with_the_hand_labels(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    truth = set(duckdb.sql(f"select distinct doc_id, subject_id from '{folder}/subject_labels.parquet'").fetchall())
    docs = {d for d, _ in truth}
    got = {(r[0], r[1]) for r in Q.p10_found(spark, folder).collect() if r[0] in docs}
    assert len(got & truth) / len(got) > 0.9 and len(got & truth) / len(truth) > 0.9  # a few labels are wrong
