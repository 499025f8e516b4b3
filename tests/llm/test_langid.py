from edumill.llm import langid as L

TEXTS = {
    "en": ["The sample covered primary school children from public and private schools.", "All figures were rounded, and totals may differ slightly from the sum of their parts.", "Some schools withdrew at short notice and were replaced by others in the district."],
    "de": ["Die Erhebung fand in vielen Schulen statt und dauerte bis zum Herbst.", "Weitere Angaben stehen im technischen Anhang des Berichts.", "Einige Schulen konnten kurzfristig nicht an der Untersuchung teilnehmen."],
    "fr": ["Certains établissements n'ont pas pu participer à l'enquête.", "Ce chapitre présente les résultats et résume les principaux constats.", "Les écoles ont été tirées avec une probabilité proportionnelle à leur taille."],
    "es": ["Este capítulo presenta los resultados y resume los hallazgos principales.", "Los centros se eligieron con una probabilidad proporcional a su tamaño.", "Hay más detalles en el anexo técnico de la encuesta."],
    "pt": ["Este capítulo apresenta os resultados e resume as principais conclusões.", "As escolas foram sorteadas com uma probabilidade proporcional ao seu tamanho.", "Há mais informações no anexo técnico da pesquisa."],
    "tr": ["Bazı okullar çalışmaya kısa sürede katılamamıştır.", "Daha fazla bilgi raporun teknik ekinde bulunmaktadır.", "Okullar büyüklükleriyle orantılı bir olasılıkla seçilmiştir."],
}
SAMPLES = [(t, lang) for lang, ts in TEXTS.items() for t in ts for _ in range(3)] + [(TEXTS["en"][0], "fr"), (TEXTS["de"][0], "tr")]


def decider():
    return L.Decider(L.train(SAMPLES))


def test_held_out_accuracy(spark, sf):
    """Trained on the labels of one half of the declared texts, decided on the other half."""
    import duckdb

    rows = duckdb.sql(f"select text, lang from '{sf}/../sf0.01/documents.parquet' where text is not null and lang in ('en','de','fr','es','pt','tr') order by doc_id").fetchall()
    d = L.Decider(L.train([(t, lang) for t, lang in rows[::2]]))
    found = L.segments_of([t for t, _ in rows[1::2]], [False] * len(rows[1::2]), d)
    right = sum(s[0][0] == lang for s, (_, lang) in zip(found, rows[1::2], strict=True) if s)
    assert right / len(found) > 0.9  # about one label in twenty is wrong


def test_segments_and_wrong_labels_in_the_sample():
    d = decider()
    text = " ".join([TEXTS["en"][0], TEXTS["en"][1], TEXTS["de"][1], TEXTS["en"][2]])
    assert [x[0] for x in L.segments_of([text], [False], d)[0]] == ["en", "de", "en"]
    assert [x[0] for x in L.segments_of([TEXTS["en"][0] + "\n\n" + TEXTS["tr"][1]], [False], d)[0]] == ["en", "tr"]
    assert [x[0] for x in L.segments_of(["Die Schulen des Landes im Herbst = The schools of the country in the district"], [True], d)[0]] == ["de", "en"]
    assert all(0 < c < 1 for _, c in L.segments_of([text], [False], d)[0])


def test_edge_cases(spark):
    rows = [("f", k, lang, t, False) for k, (t, lang) in enumerate(SAMPLES * 2)]
    rows += [("f", 900, None, None, False), ("f", 901, "en", "", False), ("f", 902, "en", "N/A", True), ("f", 903, "en", "12 34 !", False), ("f", 904, " EN ", TEXTS["en"][0], False), ("f", 905, "und", TEXTS["fr"][0], False), ("f", 906, "en", (TEXTS["en"][0] + " ") * 3000, False)]
    df = spark.createDataFrame(rows, "field_name string, row_id long, label string, text string, is_title boolean").withColumnRenamed("x", "x")
    got = {r["row_id"]: r for r in L.segments(df).collect() if r["row_id"] >= 900}
    assert sorted(got) == [904, 905, 906] and not got[904]["is_case"] and got[905]["is_case"] and got[905]["lang"] == "fr" and not got[906]["is_case"]
    assert L.segments(df.limit(0)).count() == 0


def test_other_languages_are_told_apart():
    d = decider()
    other = ["Questa relazione descrive i risultati degli alunni nelle scuole del paese durante l'anno", "De leerlingen van de basisschool hebben vorig jaar meer gelezen dan in het jaar daarvoor", "Ученики начальной школы читали больше чем в прошлом году"]
    assert [L.segments_of([t], [False], d)[0] for t in other] == [[("und", 0.5)]] * 3
    mixed = TEXTS["en"][0] + " " + other[1] + ". " + TEXTS["en"][2]
    assert [x[0] for x in L.segments_of([mixed], [False], d)[0]] == ["en", "und", "en"]


def test_confidence_is_a_probability():
    slope, offset = L._calibrated([0.1] * 50 + [1.5] * 50, [True, False] * 25 + [True] * 50)
    p = lambda m: 1 / (1 + 2.718281828 ** -(slope * m + offset))
    assert abs(p(0.1) - 0.5) < 0.05 and p(1.5) > 0.95
