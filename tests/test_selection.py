from edumill.operators.selection import first_column, replicate_columns, skip_reasons, where_equal


def test_columns_chosen_when_the_plan_is_built(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "W_R10 int, W_R2 int, w_r001 int, W_RX int, escs int")
    assert replicate_columns(df, "W_R") == ["w_r001"] and replicate_columns(df.drop("w_r001"), "W_R") == ["W_R2", "W_R10"] and replicate_columns(df, "Z") == []
    assert first_column(df, "HISEI", "ESCS") == "escs" and first_column(df, "none") is None


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    assert [r["k"] for r in where_equal(df, k=["a", "b"], v=2).collect()] == ["b"] and where_equal(df, k=None).count() == 3


def test_skip_ladder(spark):
    new = spark.createDataFrame([("7. A.pdf",), ("B.pdf",), ("3. c d.pdf",), ("E.pdf",), ("e.PDF",), ("F.pdf",), (None,)], "file_name string")
    done = spark.createDataFrame([("B.pdf",), ("C-D.pdf",)], "file_name string")
    got = {r["file_name"]: r["reason"] for r in skip_reasons(new, done, [7]).collect()}
    assert got == {"7. A.pdf": "number excluded", "B.pdf": "output exists", "3. c d.pdf": "stem match", "E.pdf": None, "e.PDF": "duplicate stem", "F.pdf": None, None: None}
