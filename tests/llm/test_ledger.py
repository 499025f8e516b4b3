import datetime as dt
import json

import pytest
from edumill.llm import ledger as L
from edumill.llm.ledger import Ledger, canonical_key, collapsed, ledger_of
from pyspark.sql import functions as F

SCHEMA = "block_id long, batch string, received_at timestamp_ntz, file_name string, doi string, block string, n_copies string"


def block(title="A Title", **more):
    return json.dumps({"title": title, "authors": "Ana Bel", "year": 2001, "venue": "Review", "publication_type": "report"} | more)


def frame(spark, rows):
    return spark.createDataFrame([(i, b, dt.datetime(2021, 1, 1) - dt.timedelta(days=i), f, d, t, "x") for i, b, f, d, t in rows], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in collapsed(df).collect())


def test_forms_nulls_and_order(spark):
    turned = json.dumps(dict(reversed(list((json.loads(block()) | {"year": "2001", "title": " a_TITLE."}).items()))))
    rows = [(5, "b1", "x-1.pdf", "10.1/a", block()), (3, "b2", "X 1 PDF", "10.1/A;", turned), (9, "b3", "x1.pdf", "10.1/a", block()), (1, "b1", "x1.pdf", None, block()), (2, "b2", "x1.pdf", "", block()), (4, "b1", "x1.pdf", None, block()), (7, "b1", "x1.pdf", "10.1/a", block("A Title 2")), (8, "b3", None, None, "{broken"), (10, "b3", None, None, "{Broken;"), (11, "b3", None, None, None), (12, None, None, None, None)]
    assert found(frame(spark, rows)) == [(1, 2), (3, 3), (8, 2), (11, 2)]
    assert found(frame(spark, rows).limit(0)) == []


def test_increments_equal_one_count(spark):
    rows = [(k, f"b{k % 7}", f"f{k % 5}.pdf", None, block(f"T{k % 11}")) for k in range(200)] + [(1000 + k, "b9", "hot.pdf", None, block("hot" * 3000)) for k in range(100)]
    df = frame(spark, rows)
    for n in (1, 3, 9):
        got = {(r["n_copies"], r["first_id"], r["first_at"]) for r in ledger_of(df, n).read().collect()}
        if n == 1:
            want = got
        assert got == want
    assert sum(r[0] for r in want) == 300 and max(want)[0] == 100


def keyed(spark, rows):
    return frame(spark, rows).select(F.col("block_id").alias("id"), F.col("received_at").alias("at"), canonical_key(F.col("file_name"), F.col("doi"), F.col("block")).alias("key"))


def test_additions_are_merged_by_bucket(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=8)
    ledger.add(keyed(spark, [(k, "b", f"f{k}", None, block()) for k in range(80)]))
    before = dict(ledger.state["base"])
    ledger.add(keyed(spark, [(99, "b", "f3", None, block())]))
    assert ledger.state["base"] == before and sum(map(len, ledger.state["added"].values())) == 1  # small: only put beside its bucket
    ledger.add(keyed(spark, [(200 + k, "b", f"f{3 if k % 2 else k + 500}", None, block()) for k in range(60)]))
    assert ledger.state["base"] != before
    ledger.add(keyed(spark, [(99, "b", "f3", None, block())]).limit(0))
    got = ledger.read().collect()
    assert sum(r["n_copies"] for r in got) == 141 and [(r["first_id"], r["n_copies"]) for r in got if r["n_copies"] > 1] == [(3, 32)]


def test_ledger_is_opened_again_and_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_KEYS", 10)
    rows = lambda n: [(k, "b", f"f{k}", None, block()) for k in range(n)]
    Ledger(spark, str(tmp_path), buckets=2).add(keyed(spark, rows(50)), "monday")
    again = Ledger(spark, str(tmp_path))
    assert again.state["buckets"] > 2 and again.state["names"] == ["monday"] and again.read().count() == 50
    again.add(keyed(spark, rows(50)), "monday")  # delivered twice, counted once
    again.add(keyed(spark, rows(70)), "tuesday")
    other = Ledger(spark, str(tmp_path)).read()
    assert {(r["n_copies"], r["n"]) for r in other.groupBy("n_copies").agg(F.count("*").alias("n")).collect()} == {(2, 50), (1, 20)}


def test_two_writers_do_not_mix(spark, tmp_path):
    one, two = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    one.add(keyed(spark, [(1, "b", "f1", None, block())]))
    with pytest.raises(RuntimeError):
        two.add(keyed(spark, [(2, "b", "f2", None, block())]))
    assert [r["first_id"] for r in Ledger(spark, str(tmp_path)).read().collect()] == [1]
