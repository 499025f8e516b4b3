import json

from pyspark.sql import functions as F

from edumill.sources import readers, sinks
from edumill.streaming import monitor


def test_record_files_with_status(spark, tmp_path):
    (tmp_path / "IEA" / "a").mkdir(parents=True)
    (tmp_path / "IEA" / "a" / "one.json").write_text(json.dumps({"metadata": {"title": "T"}, "data": {"outcome_summary": "x"}}))
    (tmp_path / "IEA" / "two.json").write_text("{broken")
    (tmp_path / "three.json").write_text('{"other": 1}')
    df = readers.article_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["r"] and r["r"]["metadata"]["title"]) for r in df.collect()}
    assert got == {"one.json": ("ok", "T"), "two.json": ("unreadable", None), "three.json": ("no article", None)}
    corpora = {r[0] for r in df.select(readers.corpus_of(F.col("path"), str(tmp_path))).collect()}
    assert corpora == {"IEA", "three.json"}


def test_files_of_one_country_each(spark, tmp_path):
    for code, rows in (("abcfin01", [(1.0, 2.0)]), ("abcswe01", [(3.0, None), (4.0, 5.0)])):
        spark.createDataFrame(rows, "PV1 double, w double").toPandas().to_parquet(tmp_path / f"{code}.parquet")
    got = sorted(tuple(r) for r in readers.by_country_files(spark, str(tmp_path), ["pv1", "W", "missing"]).collect())
    assert [r[0] for r in got] == ["FIN", "SWE", "SWE"] and got[0] == ("FIN", 1.0, 2.0, None)
    assert {r["path"].rsplit("/", 1)[1] for r in readers.listing(spark, str(tmp_path)).collect()} == {"abcfin01.parquet", "abcswe01.parquet"}


def test_fixed_width_missing_values(spark, tmp_path):
    lines = ["FIN    1.5   500", "FIN    2.0   995", "12A    1.0   100", "SWE    0.0   100", "SWE    bad   100"]
    (tmp_path / "x.txt").write_text("\n".join(lines))
    df = readers.fixed_width(spark, str(tmp_path / "x.txt"), {"country": (1, 3, "text"), "weight": (4, 7, "weight"), "v": (11, 6, "number")})
    got = readers.survey_lines(df, least=1, values=("v",)).collect()
    assert [(r["country"], r["n"], r["v"]) for r in got] == [("FIN", 2, 500.0)]


def test_sinks(spark):
    df = spark.createDataFrame([(1, ("a", 2), ["x\x01", "y"])], "k int, s struct<p string, q int>, l array<string>")
    assert sinks.flattened(df).columns == ["k", "s__p", "s__q", "l"]
    assert sinks.publishable(df).first()["l"] == '["x\\u0001","y"]'
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "o"), (2, "n"), (3, "n")]


def test_stream_equals_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    late = monitor.run_once(spark, monitor.counted_stream(stream, late="400 days"), "complete", str(tmp_path / "out"), str(tmp_path / "state"))
    batch = monitor.window_counts(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(late) == key(batch)


def test_streams_of_several_batches_keep_one_row_per_key(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = monitor.run_once(spark, read().groupBy("event_type").agg(F.count("*").alias("n")), "update", str(tmp_path / "o1"), str(tmp_path / "c1"), ["event_type"])
    assert {(r["event_type"], r["n"]) for r in counts.collect()} == {(r["event_type"], r["count"]) for r in events.groupBy("event_type").count().collect()}
    once = monitor.run_once(spark, read().select("event_id"), "append", str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert once.count() == events.count()
    whole = monitor.run_once(spark, read().groupBy("event_type").agg(F.count("*").alias("n")), "complete", str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert sum(r["n"] for r in whole.collect()) == events.count()


def test_vector_index_is_replaced_by_version(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *ks: spark.createDataFrame([(k, [float(k), v]) for k, v in ks], "id long, vector array<double>")
    assert sinks.vector_manifest(spark, path) is None
    sinks.upsert_vectors(path, rows((1, 0.0), (2, 0.0)), "id", "vector", 2)
    index = sinks.upsert_vectors(path, rows((2, 5.0), (3, 5.0)), "id", "vector", 2)
    assert sorted((r["id"], r["vector"][1]) for r in index.collect()) == [(1, 0.0), (2, 5.0), (3, 5.0)]
    assert sinks.vector_manifest(spark, path) == {"version": 2, "n_vectors": 3, "dimension": 2, "n_buckets": 2}


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    import pytest
    from edumill.session import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_log_lines(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05 | OK | a.pdf (12 s)",), ("noise",), (None,), ("2024-01-02 03:04:06 | START | queue=2",)], "value string")
    got = readers.log_lines(df).collect()
    assert [(r["status"], r["key"]) for r in got] == [("OK", "OK|a.pdf"), ("START", "START|queue=2")]
    assert {r["status"] for r in monitor.progress(readers.log_lines(df)).collect()} == {"START"}
