"""Queries that write and read files in the shared folder, the catalogue, and the streaming monitor."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import readers, sinks
from ..session import staged_path, table
from ..streaming import monitor
from .base import Book, r6

BOOK = Book()


def _place(spark, label):
    return staged_path(spark, label)


@BOOK.query("s01_json_files", "select case when payload is null then 'null' when not json_valid(payload) then 'bad' else 'good' end kind, count(*) n from article_records group by 1")
def s01(spark, d):
    """Payloads written as text lines and read again as JSON records, the unreadable ones kept apart."""
    a = table(spark, d, "article_records")
    place = _place(spark, "json")
    a.where("payload is not null").select(F.regexp_replace("payload", r"[\r\n]+", " ").alias("value")).write.text(place)
    back = spark.read.text(place).select(F.when(F.try_parse_json("value").isNotNull() & ~F.col("value").startswith("﻿"), "good").otherwise("bad").alias("kind"))
    return back.unionByName(a.where("payload is null").select(F.lit("null").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@BOOK.query("s10_csv_round_trip", "select p_brand, count(*) n, round(sum(p_retailprice),2) total from part group by 1")
def s10(spark, d):
    place = _place(spark, "csv")
    table(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("price")).write.option("header", True).option("sep", ";").csv(place)
    return readers.delimited(spark, place, ";").groupBy(F.col("P_BRAND").alias("p_brand")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("PRICE").cast("double")), 2).alias("total"))


@BOOK.query("s11_fixed_width", "select country, n, round(v,4) v from (select chr(65+c_nationkey::int)||'AA' country, count(*) n, sum((c_custkey%100)*(1+c_custkey%7))/sum(1+c_custkey%7) v from customer group by 1) where n>=10")
def s11(spark, d):
    place = _place(spark, "fwf")
    c = table(spark, d, "customer")
    line = F.concat(F.expr("char(65 + c_nationkey)"), F.lit("AA"), F.lpad((1 + F.col("c_custkey") % 7).cast("string"), 8, " "), F.lpad((F.col("c_custkey") % 100).cast("string"), 6, " "))
    c.select(line.alias("value")).write.text(place)
    df = readers.fixed_width(spark, place, {"country": (1, 3, "text"), "weight": (4, 8, "weight"), "v": (12, 6, "number")})
    return readers.survey_lines(df, values=("v",)).select("country", "n", F.round("v", 4).alias("v"))


@BOOK.query("s08_files_by_country", "select 'N'||lpad(s_nationkey::varchar,2,'0') country, count(*) n, round(avg(s_acctbal),4) bal from supplier group by 1")
def s08(spark, d):
    """One folder of Parquet files per country, read into one table with the country from the path."""
    j = table(spark, d, "supplier").select(F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("country"), "s_acctbal")
    place = _place(spark, "countries")
    j.write.partitionBy("country").parquet(place)
    return spark.read.parquet(place).groupBy(F.col("country").cast("string").alias("country")).agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("bal"))


@BOOK.query("k02_flattened", "select count(*) n, count(distinct record_id) n_records, 10 n_columns from (select record_id from article_records where json_valid(payload) and json_type(payload::json)='OBJECT' and json_type(payload::json,'$.metadata')='OBJECT' and json_type(payload::json,'$.data')='OBJECT')")
def k02(spark, d):
    r = R.parsed(table(spark, d, "article_records").select("record_id", "payload")).select("record_id", F.col("r.metadata").alias("metadata"))
    place = _place(spark, "flat")
    sinks.flattened(r).write.parquet(place)
    back = spark.read.parquet(place)
    return back.agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records")).withColumn("n_columns", F.lit(len(back.columns)))


@BOOK.query("k03_ordinal_table", "select row_id, (i-1)::int ordinal, string_split(authors,'; ')[i] \"value\" from metadata, unnest(range(1, len(string_split(authors,'; '))+1)) t(i) where authors is not null")
def k03(spark, d):
    m = table(spark, d, "metadata").where("authors is not null").select("row_id", F.split("authors", "; ").alias("a"))
    return sinks.ordinal_table(m, "row_id", "a")


@BOOK.query("k07_published", "select count(*) n, sum(length(embedding_json)>2)::bigint n_json from (select to_json(embedding)::varchar embedding_json from embeddings)")
def k07(spark, d):
    place = _place(spark, "published")
    sinks.publish(table(spark, d, "embeddings"), place)
    return spark.read.parquet(place).agg(F.count("*").alias("n"), F.sum((F.length("embedding") > 2).cast("long")).alias("n_json"))


@BOOK.query("k09_bundle_id", "select row_id, left(sha256(concat_ws('::', row_id::varchar, corpus, load_no::varchar)),16) bundle from metadata")
def k09(spark, d):
    return table(spark, d, "metadata").select("row_id", sinks.bundle_id("row_id", "corpus", "load_no").alias("bundle"))


@BOOK.query("k10_keyed_replace", "select r_regionkey, r_name, 'old' source from region where r_regionkey not in (1,3) union all select * from (values (1,'NEW_1','new'),(3,'NEW_3','new'),(9,'NEW_9','new')) t")
def k10(spark, d):
    old = table(spark, d, "region").withColumn("source", F.lit("old"))
    new = spark.createDataFrame([(1, "NEW_1", "new"), (3, "NEW_3", "new"), (9, "NEW_9", "new")], "r_regionkey int, r_name string, source string")
    return sinks.upsert(old, new, ["r_regionkey"])


_PARTS = "json_type(payload::json,'$.metadata')='OBJECT' and json_type(payload::json,'$.data')='OBJECT'"
_STATUS = f"case when payload is null or not json_valid(payload) or starts_with(payload, chr(65279)) then 'unreadable' when json_type(payload::json)='OBJECT' and {_PARTS} then 'ok' else 'no article' end"


@BOOK.query("s02_record_status", f"select corpus, {_STATUS} status, count(*) n from article_records where payload is not null group by 1,2")
def s02(spark, d):
    """Records written under the folder of their corpus, then read back by folder with their status."""
    place = _place(spark, "records")
    a = table(spark, d, "article_records").where("payload is not null")
    a.select(F.coalesce("corpus", F.lit("none")).alias("corpus"), F.regexp_replace("payload", r"[\r\n]+", " ").alias("value")).write.partitionBy("corpus").text(place)
    r = readers.article_lines(spark, place)
    return r.groupBy(F.regexp_extract("path", "corpus=([^/]+)", 1).alias("corpus"), "status").agg(F.count("*").alias("n"))


@BOOK.query("k01_records_written", f"select {_STATUS} status, count(*) n, count(case when {_STATUS}='ok' then 1 end) n_titles from (select payload from article_records where payload is not null) group by 1")
def k01(spark, d):
    """Public records and failed ones written as JSON by status, and read again."""
    place = _place(spark, "public")
    a = table(spark, d, "article_records").where("payload is not null").select(F.col("payload").alias("value"), F.lit("").alias("path"))
    sinks.write_records(readers.with_status(a).select("status", "r"), place, "status")
    back = spark.read.json(place)
    return back.groupBy("status").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "ok", 1)).alias("n_titles"))


_CATALOGUED = ("metadata", "core_data", "documents", "lineitem", "events")


@BOOK.query("k08_catalog_view", "select file, n_rows, n_columns, n_text from (" + " union all ".join(f"select '{t}' file, (select count(*) from {t}) n_rows, (select count(*) from information_schema.columns where table_name='{t}') n_columns, (select count(*) from information_schema.columns where table_name='{t}' and data_type='VARCHAR') n_text" for t in _CATALOGUED) + ")")
def k08(spark, d):
    """The catalogue kept as Parquet tables, and a view that joins files and variables."""
    files, variables = readers.catalog(spark, d, list(_CATALOGUED))
    place = _place(spark, "catalogue")
    sinks.write_catalog(files, variables, place)
    return sinks.catalog_view(spark, place)


@BOOK.query("k11_vector_upsert", "select 2 as version, (select count(*) from embeddings)+1 n_vectors, (select max(len(embedding)) from embeddings)::bigint dimension, (select count(*) from embeddings) n_new")
def k11(spark, d):
    """A vector index written, then all its vectors replaced and one added."""
    place = _place(spark, "vectors")
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    sinks.upsert_vectors(place, e, "vec_id", "embedding")
    more = e.withColumn("batch", F.lit(2)).unionByName(e.agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.lit(-1).cast("long").alias("vec_id"), "embedding", F.lit(1).alias("batch")))
    index = sinks.upsert_vectors(place, more.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "batch"), "vec_id", "embedding")
    m = sinks.vector_manifest(spark, place)
    return index.agg(F.lit(m["version"]).cast("int").alias("version"), F.count("*").alias("n_vectors"), F.lit(m["dimension"]).cast("long").alias("dimension"), F.sum((F.col("batch") == 2).cast("long")).alias("n_new"))


@BOOK.query("s09_international_file", "select upper(left(n_name,3)) country, count(*) n, round(sum(c_acctbal*(1+c_custkey%7))/sum(1+c_custkey%7),4) bal from customer join nation on c_nationkey=n_nationkey where regexp_full_match(upper(left(n_name,3)),'[A-Z]{3}') group by 1")
def s09(spark, d):
    """One file with the country as a column."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(F.left("n_name", F.lit(3)).alias("code"), "c_acctbal", (1 + F.col("c_custkey") % 7).alias("w"))
    return readers.international_file(rows, "code", ["c_acctbal"], "w").select("country", "n", F.round("c_acctbal", 4).alias("bal"))


@BOOK.query("s14_normalised_csv", "select upper(trim(p_brand)) BRAND, lower(trim(p_type)) TYPE, p_size::bigint SIZE, count(*) n from part group by 1,2,3")
def s14(spark, d):
    """A CSV read, trimmed and coerced."""
    place = _place(spark, "norm")
    p = table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_brand"), F.lit("  ")).alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size"))
    p.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    df = readers.normalised(readers.delimited(spark, place), upper=("BRAND",), lower=("TYPE",), whole=("SIZE",))
    return df.groupBy("BRAND", "TYPE", "SIZE").agg(F.count("*").alias("n"))


@BOOK.query("s12_catalog_files", " union all ".join(f"select '{t}' file, (select count(*) from {t}) n_rows, (select count(*)::int from information_schema.columns where table_name='{t}') n_columns" for t in ("metadata", "core_data", "documents", "lineitem")))
def s12(spark, d):
    return readers.catalog(spark, d, ["metadata", "core_data", "documents", "lineitem"])[0]


@BOOK.query("s17_catalog_lookup", "select file, n_rows from (values ('orders',(select count(*) from orders)),('lineitem',(select count(*) from lineitem)),('customer',(select count(*) from customer))) t(file,n_rows) order by n_rows desc, file limit 1")
def s17(spark, d):
    """Largest file of a set, as a claim without a file id finds its data."""
    return readers.catalog(spark, d, ["orders", "lineitem", "customer"])[0].orderBy(F.desc("n_rows"), "file").limit(1).select("file", "n_rows")


_LINE = "strftime(ts,'%Y-%m-%d %H:%M:%S')"


@BOOK.query("s16_log_lines", "select event_type status, count(*) n, count(distinct user_id) n_keys from events group by 1")
def s16(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", F.concat(F.lit("user "), F.col("user_id"), F.lit(" (done)"))).alias("value")).unionByName(e.select(F.concat(F.lit("--- noise "), F.col("event_id")).alias("value")))
    return readers.log_lines(lines).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@BOOK.query("z01_window_counts", "select date_trunc('day', ts) window_start, event_type, count(*) n, round(sum(\"value\"),4) total from events group by 1,2")
def z01(spark, d):
    return monitor.window_counts(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@BOOK.query("z02_rolling_rate", "with t as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) r from events) select event_type, count(*) n_last, round((count(*)-1)/((epoch_us(max(ts))-epoch_us(min(ts)))/3.6e9),6) per_hour from t where r<=20 group by 1")
def z02(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.rolling_rate(e).select("event_type", "n_last", r6("per_hour").alias("per_hour"))


@BOOK.query("z03_progress", "with e as (select ts, case when event_type='signup' then 'START' else event_type end status, user_id::varchar key from events), s as (select max(ts) t from e where status='START') select status, count(distinct key) n from e, s where ts>=t group by 1")
def z03(spark, d):
    e = table(spark, d, "events").select("ts", F.when(F.col("event_type") == "signup", "START").otherwise(F.col("event_type")).alias("status"), F.col("user_id").cast("string").alias("key"))
    return monitor.progress(e).select("status", "n")


def _events_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@BOOK.query("z04_stream_counts", "select date_trunc('day', ts) window_start, event_type, count(*) n from events group by 1,2")
def z04(spark, d):
    """The window counts computed by a stream over the same file, in complete mode, repeats within the watermark dropped."""
    counts = monitor.counted_stream(_events_stream(spark, d))
    out = monitor.run_once(spark, counts, "complete", _place(spark, "counts"), _place(spark, "stream"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@BOOK.query("z05_stream_rate", BOOK.sql["z02_rolling_rate"])
def z05(spark, d):
    """The rolling rate kept as state by a stream over the same file."""
    rates = monitor.rate_stream(_events_stream(spark, d).select("ts", "event_type"))
    out = monitor.run_once(spark, rates, "update", _place(spark, "rates"), _place(spark, "stream"), ["event_type"])
    return out.select("event_type", "n_last", r6("per_hour").alias("per_hour"))


@BOOK.query("z06_stream_deduplicated", "select count(*) n from (select distinct event_id from events)")
def z06(spark, d):
    """Distinct events of a stream, repeats within the watermark dropped."""
    once = _events_stream(spark, d).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id")
    return monitor.run_once(spark, once, "append", _place(spark, "once"), _place(spark, "stream")).agg(F.count("*").alias("n"))
