"""Sources: nested JSON, fixed-width and delimited text, binary files, log lines, and file listings for the catalogue."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import RECORD


def with_status(raw: DataFrame) -> DataFrame:
    """(path, status, r) of rows (path, value): ok, unreadable, or no article."""
    parsed = raw.withColumn("v", F.try_parse_json("value")).withColumn("r", F.from_json("value", RECORD))
    status = F.when(F.col("v").isNull(), "unreadable").when(F.col("r.metadata").isNull() | F.col("r.data").isNull(), "no article").otherwise("ok")
    return parsed.select("path", status.alias("status"), F.when(status == "ok", F.col("r")).alias("r"))


def article_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status, r) of all JSON files below a folder; one record per file."""
    return with_status(spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), "value"))


def article_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same for files of one record per line."""
    return with_status(spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), "value"))


def corpus_of(path: Column, root: str) -> Column:
    """First part of a path below the root."""
    return F.element_at(F.split(F.substring_index(path, root.rstrip("/") + "/", -1), "/"), 1)


def fixed_width(spark: SparkSession, path: str, fields: dict[str, tuple[int, int, str]], missing_from: float = 990) -> DataFrame:
    """Fields by (1-based start, length, kind text or number); numbers of missing_from or more in size are null."""
    number = lambda c: F.when(F.abs(c) < missing_from, c)
    cols = []
    for name, (start, length, kind) in fields.items():
        c = F.trim(F.substring("value", start, length))
        cols.append((number(c.try_cast("double")) if kind == "number" else c if kind == "text" else c.try_cast("double")).alias(name))
    return spark.read.text(path).select(*cols)


def survey_lines(df: DataFrame, country: str = "country", weight: str = "weight", least: int = 10, values: tuple[str, ...] = ()) -> DataFrame:
    """Weighted means per country of rows with a letter code and a usable weight; small groups are left out."""
    ok = df.where(F.col(country).rlike(r"^\p{L}+$") & (F.col(weight) > 0) & (F.col(weight) < 999_990))
    aggs = [F.try_divide(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * F.col(weight))), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v) for v in values]
    return ok.groupBy(country).agg(F.count("*").alias("n"), *aggs).where(F.col("n") >= least)


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header; names in upper case, of equal names the first column stays."""
    df = spark.read.csv(path, sep=sep, header=True)
    seen: set[str] = set()
    keep = []
    for i, name in enumerate(df.columns):
        upper = name.upper().strip()
        base = upper.rstrip("0123456789") if upper.endswith(str(i)) else upper
        if base not in seen and upper not in seen:
            keep.append((name, upper))
            seen |= {upper}
    return df.select(*[F.col(f"`{n}`").alias(u) for n, u in keep])


def normalised(df: DataFrame, upper: tuple[str, ...] = (), lower: tuple[str, ...] = (), whole: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Text columns trimmed, some in upper or lower case, some as whole numbers or numbers (null where they are none)."""
    out = []
    for name, kind in df.dtypes:
        c = F.trim(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")
        c = F.upper(c) if name in upper else F.lower(c) if name in lower else c
        c = c.try_cast("double").cast("long") if name in whole else c.try_cast("double") if name in numbers else c
        out.append(c.alias(name))
    return df.select(*out)


def international_file(df: DataFrame, country: str, values: list[str], weight: str) -> DataFrame:
    """Weighted means per country of one file with a country column; only letter codes of three signs count."""
    ok = df.where(F.upper(F.col(country)).rlike("^[A-Z]{3}$") & (F.col(weight) > 0))
    means = [F.try_divide(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * F.col(weight))), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v) for v in values]
    return ok.groupBy(F.upper(F.col(country)).alias("country")).agg(F.count("*").alias("n"), *means)


def by_country_files(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Parquet files of one country each, named xxxCCC..., read by name into one table with the column country."""
    df = spark.read.option("mergeSchema", True).parquet(folder)
    have = {c.upper(): c for c in reversed(df.columns)}
    cols = [F.col(have[c.upper()]).alias(c) if c.upper() in have else F.lit(None).cast("double").alias(c) for c in columns]
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select(F.upper(F.substring(name, 4, 3)).alias("country"), *cols)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of the files below a folder, contents not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def catalog(spark: SparkSession, folder: str, tables: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, variables) of Parquet tables from their footers: rows, columns, types; data pages are not read."""
    files, variables = [], []
    for t in tables:
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        files.append((t, df.count(), len(df.columns)))
        variables += [(t, i, n, k) for i, (n, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(files, "file string, n_rows bigint, n_columns int"), spark.createDataFrame(variables, "file string, position int, name string, type string")


def first_existing(paths: list[str]) -> str:
    """The first path that is there, decided when the plan is built."""
    return next((p for p in paths if os.path.exists(p)), paths[-1])


#: fixed value: how a line of the batch log is written
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+) \| (.*)$"


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ts, status, body, key) of log lines; other lines are left out."""
    part = lambda i: F.regexp_extract(column, LOG_LINE, i)
    body = part(3)
    return lines.where(F.col(column).rlike(LOG_LINE)).select(F.to_timestamp(part(1)).alias("ts"), part(2).alias("status"), body.alias("body"), F.concat_ws("|", part(2), F.regexp_replace(body, r"\s+\(.*\)$", "")).alias("key"))
