"""Sinks: record files, flat and published Parquet, ordinal tables, keyed replacement, evidence bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_control


def write_records(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON records; a status column says which failed, no sentinel text is written."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Structs of the first level as section__field columns."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}__{g.name}") for g in f.dataType.fields]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def publishable(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, texts without control characters."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.to_json(c) if kind.startswith(("array", "map", "struct")) else strip_control(c) if kind == "string" else c).alias(name))
    return df.select(*out)


def publish(df: DataFrame, path: str) -> None:
    publishable(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def ordinal_table(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, ordinal, value) of an array column."""
    return df.select(key, F.posexplode(array).alias("ordinal", "value"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_vectors(path: str, new: DataFrame, key: str, vector: str, buckets: int = 16) -> DataFrame:
    """Write rows (key, vector, ...) into the vector index under path, replacing those of equal keys; gives the index.

    Every call writes a new version beside the old one and then a manifest of one row (version, n_vectors, dimension,
    n_buckets), so a call that fails leaves the index as it was. Rows are spread over buckets by their key.
    """
    spark = new.sparkSession
    known = vector_manifest(spark, path)
    version = 1 if known is None else known["version"] + 1
    rows = new.dropDuplicates([key]) if known is None else upsert(spark.read.parquet(f"{path}/v{known['version']}"), new.dropDuplicates([key]), [key])
    rows.repartition(buckets, key).write.parquet(f"{path}/v{version}")
    index = spark.read.parquet(f"{path}/v{version}")
    index.agg(F.lit(version).alias("version"), F.count("*").alias("n_vectors"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimension"), F.lit(buckets).alias("n_buckets")).coalesce(1).write.json(f"{path}/manifest-{version:06d}")
    return index


def vector_manifest(spark: SparkSession, path: str) -> dict | None:
    """The last manifest of a vector index, or None where there is no index."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [n for s in fs.listStatus(where) if (n := s.getPath().getName()).startswith("manifest-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))] if fs.exists(where) else []
    return spark.read.json(f"{path}/{max(done)}").first().asDict() if done else None


def write_catalog(files: DataFrame, variables: DataFrame, path: str) -> None:
    """The catalogue's two tables as Parquet."""
    files.write.mode("overwrite").parquet(f"{path}/files")
    variables.write.mode("overwrite").parquet(f"{path}/variables")


def catalog_view(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, n_columns, n_text): the view of a written catalogue, the variables counted before they are joined."""
    v = spark.read.parquet(f"{path}/variables").groupBy("file").agg(F.count("*").alias("n_columns"), F.sum((F.col("type") == "string").cast("long")).alias("n_text"))
    return spark.read.parquet(f"{path}/files").select("file", "n_rows").join(v, "file", "left")


def bundle_id(*parts: str):
    """Sixteen letters of the hash of an evidence bundle."""
    return F.left(F.sha2(F.concat_ws("::", *[F.col(p).cast("string") for p in parts]), 256), F.lit(16))
