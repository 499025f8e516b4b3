"""Session helpers: table loading, shared intermediate tables, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows a side may have to be broadcast; rows here are short.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if the driver is the only
    process (local mode, as in tests), else an error: other machines could not read it."""
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="edumill-")
    if not set_.isDefined():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path for a table of this application in the shared folder."""
    return f"{shared_dir(spark)}/edumill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df only after counting it (reads at most rows + 1 rows); beyond the bound it is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remove_stages(spark: SparkSession) -> None:
    """Remove the staged tables of this application; for the end of a job, when no result is read any more."""
    jvm, path = spark._jvm, f"{shared_dir(spark)}/edumill/{spark.sparkContext.applicationId}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
