"""A batch monitor as a stream: status counts per window, repeated events dropped, rolling rate of the last ones.

The batch forms are the definition; the streaming forms give the same rows once the watermark has passed. State is
bounded: duplicates are remembered for the watermark, the rate keeps the times of the last LAST events per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LAST = 20


def window_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of distinct events."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def counted_stream(stream: DataFrame, late: str = "2 days", size: str = "1 day") -> DataFrame:
    return window_counts(stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), size)


def rolling_rate(events: DataFrame, key: str = "event_type", last: int = LAST) -> DataFrame:
    """(key, n_last, per_hour): the rate over the last events of each key."""
    # the rows that count are bounded by key x last; each task prunes before the shuffle
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    top = events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9
    return top.groupBy(key).agg(F.count("*").alias("n_last"), F.try_divide(F.count("*") - 1, hours).alias("per_hour"))


def rate_states(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Stateful form of rolling_rate for applyInPandasWithState: state holds the last event times in seconds."""
    times = list(state.get[0]) if state.exists else []
    for batch in batches:
        times += batch["ts"].astype("int64").div(1e9 if str(batch["ts"].dtype) == "datetime64[ns]" else 1e6).tolist()
    times = sorted(times)[-LAST:]
    state.update((times,))
    hours = (times[-1] - times[0]) / 3600 if len(times) > 1 else 0.0
    yield pd.DataFrame({"event_type": [key[0]], "n_last": [len(times)], "per_hour": [(len(times) - 1) / hours if hours else float("nan")]})


def rate_stream(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").applyInPandasWithState(rate_states, "event_type string, n_last long, per_hour double", "times array<double>", "update", "NoTimeout")


def run_once(spark: SparkSession, stream: DataFrame, mode: str, path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and give its result, written batch by batch as Parquet under path.

    Every batch goes to its own folder, so a batch that is run again after a failure replaces its own rows. In append
    mode all batches are the result, in complete mode the last one, in update mode the last row of each key.
    """
    fields = stream.schema

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={no}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    files = path.rstrip("/")
    if not _exists(spark, files):
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(StructType([*fields.fields, StructField("batch", LongType())])).option("basePath", files).parquet(files)
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    elif mode == "update":
        rest = [f.name for f in fields if f.name not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return rows.select(*fields.names)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def progress(lines: DataFrame) -> DataFrame:
    """Counts since the last START of a batch log (ts, status, body, key): status, n of distinct keys, last_ts."""
    start = lines.where("status = 'START'").agg(F.max("ts")).scalar()
    return lines.where(F.col("ts") >= start).groupBy("status").agg(F.countDistinct("key").alias("n"), F.max("ts").alias("last_ts"))
