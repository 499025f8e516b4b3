"""Duplicates hidden by formatting differences (problem 5): an incremental ledger of canonical-key counts.

Every row gets a canonical key: file name, DOI and the five fields of its block, each reduced to its letters and
digits in lower case, in a fixed order. The ledger holds, per key, the number of copies and the earliest
representative, stored by bucket of the key. A new batch is first aggregated by key (map-side combine, so a key with a
third of all rows shuffles one row per task) and kept as a small addition beside the buckets. A bucket whose additions
have grown to MERGE_SHARE of it is full-outer-joined with them: counts are added and the earliest representative is
retained. The other buckets are not read or written, so what a batch writes is in proportion to the batch.

The ledger is durable: a numbered manifest in its folder lists buckets, additions and the names of the batches they
hold. It is written last, so a batch that failed half-way leaves the ledger as it was, a ledger can be opened again by
its path, and a batch of a name that is already in it is not counted twice. The number of buckets is doubled whenever a
bucket would hold more than BUCKET_KEYS keys.

Defined results: null equals null only and differs from a blank text; a block that is not a JSON object is compared by
the letters and digits of its raw text; rows without an id cannot represent a group but are counted; very long texts
count whole; an empty batch leaves the ledger as it is; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, staged_path

BLOCK_FIELDS = ("title", "authors", "year", "venue", "publication_type")
LEDGER = "key string, n_copies bigint, first_id bigint, first_at timestamp_ntz"
BUCKET_KEYS = 5_000_000
MERGE_SHARE = 0.25

def bare(column: Column) -> Column:
    """Letters and digits in lower case; the dotless and the dotted i of Turkish fold to i, as capitals hide them."""
    return F.regexp_replace(F.translate(F.lower(column), "ı̇", "i"), r"[^\p{L}\p{N}]", "")


def canonical_key(file_name: Column, doi: Column, block: Column) -> Column:
    schema = ", ".join(f"{f} string" for f in BLOCK_FIELDS) + ", _bad string"
    parsed = F.from_json(block, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parts = [bare(file_name), bare(doi), *[bare(parsed[f]) for f in BLOCK_FIELDS], bare(parsed["_bad"])]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts]), 256)


class Ledger:
    """Counts per canonical key in bucketed files under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._load() or {"version": 0, "buckets": buckets, "base": {}, "added": {}, "names": []}

    # The manifest: base maps a bucket to [path, keys], added to a list of such pairs

    def _load(self) -> dict | None:
        folder = self._hadoop.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        last = max((n for n in names if n.startswith("manifest-")), default=None)
        if last is None:
            return None
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/{last}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        draft, final = self._hadoop.Path(f"{self.path}/draft-{uuid.uuid4().hex}"), self._hadoop.Path(f"{self.path}/manifest-{state['version']:010d}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError("another writer has changed the ledger")
        self.state = state

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, list]:
        """Write rows by bucket; bucket -> [path, keys]."""
        path = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.withColumn("part", self._bucket(buckets)).write.partitionBy("part").parquet(path)
        counts = self.spark.read.schema(LEDGER + ", part int").parquet(path).groupBy("part").count().collect()
        return {str(r[0]): [f"{path}/part={r[0]}", r[1]] for r in counts}  # one row per bucket

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("n_copies").alias("n_copies"), F.min("first_id").alias("first_id"), F.min("first_at").alias("first_at"))

    def _merged(self, base: list[str], added: list[str]) -> DataFrame:
        """The rows of some buckets with their additions, by a full outer join."""
        if not added:
            return self._rows(base)
        fresh = self._rows(added) if len(added) == 1 else self._summed(self._rows(added))
        if not base:
            return fresh
        fresh = fresh.select("key", F.col("n_copies").alias("n_new"), F.col("first_id").alias("id_new"), F.col("first_at").alias("at_new"))
        return self._rows(base).join(fresh, "key", "full_outer").select(
            "key",
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n_new", F.lit(0))).alias("n_copies"),
            F.least("first_id", "id_new").alias("first_id"),
            F.least("first_at", "at_new").alias("first_at"),
        )

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """batch: key, id, at; a batch whose name is in the ledger is left out."""
        self.add_counted(batch.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("id").alias("first_id"), F.min("at").alias("first_at")), name)

    def add_counted(self, counted: DataFrame, name: str | None = None) -> None:
        """As add, for a batch that is already aggregated by key."""
        if name is not None and name in self.state["names"]:
            return
        state = json.loads(json.dumps(self.state))
        for b, part in self._write(counted.select("key", "n_copies", "first_id", "first_at"), state["buckets"]).items():
            state["added"].setdefault(b, []).append(part)
        state["names"] += [] if name is None else [name]
        grown = [b for b, parts in state["added"].items() if sum(n for _, n in parts) >= MERGE_SHARE * state["base"].get(b, [None, 0])[1]]
        fullest = max((state["base"].get(b, [None, 0])[1] + sum(n for _, n in state["added"].get(b, [])) for b in {*state["base"], *state["added"]}), default=0)
        buckets = state["buckets"]
        while fullest * state["buckets"] > BUCKET_KEYS * buckets:
            buckets *= 2
        if buckets != state["buckets"]:  # every key gets a new bucket
            grown = list({*state["base"], *state["added"]})
        first = [b for b in grown if b not in state["base"] and len(state["added"][b]) == 1] if buckets == state["buckets"] else []
        for b in first:  # the first addition of a bucket is the bucket
            state["base"][b] = state["added"].pop(b)[0]
        grown = [b for b in grown if b not in first]
        if grown:
            rows = self._merged([state["base"][b][0] for b in grown if b in state["base"]], [p for b in grown for p, _ in state["added"].get(b, [])])
            for b in grown:
                state["added"].pop(b, None)
                state["base"].pop(b, None)
            state["base"] |= self._write(rows, buckets)
            state["buckets"] = buckets
        self._commit(state)

    def read(self) -> DataFrame:
        """All keys: the buckets with their additions."""
        state = self.state
        whole = [p for b, (p, _) in state["base"].items() if b not in state["added"]]
        mixed = self._merged([p for b, (p, _) in state["base"].items() if b in state["added"]], [p for parts in state["added"].values() for p, _ in parts])
        return self._rows(whole).unionByName(mixed) if whole else mixed


def ledger_of(blocks: DataFrame, increments: int = 3, path: str | None = None) -> Ledger:
    """The ledger of metadata_blocks, its batches added in order of their names, several batches at a time.

    The rows are read once: every increment is aggregated by key in the same pass and kept apart.
    """
    ledger = Ledger(blocks.sparkSession, path or staged_path(blocks.sparkSession, "ledger"))
    # batch names: one row per delivery, not per record
    names = sorted(r[0] or "" for r in blocks.select("batch").distinct().collect())
    size = max(1, -(-len(names) // increments))
    ends = names[size::size]  # the first name of every increment but the first
    step = sum((F.when(F.coalesce("batch", F.lit("")) >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    rows = blocks.select(step.alias("step"), F.col("block_id").alias("id"), F.col("received_at").cast("timestamp_ntz").alias("at"), canonical_key(F.col("file_name"), F.col("doi"), F.col("block")).alias("key"))
    counted = stage(rows.groupBy("step", "key").agg(F.count("*").alias("n_copies"), F.min("id").alias("first_id"), F.min("at").alias("first_at")), "ledger-steps", ["step"])
    for k in range(len(ends) + 1 if names else 0):
        ledger.add_counted(counted.where(F.col("step") == k), f"step {k} of {len(ends) + 1}")
    return ledger


def collapsed(blocks: DataFrame) -> DataFrame:
    """(block_id, n_copies) of every group of two or more equal rows."""
    return ledger_of(blocks).read().where("n_copies > 1 and first_id is not null").select(F.col("first_id").alias("block_id"), F.col("n_copies").cast("int").alias("n_copies"))
