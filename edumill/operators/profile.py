"""Column-level data quality profile of tables that arrive in loads (problem 4).

Method: the profiled columns are unpivoted to (column, value, load), equal values are counted before any shuffle, and
the distinct values are range-sorted by (column, value) over all partitions. Per-partition counts give every
partition its prefix, so each partition knows the exact cumulative count of every load at each of its values. One
pass over the sorted partitions then yields exact distinct counts, exact order statistics and, by merging the
cumulative curves of consecutive loads, the exact Kolmogorov-Smirnov distance and the largest change of any value's
share. Nothing but one counter per (partition, column, load) reaches the driver; a hot value is one row per load
after the counting, so it cannot make a hot task.

Defined results: null, NaN and blank values count as null and take no part in distincts, quantiles or distances; a
load without any value has null quantiles and distances; a load is compared with the next lower load of the table;
rows without a load number form no load and are left out; an empty table gives an empty profile; extra columns are
never read; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

QUANTILES = (0.25, 0.5, 0.75)


_MOVED = 5 * 10**37


def _entry(name: str, column: Column, kind: str) -> Column:
    if kind in ("string",):
        text = F.when(~column.rlike(r"^[\s\p{Z}]*$"), column)
        return F.struct(F.lit(name).alias("column_name"), F.lit(None).cast("double").alias("num"), text.alias("str"))
    number = column.cast("double") if kind != "timestamp" else F.unix_micros(column.cast("timestamp")).cast("double") / 1e6
    # whole numbers that a double cannot tell apart keep their digits, moved up so that their text sorts by size
    moved = (column.cast("decimal(38,0)") + F.lit(str(_MOVED)).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")
    exact = F.when(F.abs(number) >= 2.0**53, moved) if kind == "whole" else F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("column_name"), F.when(~F.isnan(number), number).alias("num"), exact.alias("str"))


def value_counts(df: DataFrame, load: str, columns: dict[str, tuple[Column, str]]) -> DataFrame:
    """(column_name, num, str, load, n): how often each value of each column stands in each load; null has its own row."""
    entries = F.explode(F.array(*[_entry(name, column, kind) for name, (column, kind) in columns.items()])).alias("e")
    return df.where(F.col(load).isNotNull()).select(F.col(load).cast("long").alias("load"), entries).select("load", "e.*").groupBy("column_name", "num", "str", "load").agg(F.count("*").alias("n"))


def _ranks(n: int) -> list[tuple[str, int, float]]:
    """(statistic, 0-based rank, weight) whose weighted sum is the linearly interpolated quantile."""
    out = []
    for q in QUANTILES:
        at = q * (n - 1)
        low = int(at)
        out.append((f"q{round(q * 100)}", low, 1 - (at - low)))
        if at > low:
            out.append((f"q{round(q * 100)}", low + 1, at - low))
    return out


#: Counters (partitions x loads) that may be sent to the tasks, 8 bytes each; more loads mean fewer, longer partitions.
COUNTERS = 1_000_000
_SEP = "\x1f"


def profile(df: DataFrame, table_name: str, load: str, columns: dict[str, tuple[Column, str]], partitions: int | None = None) -> DataFrame:
    """One row per column and load; columns maps a name to (expression, kind), kind one of string, number (doubles),
    whole (integers, exact at any size), timestamp.

    Result: table_name, column_name, load_no, n_rows, n_null, n_distinct, min_value, max_value (as strings), q25, q50,
    q75 (numbers only), ks_previous, share_change_previous.
    """
    return profiles([(df, table_name, load, columns)], partitions)


def profiles(tables: list[tuple[DataFrame, str, str, dict[str, tuple[Column, str]]]], partitions: int | None = None) -> DataFrame:
    """The profiles of several tables (df, table_name, load, columns) in one pass over their counted values."""
    spark = tables[0][0].sparkSession
    counts = None
    for df, table_name, load, columns in tables:
        part = value_counts(df, load, {f"{table_name}{_SEP}{c}": v for c, v in columns.items()})
        counts = part if counts is None else counts.unionByName(part)
    counts = checkpointed(counts)
    filled = F.col("num").isNotNull() | F.col("str").isNotNull()
    per_load = counts.groupBy("column_name", "load").agg(F.sum("n").alias("n_rows"), F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("n_null"))
    loads: dict[str, list[int]] = {}  # one entry per column and load, as many as rows of the result
    for r in per_load.select("column_name", "load").collect():
        loads.setdefault(r[0], []).append(r[1])
    loads = {c: sorted(v) for c, v in loads.items()}
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(partitions, COUNTERS // max([len(v) for v in loads.values()] + [1])))
    ordered = checkpointed(counts.where(filled).repartitionByRange(partitions, "column_name", "num", "str").sortWithinPartitions("column_name", "num", "str"))

    # one counter per partition, column and load: bounded by COUNTERS and the size of the result, not by the rows
    parts = ordered.groupBy(F.spark_partition_id().alias("pid"), "column_name", "load").agg(F.sum("n").alias("n")).collect()
    prefix: dict[tuple[int, str], np.ndarray] = {}
    totals = {c: np.zeros(len(v)) for c, v in loads.items()}
    by_part: dict[tuple[int, str], dict[int, int]] = {}
    for r in parts:
        by_part.setdefault((r["pid"], r["column_name"]), {})[r["load"]] = r["n"]
    for (pid, c), per in sorted(by_part.items()):
        prefix[pid, c] = totals[c].copy()
        totals[c] = totals[c] + np.array([per.get(x, 0) for x in loads[c]])
    shared = spark.sparkContext.broadcast((loads, prefix, totals))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, prefix, totals = shared.value
        pid = TaskContext.get().partitionId()
        held, column, cum, best, out = None, None, None, {}, []

        def close() -> None:
            for (c, k), (ks, share, distinct) in best.items():
                out.append((c, loads[c][k], "partial", distinct, ks, share, None))
            best.clear()

        def take(part: pd.DataFrame) -> None:
            nonlocal column, cum
            for c, rows in part.groupby("column_name", sort=False):
                if c != column:
                    close()
                    column, cum = c, prefix[pid, c].copy()
                order, total = {x: i for i, x in enumerate(loads[c])}, totals[c]
                text = rows["str"].fillna("")
                if rows["num"].notna().any():
                    key = rows["num"].astype(str).where(text == "", text.map(lambda x: str(int(x) - _MOVED) if x else ""))
                else:
                    key = text
                code = ((key != key.shift()) | (rows["num"] != rows["num"].shift()) & rows["num"].notna()).cumsum().to_numpy() - 1
                at = rows["load"].map(order).to_numpy()
                matrix = np.zeros((code[-1] + 1, len(total)))
                np.add.at(matrix, (code, at), rows["n"].to_numpy())
                first = np.searchsorted(code, np.arange(code[-1] + 1))
                names, nums = key.to_numpy()[first], rows["num"].to_numpy()[first]
                curve = cum + np.cumsum(matrix, axis=0)
                safe = np.where(total > 0, total, 1)
                cdf, share = curve / safe, matrix / safe
                for k in range(len(total)):
                    if total[k] == 0:
                        continue
                    ks = change = None
                    if k and total[k - 1] > 0:
                        ks, change = float(np.abs(cdf[:, k] - cdf[:, k - 1]).max()), float(np.abs(share[:, k] - share[:, k - 1]).max())
                    old = best.get((c, k), (0.0, 0.0, 0))
                    best[c, k] = (max(old[0], ks) if ks is not None else None, max(old[1], change) if change is not None else None, old[2] + int((matrix[:, k] > 0).sum())) if old[0] is not None else (None, None, old[2] + int((matrix[:, k] > 0).sum()))
                    here = np.flatnonzero(matrix[:, k] > 0)
                    if len(here):
                        for stat, rank in (("min", 0), ("max", int(total[k]) - 1)):
                            if cum[k] <= rank < curve[-1, k]:
                                out.append((c, loads[c][k], stat, None, None, None, names[np.searchsorted(curve[:, k], rank, side="right")]))
                        if not np.isnan(nums[0] if nums.dtype.kind == "f" else np.nan):
                            for stat, rank, weight in _ranks(int(total[k])):
                                if cum[k] <= rank < curve[-1, k]:
                                    out.append((c, loads[c][k], stat, None, float(nums[np.searchsorted(curve[:, k], rank, side="right")]) * weight, None, None))
                cum = curve[-1]

        for batch in batches:
            if held is not None and len(held):
                batch = pd.concat([held, batch], ignore_index=True)
            # the rows of the last value may go on in the next batch
            last = batch.iloc[-1] if len(batch) else None
            same = (batch["column_name"] == last["column_name"]) & ((batch["num"] == last["num"]) | batch["num"].isna() & pd.isna(last["num"])) & ((batch["str"] == last["str"]) | batch["str"].isna() & pd.isna(last["str"])) if len(batch) else pd.Series([], dtype=bool)
            held, ready = batch[same], batch[~same]
            if len(ready):
                take(ready)
        if held is not None and len(held):
            take(held)
        close()
        yield pd.DataFrame(out, columns=["column_name", "load", "stat", "n", "x", "y", "value"]).astype({"load": "int64", "n": "Int64", "x": "float64", "y": "float64", "value": object, "column_name": object, "stat": object})

    found = ordered.select("column_name", "num", "str", "load", "n").mapInPandas(run, "column_name string, load bigint, stat string, n bigint, x double, y double, value string")
    on = lambda s, v: F.when(F.col("stat") == s, v)
    stats = found.groupBy("column_name", "load").agg(
        F.sum(on("partial", F.col("n"))).alias("n_distinct"),
        F.max(on("min", F.col("value"))).alias("min_value"),
        F.max(on("max", F.col("value"))).alias("max_value"),
        *[F.sum(on(q, F.col("x"))).alias(q) for q in dict.fromkeys(s for s, _, _ in _ranks(10))],
        F.max(on("partial", F.col("x"))).alias("ks_previous"),
        F.max(on("partial", F.col("y"))).alias("share_change_previous"),
    )
    return per_load.join(stats, ["column_name", "load"], "left").select(
        F.split("column_name", _SEP)[0].alias("table_name"), F.split("column_name", _SEP)[1].alias("column_name"), F.col("load").alias("load_no"), "n_rows", "n_null", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "min_value", "max_value", "q25", "q50", "q75", "ks_previous", "share_change_previous",
    )


def violations(df: DataFrame, table_name: str, ref: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(table_name, column_name, finding, ref_id) of rows that break a rule; rules hold (column, finding, broken). One scan."""
    hit = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("finding"))) for c, f, broken in rules]))
    return df.select(F.col(ref).alias("ref_id"), F.explode(hit).alias("h")).select(F.lit(table_name).alias("table_name"), "h.column_name", "h.finding", "ref_id")


def shifts(profiled: DataFrame, null_change: float = 0.2, median_factor: float = 2.0, share_change: float = 0.2, medians_of: dict[str, str] | None = None, shares_of: tuple[str, ...] = ()) -> DataFrame:
    """Loads that differ from the next lower load: null share, median by a factor, or any value's share.

    medians_of maps a column to the profiled column whose median stands for it; shares_of names the columns whose
    value shares are compared.
    """
    from pyspark.sql import Window

    medians_of = medians_of or {}
    helper = [h for c, h in medians_of.items() if h != c]
    main = profiled.where(~F.col("column_name").isin(helper)) if helper else profiled
    names = F.create_map(*[F.lit(x) for h, c in {h: c for c, h in medians_of.items()}.items() for x in (h, c)]) if medians_of else None
    w = Window.partitionBy("table_name", "column_name").orderBy("load_no")
    if medians_of:
        med = profiled.where(F.col("column_name").isin(list(medians_of.values()))).select("table_name", names[F.col("column_name")].alias("column_name"), "load_no", F.col("q50").alias("median"))
        main = main.join(med, ["table_name", "column_name", "load_no"], "left")
    else:
        main = main.withColumn("median", F.lit(None).cast("double"))
    null_share = F.col("n_null") / F.col("n_rows")
    last, last_null = F.lag("median").over(w), F.lag(null_share).over(w)
    moved = (F.abs(null_share - last_null) > null_change) | ((F.col("median") > median_factor * last) | (last > median_factor * F.col("median")))
    if shares_of:
        moved = F.coalesce(moved, F.lit(False)) | (F.col("column_name").isin(*shares_of) & F.coalesce(F.col("share_change_previous") > share_change, F.lit(False)))
    # one row per column and load, so the window is as small as the profile
    return main.withColumn("moved", F.coalesce(F.abs(null_share - last_null) > null_change, F.lit(False)) | F.coalesce(moved, F.lit(False))).where("moved").select("table_name", "column_name", F.lit("shift").alias("finding"), F.col("load_no").alias("ref_id"))
