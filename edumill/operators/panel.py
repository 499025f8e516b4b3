"""Country x cycle panels: lags, fixed as-of pairs, pivots, folds, availability.

Two lags exist and are named apart: lag_observed bridges gaps (the country's last row), lag_cycle takes the previous
cycle of the programme and is null where the country has no row in it. Pivots always get explicit values. Windows are
partitioned by country or run over the handful of cycles of a programme.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def previous_cycles(panel: DataFrame, program: list[str], cycle: str = "cycle") -> DataFrame:
    """(program..., cycle, previous) for the distinct cycles of each programme."""
    w = Window.partitionBy(*program).orderBy(cycle)
    return panel.select(*program, cycle).distinct().withColumn("previous", F.lag(cycle).over(w))


def lag_observed(panel: DataFrame, keys: list[str], value: str, out: str, cycle: str = "cycle") -> DataFrame:
    return panel.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(cycle)))


def lag_cycle(panel: DataFrame, program: list[str], country: str, value: str, out: str, cycle: str = "cycle") -> DataFrame:
    """The value in the previous cycle of the programme; null where the country took no part or the value is not finite."""
    before = panel.select(*program, country, F.col(cycle).alias("previous"), F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value)).alias(out))
    return panel.join(broadcast_if_small(previous_cycles(panel, program, cycle)), [*program, cycle]).join(before, [*program, country, "previous"], "left").drop("previous")


def fixed_pairs(source: DataFrame, target: DataFrame, pairs: DataFrame, country: str = "country") -> DataFrame:
    """Source rows moved to the target cycle of each (source_cycle, target_cycle) pair, with the overlap of countries."""
    s = source.select(F.col("cycle").alias("source_cycle"), country).distinct().join(broadcast_if_small(pairs), "source_cycle")
    t = target.select(F.col("cycle").alias("target_cycle"), country).distinct()
    both = s.join(t, ["target_cycle", country])
    return pairs.join(both.groupBy("source_cycle", "target_cycle").agg(F.count("*").alias("n_overlap"), F.array_join(F.sort_array(F.collect_set(country)), "|").alias("countries")), ["source_cycle", "target_cycle"], "left").withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)))


def pivot(df: DataFrame, keys: list[str], column: str, value: str, values: list, how: str = "avg", prefix: str = "", order: str | None = None) -> DataFrame:
    """Wide columns for the given values; how is avg, sum or first: the value that is not null in the first row by order."""
    filled = F.when(F.col(value).isNotNull(), F.col(order)) if order else None
    agg = {"avg": F.avg, "sum": F.sum, "first": lambda v: F.min_by(v, filled)}[how](value)
    wide = df.groupBy(*keys).pivot(column, values).agg(agg)
    return wide.select(*keys, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "construct", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull() & ~F.isnan(value))


def folds(panel: DataFrame, program: list[str], cycle: str = "cycle", least_prior: int = 1) -> DataFrame:
    """Expanding windows: every row with each test_cycle it trains for, role train or test; folds with enough prior
    cycles. The fold dimension holds cycles only, so the range join is over a handful of rows per programme."""
    cycles = panel.select(*program, cycle).distinct()
    tests = cycles.alias("a").join(cycles.select(*program, F.col(cycle).alias("prior")), program).where(F.col("prior") < F.col(cycle)).groupBy(*program, cycle).agg(F.count("*").alias("n_prior")).where(F.col("n_prior") >= least_prior).select(*program, F.col(cycle).alias("test_cycle"))
    return panel.join(broadcast_if_small(tests), program).where(F.col(cycle) <= F.col("test_cycle")).withColumn("role", F.when(F.col(cycle) == F.col("test_cycle"), "test").otherwise("train"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of value in its group, ties averaged; null values get none.

    Equal values are counted first, so the window holds one row per distinct value of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_"))
    below = F.sum("n_").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*keys, value, (F.coalesce(below, F.lit(0)) + (F.col("n_") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def next_cycle(panel: DataFrame, program: list[str], cycle: str = "cycle") -> DataFrame:
    """The cycle that the mean gap between cycles points to, gaps rounded half to even."""
    g = previous_cycles(panel, program, cycle).where("previous is not null").groupBy(*program).agg(F.max(cycle).alias("last_cycle"), F.avg(F.col(cycle) - F.col("previous")).alias("gap"))
    return g.select(*program, "last_cycle", (F.col("last_cycle") + F.bround("gap").cast("int")).alias("next_cycle"))
