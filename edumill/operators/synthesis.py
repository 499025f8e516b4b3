"""Aggregations of coded findings: synthesis cube, predictor weights, priority, provenance, policy signals, profiles.

Nulls form no group: rows without a method, variable or trend are left out of the cube. Ties between trends go to the
alphabetically first. Global minima and maxima are scalar subqueries, so no window spans the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube(findings: DataFrame, study: str = "study") -> DataFrame:
    """method, variable, trend, study_count: distinct studies per cell."""
    return findings.where("method is not null and variable is not null and trend is not null").groupBy("method", "variable", "trend").agg(F.countDistinct(study).alias("study_count"))


def min_max(df: DataFrame, column: str, out: str, default: float = 1.0) -> DataFrame:
    """Column scaled to [0, 1]; default where all values are equal."""
    lo, hi = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return df.withColumn(out, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(default))


def predictor_weights(cells: DataFrame) -> DataFrame:
    """Weights from a cube: F studies, D distinct methods, C share of the dominant trend, w = F D C, scaled."""
    by_trend = cells.groupBy("variable", "trend").agg(F.sum("study_count").alias("n"))
    top = by_trend.groupBy("variable").agg(F.min(F.struct((-F.col("n")).alias("m"), "trend")).alias("t"), F.sum("n").alias("F_raw"))
    methods = cells.groupBy("variable").agg(F.countDistinct("method").alias("D_raw"))
    j = top.join(methods, "variable").select("variable", F.col("F_raw").cast("double").alias("F_raw"), F.col("D_raw").cast("double").alias("D_raw"), (-F.col("t.m") / F.col("F_raw")).alias("C_raw"), F.col("t.trend").alias("dominant_trend"))
    return min_max(j.withColumn("w_raw", F.col("F_raw") * F.col("D_raw") * F.col("C_raw")), "w_raw", "w_norm")


#: fixed values: quality factors of effect rows
QUALITY = {"high": 1.0, "medium": 0.8, "low": 0.5}


def effect_weights(effects: DataFrame) -> DataFrame:
    """Weights from effect rows (predictor, program, domain, direction, effect_type, effect_value, pv_correct,
    weight_correct, quality): quality-weighted counts, contexts, dominant direction, median absolute effect."""
    q = F.when(~F.col("pv_correct"), 0.5).otherwise(1.0) * F.when(~F.col("weight_correct"), 0.7).otherwise(1.0)
    q = q * F.coalesce(*[F.when(F.col("quality") == k, v) for k, v in QUALITY.items()], F.lit(0.5))
    size = F.when(F.col("effect_type") == "R2", F.sqrt(F.abs("effect_value"))).when(~F.col("effect_type").isin("accuracy", "AUC", "F1"), F.abs("effect_value"))
    rows = effects.withColumns({"q_": q, "e_": size})
    by_dir = rows.groupBy("predictor", "direction").agg(F.count("*").alias("n"))
    dom = by_dir.groupBy("predictor").agg(F.min(F.struct((-F.col("n")).alias("m"), "direction")).alias("t"), F.sum("n").alias("all_"))
    g = rows.groupBy("predictor").agg(F.sum("q_").alias("F_raw"), F.countDistinct("program", "domain").cast("double").alias("D_raw"), F.percentile("e_", 0.5).alias("E_raw"), F.count("*").alias("effect_count"))
    j = g.join(dom, "predictor").withColumn("C_raw", -F.col("t.m") / F.col("all_")).withColumn("dominant_direction", F.col("t.direction"))
    e = min_max(j.drop("t", "all_"), "E_raw", "E_norm", 0.5).withColumn("E_norm", F.coalesce("E_norm", F.lit(0.5)))
    return min_max(e.withColumn("w_raw", F.col("F_raw") * F.col("D_raw") * F.col("C_raw") * F.col("E_norm")), "w_raw", "w_norm")


def priority(profile: DataFrame) -> DataFrame:
    """Priority of constructs from n_studies, n_programs, n_cycles, n_countries, predictive_share: the geometric mean of
    log frequency and three capped ratios, raised by the predictive share, relative to the largest."""
    top = profile.agg(F.max(F.log1p("n_studies"))).scalar()
    clip = lambda c: F.least(F.greatest(c, F.lit(0.01)), F.lit(1.0))
    parts = [clip(F.log1p("n_studies") / top), clip(F.col("n_programs") / 8), clip(F.col("n_cycles") / 8), clip(F.col("n_countries") / 50)]
    geo = F.exp((F.log(parts[0]) + F.log(parts[1]) + F.log(parts[2]) + F.log(parts[3])) / 4)
    boost = F.least(F.greatest(1 + 0.3 * F.coalesce("predictive_share", F.lit(0.0)), F.lit(1.0)), F.lit(1.3))
    w = profile.withColumn("w_geo", geo).withColumn("w_raw", F.col("w_geo") * boost)
    return w.withColumn("w_j", F.try_divide(F.col("w_raw"), w.agg(F.max("w_raw")).scalar()))


def first_non_null(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """First non-null value of every column per group in the given order."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def provenance(rows: DataFrame, variable: str, study: str, program: str, cycle: str, places: str, direction: str, year: str, canonical: str) -> DataFrame:
    """Where the evidence on a variable comes from; places is a list per row, ties of the direction go to the alphabet."""
    by = rows.groupBy(variable, direction).agg(F.count("*").alias("n"))
    main = by.groupBy(variable).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(direction).alias("d"))).alias("m")).select(variable, F.col("m.d").alias("dominant_direction"))
    listed = rows.select(variable, F.explode(places).alias("p")).distinct().groupBy(variable).agg(F.count("*").alias("n_places"), F.array_join(F.array_sort(F.collect_list("p")), "|").alias("places"))
    g = rows.groupBy(variable).agg(F.countDistinct(study).alias("n_studies"), F.countDistinct(program).alias("n_programs"), F.countDistinct(cycle).alias("n_cycles"), F.avg((F.col(direction) == canonical).cast("int")).alias("predictive_share"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return g.join(main, variable).join(listed, variable, "left").withColumn("agrees", F.col("dominant_direction") == canonical)


def value_counts(df: DataFrame, dimensions: dict[str, Column], top: int | None = None) -> DataFrame:
    """(dimension, label, n) of several dimensions in one pass; the most frequent of each where top is given."""
    from pyspark.sql import Window

    cells = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("label")) for k, v in dimensions.items()])).alias("c")).select("c.*").where("label is not null").groupBy("dimension", "label").agg(F.count("*").alias("n"))
    if top is None:
        return cells
    return cells.withColumn("r", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "label"))).where(F.col("r") <= top).drop("r")


def filled_profile(df: DataFrame, columns: list[str], missing: Column | None = None) -> DataFrame:
    """(column_name, n_rows, n_filled, missing_rate) of every column: one aggregation, unpivoted."""
    from ..functions.text import is_blank

    g = df.agg(F.count("*").alias("n_rows"), *[F.sum((~is_blank(F.col(c).cast("string"))).cast("long")).alias(c) for c in columns])
    return g.unpivot(["n_rows"], columns, "column_name", "n_filled").select("column_name", "n_rows", F.coalesce("n_filled", F.lit(0)).alias("n_filled"), F.try_divide(F.col("n_rows") - F.coalesce("n_filled", F.lit(0)), F.col("n_rows")).alias("missing_rate"))
