"""Choice of rows and columns that is made when a plan is built or by a ladder of reasons."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every wanted value; a list means any of it, None means no condition."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(*value))
        elif value is not None:
            df = df.where(F.col(name) == value)
    return df


def first_column(df: DataFrame, *candidates: str) -> str | None:
    """The first of the names that the table has, case aside."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def replicate_columns(df: DataFrame, prefix: str, most: int = 999) -> list[str]:
    """The columns prefix001, prefix002, ... if there is any of them, else all of the prefix and a number, by that number."""
    have = {c.upper(): c for c in df.columns}
    padded = [have[k] for n in range(1, most + 1) if (k := f"{prefix}{n:03d}".upper()) in have]
    if padded:
        return padded
    found = [(int(m[1]), c) for c in df.columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", c, re.I))]
    return [c for _, c in sorted(found)]


def skip_reasons(files: DataFrame, done: DataFrame, excluded: list[int], name: str = "file_name") -> DataFrame:
    """files with reason: number excluded, output exists, stem match, duplicate stem, or null for those to process.

    A stem is the folded name without a leading number; of equal new stems the alphabetically first is kept.
    """
    stem = fold(F.regexp_replace(F.regexp_replace(name, r"(?i)\.[a-z0-9]{1,5}$", ""), r"^\d+\.\s*", ""))
    rows = files.select("*", F.regexp_extract(name, r"^(\d+)\.", 1).try_cast("int").alias("no_"), stem.alias("stem_"))
    out = done.select(F.col(name).alias("done_")).distinct()
    stems = done.select(stem.alias("stem_")).distinct().withColumn("known_", F.lit(True))
    rows = rows.join(out, rows[name] == out["done_"], "left").join(stems, "stem_", "left")
    early = F.when(F.col("no_").isin(*excluded), "number excluded").when(F.col("done_").isNotNull(), "output exists").when(F.col("known_"), "stem match")
    rows = rows.withColumn("early_", early)
    first = rows.where("early_ is null").groupBy("stem_").agg(F.min(name).alias("first_"))
    rows = rows.join(first, "stem_", "left")
    return rows.withColumn("reason", F.coalesce("early_", F.when(F.col(name) != F.col("first_"), "duplicate stem"))).drop("no_", "stem_", "done_", "known_", "early_", "first_")
