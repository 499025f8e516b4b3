"""Design-based survey estimates: weighted means and correlations with replicate-weight variance and pooled draws.

Replicate weights are summed side by side in one aggregation (two sums per replicate), the zone jackknife is algebra on
one two-level aggregation; rows are never copied per replicate. Rows with a null value or weight, or a weight of 0 or
less, take no part; a group without such rows has no row; a single draw has no variance between draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def analytic(df: DataFrame, weight: str, *values: str) -> DataFrame:
    """Rows that take part in estimates."""
    keep = F.col(weight) > 0
    for v in values:
        keep = keep & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    return df.where(keep)


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """mean, n, and the SE that ignores the design: sqrt(sum w (v - m)^2 / (sum w)^2 * n)."""
    w, v = F.col(weight), F.col(value)
    g = analytic(df, weight, value).groupBy(*keys).agg(F.sum(w).alias("sw"), F.sum(w * v).alias("swv"), F.sum(w * v * v).alias("swvv"), F.count("*").alias("n"))
    m = F.col("swv") / F.col("sw")
    return g.select(*keys, m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("swvv") - m * m * F.col("sw")) / (F.col("sw") * F.col("sw")) * F.col("n")).alias("se"), "n")


def replicate_scale(method: str, replicates: int, fay: float = 0.5) -> float:
    """What the sum of squared deviations is multiplied by."""
    return {"fay": 1 / (replicates * (1 - fay) ** 2), "brr": 1 / replicates, "jrr": 1.0}[method]


def replicate_means(df: DataFrame, keys: list[str], value: str, weight: str, replicates: list[Column], method: str) -> DataFrame:
    """mean, variance and n of each group from replicate weights; a replicate without weight is skipped."""
    v = F.col(value)
    sums = [F.sum(x).alias(n) for r, w in enumerate(replicates) for n, x in ((f"s{r}", w * v), (f"w{r}", w))]
    g = analytic(df, weight, value).groupBy(*keys).agg(F.sum(F.col(weight) * v).alias("s"), F.sum(weight).alias("w"), F.count("*").alias("n"), *sums)
    theta = F.col("s") / F.col("w")
    squares = F.array(*[F.pow(F.try_divide(F.col(f"s{r}"), F.col(f"w{r}")) - theta, F.lit(2.0)) for r in range(len(replicates))])
    total = F.aggregate(squares, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return g.select(*keys, theta.alias("mean"), (total * replicate_scale(method, len(replicates))).alias("variance"), "n")


def jackknife_zones(df: DataFrame, keys: list[str], value: str, weight: str, zone: str, half: str) -> DataFrame:
    """theta and u per group by the zone jackknife: in each zone one half counts double, the other not at all.

    Rows without a half count in their zone but in no half. u is the sum of squares over zones and halves, halved.
    """
    w, y = F.col(weight), F.col(weight) * F.col(value)
    on = lambda h, x: F.sum(F.when(F.col(half) == h, x).otherwise(0.0))
    per_zone = analytic(df, weight, value).groupBy(*keys, zone).agg(F.sum(y).alias("s"), F.sum(w).alias("w"), *[on(h, x).alias(f"{n}{h}") for h in (0, 1) for n, x in (("s", y), ("w", w))])
    total = per_zone.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("w").alias("tw"))
    joined = per_zone.join(total, keys)
    theta = F.col("ts") / F.col("tw")

    def square(h: int) -> Column:
        rest = F.col("tw") - F.col("w") + 2 * F.col(f"w{h}")
        return F.when(rest > 0, F.pow((F.col("ts") - F.col("s") + 2 * F.col(f"s{h}")) / rest - theta, F.lit(2.0))).otherwise(0.0)

    return joined.groupBy(*keys).agg(F.max(theta).alias("theta"), (F.sum(square(0) + square(1)) / 2).alias("u"))


def rubin_pool(df: DataFrame, keys: list[str], theta: str = "theta", u: str = "u") -> DataFrame:
    """Pooled estimate of several draws: mean, se, ci_lo, ci_hi, total variance t, within u_bar, between b, draws m."""
    g = df.groupBy(*keys).agg(F.avg(theta).alias("mean"), F.avg(u).alias("u_bar"), F.coalesce(F.var_samp(theta), F.lit(0.0)).alias("b"), F.count(theta).alias("m"))
    t = F.col("u_bar") + (1 + 1 / F.col("m")) * F.col("b")
    g = g.withColumn("t", t).withColumn("se", F.sqrt(F.greatest(F.col("t"), F.lit(0.0))))
    return g.withColumn("ci_lo", F.col("mean") - Z95 * F.col("se")).withColumn("ci_hi", F.col("mean") + Z95 * F.col("se"))


def correlation_sums(x: Column, y: Column, w: Column, tag: str = "") -> list[Column]:
    return [F.sum(e).alias(n + tag) for n, e in (("w", w), ("wx", w * x), ("wy", w * y), ("wxx", w * x * x), ("wyy", w * y * y), ("wxy", w * x * y))]


def correlation(tag: str = "") -> Column:
    """Weighted Pearson correlation from correlation_sums; null if a variance is 0."""
    c = lambda n: F.col(n + tag)
    mx, my = c("wx") / c("w"), c("wy") / c("w")
    vx, vy = c("wxx") / c("w") - mx * mx, c("wyy") / c("w") - my * my
    return F.when((vx > 0) & (vy > 0), (c("wxy") / c("w") - mx * my) / F.sqrt(vx * vy))


def weighted_correlation(df: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    return analytic(df, weight, x, y).groupBy(*keys).agg(*correlation_sums(F.col(x), F.col(y), F.col(weight)), F.count("*").alias("n")).select(*keys, correlation().alias("r"), "n")


def pooled_correlation(df: DataFrame, keys: list[str], x: str, y: str, weight: str, replicates: list[Column], method: str = "fay", near: float = 0.05) -> DataFrame:
    """Correlation per draw with replicate variance, pooled; interval on Fisher's z scale; direction beyond +-near."""
    xs, ys = F.col(x), F.col(y)
    sums = correlation_sums(xs, ys, F.col(weight)) + [s for r, w in enumerate(replicates) for s in correlation_sums(xs, ys, w, f"_{r}")]
    g = analytic(df, weight, x, y).groupBy(*keys, "draw").agg(*sums)
    squares = F.array(*[F.pow(correlation(f"_{r}") - correlation(), F.lit(2.0)) for r in range(len(replicates))])
    u = F.aggregate(squares, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) * replicate_scale(method, len(replicates))
    pooled = rubin_pool(g.select(*keys, "draw", correlation().alias("theta"), u.alias("u")), keys)
    z, zse = F.atanh("mean"), F.col("se") / (1 - F.col("mean") * F.col("mean"))
    direction = F.when(F.col("mean") > near, "positive").when(F.col("mean") < -near, "negative").otherwise("null")
    return pooled.select(*keys, F.col("mean").alias("r"), "se", F.tanh(z - Z95 * zse).alias("ci_lo"), F.tanh(z + Z95 * zse).alias("ci_hi"), "m", direction.alias("direction"))


def match_status(claimed: Column, replicated: Column, claimed_direction: Column, direction: Column) -> Column:
    """Verdict on a claim: the direction first, then a difference within the larger of 10 % and 0.05."""
    gap = F.abs(replicated - claimed)
    return F.when(replicated.isNull(), "not_replicable").when(claimed_direction != direction, "direction_mismatch").when(claimed.isNull(), "direction_match").when(gap <= F.greatest(0.1 * F.abs(claimed), F.lit(0.05)), "match").otherwise("magnitude_mismatch")


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p value of Student's t by the continued fraction of the incomplete beta function."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(p: float, q: float, y: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (p + q) * y / (p + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
