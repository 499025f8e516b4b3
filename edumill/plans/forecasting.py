"""Forecast queries on the order panel of nations and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as M
from ..operators import panel as P
from ..operators import synthesis as Y
from ..session import table
from .base import Book, r6
from .evidence import BOOK as EVIDENCE
from .evidence import coded
from .relational import SCORES, covariates, scores

BOOK = Book()
FEATURES = ["score", "n", "lag_discount", "lag_tax"]
WEIGHTS = [1.0, 0.5, 0.25, 0.25]
TIERS = ["A", "B", "C", "C"]
OWN = 2  # the lagged score and count are the programme's own; the lagged covariates come from another source


def wide(spark, d):
    """Panel rows with lagged covariates: program, country, cycle, score, n, lag_discount, lag_tax."""
    c = covariates(spark, d).select("country", (F.col("cycle") + 1).alias("cycle"), F.col("value").alias("lag_discount"), F.col("tax").alias("lag_tax"))
    return scores(spark, d).join(c, ["country", "cycle"], "left")


def pairs(spark, d):
    return M.pairs(wide(spark, d), "score", ["score", "n"], ["lag_discount", "lag_tax"])


PAIRS = f"s as ({SCORES}), c as (select \"cycle\" cy, lag(\"cycle\") over (order by \"cycle\") p from (select distinct \"cycle\" from s)), pr as (select a.country, a.\"cycle\" cy, a.score y, b.score x from s a join c on a.\"cycle\"=c.cy join s b on b.country=a.country and b.\"cycle\"=c.p)"
FOLDS = PAIRS + ", t as (select distinct cy test_cycle from pr where cy>(select min(cy) from pr))"


@BOOK.query("m01_fold_matrix", f"with {FOLDS} select test_cycle, sum((cy<test_cycle)::int)::bigint n_train, sum((cy=test_cycle)::int)::bigint n_test from pr cross join t where cy<=test_cycle group by 1")
def m01(spark, d):
    f = M.fold_rows(pairs(spark, d))
    return f.groupBy("test_cycle").agg(F.sum((F.col("role") == "train").cast("long")).alias("n_train"), F.sum((F.col("role") == "test").cast("long")).alias("n_test"))


@BOOK.query("m02_persistence", f"with {FOLDS} select test_cycle, round(sqrt(avg(power(y-x,2))),4) rmse, round(avg(abs(y-x)),4) mae, round(1-sum(power(y-x,2))/nullif(sum(power(y-m,2)),0),6) r2 from (select *, avg(y) over (partition by test_cycle) m from pr join t on cy=test_cycle) group by 1")
def m02(spark, d):
    f = M.fold_rows(pairs(spark, d)).where("role = 'test'").select("test_cycle", "y", F.element_at("x", 1).alias("x"))
    g = f.groupBy("test_cycle").agg(F.avg(F.pow(F.col("y") - F.col("x"), F.lit(2.0))).alias("mse"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("mae"), F.var_pop("y").alias("v"))
    return g.select("test_cycle", F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6(F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v"))).alias("r2"))


@BOOK.query("m04_pooled_ar1", f"with {FOLDS}, f as (select test_cycle, regr_slope(y,x) b, regr_intercept(y,x) a, count(*) n from pr join t on cy<test_cycle group by 1) select test_cycle, round(b,6) slope, round(a,3) intercept, n n_train, round(sqrt(avg(power(y-a-b*x,2))),4) rmse from f join pr on cy=test_cycle group by test_cycle, a, b, n")
def m04(spark, d):
    f = M.fold_rows(pairs(spark, d)).withColumn("x", F.element_at("x", 1))
    fit = f.where("role = 'train'").groupBy("test_cycle").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n_train"))
    e = f.where("role = 'test'").join(fit, "test_cycle").groupBy("test_cycle", "b", "a", "n_train").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.lit(2.0)))).alias("rmse"))
    return e.select("test_cycle", r6("b").alias("slope"), F.round("a", 3).alias("intercept"), "n_train", F.round("rmse", 4).alias("rmse"))


@BOOK.query("m06_spearman", f"with {FOLDS}, k as (select test_cycle, rank() over (partition by test_cycle order by y)+(count(*) over (partition by test_cycle,y)-1)/2.0 ry, rank() over (partition by test_cycle order by x)+(count(*) over (partition by test_cycle,x)-1)/2.0 rx from pr join t on cy=test_cycle) select test_cycle, round(corr(ry,rx),6) rho, count(*) n from k group by 1")
def m06(spark, d):
    f = M.fold_rows(pairs(spark, d)).where("role = 'test'").select("test_cycle", "y", F.element_at("x", 1).alias("x"))
    k = P.average_ranks(P.average_ranks(f, ["test_cycle"], "y", "ry"), ["test_cycle"], "x", "rx")
    return k.groupBy("test_cycle").agg(r6(F.corr("ry", "rx")).alias("rho"), F.count("*").alias("n"))


@BOOK.query("m07_diebold_mariano", f"""with {FOLDS}, f as (select test_cycle, regr_slope(y,x) b, regr_intercept(y,x) a from pr join t on cy<test_cycle group by 1), e as (select test_cycle, country, power(y-a-b*x,2)-power(y-x,2) dd from f join pr on cy=test_cycle), l as (select *, lag(dd) over (partition by test_cycle order by country) pd from e),
g as (select test_cycle, avg(dd) m, var_samp(dd) g0, covar_samp(dd,pd) g1, count(*) n from l group by 1) select test_cycle, round(case when n>=3 and (g0+2*g1)/n>0 then m/sqrt((g0+2*g1)/n) end,5) dm, n from g""")
def m07(spark, d):
    f = M.fold_rows(pairs(spark, d)).withColumn("x", F.element_at("x", 1))
    fit = f.where("role = 'train'").groupBy("test_cycle").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    e = f.where("role = 'test'").join(fit, "test_cycle").select("test_cycle", "country", (F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.lit(2.0)) - F.pow(F.col("y") - F.col("x"), F.lit(2.0))).alias("dd"))
    l = P.lag_observed(e, ["test_cycle"], "dd", "pd", "country")
    g = l.groupBy("test_cycle").agg(F.avg("dd").alias("m"), F.var_samp("dd").alias("g0"), F.covar_samp("dd", "pd").alias("g1"), F.count("*").alias("n"))
    v = (F.col("g0") + 2 * F.col("g1")) / F.col("n")
    return g.select("test_cycle", F.round(F.when((F.col("n") >= 3) & (v > 0), F.col("m") / F.sqrt(v)), 5).alias("dm"), "n")


@BOOK.query("m03_model_hierarchy")
def m03(spark, d):
    """Persistence, AR(1) and the ridge models of every fold with their tests against persistence."""
    return M.by_fold(M.fold_rows(pairs(spark, d)), M.model_metrics(WEIGHTS, 2), M.METRICS)


@BOOK.query("m11_tier_hierarchy")
def m11(spark, d):
    """Persistence and four ridge models of every fold with two cycles before it, and why a fold or model has none."""
    # a pair has a cycle before it, so one earlier cycle of pairs is two of the panel
    return M.by_fold(M.fold_rows(pairs(spark, d), 1), M.hierarchy(TIERS, OWN, least_by_program=M.LEAST_TRAIN), M.HIERARCHY)


@BOOK.query("m15_tier_audit")
def m15(spark, d):
    """Coefficients of M0B and M1A, tiers among the features and the change of RMSE by the tier weights."""
    return M.by_fold(M.fold_rows(pairs(spark, d), 1), M.tier_audit(FEATURES, TIERS, OWN), M.AUDIT)


@BOOK.query("m08_attributions")
def m08(spark, d):
    return M.by_fold(M.fold_rows(pairs(spark, d)), M.attributions(FEATURES, WEIGHTS), M.ATTRIBUTIONS)


@BOOK.query("a24_mean_attribution")
def a24(spark, d):
    return m08(spark, d).groupBy("feature").agg(F.avg("mean_abs").alias("mean_abs"), F.avg("share").alias("share"))


@BOOK.query("m09_forward_forecast")
def m09(spark, d):
    """The next cycle of every country from a model of all pairs; the year comes from the mean gap of the cycles."""
    p = wide(spark, d)
    rows = pairs(spark, d).withColumn("role", F.lit("train"))
    nxt = P.next_cycle(p, ["program"])
    last = p.join(nxt, "program").where("cycle = last_cycle")
    ahead = last.select("program", "country", F.col("next_cycle").alias("cycle"), F.lit(0.0).alias("y"), F.array(F.col("score"), F.col("n").cast("double"), F.col("lag_discount"), F.col("lag_tax")).alias("x"), F.lit("test").alias("role"))
    both = rows.select("program", "country", "cycle", "y", "x", "role").unionByName(ahead).join(nxt.select("program", F.col("next_cycle").alias("test_cycle")), "program")
    return M.by_fold(both, M.predictions, M.PREDICTIONS).drop("y")


@BOOK.query("m13_hold_out")
def m13(spark, d):
    """Predictions of the last cycle from all earlier pairs."""
    f = M.fold_rows(pairs(spark, d))
    return M.by_fold(f.where(F.col("test_cycle") == f.agg(F.max("test_cycle")).scalar()), M.predictions, M.PREDICTIONS)


@BOOK.query("m13_in_sample")
def m13_inside(spark, d):
    """Predictions of the last transition by a model of that transition."""
    return M.by_fold(M.in_sample(pairs(spark, d)), M.predictions, M.PREDICTIONS)


@BOOK.query("m10_feature_weights", f"with w as ({EVIDENCE.sql['a12_predictor_weights']}), f as (select 'lag_'||variable feature, variable c from w union select p_brand, p_brand from part) select feature, round(coalesce(w_norm, 1.0), 6) weight from f left join w on w.variable = f.c")
def m10(spark, d):
    """Literature weights of features by their construct, lagged or not; features without one weigh 1."""
    w = Y.predictor_weights(Y.cube(coded(spark, d))).select(F.col("variable").alias("construct"), F.col("w_norm").alias("weight"))
    features = w.select(F.concat(F.lit("lag_"), F.col("construct")).alias("feature")).unionByName(table(spark, d, "part").select(F.col("p_brand").alias("feature")).distinct())
    return M.feature_weights(features, w).select("feature", r6("weight").alias("weight"))


@BOOK.query("m14_ablation")
def m14(spark, d):
    """Change of the weighted model's error when the covariates are dropped."""
    f = M.fold_rows(pairs(spark, d))
    a, b = M.by_fold(f, M.model_metrics(WEIGHTS, 2), M.METRICS), M.by_fold(f, M.model_metrics(WEIGHTS, 2, (2, 3)), M.METRICS)
    pick = lambda x, n: x.where("model in ('M0', 'M1')").select("test_cycle", "model", F.col("mae").alias(n))
    return pick(a, "mae_with").join(pick(b, "mae_without"), ["test_cycle", "model"]).withColumn("delta", F.col("mae_without") - F.col("mae_with"))


@BOOK.query("m16_rank_alignment")
def m16(spark, d):
    w = F.create_map(*[x for k, v in zip(FEATURES, WEIGHTS, strict=True) for x in (F.lit(k), F.lit(v))])
    return M.rank_alignment(m08(spark, d).select("test_cycle", "mean_abs", w[F.col("feature")].alias("weight")), ["test_cycle"], "mean_abs", "weight")


@BOOK.query("m17_weight_sensitivity")
def m17(spark, d):
    """Alignment under four weightings of the literature, and whether its sign holds."""
    specs = {"full": WEIGHTS, "flat": [1.0, 0.9, 0.8, 0.7], "reversed": WEIGHTS[::-1], "no_lag": [0.0, 0.5, 0.25, 0.2]}
    entries = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(f).alias("feature"), F.lit(v).alias("weight")) for s, ws in specs.items() for f, v in zip(FEATURES, ws, strict=True)])).alias("e")
    dim = spark.range(1).select(entries).select("e.*")
    j = m08(spark, d).join(dim, "feature")
    rho = M.rank_alignment(j.select("spec", "test_cycle", "mean_abs", "weight"), ["spec", "test_cycle"], "mean_abs", "weight", boots=100)
    return rho.groupBy("spec").agg(F.avg("rho").alias("mean_rho"), F.bool_and(F.col("rho") >= 0).alias("always_positive"), F.sum(F.col("trivial").cast("int")).alias("n_trivial"))


@BOOK.query("m18_permutation")
def m18(spark, d):
    """rho: 1000 permutations of the weights against the mean importance, the lagged target left out; the other kinds compare errors of folds."""
    f = M.fold_rows(pairs(spark, d))
    w = F.create_map(*[x for k, v in zip(FEATURES, WEIGHTS, strict=True) for x in (F.lit(k), F.lit(v))])
    mean = m08(spark, d).where(F.col("feature") != FEATURES[0]).groupBy("program", "feature").agg(F.avg("mean_abs").alias("mean_abs")).withColumn("weight", w[F.col("feature")])
    rho = M.weight_permutation(mean, ["program"]).withColumnRenamed("rho", "observed").withColumn("kind", F.lit("rho"))
    errors = M.by_fold(f, M.permutation_test("labels", 1000), M.PERMUTED).unionByName(M.by_fold(f, M.permutation_test("weights", 50, weights=WEIGHTS), M.PERMUTED))
    return errors.unionByName(rho, allowMissingColumns=True)


@BOOK.query("m18_subgroups")
def m18b(spark, d):
    """Errors of the full model inside and outside a group of countries."""
    p = m13(spark, d).withColumn("inside", F.col("country").isin(*[f"NATION_{k}" for k in range(0, 12)]))
    return p.groupBy("inside").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("predicted"), F.lit(2.0)))).alias("rmse"))


@BOOK.query("m18_leave_one_out")
def m18c(spark, d):
    """Alignment of attributions and weights with each feature left out in turn."""
    w = F.create_map(*[x for k, v in zip(FEATURES, WEIGHTS, strict=True) for x in (F.lit(k), F.lit(v))])
    left = F.explode(F.array(*[F.lit(k) for k in FEATURES])).alias("left_out")
    j = m08(spark, d).select("test_cycle", "feature", "mean_abs", w[F.col("feature")].alias("weight"), left).where("feature != left_out")
    return M.rank_alignment(j.select("left_out", "test_cycle", "mean_abs", "weight"), ["left_out", "test_cycle"], "mean_abs", "weight", boots=50).drop("ci_lo", "ci_hi")
