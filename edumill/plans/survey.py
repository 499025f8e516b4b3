"""Survey statistics on lineitem read as a survey: flags are countries, quantity is the base weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import survey as S
from ..session import table
from .base import Book, r6

BOOK = Book()
KEYS = ["k1", "k2"]
REPLICATES = 8
DRAWS = 5


def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k1"), F.col("l_linestatus").alias("k2"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("x"))


def replicates():
    return [F.col("w") * (1 + 0.5 * (1 - 2 * ((F.col("l_orderkey") * (2 * r + 1) + F.col("l_partkey")) % 2))) for r in range(REPLICATES)]


def drawn(df: DataFrame) -> DataFrame:
    """One row per pseudo plausible value."""
    ys = F.array(*[F.col("y") * (1 + 0.01 * ((F.col("l_partkey") + i) % 7 - 3)) for i in range(1, DRAWS + 1)])
    return df.select("*", F.posexplode(ys).alias("draw", "pv"))


BASE = "select l_returnflag k1, l_linestatus k2, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity w, l_extendedprice y, l_discount x from lineitem"
REP = f"select *, w*(1+0.5*(1-2*((l_orderkey*(2*r+1)+l_partkey)%2))) rw from ({BASE}) cross join (select unnest(range({REPLICATES})) r)"


@BOOK.query("a01_weighted_mean", f"select k1, k2, round(sum(w*y)/sum(w),6) mean, count(*) n from ({BASE}) where w>0 and y is not null group by k1,k2")
def a01(spark, d):
    return S.weighted_mean(microdata(spark, d), KEYS, "y", "w").select(*KEYS, r6("mean").alias("mean"), "n")


@BOOK.query("a02_weighted_mean_se", f"with m as (select k1,k2,sum(w*y)/sum(w) mu from ({BASE}) group by k1,k2) select k1,k2,round(max(mu),6) mean, round(sqrt(sum(w*power(y-mu,2))/power(sum(w),2)*count(*)),4) se, count(*) n from ({BASE}) join m using (k1,k2) group by k1,k2")
def a02(spark, d):
    return S.weighted_mean(microdata(spark, d), KEYS, "y", "w").select(*KEYS, r6("mean").alias("mean"), F.round("se", 4).alias("se"), "n")


def _replicated(method: str, scale: str) -> str:
    return f"""with t as (select k1,k2,sum(w*y)/sum(w) th, count(*) n from ({BASE}) group by k1,k2),
r as (select k1,k2,r,sum(rw*y)/nullif(sum(rw),0) tr from ({REP}) group by k1,k2,r)
select k1,k2,round(max(th),6) mean, round(coalesce(sum(power(tr-th,2)),0)*{scale},4) variance, max(n) n from r join t using (k1,k2) group by k1,k2"""


for _name, _method, _scale in (("a03_fay_variance", "fay", f"1.0/({REPLICATES}*0.25)"), ("a04_jrr_variance", "jrr", "1.0"), ("a05_brr_variance", "brr", f"1.0/{REPLICATES}")):

    def _run(spark, d, method=_method):
        return S.replicate_means(microdata(spark, d), KEYS, "y", "w", replicates(), method).select(*KEYS, r6("mean").alias("mean"), F.round("variance", 4).alias("variance"), "n")

    BOOK.query(_name, _replicated(_method, _scale))(_run)

JACK = """with p as (select l_returnflag k1,l_linestatus k2,i, l_quantity w, l_extendedprice*(1+0.01*((l_partkey+i)%7-3)) y, l_suppkey%15 z, l_linenumber%2 r
 from lineitem cross join (values (1),(2),(3),(4),(5)) t(i)),
g as (select k1,k2,i,z,sum(case when r=0 then w*y else 0 end) s0,sum(case when r=1 then w*y else 0 end) s1,sum(case when r=0 then w else 0 end) w0,sum(case when r=1 then w else 0 end) w1 from p group by k1,k2,i,z),
t as (select k1,k2,i,sum(s0+s1) s,sum(w0+w1) w from g group by k1,k2,i),
u as (select g.k1,g.k2,g.i,max(t.s/t.w) th, sum(case when t.w-w0-w1+2*w0>0 then power((t.s-s0-s1+2*s0)/nullif(t.w-w0-w1+2*w0,0)-t.s/t.w,2) else 0 end
 + case when t.w-w0-w1+2*w1>0 then power((t.s-s0-s1+2*s1)/nullif(t.w-w0-w1+2*w1,0)-t.s/t.w,2) else 0 end)/2 u from g join t on g.k1=t.k1 and g.k2=t.k2 and g.i=t.i group by g.k1,g.k2,g.i)
"""


def _zoned(spark, d):
    data = drawn(microdata(spark, d)).withColumns({"zone": F.col("l_suppkey") % 15, "half": F.col("l_linenumber") % 2})
    return S.jackknife_zones(data, [*KEYS, "draw"], "pv", "w", "zone", "half")


@BOOK.query("a06_jackknife_pooled", JACK + "select k1,k2,round(avg(th),6) mean, round(sqrt(avg(u)+(1+1.0/count(*))*var_samp(th)),4) se, count(*) m from u group by k1,k2")
def a06(spark, d):
    return S.rubin_pool(_zoned(spark, d), KEYS).select(*KEYS, r6("mean").alias("mean"), F.round("se", 4).alias("se"), "m")


@BOOK.query("a07_rubin_pool", JACK + "select k1,k2,round(avg(th)-1.96*sqrt(avg(u)+(1+1.0/count(*))*var_samp(th)),4) ci_lo, round(avg(th)+1.96*sqrt(avg(u)+(1+1.0/count(*))*var_samp(th)),4) ci_hi, round(avg(u),4) u_bar, round(var_samp(th),4) b from u group by k1,k2")
def a07(spark, d):
    return S.rubin_pool(_zoned(spark, d), KEYS).select(*KEYS, *[F.round(c, 4).alias(c) for c in ("ci_lo", "ci_hi", "u_bar", "b")])


@BOOK.query("a08_single_outcome", f"""with t as (select k1,k2,sum(w*y)/sum(w) th, count(*) n from ({BASE}) group by k1,k2 having count(*)>=30),
r as (select k1,k2,r,sum(rw*y)/nullif(sum(rw),0) tr from ({REP}) group by k1,k2,r)
select k1 country, round(max(th),4) mean, round(sqrt(coalesce(sum(power(tr-th,2)),0)/({REPLICATES}*0.25)),4) se, 'fay' "method", max(n) n_analytic, {REPLICATES} n_replicates, k2 cycle from r join t using (k1,k2) group by k1,k2""")
def a08(spark, d):
    e = S.replicate_means(microdata(spark, d), KEYS, "y", "w", replicates(), "fay").where("n >= 30")
    return e.select(F.col("k1").alias("country"), F.round("mean", 4).alias("mean"), F.round(F.sqrt("variance"), 4).alias("se"), F.lit("fay").alias("method"), F.col("n").alias("n_analytic"), F.lit(REPLICATES).alias("n_replicates"), F.col("k2").alias("cycle"))


_CORR = "(sum({w}*x*{y})/sum({w})-sum({w}*x)/sum({w})*sum({w}*{y})/sum({w}))/sqrt((sum({w}*x*x)/sum({w})-power(sum({w}*x)/sum({w}),2))*(sum({w}*{y}*{y})/sum({w})-power(sum({w}*{y})/sum({w}),2)))"


@BOOK.query("a09_weighted_correlation", f"select k1,k2,round({_CORR.format(w='w', y='y')},6) r, count(*) n from ({BASE}) where w>0 group by k1,k2")
def a09(spark, d):
    return S.weighted_correlation(microdata(spark, d), KEYS, "x", "y", "w").select(*KEYS, r6("r").alias("r"), "n")


@BOOK.query("a10_pooled_correlation", f"""with p as (select *, y*(1+0.01*((l_partkey+i)%7-3)) pv from ({BASE}) cross join (select unnest(range(1,{DRAWS + 1})) i)),
t as (select k1,k2,i,{_CORR.format(w='w', y='pv')} th from p group by k1,k2,i),
rr as (select *, w*(1+0.5*(1-2*((l_orderkey*(2*r+1)+l_partkey)%2))) rw from p cross join (select unnest(range({REPLICATES})) r)),
v as (select k1,k2,i,r,{_CORR.format(w='rw', y='pv')} tr from rr group by k1,k2,i,r),
u as (select k1,k2,i,max(th) th,sum(power(tr-th,2))/({REPLICATES}*0.25) u from v join t using (k1,k2,i) group by k1,k2,i),
q as (select k1,k2,avg(th) r, sqrt(avg(u)+(1+1.0/count(*))*coalesce(var_samp(th),0)) se, count(*) m from u group by k1,k2)
select k1,k2,round(r,6) r, round(se,6) se, round((exp(2*(0.5*ln((1+r)/(1-r))-1.96*se/(1-r*r)))-1)/(exp(2*(0.5*ln((1+r)/(1-r))-1.96*se/(1-r*r)))+1),6) ci_lo,
round((exp(2*(0.5*ln((1+r)/(1-r))+1.96*se/(1-r*r)))-1)/(exp(2*(0.5*ln((1+r)/(1-r))+1.96*se/(1-r*r)))+1),6) ci_hi, m, case when r>0.05 then 'positive' when r<-0.05 then 'negative' else 'null' end direction from q""")
def a10(spark, d):
    p = S.pooled_correlation(drawn(microdata(spark, d)), KEYS, "x", "pv", "w", replicates())
    return p.select(*KEYS, *[r6(c).alias(c) for c in ("r", "se", "ci_lo", "ci_hi")], "m", "direction")


@BOOK.query("f45_claim_status", f"""with c as (select k1,k2,{_CORR.format(w='w', y='y')} r from ({BASE}) group by k1,k2), j as (select *, case when r>0.05 then 'positive' when r<-0.05 then 'negative' else 'null' end dir, case when k1='A' then 0.02 when k1='N' then 0.5 end claimed from c)
select k1,k2, case when r is null then 'not_replicable' when (case when k1='A' then 'null' else 'positive' end)<>dir then 'direction_mismatch' when claimed is null then 'direction_match' when abs(r-claimed)<=greatest(0.1*abs(claimed),0.05) then 'match' else 'magnitude_mismatch' end status from j""")
def f45(spark, d):
    c = S.weighted_correlation(microdata(spark, d), KEYS, "x", "y", "w")
    direction = F.when(F.col("r") > 0.05, "positive").when(F.col("r") < -0.05, "negative").otherwise("null")
    claimed = F.when(F.col("k1") == "A", 0.02).when(F.col("k1") == "N", 0.5)
    return c.select(*KEYS, S.match_status(claimed, F.col("r"), F.when(F.col("k1") == "A", "null").otherwise("positive"), direction).alias("status"))
