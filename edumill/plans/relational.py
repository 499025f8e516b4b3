"""Joins, windows, reshaping, set operations and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import panel as P
from ..session import table
from .base import Book, r6

BOOK = Book()
YEARS = list(range(1995, 2002))


def scores(spark, d):
    """Panel of order values: program ORD, domain price, country = nation of the customer, cycle = order year."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    program = F.when(F.col("o_orderkey").isNotNull(), "ORD")  # of the row, not a literal: joins on the programme stay equi-joins
    return j.groupBy(program.alias("program"), F.col("n_name").alias("country"), F.year("o_orderdate").alias("cycle")).agg(F.avg("o_totalprice").alias("score"), F.count("*").alias("n"))


SCORES = "select 'ORD' program, n_name country, year(o_orderdate)::int \"cycle\", avg(o_totalprice) score, count(*) n from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1,2,3"


def covariates(spark, d):
    """Second panel: supplier nations by shipping year."""
    l, s, n = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    j = l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)  # nation has 25 rows at every scale
    return j.groupBy(F.col("n_name").alias("country"), F.year("l_shipdate").alias("cycle")).agg(F.avg("l_discount").alias("value"), F.avg("l_tax").alias("tax"))


COVS = "select n_name country, year(l_shipdate)::int \"cycle\", avg(l_discount) \"value\", avg(l_tax) tax from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey group by 1,2"


@BOOK.query("p06_analytic_rows", f"with s as ({SCORES}) select country, \"cycle\", round(score,4) score, n from s where n>=30")
def p06(spark, d):
    return scores(spark, d).where("n >= 30").select("country", "cycle", F.round("score", 4).alias("score"), "n")


@BOOK.query("p07_valid_codes", "select title_lang, count(*) n from metadata where regexp_full_match(title_lang,'\\p{L}{2}') group by 1")
def p07(spark, d):
    return table(spark, d, "metadata").where(F.col("title_lang").rlike(r"^\p{L}{2}$")).groupBy("title_lang").agg(F.count("*").alias("n"))


@BOOK.query("p08_code_repair", "select coalesce(case title_lang when 'und' then 'xx' when '' then 'xx' when 'EN' then 'en' end, title_lang, 'xx') code, count(*) n from metadata group by 1")
def p08(spark, d):
    repair = F.create_map(*[F.lit(x) for kv in (("und", "xx"), ("", "xx"), ("EN", "en")) for x in kv])
    return table(spark, d, "metadata").groupBy(F.coalesce(repair[F.col("title_lang")], F.col("title_lang"), F.lit("xx")).alias("code")).agg(F.count("*").alias("n"))


@BOOK.query("p13_crosswalk_transform", f"with c as ({COVS}), u as (select country, \"cycle\", 'discount' construct, \"value\" v from c union all select country, \"cycle\", 'tax', tax from c) select country, \"cycle\", construct, round(case when construct='tax' then -v else v end,6) v, case construct when 'tax' then 'B' else 'A' end tier from u")
def p13(spark, d):
    walk = spark.createDataFrame([("discount", "keep", "A"), ("tax", "negate", "B"), ("noise", "drop_near_zero_variance", "C")], "construct string, transformation string, tier string")
    u = P.unpivot(covariates(spark, d).withColumnRenamed("value", "discount"), ["country", "cycle"], ["discount", "tax"], value="v")
    j = u.join(walk, "construct", "left").where("coalesce(transformation, 'keep') != 'drop_near_zero_variance'")
    return j.select("country", "cycle", "construct", r6(F.when(F.col("transformation") == "negate", -F.col("v")).otherwise(F.col("v"))).alias("v"), "tier")


@BOOK.query("p14_leakage", f"with c as ({SCORES}), y as (select distinct \"cycle\" cy from c), p as (select a.cy source_cycle, b.cy target_cycle, b.cy - a.cy lag from y a cross join y b) select source_cycle, target_cycle, source_cycle >= target_cycle and lag != 0 leaks from p")
def p14(spark, d):
    """Which pairs of the panel's cycles would leak: a source that is not earlier than its target."""
    cycles = scores(spark, d).select("cycle").distinct()
    every = F.array_sort(F.collect_set("cycle"))  # the cycles of a panel are a handful
    pairs = cycles.agg(every.alias("s"), every.alias("t")).select(F.explode("s").alias("source_cycle"), "t").select("source_cycle", F.explode("t").alias("target_cycle"))
    lag = F.col("target_cycle") - F.col("source_cycle")
    return pairs.withColumn("leaks", (F.col("source_cycle") >= F.col("target_cycle")) & (lag != 0))


@BOOK.query("p15_duplicate_keys", "select file_name, ordinal, count(*) n from core_ml_techniques_all group by 1,2 having count(*)>1")
def p15(spark, d):
    return table(spark, d, "core_ml_techniques_all").groupBy("file_name", "ordinal").agg(F.count("*").alias("n")).where("n > 1")


@BOOK.query("p16_resume", "select count(*) n from processed_pdf p where not exists (select 1 from article_records a where a.record_id=p.file_id and a.payload is not null)")
def p16(spark, d):
    done = table(spark, d, "article_records").where("payload is not null").select(F.col("record_id").alias("file_id"))
    return table(spark, d, "processed_pdf").join(done, "file_id", "left_anti").agg(F.count("*").alias("n"))


@BOOK.query("j01_left_equi", "select c_custkey, c_name, count(o_orderkey) n_orders from customer left join orders on c_custkey=o_custkey group by 1,2")
def j01(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))  # pre-aggregated before the join
    return c.join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@BOOK.query("j02_inherit_from_deduplicated", "with m as (select file_name, corpus from (select *, row_number() over (partition by file_name order by row_id) r from metadata where file_name is not null) where r=1) select c.row_id, m.corpus from core_data c left join m using (file_name)")
def j02(spark, d):
    first = table(spark, d, "metadata").where("file_name is not null").groupBy("file_name").agg(F.min_by("corpus", "row_id").alias("corpus"))
    return table(spark, d, "core_data").join(first, "file_name", "left").select("row_id", "corpus")


@BOOK.query("j03_placeholder_children", "select m.file_name, s.row_id, false placeholder from survey_design s join (select distinct file_name from core_data) m using (file_name) union all select file_name, null, true from (select distinct file_name from core_data where file_name is not null) m where not exists (select 1 from survey_design s where s.file_name=m.file_name)")
def j03(spark, d):
    parents, kids = table(spark, d, "core_data").select("file_name").where("file_name is not null").distinct(), table(spark, d, "survey_design").select("file_name", "row_id")
    have = kids.join(parents, "file_name", "left_semi").select("file_name", "row_id", F.lit(False).alias("placeholder"))
    return have.unionByName(parents.join(kids, "file_name", "left_anti").select("file_name", F.lit(None).cast("long").alias("row_id"), F.lit(True).alias("placeholder")))


@BOOK.query("j04_fallback_lookup", "with t as (select file_name, min(technique) technique from core_ml_techniques_all where technique is not null group by 1) select c.row_id, coalesce(c.ml_technique_primary, t.technique, 'Traditional_Stats') ml from core_data c left join t using (file_name)")
def j04(spark, d):
    t = table(spark, d, "core_ml_techniques_all").where("technique is not null").groupBy("file_name").agg(F.min("technique").alias("technique"))
    return table(spark, d, "core_data").join(t, "file_name", "left").select("row_id", F.coalesce("ml_technique_primary", "technique", F.lit("Traditional_Stats")).alias("ml"))


@BOOK.query("j05_index_intersection", f"with s as ({SCORES}) select a.country, a.\"cycle\", round(a.score,4) score, round(b.score,4) previous from s a join s b on a.country=b.country and b.\"cycle\"=a.\"cycle\"-1")
def j05(spark, d):
    s = scores(spark, d)
    b = s.select("country", (F.col("cycle") + 1).alias("cycle"), F.col("score").alias("previous"))
    return s.join(b, ["country", "cycle"]).select("country", "cycle", F.round("score", 4).alias("score"), F.round("previous", 4).alias("previous"))


@BOOK.query("j06_composite_features", f"with s as ({SCORES}), c as ({COVS}) select s.country, s.\"cycle\", round(score,4) score, round(\"value\",6) discount, round(tax,6) tax from s left join c using (country, \"cycle\")")
def j06(spark, d):
    return scores(spark, d).join(covariates(spark, d), ["country", "cycle"], "left").select("country", "cycle", F.round("score", 4).alias("score"), r6("value").alias("discount"), r6("tax").alias("tax"))


@BOOK.query("j07_lag_program_cycle", f"with s as ({SCORES}), c as (select \"cycle\", lag(\"cycle\") over (order by \"cycle\") p from (select distinct \"cycle\" from s)) select s.country, s.\"cycle\", round(b.score,4) lag_score from s join c using (\"cycle\") left join s b on b.country=s.country and b.\"cycle\"=c.p")
def j07(spark, d):
    return P.lag_cycle(scores(spark, d), ["program"], "country", "score", "lag_score").select("country", "cycle", F.round("lag_score", 4).alias("lag_score"))


@BOOK.query("j08_fixed_pairs", f"with s as ({SCORES}), c as ({COVS}), p(source_cycle,target_cycle) as (values (1995,1998),(1996,1999),(1997,2001)), b as (select distinct p.source_cycle, p.target_cycle, c.country from p join c on c.\"cycle\"=p.source_cycle join s on s.\"cycle\"=p.target_cycle and s.country=c.country) select p.source_cycle, p.target_cycle, p.target_cycle-p.source_cycle lag_years, count(b.country) n_overlap, string_agg(b.country,'|' order by b.country) countries from p left join b using (source_cycle,target_cycle) group by 1,2,3")
def j08(spark, d):
    pairs = spark.createDataFrame([(1995, 1998), (1996, 1999), (1997, 2001)], "source_cycle int, target_cycle int")
    return P.fixed_pairs(covariates(spark, d), scores(spark, d), pairs).select("source_cycle", "target_cycle", (F.col("target_cycle") - F.col("source_cycle")).alias("lag_years"), "n_overlap", "countries")


@BOOK.query("j09_target_explode", f"with c as ({COVS}) select country, t target_cycle, round(\"value\",6) v from c cross join (values (1998),(2000),(2001)) x(t) where \"cycle\"=1996")
def j09(spark, d):
    targets = F.explode(F.array(F.lit(1998), F.lit(2000), F.lit(2001))).alias("target_cycle")
    return covariates(spark, d).where("cycle = 1996").select("country", targets, r6("value").alias("v"))


@BOOK.query("j10_dimension_default", "select p_brand, coalesce(m.construct,'UNMAPPED') construct, count(*) n from part left join (values ('Brand#11','SES'),('Brand#12','ICT'),('Brand#13','SES')) m(b,construct) on p_brand=b group by 1,2")
def j10(spark, d):
    dim = spark.createDataFrame([("Brand#11", "SES"), ("Brand#12", "ICT"), ("Brand#13", "SES")], "p_brand string, construct string")
    return table(spark, d, "part").join(dim, "p_brand", "left").groupBy("p_brand", F.coalesce("construct", F.lit("UNMAPPED")).alias("construct")).agg(F.count("*").alias("n"))


@BOOK.query("j11_catalog_view", "with v as (select l_orderkey, count(*) n_vars, sum((l_returnflag='R')::int) n_weights from lineitem group by 1), c as (select o_orderkey, count(distinct o_custkey) n_countries from orders group by 1) select o_orderstatus status, count(*) n_files, sum(n_vars)::bigint n_variables, sum(n_weights)::bigint n_weights, sum(n_countries)::bigint n_countries from orders join c using (o_orderkey) left join v on l_orderkey=o_orderkey group by 1")
def j11(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_vars"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n_weights"))
    o = table(spark, d, "orders")
    c = o.groupBy("o_orderkey").agg(F.countDistinct("o_custkey").alias("n_countries"))
    return o.join(c, "o_orderkey").join(v, "o_orderkey", "left").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_files"), F.sum("n_vars").alias("n_variables"), F.sum("n_weights").alias("n_weights"), F.sum("n_countries").alias("n_countries"))


@BOOK.query("j11_catalog_view_fan_out", "select p_brand brand, count(distinct p_partkey) n_files, sum((l_returnflag='R')::int)::bigint n_weights, count(distinct n_nationkey) n_countries from part left join lineitem on l_partkey=p_partkey left join supplier on s_suppkey=l_suppkey left join nation on n_nationkey=s_nationkey group by 1")
def j11b(spark, d):
    """The literal three-way form, whose sums count a variable once per joined row."""
    p, l, s, n = (table(spark, d, t) for t in ("part", "lineitem", "supplier", "nation"))
    j = p.join(l, p.p_partkey == l.l_partkey, "left").join(s, l.l_suppkey == s.s_suppkey, "left").join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.groupBy(F.col("p_brand").alias("brand")).agg(F.countDistinct("p_partkey").alias("n_files"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n_weights"), F.countDistinct("n_nationkey").alias("n_countries"))


@BOOK.query("j12_full_outer", f"with s as ({SCORES}), a as (select country, avg(score) x from s where \"cycle\"<1998 and n>3 group by 1), b as (select country, avg(score) y from s where \"cycle\">=1998 and n>4 group by 1) select country, round(x,4) x, round(y,4) y, round(y-x,4) delta from a full outer join b using (country)")
def j12(spark, d):
    s = scores(spark, d)
    a, b = s.where("cycle < 1998 and n > 3").groupBy("country").agg(F.avg("score").alias("x")), s.where("cycle >= 1998 and n > 4").groupBy("country").agg(F.avg("score").alias("y"))
    return a.join(b, "country", "full_outer").select("country", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.col("y") - F.col("x"), 4).alias("delta"))


@BOOK.query("j14_inner_left", f"with s as ({SCORES}), c as ({COVS}) select a.country, round(a.score,4) s1, round(b.score,4) s2, round(c.\"value\",6) cov from s a join s b on a.country=b.country and a.\"cycle\"=1995 and b.\"cycle\"=1999 left join c on c.country=a.country and c.\"cycle\"=1995")
def j14(spark, d):
    s = scores(spark, d)
    a, b = s.where("cycle = 1995").select("country", F.col("score").alias("s1")), s.where("cycle = 1999").select("country", F.col("score").alias("s2"))
    c = covariates(spark, d).where("cycle = 1995").select("country", "value")
    return a.join(b, "country").join(c, "country", "left").select("country", F.round("s1", 4).alias("s1"), F.round("s2", 4).alias("s2"), r6("value").alias("cov"))


@BOOK.query("j15_semi_membership", "select c_mktsegment segment, count(*) n from customer where exists (select 1 from orders where o_custkey=c_custkey and o_orderstatus='F') group by 1")
def j15(spark, d):
    hit = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(hit, "c_custkey", "left_semi").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@BOOK.query("w01_lag_observed", f"with s as ({SCORES}) select country, \"cycle\", round(lag(score) over (partition by country order by \"cycle\"),4) lag_y from s")
def w01(spark, d):
    return P.lag_observed(scores(spark, d), ["program", "country"], "score", "lag_y").select("country", "cycle", F.round("lag_y", 4).alias("lag_y"))


@BOOK.query("w02_previous_cycle", f"with s as ({SCORES}) select program, \"cycle\", lag(\"cycle\") over (partition by program order by \"cycle\") previous from (select distinct program, \"cycle\" from s)")
def w02(spark, d):
    return P.previous_cycles(scores(spark, d), ["program"])


@BOOK.query("w03_rank_in_study", "select row_id, technique, row_number() over (partition by file_name, loaded_at order by ordinal, row_id)::int position from core_ml_techniques_all")
def w03(spark, d):
    t = table(spark, d, "core_ml_techniques_all")  # a file name may be shared by unrelated studies, a record's load time is its own
    return t.select("row_id", "technique", F.row_number().over(Window.partitionBy("file_name", "loaded_at").orderBy("ordinal", "row_id")).alias("position"))


@BOOK.query("w04_next_cycle", f"with s as ({SCORES}), c as (select \"cycle\", \"cycle\"-lag(\"cycle\") over (order by \"cycle\") g from (select distinct \"cycle\" from s)) select 'ORD' program, max(\"cycle\") last_cycle, (max(\"cycle\")+round_even(avg(g),0)::int)::int next_cycle from c")
def w04(spark, d):
    return P.next_cycle(scores(spark, d), ["program"])


@BOOK.query("w05_expanding_folds", f"with s as ({SCORES}), c as (select distinct \"cycle\" t from s), f as (select t from c where (select count(*) from c c2 where c2.t<c.t)>=2) select t test_cycle, sum((\"cycle\"<t)::int)::bigint n_train, sum((\"cycle\"=t)::int)::bigint n_test from s cross join f where \"cycle\"<=t group by 1")
def w05(spark, d):
    f = P.folds(scores(spark, d), ["program"], least_prior=2)
    return f.groupBy("test_cycle").agg(F.sum((F.col("role") == "train").cast("long")).alias("n_train"), F.sum((F.col("role") == "test").cast("long")).alias("n_test"))


@BOOK.query("w06_global_scaling", f"with s as ({SCORES}) select country, \"cycle\", round((score-(select min(score) from s))/((select max(score) from s)-(select min(score) from s)),6) scaled from s")
def w06(spark, d):
    from ..operators.synthesis import min_max

    return min_max(scores(spark, d), "score", "scaled").select("country", "cycle", r6("scaled").alias("scaled"))


@BOOK.query("w07_average_ranks", "select p_type, p_partkey, rank() over (partition by p_type order by p_size) + (count(*) over (partition by p_type, p_size)-1)/2.0 r from part")
def w07(spark, d):
    return P.average_ranks(table(spark, d, "part").select("p_type", "p_partkey", "p_size"), ["p_type"], "p_size", "r").select("p_type", "p_partkey", "r")


@BOOK.query("t01_sorted_weights", "select p_brand, round(sum(p_retailprice),4) w from part group by 1 order by w desc, p_brand limit 10")
def t01(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 4).alias("w")).orderBy(F.desc("w"), "p_brand").limit(10)


@BOOK.query("t02_largest_wins", "select l_returnflag flag, max_by(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) orderkey from lineitem group by 1")
def t02(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("orderkey"))


@BOOK.query("t06_first_elements", "select row_id, array_to_string(string_split(authors,'; ')[1:3],'|') first_three from metadata where authors is not null")
def t06(spark, d):
    return table(spark, d, "metadata").where("authors is not null").select("row_id", F.array_join(F.slice(F.split("authors", "; "), 1, 3), "|").alias("first_three"))


@BOOK.query("u02_intersection", "select c_nationkey nation from customer where c_acctbal>9000 intersect select s_nationkey from supplier where s_acctbal>5000")
def u02(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")))


@BOOK.query("u03_difference", "select distinct file_name from core_data where file_name is not null except select file_name from metadata")
def u03(spark, d):
    return table(spark, d, "core_data").select("file_name").where("file_name is not null").distinct().join(table(spark, d, "metadata").select("file_name"), "file_name", "left_anti")


@BOOK.query("u04_keep_first", "select file_name, row_id, corpus from (select *, row_number() over (partition by file_name order by row_id) r from metadata where file_name is not null) where r=1")
def u04(spark, d):
    g = table(spark, d, "metadata").where("file_name is not null").groupBy("file_name").agg(F.min(F.struct("row_id", "corpus")).alias("f"))
    return g.select("file_name", "f.row_id", "f.corpus")


@BOOK.query("u01_union_by_name", "select 'metadata' t, count(*) n, count(doi) n_doi from metadata union all select 'core_data', count(*), 0 from core_data")
def u01(spark, d):
    a = table(spark, d, "metadata").select(F.lit("metadata").alias("t"), "file_name", "doi")
    b = table(spark, d, "core_data").select(F.lit("core_data").alias("t"), "file_name")
    return a.unionByName(b, allowMissingColumns=True).groupBy("t").agg(F.count("*").alias("n"), F.count("doi").alias("n_doi"))


@BOOK.query("u05_ordered_unique", "select file_name, loaded_at, string_agg(technique,'|' order by o) techniques from (select file_name, loaded_at, technique, min((ordinal,row_id)) o from core_ml_techniques_all where technique is not null group by 1,2,3) group by 1,2")
def u05(spark, d):
    t = table(spark, d, "core_ml_techniques_all").where("technique is not null")
    first = t.groupBy("file_name", "loaded_at", "technique").agg(F.min(F.struct("ordinal", "row_id")).alias("o"))
    return first.groupBy("file_name", "loaded_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "technique"))), lambda x: x["technique"]), "|").alias("techniques"))


@BOOK.query("r02_pivot_mean", f"with s as ({SCORES}) select country, " + ", ".join(f"round(avg(score) filter (where \"cycle\"={y}),4) y{y}" for y in YEARS) + " from s group by 1")
def r02(spark, d):
    w = P.pivot(scores(spark, d), ["country"], "cycle", "score", YEARS, prefix="y")
    return w.select("country", *[F.round(f"y{y}", 4).alias(f"y{y}") for y in YEARS])


@BOOK.query("r01_pivot_first", "select c_nationkey country, " + ", ".join(f"arg_min(o_totalprice, o_orderkey) filter (where year(o_orderdate)={y} and o_totalprice is not null) y{y}" for y in YEARS) + " from orders join customer on o_custkey=c_custkey group by 1")
def r01(spark, d):
    """Wide covariates: the first value that is there, by the key of its row."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("country"), F.year("o_orderdate").alias("cycle"), "o_totalprice", "o_orderkey")
    return P.pivot(j, ["country"], "cycle", "o_totalprice", YEARS, "first", "y", "o_orderkey")


_DOMAINS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")
_BY_DOMAIN = "select n_name country, year(o_orderdate)::int cy, c_mktsegment dom, avg(o_totalprice) v from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1,2,3"


def _domain_scores(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").alias("cycle"), F.concat(F.lit("ORD_"), "c_mktsegment").alias("program_domain")).agg(F.avg("o_totalprice").alias("v"))


@BOOK.query("r03_pivot_domains", f"with s as ({_BY_DOMAIN}) select country, cy as \"cycle\", " + ", ".join(f"round(avg(v) filter (where dom='{x}'),4) \"ORD_{x}\"" for x in _DOMAINS) + " from s group by 1,2")
def r03(spark, d):
    """Scores of each programme and domain side by side."""
    w = P.pivot(_domain_scores(spark, d), ["country", "cycle"], "program_domain", "v", [f"ORD_{x}" for x in _DOMAINS])
    return w.select("country", "cycle", *[F.round(f"ORD_{x}", 4).alias(f"ORD_{x}") for x in _DOMAINS])


@BOOK.query("r05_unpivot_outcomes", f"with s as ({_BY_DOMAIN}) select country, cy as \"cycle\", 'ORD_'||dom outcome, 'ORD' program, dom as \"domain\", round(v,4) v from s where dom in {_DOMAINS} and v is not null")
def r05(spark, d):
    """Outcomes one below the other again, with the programme and domain of their names."""
    long = P.unpivot(r03(spark, d), ["country", "cycle"], [f"ORD_{x}" for x in _DOMAINS], "outcome", "v")
    return long.select("country", "cycle", "outcome", F.split_part("outcome", F.lit("_"), F.lit(1)).alias("program"), F.split_part("outcome", F.lit("_"), F.lit(2)).alias("domain"), F.col("v").cast("double").alias("v"))


@BOOK.query("r04_unpivot", f"with c as ({COVS}) select country, \"cycle\", construct, round(v,6) v from (select country, \"cycle\", \"value\" discount, tax from c) unpivot (v for construct in (discount, tax))")
def r04(spark, d):
    return P.unpivot(covariates(spark, d).withColumnRenamed("value", "discount"), ["country", "cycle"], ["discount", "tax"], value="v").select("country", "cycle", "construct", r6("v").alias("v"))


@BOOK.query("r10_unstack_zero", "select c_mktsegment segment, " + ", ".join(f"sum((c_nationkey={k})::int)::bigint n{k}" for k in range(5)) + " from customer group by 1")
def r10(spark, d):
    w = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).pivot("c_nationkey", list(range(5))).count().na.fill(0)
    return w.select("segment", *[F.col(str(k)).alias(f"n{k}") for k in range(5)])


@BOOK.query("r09_split_packed", "select unnest(string_split(authors,'; ')) author, count(*) n from metadata where authors is not null group by 1")
def r09(spark, d):
    return table(spark, d, "metadata").where("authors is not null").select(F.explode(F.split("authors", "; ")).alias("author")).groupBy("author").agg(F.count("*").alias("n"))


@BOOK.query("d06_seen_titles", "select row_id from (select row_id, row_number() over (partition by left(lower(coalesce(doi,title)),120) order by row_id) r from metadata where coalesce(doi,title) is not null) where r=1")
def d06(spark, d):
    m = table(spark, d, "metadata").where("coalesce(doi, title) is not null")
    return m.groupBy(F.left(F.lower(F.coalesce("doi", "title")), F.lit(120)).alias("k")).agg(F.min("row_id").alias("row_id")).select("row_id")


@BOOK.query("d03_confounder_dedupe", "select upper(trim(weight_variable_name)) code, lower(coalesce(ml_technique_primary,'')) name, count(*) n, min(row_id) row_id from core_data where weight_variable_name is not null group by 1,2")
def d03(spark, d):
    return table(spark, d, "core_data").where("weight_variable_name is not null").groupBy(F.upper(F.trim("weight_variable_name")).alias("code"), F.lower(F.coalesce("ml_technique_primary", F.lit(""))).alias("name")).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))


@BOOK.query("s18_prefer_copy", r"with f as (select row_id, file_name, regexp_replace(file_name,' ?\([0-9]+\)(\.pdf)$','\1') base, regexp_matches(file_name,'\(1\)\.pdf$') c from metadata where file_name is not null) select base, row_id, file_name from (select *, row_number() over (partition by base order by c desc, row_id) r from f) where r=1")
def s18(spark, d):
    f = table(spark, d, "metadata").where("file_name is not null").select("row_id", "file_name", F.regexp_replace("file_name", r" ?\([0-9]+\)(\.pdf)$", "$1").alias("base"), F.col("file_name").rlike(r"\(1\)\.pdf$").alias("c"))
    g = f.groupBy("base").agg(F.min(F.struct((~F.col("c")).alias("x"), "row_id", "file_name")).alias("f"))
    return g.select("base", "f.row_id", "f.file_name")


@BOOK.query("s04_corpus_rank", "select m.row_id, coalesce(t.trust_rank, 99) corpus_rank from metadata m left join corpus_trust t using (corpus)")
def s04(spark, d):
    return table(spark, d, "metadata").join(table(spark, d, "corpus_trust"), "corpus", "left").select("row_id", F.coalesce("trust_rank", F.lit(99)).alias("corpus_rank"))
