"""Queries of the general data-pipeline operators: column profile and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import profiles, shifts, violations
from ..operators.shred import article_children, article_levels
from ..session import table

DOI_FORM = r"^10\.[0-9]{4,9}/[^\s\p{Z}]*[A-Za-z0-9]$"
STUDENTS = (1, 2_000_000)
#: fixed values: the vocabulary of plausible_values_handling
PV_WORDS = ("rubin_rules", "single_pv", "average_pv", "all_pv", "mitml", "wle", "irt_theta", "not_applicable", "not_reported")


def _kinds(df: DataFrame, skip: tuple[str, ...]) -> dict:
    out = {}
    for name, kind in df.dtypes:
        if name not in skip and not kind.startswith(("array", "map", "struct", "binary")):
            out[name] = (F.col(name), "string" if kind == "string" else "timestamp" if kind.startswith("timestamp") else "whole" if kind in ("bigint", "int", "smallint", "tinyint") else "number")
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "metadata").select("row_id", "load_no", "doi")
    core = table(spark, sf_dir, "core_data").select("row_id", "load_no", "total_students", "plausible_values_handling")
    filled = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike(r"^[\s\p{Z}]*$")
    inside = F.col("total_students").between(*STUDENTS)
    broken = violations(meta, "metadata", "row_id", [("doi", "pattern", filled("doi") & ~F.col("doi").rlike(DOI_FORM))]).unionByName(
        violations(core, "core_data", "row_id", [("total_students", "range", F.col("total_students").isNotNull() & ~inside), ("plausible_values_handling", "vocabulary", filled("plausible_values_handling") & ~F.col("plausible_values_handling").isin(*PV_WORDS))])
    )
    found = profiles([(meta, "metadata", "load_no", {"doi": (F.col("doi"), "string")}), (core, "core_data", "load_no", {"total_students": (F.col("total_students"), "whole"), "total_students in range": (F.when(inside, F.col("total_students")), "whole"), "plausible_values_handling": (F.col("plausible_values_handling"), "string")})])
    moved = shifts(found, medians_of={"total_students": "total_students in range"}, shares_of=("plausible_values_handling",))
    return broken.unionByName(moved)


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every scalar column of both tables, ids and load numbers left out."""
    skip = ("row_id", "load_no")
    meta, core = table(spark, sf_dir, "metadata"), table(spark, sf_dir, "core_data")
    every = profiles([(meta, "metadata", "load_no", _kinds(meta, skip)), (core, "core_data", "load_no", _kinds(core, skip))])
    return every.select("table_name", "column_name", "load_no", "n_rows", "n_null", "n_distinct", "min_value", "max_value", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75", "ks_previous", "share_change_previous")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_children(table(spark, sf_dir, "article_records").select("record_id", "payload"))


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_levels(table(spark, sf_dir, "article_records").select("record_id", "payload"))


P4_SQL = r"""
with m as (select row_id, load_no, case when not regexp_full_match(doi, '[\s\p{Z}]*') then doi end v from metadata),
c as (select row_id, load_no, total_students s, case when total_students between 1 and 2000000 then total_students end ok,
  case when not regexp_full_match(plausible_values_handling, '[\s\p{Z}]*') then plausible_values_handling end v from core_data),
nulls as (select 'metadata' t, 'doi' c, load_no, avg(case when v is null then 1.0 else 0 end) x, null::double med from m group by load_no
  union all select 'core_data', 'total_students', load_no, avg(case when s is null then 1.0 else 0 end), median(ok) from c group by load_no
  union all select 'core_data', 'plausible_values_handling', load_no, avg(case when v is null then 1.0 else 0 end), null from c group by load_no),
lagged as (select *, lag(x) over w px, lag(med) over w pmed from nulls window w as (partition by t, c order by load_no)),
loads as (select distinct load_no from c), words as (select distinct v from c where v is not null),
shares as (select l.load_no, w.v, sum(case when c.v = w.v then 1 else 0 end) / nullif(count(c.v), 0) p
  from loads l cross join words w join c on c.load_no = l.load_no group by l.load_no, w.v),
moved as (select distinct load_no from (select load_no, p - lag(p) over (partition by v order by load_no) d from shares) where abs(d) > 0.2)
select 'metadata' table_name, 'doi' column_name, 'pattern' finding, row_id ref_id from m
  where v is not null and not regexp_full_match(v, '10\.[0-9]{4,9}/[^\s\p{Z}]*[A-Za-z0-9]')
union all select 'core_data', 'total_students', 'range', row_id from c where s is not null and ok is null
union all select 'core_data', 'plausible_values_handling', 'vocabulary', row_id from c
  where v not in ('rubin_rules','single_pv','average_pv','all_pv','mitml','wle','irt_theta','not_applicable','not_reported')
union all select t, c, 'shift', load_no from (
  select t, c, load_no from lagged where abs(x - px) > 0.2 or med > 2 * pmed or pmed > 2 * med
  union select 'core_data', 'plausible_values_handling', load_no from moved)
"""

_TEXT = {"metadata": "corpus file_name title title_lang authors doi venue publication_type source_category", "core_data": "file_name research_design_type student_weights_used replicate_weights_used weight_variable_name plausible_values_handling missing_data_handling ml_technique_primary feature_selection baseline_model xai_method"}
_NUMBER = {"metadata": "pub_year open_access extraction_cost_usd prompt_tokens completion_tokens", "core_data": "total_students"}
_TIME = {"metadata": "extraction_timestamp", "core_data": "loaded_at"}


def _unpivoted() -> str:
    parts = []
    for t in _TEXT:
        parts += [f"select '{t}' t, '{c}' c, load_no l, null::double num, case when not regexp_full_match({c}, '[\\s\\p{{Z}}]*') then {c} end str from {t}" for c in _TEXT[t].split()]
        parts += [f"select '{t}', '{c}', load_no, {c}::double, null from {t}" for c in _NUMBER[t].split()]
        parts += [f"select '{t}', '{c}', load_no, epoch_us({c})::double/1e6, null from {t}" for c in _TIME[t].split()]
    return " union all ".join(parts)


PROFILE_SQL = f"""
with u as ({_unpivoted()}), f as (select * from u where num is not null or str is not null),
b as (select t, c, l, count(*) n_rows, sum((num is null and str is null)::int)::bigint n_null from u group by all),
v as (select t, c, num, str, row_number() over (partition by t, c order by num, str) k from (select distinct t, c, num, str from f)),
d as (select f.t, f.c, f.l, v.k, count(*) n from f join v on f.t=v.t and f.c=v.c and f.num is not distinct from v.num and f.str is not distinct from v.str group by all),
g as (select v.t, v.c, v.k, b.l from v join b on v.t=b.t and v.c=b.c),
x as (select g.*, coalesce(d.n, 0) n, sum(coalesce(d.n, 0)) over (partition by g.t, g.c, g.l order by g.k) cum, sum(coalesce(d.n, 0)) over (partition by g.t, g.c, g.l) tot from g left join d using (t, c, l, k)),
y as (select t, c, k, l, case when tot>0 then cum/tot end cdf, case when tot>0 then n/tot end sh from x),
z as (select t, c, l, k, cdf - lag(cdf) over w dc, sh - lag(sh) over w ds from y window w as (partition by t, c, k order by l)),
ks as (select t, c, l, max(abs(dc)) ks, max(abs(ds)) sc from z group by all),
q as (select t, c, l, count(distinct (num, str)) n_distinct, coalesce(min(num)::varchar, min(str)) mn, coalesce(max(num)::varchar, max(str)) mx, quantile_cont(num, 0.25) q25, quantile_cont(num, 0.5) q50, quantile_cont(num, 0.75) q75 from f group by all)
select b.t table_name, b.c column_name, b.l load_no, b.n_rows, b.n_null, coalesce(q.n_distinct, 0) n_distinct, q.mn min_value, q.mx max_value,
  round(q.q25, 6) q25, round(q.q50, 6) q50, round(q.q75, 6) q75, round(ks.ks, 6) ks_previous, round(ks.sc, 6) share_change_previous
from b left join q using (t, c, l) left join ks using (t, c, l)
"""

QUERIES = {"p4_found": p4_found, "p4_profile": p4_profile, "p6_found": p6_found, "p6_levels": p6_levels}
SQL = {"p4_found": P4_SQL, "p4_profile": PROFILE_SQL}
