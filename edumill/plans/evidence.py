"""Aggregations of coded evidence and queries on article records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions import text as T
from ..operators import records as R
from ..operators import synthesis as Y
from ..session import broadcast_if_small, table
from .base import Book, r6
from .textual import _CLASS, BLANK, MISS, variable_sql

BOOK = Book()


def coded(spark, d):
    """Coded findings: brand is the method, type the variable, the return flag the trend, the supplier the study."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    trend = F.when(F.col("l_returnflag") == "A", "Positive").when(F.col("l_returnflag") == "R", "Negative").otherwise("Null")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("p_brand").alias("method"), F.col("p_type").alias("variable"), trend.alias("trend"), F.col("l_suppkey").alias("study"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_linestatus", "p_size")


CODED = "select p_brand \"method\", p_type variable, case l_returnflag when 'A' then 'Positive' when 'R' then 'Negative' else 'Null' end trend, l_suppkey study, l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity, l_linestatus, p_size from lineitem join part on l_partkey=p_partkey"
CUBE = f"select \"method\", variable, trend, count(distinct study) study_count from ({CODED}) group by 1,2,3"


@BOOK.query("a11_synthesis_cube", CUBE)
def a11(spark, d):
    return Y.cube(coded(spark, d))


@BOOK.query("a12_predictor_weights", f"""with c as ({CUBE}), t as (select variable, trend, sum(study_count) n from c group by 1,2), f as (select variable, sum(n) f, max(n) top, arg_min(trend, (-n, trend)) dominant_trend from t group by 1), m as (select variable, count(distinct \"method\") d from c group by 1), w as (select variable, f::double F_raw, d::double D_raw, top/f C_raw, dominant_trend, f*d*(top/f) w_raw from f join m using (variable))
select variable, F_raw, D_raw, round(C_raw,6) C_raw, dominant_trend, round(w_raw,4) w_raw, round(case when (select max(w_raw) from w)>(select min(w_raw) from w) then (w_raw-(select min(w_raw) from w))/((select max(w_raw) from w)-(select min(w_raw) from w)) else 1 end,6) w_norm from w""")
def a12(spark, d):
    w = Y.predictor_weights(Y.cube(coded(spark, d)))
    return w.select("variable", "F_raw", "D_raw", r6("C_raw").alias("C_raw"), "dominant_trend", F.round("w_raw", 4).alias("w_raw"), r6("w_norm").alias("w_norm"))


EFFECTS = f"""select variable predictor, l_linestatus program, "method" "domain", trend direction, case p_size%3 when 0 then 'R2' when 1 then 'beta' else 'accuracy' end effect_type, l_discount effect_value, l_quantity<=25 pv_correct, l_linenumber<>2 weight_correct, case p_size%4 when 0 then 'high' when 1 then 'medium' else 'low' end quality from ({CODED})"""


def effects(spark, d):
    c = coded(spark, d)
    return c.select(
        F.col("variable").alias("predictor"), F.col("l_linestatus").alias("program"), F.col("method").alias("domain"), F.col("trend").alias("direction"), F.when(F.col("p_size") % 3 == 0, "R2").when(F.col("p_size") % 3 == 1, "beta").otherwise("accuracy").alias("effect_type"), F.col("l_discount").alias("effect_value"),
        (F.col("l_quantity") <= 25).alias("pv_correct"), (F.col("l_linenumber") != 2).alias("weight_correct"), F.when(F.col("p_size") % 4 == 0, "high").when(F.col("p_size") % 4 == 1, "medium").otherwise("low").alias("quality"),
    )


@BOOK.query("a13_effect_weights", f"""with e as ({EFFECTS}), q as (select *, (case when pv_correct then 1 else 0.5 end)*(case when weight_correct then 1 else 0.7 end)*(case quality when 'high' then 1.0 when 'medium' then 0.8 else 0.5 end) q, case when effect_type='R2' then sqrt(abs(effect_value)) when effect_type='beta' then abs(effect_value) end s from e),
dd as (select predictor, direction, count(*) n from q group by 1,2), dm as (select predictor, max(n)/sum(n) c, arg_min(direction,(-n,direction)) dominant_direction from dd group by 1),
g as (select predictor, sum(q)::double F_raw, count(distinct (program,"domain"))::double D_raw, quantile_cont(s,0.5) E_raw, count(*) effect_count from q group by 1), j as (select * from g join dm using (predictor)),
n as (select *, case when (select max(E_raw) from j)>(select min(E_raw) from j) then coalesce((E_raw-(select min(E_raw) from j))/((select max(E_raw) from j)-(select min(E_raw) from j)),0.5) else 0.5 end E_norm from j), w as (select *, F_raw*D_raw*c*E_norm w_raw from n)
select predictor, round(F_raw,4) F_raw, D_raw, round(c,6) C_raw, round(E_raw,6) E_raw, round(E_norm,6) E_norm, dominant_direction, effect_count, round((w_raw-(select min(w_raw) from w))/nullif((select max(w_raw) from w)-(select min(w_raw) from w),0),6) w_norm from w""")
def a13(spark, d):
    w = Y.effect_weights(effects(spark, d))
    return w.select("predictor", F.round("F_raw", 4).alias("F_raw"), "D_raw", r6("C_raw").alias("C_raw"), r6("E_raw").alias("E_raw"), r6("E_norm").alias("E_norm"), "dominant_direction", "effect_count", r6("w_norm").alias("w_norm"))


@BOOK.query("a14_provenance", f"""with c as ({CODED}), t as (select variable, trend, count(*) n from c group by 1,2), dom as (select variable, arg_min(trend, (-n, trend)) dominant from t group by 1),
o as (select variable, list_sort(list_distinct(flatten(list([l_linestatus, l_linenumber::varchar])))) places from c group by 1)
select c.variable, count(distinct study) n_studies, count(distinct "method") n_programs, count(distinct l_linenumber) n_cycles, any_value(len(places)) n_places, array_to_string(any_value(places),'|') places, round(avg((trend='Positive')::int),6) predictive_share, any_value(dominant) dominant_direction, any_value(dominant)='Positive' agrees, min(p_size) first_year, max(p_size) last_year from c join dom using (variable) join o using (variable) group by 1""")
def a14(spark, d):
    """Provenance of every variable: distinct studies, programmes, cycles and listed places, the direction that most rows have and whether it is the canonical one, years."""
    return Y.provenance(coded(spark, d).withColumn("places", F.array(F.col("l_linestatus"), F.col("l_linenumber").cast("string"))), "variable", "study", "method", "l_linenumber", "places", "trend", "p_size", "Positive").withColumn("predictive_share", r6("predictive_share"))


_CLIP = "least(greatest({0},0.01),1.0)"


@BOOK.query("a15_priority", f"""with p as (select variable, count(distinct study) s, count(distinct "method") g, count(distinct l_linenumber) c, count(distinct p_size) k, avg((trend='Positive')::int) ps from ({CODED}) group by 1),
w as (select variable, exp((ln({_CLIP.format('ln(1+s)/(select max(ln(1+s)) from p)')})+ln({_CLIP.format('g/8.0')})+ln({_CLIP.format('c/8.0')})+ln({_CLIP.format('k/50.0')}))/4) w_geo, ps from p), v as (select variable, w_geo, w_geo*least(greatest(1+0.3*ps,1.0),1.3) r from w)
select variable, round(w_geo,6) w_geo, round(r/(select max(r) from v),6) w_j from v""")
def a15(spark, d):
    prof = coded(spark, d).groupBy("variable").agg(F.countDistinct("study").alias("n_studies"), F.countDistinct("method").alias("n_programs"), F.countDistinct("l_linenumber").alias("n_cycles"), F.countDistinct("p_size").alias("n_countries"), F.avg((F.col("trend") == "Positive").cast("int")).alias("predictive_share"))
    return Y.priority(prof).select("variable", r6("w_geo").alias("w_geo"), r6("w_j").alias("w_j"))


@BOOK.query("a16_first_non_null", "select file_name, arg_min(doi,row_id) filter (where doi is not null) doi, arg_min(title,row_id) filter (where title is not null) title, arg_min(pub_year,row_id) filter (where pub_year is not null) pub_year from metadata where file_name is not null group by 1")
def a16(spark, d):
    return Y.first_non_null(table(spark, d, "metadata").where("file_name is not null"), ["file_name"], ["doi", "title", "pub_year"], "row_id")


@BOOK.query("a17_any_per_group", "select file_name, bool_or(technique ilike '%forest%') any_forest, bool_or(technique is null) any_missing from core_ml_techniques_all where file_name is not null group by 1")
def a17(spark, d):
    return table(spark, d, "core_ml_techniques_all").where("file_name is not null").groupBy("file_name").agg(F.bool_or(F.col("technique").ilike("%forest%")).alias("any_forest"), F.bool_or(F.col("technique").isNull()).alias("any_missing"))


_SECTIONS = {"Corpus": {"venue": "venue", "publication_type": "publication_type", "pub_year": "pub_year"}, "Files": {"corpus": "corpus", "source_category": "source_category"}}


def _section_sql(section: str, name: str, col: str) -> str:
    return f"select '{section}' section, '{name}' dimension, {col}::varchar label, count(*) n from metadata where {col} is not null group by 3"


@BOOK.query("a18_dashboard", "with c as (" + " union all ".join(_section_sql(s, n, c) for s, ds in _SECTIONS.items() for n, c in ds.items()) + ") select section, dimension, label, n from (select *, row_number() over (partition by section, dimension order by n desc, label) r from c) where r<=5 union all select 'Totals', 'rows', 'all', count(*) from metadata")
def a18(spark, d):
    """A dashboard of sections: the most frequent values of their dimensions, and the total."""
    m = table(spark, d, "metadata")
    cells = Y.value_counts(m, {f"{s}|{n}": F.col(c) for s, ds in _SECTIONS.items() for n, c in ds.items()}, top=5)
    rows = cells.select(F.split_part("dimension", F.lit("|"), F.lit(1)).alias("section"), F.split_part("dimension", F.lit("|"), F.lit(2)).alias("dimension"), "label", "n")
    return rows.unionByName(m.agg(F.lit("Totals").alias("section"), F.lit("rows").alias("dimension"), F.lit("all").alias("label"), F.count("*").alias("n")))


_PROFILED = ("file_name", "title", "authors", "doi", "venue", "publication_type", "source_category")


@BOOK.query("a19_missing_profile", " union all ".join(f"select '{c}' column_name, count(*) n_rows, sum((not coalesce(trim({c}) in ('','nan','NaN'),true))::int)::bigint n_filled, round(1-sum((not coalesce(trim({c}) in ('','nan','NaN'),true))::int)/count(*),6) missing_rate from metadata" for c in _PROFILED))
def a19(spark, d):
    return Y.filled_profile(table(spark, d, "metadata"), list(_PROFILED)).select("column_name", "n_rows", "n_filled", r6("missing_rate").alias("missing_rate"))


@BOOK.query("a21_evidence_summary", f"with g as (select variable, trend, count(distinct study) n_studies, count(*) n_rows, min(p_size)::varchar||'-'||max(p_size)::varchar \"years\" from ({CODED}) group by 1,2) select *, round(n_rows/(select max(n_rows) from g),6) frequency from g")
def a21(spark, d):
    g = coded(spark, d).groupBy("variable", "trend").agg(F.countDistinct("study").alias("n_studies"), F.count("*").alias("n_rows"), F.concat_ws("-", F.min("p_size").cast("string"), F.max("p_size").cast("string")).alias("years"))
    return g.withColumn("frequency", r6(F.col("n_rows") / g.agg(F.max("n_rows")).scalar()))


_POLICY = " ".join(f"when v='{k}' then '{x}'" for k, x in O.POLICY_DOMAINS.items())
_VARCASE = " ".join(f"when regexp_matches(title,'(?i){p}') then '{l}'" for l, p in O.joined(O.VARIABLES))


@BOOK.query("a23_policy_insight", f"""with m as (select row_id, corpus, case {_VARCASE} end v, regexp_matches(title,'(?i){O.POLICY_WORDS}') pol from metadata where title is not null), p as (select *, case {_POLICY} end "domain" from m)
select corpus, coalesce("domain",'No signal') "domain", count(*) n_signals, sum(pol::int)::bigint n_policy, round(least(1.0, least(0.30+0.05*(count(*)-1),0.45)+(case when sum(pol::int)>0 then 0.10 else 0 end)),2) confidence from p group by 1,2""")
def a23(spark, d):
    m = table(spark, d, "metadata").where("title is not null")
    v = F.col("v")
    chain = None
    for k, x in O.POLICY_DOMAINS.items():
        chain = F.when(v == k, x) if chain is None else chain.when(v == k, x)
    domain = F.coalesce(chain, F.lit("No signal"))
    p = m.select("corpus", O.folded_once(F.col("title"), lambda x: O.first_listed(x, O.VARIABLES)).alias("v"), F.col("title").rlike("(?i)" + O.POLICY_WORDS).alias("pol"))
    g = p.groupBy("corpus", domain.alias("domain")).agg(F.count("*").alias("n_signals"), F.sum(F.col("pol").cast("long")).alias("n_policy"))
    conf = F.least(F.lit(1.0), F.least(0.30 + 0.05 * (F.col("n_signals") - 1), F.lit(0.45)) + F.when(F.col("n_policy") > 0, 0.10).otherwise(0.0))
    return g.withColumn("confidence", F.round(conf, 2))


@BOOK.query("a25_fold_summary", f"with f as (select \"method\" fold, avg(l_discount) m from ({CODED}) group by 1) select count(*) n, round(avg(m),6) mean, round(quantile_cont(m,0.5),6) median, round(stddev_pop(m),8) sd from f")
def a25(spark, d):
    f = coded(spark, d).groupBy(F.col("method").alias("fold")).agg(F.avg("l_discount").alias("m"))
    return f.agg(F.count("*").alias("n"), r6(F.avg("m")).alias("mean"), r6(F.percentile("m", 0.5)).alias("median"), F.round(F.stddev_pop("m"), 8).alias("sd"))


@BOOK.query("a26_overlap_counts", "select n_name country, " + ", ".join(f"count(distinct case when year(o_orderdate)={y} then c_custkey end) y{y}" for y in range(1995, 2002)) + " from orders join customer on o_custkey=c_custkey join nation on n_nationkey=c_nationkey group by 1")
def a26(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    w = j.withColumn("yr", F.year("o_orderdate")).groupBy(F.col("n_name").alias("country")).pivot("yr", list(range(1995, 2002)))
    wide = w.agg(F.countDistinct("c_custkey"))
    return wide.select("country", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in range(1995, 2002)])


def _records(spark, d):
    return R.parsed(table(spark, d, "article_records").select("record_id", "payload"))


_J = "select record_id, payload::json j from article_records where json_valid(payload) and json_type(payload::json)='OBJECT' and json_type(payload::json,'$.metadata')='OBJECT' and json_type(payload::json,'$.data')='OBJECT'"


@BOOK.query("p01_master_projection", f"select record_id, j->>'$.metadata.file_name' file_name, j->>'$.metadata.title' title, try_cast(j->>'$.metadata.year' as int) pub_year, regexp_replace(trim(j->>'$.metadata.doi'),'(?i)^(https?://(dx\\.)?doi\\.org/|doi:?\\s*)','') doi, j->>'$.data.plausible_values_handling' plausible_values_handling from ({_J})")
def p01(spark, d):
    return R.master(_records(spark, d)).select("record_id", "file_name", "title", F.col("year").alias("pub_year"), "doi", "plausible_values_handling")


def _path(name: str) -> str:
    return f"j->>'$.{name}'"


_PLAIN = {
    "file_name": "metadata.file_name", "doi": "metadata.doi", "title": "metadata.title", "year": "metadata.year", "publication_type": "metadata.publication_type", "source_category": "metadata.source_category", "venue": "metadata.venue", "open_access": "metadata.open_access",
    "student_weights_used": "data.survey_design.student_weights_used", "replicate_weights_used": "data.survey_design.replicate_weights_used", "weight_variable_name": "data.survey_design.weight_variable_name", "weight_fields_interpretation": "data.survey_design.weight_fields_interpretation",
    "plausible_values_handling": "data.plausible_values_handling", "missing_data_handling": "data.missing_data_handling", "handling_not_reported_explanation": "data.handling_not_reported_explanation", "research_design_type": "data.research_design_type", "outcome_summary": "data.outcome_summary",
    "null_fields_interpretation": "data.null_fields_interpretation", "ml_primary": "data.ml_techniques.primary", "total_students": "data.sample_details.total_students", "sample_filtering_criteria": "data.sample_details.sample_filtering_criteria",
}


def _joined(path: str) -> str:
    items = f"list_filter(list_transform(json_extract(try_cast({_path(path)} as json),'$[*]'), lambda x: trim(x->>'$')), lambda x: x is not null and x != '')"
    return f"nullif(case when left(trim({_path(path)}),1)='[' then array_to_string({items},', ') else trim({_path(path)}) end,'')"


_WITH_CORPUS = "select a.record_id, corpus, payload::json j from article_records a where json_valid(payload) and json_type(payload::json)='OBJECT' and json_type(payload::json,'$.metadata')='OBJECT' and json_type(payload::json,'$.data')='OBJECT'"
_COUNTRIES = _path("data.sample_details.countries")
_FORMATTED = f"""case when left(trim({_COUNTRIES}),1)='[' then nullif(array_to_string(list_transform(list_filter(json_extract(try_cast({_COUNTRIES} as json),'$[*]'), lambda x: json_type(x)='OBJECT'),
 lambda x: coalesce(nullif(upper(trim(x->>'$.country_code')),''),'Unknown')||case when coalesce(trim(x->>'$.n_students'),'')='' then '' else ' ('||trim(x->>'$.n_students')||')' end),', '),'') end"""


@BOOK.query("p01_master_full", f"select record_id, {', '.join(_path(p) + ' as "' + n + '"' for n, p in _PLAIN.items())}, {_joined('metadata.authors')} authors, {_joined('data.ml_techniques.all_techniques')} ml_all_techniques, corpus corpus_source, 'record/'||record_id json_source_path, {_FORMATTED} countries_formatted, case when trim({_COUNTRIES}) not in ('','[]','{{}}') then {_COUNTRIES} end countries_json from ({_WITH_CORPUS})")
def p01_full(spark, d):
    """All 27 columns of the master table."""
    return R.master_full(R.parsed(table(spark, d, "article_records").select("record_id", "corpus", "payload")))


_MASTER = BOOK.sql["p01_master_full"]
_OPEN = "case when {0} then 'UNKNOWN' when lower(\"{1}\")='true' then 'TRUE' when lower(\"{1}\")='false' then 'FALSE' else \"{1}\" end"
_FILLS = {c: "UNKNOWN — not in extraction" for c in ("doi", "venue", "authors")} | {"countries_formatted": "No country breakdown reported"} | {c: "Not reported in extraction" for c in ("research_design_type", "publication_type", "source_category", "weight_variable_name", "total_students")}
_FLAGS = ("open_access", "student_weights_used", "replicate_weights_used")
_FIRST = f"case when not {BLANK.format('ml_primary')} then ml_primary else coalesce(nullif(trim(string_split(ml_all_techniques,',')[1]),''),'Not reported in extraction') end"


@BOOK.query("p04_sentinel_master", "select record_id, " + ", ".join(f'case when {BLANK.format(chr(34) + c + chr(34))} then {v!r} else "{c}" end as "{c}"' for c, v in _FILLS.items()) + ", " + ", ".join(_OPEN.format(BLANK.format(c), c) + f" as {c}" for c in _FLAGS) + f", {_FIRST} ml_primary from ({_MASTER})")
def p04_master(spark, d):
    """The sentinel fill of all master columns that have one; nothing is imputed."""
    return R.sentinels(p01_full(spark, d), _FILLS, _FLAGS)


_MASKED = "replace(" * len(O.FALSE_SIGNALS) + "lower(coalesce(title,''))" + "".join(f",'{p}',' ')" for p in O.FALSE_SIGNALS)
_LABELS = {"technical": "N/A: Technical Report", "descriptive": "N/A: Descriptive Report", "authors": "Not Reported by Authors", "traditional": "Not Reported: Likely Traditional Methods", "reported": "Not Reported", "missing": "Missing"}
_BY_CLASS = {"ml_techniques": ("technical", "traditional"), "effect_size": ("technical", "authors"), "sample_size": ("technical", "reported"), "primary_finding": ("descriptive", "authors"), "confounders": ("technical", "authors")}


def _filled_by_class(c: str) -> str:
    technical, empirical = (_LABELS[k] for k in _BY_CLASS[c])
    return f"case when not {MISS.format(c)} then {c} when document_class='technical_report' then '{technical}' when document_class='empirical_article' then '{empirical}' else '{_LABELS['missing']}' end {c}"


@BOOK.query("p05_conditional_master", f"""with f as (select record_id rid, json_extract(j,'$.data.main_findings[*]') l, json_extract(j,'$.data.confounders_identified[*]') c, j->>'$.data.outcome_summary' o from ({_WITH_CORPUS})),
m as (select *, lower(coalesce(publication_type,'')) pub, lower(coalesce(source_category,'')) sc, {_MASKED} t from ({_MASTER})),
b as (select record_id, {_CLASS} document_class, case when {MISS.format('ml_primary')} then ml_all_techniques else ml_primary end ml_techniques, list_filter(l, lambda x: (x->>'$.target_variable') is not null)[1]->>'$.performance_metrics' effect_size, total_students sample_size, o primary_finding, case when len(list_filter(c, lambda x: not {MISS.format("(x->>'$.variable_name')")}))>0 then 'present' end confounders from m join f on rid=record_id)
select record_id, document_class, {', '.join(_filled_by_class(c) for c in _BY_CLASS)} from b""")
def p05_master(spark, d):
    """Empty cells of a record labelled by the class of its document; nothing is imputed."""
    r = R.parsed(table(spark, d, "article_records").select("record_id", "corpus", "payload"))
    m = R.master_full(r)
    cls = O.document_class(F.col("publication_type"), F.col("source_category"), F.col("title")).alias("document_class")
    first = F.try_element_at(F.filter("r.data.main_findings", lambda f: f["target_variable"].isNotNull()), F.lit(1))["performance_metrics"].alias("effect_size")
    named = F.when(F.exists("r.data.confounders_identified", lambda c: ~T.is_missing(c["variable_name"])), "present").alias("confounders")
    more = r.select("record_id", first, F.col("r.data.outcome_summary").alias("primary_finding"), named)
    b = m.select("record_id", cls, F.when(T.is_missing(F.col("ml_primary")), F.col("ml_all_techniques")).otherwise(F.col("ml_primary")).alias("ml_techniques"), F.col("total_students").alias("sample_size")).join(more, "record_id")

    def fill(c: str):
        technical, empirical = (_LABELS[k] for k in _BY_CLASS[c])
        return F.when(~T.is_missing(F.col(c)), F.col(c)).when(F.col("document_class") == "technical_report", technical).when(F.col("document_class") == "empirical_article", empirical).otherwise(_LABELS["missing"]).alias(c)

    return b.select("record_id", "document_class", *[fill(c) for c in _BY_CLASS])


# fixed values: codes of countries and regions that the surveys write in their own way
CODE_REPAIR = (("ABA", "ARE"), ("CNL", "TWN"), ("COT", "COL"), ("RMO", "MKD"), ("DNW", "DNK"), ("BFL", "BEL"))


@BOOK.query("p07_country_codes", f"with c as (select record_id, trim(unnest(json_extract(try_cast({_COUNTRIES} as json),'$[*]'))->>'$.country_code') code from ({_WITH_CORPUS}) where left(trim({_COUNTRIES}),1)='[') select case code {' '.join(f'when {a!r} then {b!r}' for a, b in CODE_REPAIR)} else code end code, count(*) n, count(distinct record_id) n_records from c where regexp_full_match(code,'\\p{{L}}{{3}}') group by 1")
def p07_codes(spark, d):
    """Valid country codes of the records, repaired by the map."""
    r = _records(spark, d).where(F.left(F.trim("r.data.sample_details.countries"), F.lit(1)) == "[")
    c = r.select("record_id", F.explode(F.from_json("r.data.sample_details.countries", "array<string>")).alias("x")).select("record_id", F.trim(F.get_json_object("x", "$.country_code")).alias("code")).where(F.col("code").rlike(r"^\p{L}{3}$"))
    repair = F.create_map(*[F.lit(x) for kv in CODE_REPAIR for x in kv])
    return c.groupBy(F.coalesce(F.try_element_at(repair, F.col("code")), F.col("code")).alias("code")).agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("n_records"))


@BOOK.query("r06_findings", f"with e as (select record_id, json_extract(j, '$.data.main_findings[*]') l from ({_J}) where json_type(j,'$.data.main_findings')='ARRAY'), x as (select record_id, unnest(l) f, generate_subscripts(l,1)::int finding_index from e) select record_id, finding_index, f->>'$.dataset_used' dataset_used, f->>'$.target_variable' target_variable, f->>'$.performance_metrics' performance_metrics from x where f->>'$.target_variable' is not null")
def r06(spark, d):
    return R.findings(_records(spark, d)).select("record_id", "finding_index", "dataset_used", "target_variable", "performance_metrics")


@BOOK.query("p02_flat_findings", f"with m as ({_MASTER}), f as (select record_id rid, list_filter(json_extract(j,'$.data.main_findings[*]'), lambda x: (x->>'$.target_variable') is not null) l from ({_WITH_CORPUS})), x as (select rid, unnest(l) f, generate_subscripts(l,1)::int finding_index from f) select record_id, file_name, doi, title, corpus_source, finding_index, f->>'$.dataset_used' dataset_used, f->>'$.target_variable' target_variable, array_to_string(list_filter(list_transform(list_slice(json_extract(f,'$.top_predictors[*]'),1,5), lambda p: p->>'$'), lambda p: trim(p) != ''),'; ') top_predictors, f->>'$.performance_metrics' performance_metrics from m left join x on rid=record_id")
def p02_flat(spark, d):
    """One row per finding beside its article, findings numbered from 1, predictors joined by semicolons; an article without findings keeps a row."""
    r = R.parsed(table(spark, d, "article_records").select("record_id", "corpus", "payload"))
    with_target = F.filter("r.data.main_findings", lambda f: f["target_variable"].isNotNull())
    f = r.select("record_id", F.posexplode(with_target).alias("pos", "f")).select("record_id", (F.col("pos") + 1).alias("finding_index"), "f.*")
    predictors = F.array_join(F.filter(F.slice(F.coalesce("top_predictors", F.array()), 1, 5), lambda p: F.trim(p) != ""), "; ")
    j = R.master_full(r).select("record_id", "file_name", "doi", "title", "corpus_source").join(f, "record_id", "left")
    return j.select("record_id", "file_name", "doi", "title", "corpus_source", "finding_index", "dataset_used", "target_variable", F.when(F.col("finding_index").isNotNull(), predictors).alias("top_predictors"), "performance_metrics")


def _listed(path: str) -> str:
    return f"with e as (select record_id, json_extract(j, '$.data.{path}[*]') l from ({_J}) where json_type(j,'$.data.{path}')='ARRAY'), x as (select record_id, unnest(l) f, generate_subscripts(l,1)::int i from e)"


_CODE = "case when s='' or s is null then 'unnamed' else s end"


@BOOK.query("r06_confounders", _listed("confounders_identified") + f", y as (select record_id, i, f->>'$.variable_code' code, f->>'$.variable_name' nm, f->>'$.category' category, left(regexp_replace(regexp_replace(lower(f->>'$.variable_name'),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),48) s from x) select record_id, i confounder_index, case when {MISS.format('code')} then {_CODE} else code end variable_code, nm variable_name, category from y")
def r06b(spark, d):
    return R.confounders(_records(spark, d))


@BOOK.query("d04_merged_findings", _listed("main_findings") + f", y as (select record_id, i, lower(trim(coalesce(f->>'$.dataset_used',''))) dataset, lower(trim(coalesce(f->>'$.target_variable',''))) target, f->>'$.performance_metrics' m from x where f->>'$.target_variable' is not null), u as (select record_id, dataset, target, case when {MISS.format('m')} then null else m end m, min(i) i from y group by all), k as (select record_id, dataset, target, min(i) finding_index from y group by all) select k.record_id, k.finding_index, k.dataset, k.target, coalesce(string_agg(u.m,'; ' order by u.i),'') metrics from k join u using (record_id, dataset, target) group by all")
def d04(spark, d):
    return R.merged_findings(R.findings(_records(spark, d)))


def _filled(path: str) -> str:
    return f"(not coalesce(trim(j->>'$.{path}') in ('','nan','NaN'),true))::int"


_TEN = "+".join(_filled(p) for p in ("metadata.title", "metadata.doi", "metadata.year", "metadata.publication_type", "data.plausible_values_handling", "data.missing_data_handling", "data.survey_design.weight_fields_interpretation", "data.survey_design.weight_variable_name", "data.sample_details.sample_filtering_criteria")) + f"+greatest({_filled('data.ml_techniques.primary')},{_filled('data.ml_techniques.all_techniques')})"
_MORE = "(coalesce(json_array_length(j,'$.data.main_findings'),0)>0)::int+(coalesce(json_array_length(j,'$.data.confounders_identified'),0)>0)::int+" + _filled("data.outcome_summary")


@BOOK.query("a20_completeness", f"select record_id, round(case when j->>'$.metadata.publication_type'='report' then ({_TEN})/10.0 else ({_TEN}+{_MORE})/13.0 end,3) data_completeness_score from ({_J})")
def a20(spark, d):
    r = _records(spark, d)
    return r.select("record_id", R.completeness(F.col("r.metadata.publication_type") == "report").alias("data_completeness_score"))


@BOOK.query("f39_metrics", _listed("main_findings") + r", y as (select record_id, i, coalesce(f->>'$.performance_metrics','') m from x where f->>'$.target_variable' is not null) select record_id, i finding_index, case when regexp_matches(m,'(?i)\bR(?:2|²|-squared)\s*[:=]\s*(-?[0-9]*\.?[0-9]+)') then 'R2='||regexp_extract(m,'(?i)\bR(?:2|²|-squared)\s*[:=]\s*(-?[0-9]*\.?[0-9]+)',1) when regexp_full_match(trim(m),'-?[0-9]*\.?[0-9]+') then trim(m) else 'Not Reported' end metrics from y".replace("\\\\", "\\"))
def f39(spark, d):
    return R.findings(_records(spark, d)).select("record_id", "finding_index", T.metrics(F.coalesce("performance_metrics", F.lit(""))).alias("metrics"))


def _cases(expr: str, rules) -> str:
    return " ".join(f"when regexp_matches({expr},'(?i){p}') then '{l}'" for l, p in rules)


_CATEGORY = "case lower(category) " + " ".join(f"when '{k}' then '{v}'" for k, v in O.PREDICTOR_CATEGORIES.items()) + f" else case {_cases('lower(predictor)', O.PREDICTOR_WORDS)} else 'Student: Attitudinal/Behavioral' end end"


@BOOK.query("r07_predictor_evidence", f"""with f as (select record_id, i finding_index, f->>'$.target_variable' t, list_slice(json_extract(f,'$.top_predictors[*]'),1,5) p from ({_listed('main_findings')} select * from x) where f->>'$.target_variable' is not null),
x as (select record_id, finding_index, unnest(p)->>'$' predictor, generate_subscripts(p,1)::int rank from f), c as (select record_id, lower(f->>'$.variable_name') k, min(f->>'$.category') category from ({_listed('confounders_identified')} select * from x) group by all)
select x.record_id, finding_index, rank, predictor, case {_cases('predictor', O.PREDICTORS)} else 'OTHER' end construct, {_CATEGORY} category from x left join c on c.record_id = x.record_id and c.k = lower(predictor)""")
def r07(spark, d):
    """Predictors of every finding with their rank, and the matched confounder's category."""
    f = R.findings(_records(spark, d)).select("record_id", "finding_index", "target_variable", F.posexplode("top_predictors").alias("pos", "predictor"))
    c = R.confounders(_records(spark, d)).groupBy("record_id", F.lower("variable_name").alias("k")).agg(F.min("category").alias("category"))
    j = f.withColumn("k", F.lower("predictor")).join(c, ["record_id", "k"], "left")
    return j.select("record_id", "finding_index", (F.col("pos") + 1).alias("rank"), "predictor", O.first_match(F.col("predictor"), O.PREDICTORS, "OTHER").alias("construct"), O.predictor_category(F.col("predictor"), F.col("category")).alias("category"))


_FOLDED = f"regexp_replace(translate(lower(file_name),'{T._MARKED}','{T._FOLDED}'),'[^a-z0-9]','','g')"


@BOOK.query("d01_linked_copies", f"""with recursive m as (select row_id, corpus, file_name, {_FOLDED} n, case when regexp_matches(doi,'10\\.[0-9]{{4,9}}/\\S+') then lower(regexp_replace(trim(regexp_replace(doi,'[\\s.,;)]+$','')),'(?i)^(https?://(dx\\.)?doi\\.org/|doi:?\\s*)','')) end d from metadata),
shared as (select n from m where n != '' group by 1 having min(d) < max(d)), e as (select row_id u, 'n'||n k from m where n != '' and n not in (select n from shared) union all select row_id, 'd'||d from m where d != ''),
l as (select distinct a.u, b.u v from e a join e b using (k) where a.u != b.u), reach as (select row_id u, row_id c from m union select l.v, reach.c from reach join l on l.u = reach.u where reach.c < l.v),
g as (select u row_id, min(c) component from reach group by 1)
select component, count(*) n_rows, arg_min(row_id, (coalesce(trust_rank,99), -length(coalesce(file_name,'')), row_id)) best_row_id from m join g using (row_id) left join corpus_trust using (corpus) group by 1""")
def d01(spark, d):
    """Articles of metadata linked by folded file name or DOI, and the row that stands for each."""
    m = table(spark, d, "metadata").select("row_id", "corpus", "file_name", F.when(F.col("doi").rlike(r"10\.[0-9]{4,9}/\S+"), F.regexp_replace("doi", r"[\s.,;)]+$", "")).alias("doi"))
    groups = R.linked_copies(m, "row_id", F.col("file_name"), F.col("doi"))
    ranked = m.join(groups, "row_id").join(broadcast_if_small(table(spark, d, "corpus_trust")), "corpus", "left")
    order = F.struct(F.coalesce("trust_rank", F.lit(99)).alias("rank"), (-F.length(F.coalesce("file_name", F.lit("")))).alias("len"), F.col("row_id"))
    return ranked.groupBy("component").agg(F.count("*").alias("n_rows"), F.min(order).alias("best")).select("component", "n_rows", F.col("best.row_id").alias("best_row_id"))


_DOMAINS = " ".join(f"when '{k}' then '{v}'" for k, v in O.POLICY_DOMAINS.items())
_LEVER = "case dom " + " ".join(f"when '{k}' then '{v}'" for k, v in O.POLICY_LEVERS.items()) + " else lower(dom) end"
_WORDS = f"regexp_matches(concat_ws(' ', j->>'$.metadata.title', j->>'$.data.outcome_summary'), '(?i){O.POLICY_WORDS}')"


def _trend_sql(col: str) -> str:
    n = lambda ps: "(" + "+".join(f"regexp_matches(lower({col}),'{p}')::int" for p in ps) + ")"
    return f"case when {MISS.format(col)} then 'Null' when {n(O.POSITIVE)} > {n(O.NEGATIVE)} then 'Positive' when {n(O.NEGATIVE)} > {n(O.POSITIVE)} then 'Negative' else 'Null' end"


@BOOK.query("a23_policy_records", f"""with r as ({_WITH_CORPUS}), b as (select record_id, {_WORDS} pol, {_trend_sql("(j->>'$.data.outcome_summary')")} trend, coalesce(list_filter(list_transform(json_extract(try_cast({_COUNTRIES} as json),'$[*]'), lambda x: upper(trim(x->>'$.country_code'))), lambda c: c != ''), []) cs from r),
c as (select record_id, unnest(json_extract(j,'$.data.confounders_identified[*]'))->>'$.variable_name' x from r), f as (select record_id, unnest(json_extract(j,'$.data.main_findings[*]'))->>'$.target_variable' x from r),
v as (select record_id, {variable_sql('x')} v, 1 is_conf from c union all select record_id, {variable_sql('x')}, 0 from f where x is not null),
s as (select record_id, case v {_DOMAINS} end dom, v, is_conf, trend from v join b using (record_id) where v not in ({', '.join(repr(x) for x in O.OUTCOMES)})),
g as (select record_id, dom, count(distinct case when is_conf=1 then v end) nc, sum(1-is_conf) nf, sum(((1-is_conf)=1 and trend='Positive')::int) p, sum(((1-is_conf)=1 and trend='Negative')::int) n, sum(((1-is_conf)=1 and trend='Null')::int) z, coalesce(nullif(string_agg(distinct case when is_conf=1 then v end, ', ' order by case when is_conf=1 then v end),''), '{O.NOT_STATED}') sup from s where dom is not null group by 1,2),
h as (select b.record_id, dom, pol, nc, nf, p, n, z, sup, unnest(case when len(cs)=0 then ['{O.INTERNATIONAL}'] else list_sort(list_distinct(cs)) end) country, case when dom is null then '{O.NOT_STATED}' when p=0 and n=0 then (case when z>0 then 'Descriptive / Null' else 'Not Reported' end) when n=0 then 'Improving (positive predictor)' when p=0 then 'Corrective (negative association)' else 'Mixed / Context-dependent' end dir from b left join g using (record_id)),
k as (select *, case when dom is null then '{O.NOT_STATED}' {' '.join(f"when starts_with(dir,'{a}') then replace('{f}','%s',{_LEVER})" for a, f in O.POLICY_ACTIONS)} else '{O.NOT_STATED}' end act from h)
select record_id, country, coalesce(dom,'{O.NOT_STATED}') policy_domain, dir direction, act recommended_action, coalesce(sup,'{O.NOT_STATED}') supporting_variables, coalesce(p,0)||'/'||coalesce(n,0)||'/'||coalesce(z,0) trend_counts,
 case when dom is null then 0.0 else round(least((case when nc>0 then least(0.30+0.05*(nc-1),0.45) else 0.0 end)+(case when nf>0 then least(0.15+0.05*(nf-1),0.30) else 0.0 end)+(case when p+n>0 then 0.15 else 0.0 end)+(case when pol then 0.10 else 0.0 end),1.0),2) end::double confidence,
 case when dom is null then '{O.NOT_STATED}' else (case when country='{O.INTERNATIONAL}' then 'Cross-country' else country end)||': '||lower(act) end context from k""")
def a23_records(spark, d):
    """Policy insights of every record and country: signals of confounders and findings by domain, direction, confidence,
    action; a record without a signal keeps a row that says so."""
    r = _records(spark, d)
    codes = F.filter(F.transform(F.from_json("r.data.sample_details.countries", "array<string>"), lambda x: F.upper(F.trim(F.get_json_object(x, "$.country_code")))), lambda c: c != "")
    base = r.select("record_id", F.coalesce(codes, F.array().cast("array<string>")).alias("cs"), F.concat_ws(" ", "r.metadata.title", "r.data.outcome_summary").rlike("(?i)" + O.POLICY_WORDS).alias("pol"), O.trend(F.col("r.data.outcome_summary")).alias("trend"))
    c = r.select("record_id", F.explode("r.data.confounders_identified").alias("c")).select("record_id", O.variable(F.col("c.variable_name")).alias("v"), F.lit(1).alias("is_conf"))
    f = r.select("record_id", F.explode("r.data.main_findings").alias("f")).where("f.target_variable is not null").select("record_id", O.variable(F.col("f.target_variable")).alias("v"), F.lit(0).alias("is_conf"))
    domain = F.create_map(*[F.lit(x) for kv in O.POLICY_DOMAINS.items() for x in kv])
    s = c.unionByName(f).where(~F.col("v").isin(*O.OUTCOMES)).withColumn("dom", F.try_element_at(domain, F.col("v"))).where("dom is not null").join(base.select("record_id", "trend"), "record_id")
    conf, found = F.when(F.col("is_conf") == 1, F.col("v")), F.when(F.col("is_conf") == 0, F.col("trend"))
    g = s.groupBy("record_id", "dom").agg(F.countDistinct(conf).alias("nc"), F.count(found).alias("nf"), *[F.sum(F.coalesce((found == t).cast("int"), F.lit(0))).alias(a) for a, t in (("p", "Positive"), ("n", "Negative"), ("z", "Null"))], F.array_join(F.sort_array(F.collect_set(conf)), ", ").alias("sup"))
    none, stated = F.col("dom").isNull(), F.lit(O.NOT_STATED)
    places = F.when(F.size("cs") == 0, F.array(F.lit(O.INTERNATIONAL))).otherwise(F.array_sort(F.array_distinct("cs")))
    h = base.join(g, "record_id", "left").withColumn("country", F.explode(places)).withColumn("direction", F.when(none, stated).otherwise(O.policy_direction(F.col("p"), F.col("n"), F.col("z"))))
    k = h.withColumn("recommended_action", F.when(none, stated).otherwise(O.policy_action(F.col("dom"), F.col("direction"))))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("string")
    return k.select(
        "record_id", "country", F.coalesce("dom", stated).alias("policy_domain"), "direction", "recommended_action", F.when(F.coalesce(F.col("sup"), F.lit("")) == "", stated).otherwise(F.col("sup")).alias("supporting_variables"),
        F.concat_ws("/", zero("p"), zero("n"), zero("z")).alias("trend_counts"), F.when(none, 0.0).otherwise(O.policy_confidence(F.col("nc"), F.col("nf"), F.col("p") + F.col("n") > 0, F.col("pol"))).alias("confidence"),
        F.when(none, stated).otherwise(F.concat(F.when(F.col("country") == O.INTERNATIONAL, "Cross-country").otherwise(F.col("country")), F.lit(": "), F.lower("recommended_action"))).alias("context"),
    )
