"""Repair queries on article records, scanned pages and core data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions import repair as X
from ..functions import text as T
from ..operators import records as R
from ..session import table
from .base import Book
from .evidence import _J, _listed, _records, BOOK as EVIDENCE, CUBE, coded
from .textual import MISS, _TRI, _sql_cases

BOOK = Book()


@BOOK.query("f06_title_from_text", r"with h as (select file_id, string_split_regex(raw_text,'(?m)^\s*(?:Abstract|ABSTRACT)\s*$')[1] h from processed_pdf where regexp_matches(raw_text,'(?m)^\s*(?:Abstract|ABSTRACT)\s*$')), l as (select file_id, list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(x)), lambda x: length(x) between 20 and 200 and regexp_matches(x,'^\p{Lu}') and not regexp_matches(x,'^(http|DOI|Available)')) l from h) select file_id, list_filter(l, lambda x: length(x)=list_max(list_transform(l, lambda y: length(y))))[1] title from l")
def f06(spark, d):
    p = table(spark, d, "processed_pdf").where(F.col("raw_text").rlike(r"(?m)^\s*(?:Abstract|ABSTRACT)\s*$"))
    return p.select("file_id", X.title_from_text(F.col("raw_text")).alias("title"))


_LINES = r"list_filter(list_transform(list_slice(string_split(raw_text, chr(10)),1,40), lambda x: trim(x)), lambda x: x != '')"
_GOOD = r"list_filter(list_slice(l, greatest(i-5,1), i-1), lambda x: length(x) between 20 and 200 and regexp_matches(x,'^\p{Lu}'))"
_MARKED = "(" + " or ".join(f"contains(l[i],'{m}')" for m in X.AFFILIATION) + ")"


@BOOK.query("f06_document_title", f"with b as ({BOOK.sql['f06_title_from_text']}), l as (select file_id, {_LINES} l from processed_pdf where raw_text is not null), k as (select file_id, l, list_filter(range(1, len(l)+1), lambda i: {_MARKED} and len({_GOOD})>0)[1] i from l), a as (select file_id, list_filter({_GOOD}, lambda x: length(x)=list_max(list_transform({_GOOD}, lambda y: length(y))))[1] t from k where i is not null) select file_id, coalesce(b.title, a.t) title from l left join b using (file_id) left join a using (file_id)")
def f06_whole(spark, d):
    """The title cascade of scanned files, which have no title of their own: before the abstract, else before the affiliation."""
    p = table(spark, d, "processed_pdf").where("raw_text is not null")
    return p.select("file_id", X.document_title(F.lit(None).cast("string"), F.col("raw_text")).alias("title"))


@BOOK.query("f07_title_from_file_name", r"with s as (select row_id, trim(regexp_replace(regexp_replace(trim(file_name),'(?i)\.pdf$',''),'^\d+\.\s*','')) s from metadata where file_name is not null), a as (select *, trim(regexp_extract(s,'^.+?\(\d{4}\)\.\s*(.+)$',1)) a from s) select row_id, case when a != '' then case when length(a)>=10 then a end when regexp_matches(s,'(?i)^978\d{10,13}(-en)?$') then 'OECD publication '||s when regexp_matches(s,'(?i)^[\da-f]{6,12}-en$') then 'OECD document '||s when length(s)>=15 then s end title from a")
def f07(spark, d):
    return table(spark, d, "metadata").where("file_name is not null").select("row_id", X.title_from_file_name(F.col("file_name")).alias("title"))


def _condensed(col: str, words: int = 8) -> str:
    """SQL of repair.condensed."""
    n = lambda sign: f"(length(trim({col}))-length(replace(trim({col}),'{sign}','')))"
    s = f"case when {n('(')}<{n(')')} then trim(regexp_replace(trim({col}),'\\)+$','')) when {n('(')}>{n(')')} then trim({col})||repeat(')',{n('(')}-{n(')')}) else trim({col}) end"
    for start in (r"(?i)^the\s+", r"(?i)^teacher[- ]related\s+variables\s+such\s+as\s+(?:the\s+)?", r"(?i)^students?''?\s+", r"(?i)^student''?s?\s+"):
        s = f"trim(regexp_replace({s},'{start}',''))"
    return f"coalesce(nullif(array_to_string(list_slice(string_split_regex({s},'\\s+'),1,{words}),' '),''),trim({col}))"


@BOOK.query("f10_condensed_labels", f"select distinct title, {_condensed('title')} label from metadata where title is not null")
def f10(spark, d):
    m = table(spark, d, "metadata").where("title is not null").select("title").distinct()
    return m.select("title", X.condensed(F.col("title")).alias("label"))


def _any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col},'{w}')" for w in words) + ")"


def _f15_sql() -> str:
    n, c = "lower(coalesce(variable_name,''))", "lower(trim(coalesce(variable_code,'')))"
    kept = f"({_any(n, X.KEPT_WORDS)} or {c} in ('votat','sequence_length','seq_length'))"
    micro = f"(regexp_matches({c},'^-?\\d+_-?\\d+_-?\\d+$') or {c} in ('start','end','reset','click') or regexp_matches({c},'^(tfidf_|word2vec_|w2v_)|\\d+_\\d+_') or {_any(n, X.MICRO_WORDS)} or {_any(c, X.MICRO_WORDS)} or regexp_matches({n},'\\d+_\\d+_-?\\d+'))"
    up = "upper(trim(coalesce(variable_code,'')))"
    weight = f"({up} != '' and (regexp_matches({up},'WGT$|^W_|^(TOTWGT|FSTUWT|SCHWGT|HOUWGT|SENWGT|MATWGT|SCIWGT|REAWGT)$') or {_any(n, X.WEIGHT_NAMES)}))"
    t = "trim(coalesce(variable_code,''))"
    invented = f"({t} != '' and not regexp_full_match({t},'[A-Z][A-Z0-9_]+') and (regexp_matches({t},'(?i)[:;/ ]|\\band\\b') or regexp_matches({t},'(?i)meta[-_]?cognit') or lower({t}) in ('remembering','understanding')))"
    bracket = "regexp_extract(concat_ws(' ', label, variable_code),'\\(([A-Z][A-Z0-9_]{2,})\\)',1)"
    slug = "coalesce(nullif(left(regexp_replace(regexp_replace(lower(label),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),48),''),'unnamed_variable')"
    made = f"case when regexp_matches(concat_ws(' ', variable_code, label),'(?i)\\b(meta[- ]?cognit\\w*|understanding|remembering)\\b') and not {MISS.format('variable_code')} then 'UNDREM' when {bracket} != '' then {bracket} else {slug} end"
    codes = " ".join(f"when upper(trim(variable_code)) in ({', '.join(repr(x) for x in v.split())}) then '{k}'" for k, v in X.CODES.items())
    words = _sql_cases("concat_ws(' ', variable_name, variable_code)", X.CATEGORY_WORDS)
    return f"select record_id, confounder_index, case when {MISS.format('variable_code')} or {invented} then {made} else trim(variable_code) end variable_code, label variable_name, case {codes} when category in ({', '.join(repr(x) for x in X.CATEGORIES)}) then category {words} else 'student_behavior' end category from (select *, {_condensed('variable_name')} label from ({EVIDENCE.sql['r06_confounders']})) where not (not {kept} and {micro}) and not {weight}"


@BOOK.query("f15_confounder_categories", _f15_sql())
def f15(spark, d):
    """Confounders of the records with repaired codes and categories, micro features and weights left out."""
    c = R.confounders(_records(spark, d))
    kept = c.where(~X.is_micro_feature(F.col("variable_name"), F.col("variable_code")) & ~X.is_weight_variable(F.col("variable_name"), F.col("variable_code")))
    return kept.select("record_id", "confounder_index", X.repaired_code(F.col("variable_code"), F.col("variable_name")).alias("variable_code"), X.condensed(F.col("variable_name")).alias("variable_name"), X.confounder_category(F.col("category"), F.col("variable_name"), F.col("variable_code")).alias("category"))


_DATA = f"case when {MISS.format('dataset')} then 'ILSA dataset not specified in manuscript' else trim(dataset) end"
_CLAUSE = f"'Using '||regexp_replace({_DATA},'\\.+$','')||case when regexp_matches({_DATA},'(?i)\\bdata\\b') then ',' else ' data,' end"
_SENTENCE = f"({_CLAUSE}||' the study leveraged '||case when len(preds)>0 then array_to_string(preds[1:3],', ') else 'the reported predictors' end||' to predict '||trim(target)||', finding that {X.NO_NARRATIVE}')"
_CONCLUSION = f"{_SENTENCE}||'. This indicates that '||case when regexp_matches(lower({_SENTENCE}),'{X.MEANING_WORDS}') and length({_SENTENCE})>40 then right({_SENTENCE},220) else '{X.NO_MEANING}' end||'.'"


@BOOK.query("f16_normalised_findings", f"""with k as (select record_id, list_filter(json_extract(j,'$.data.main_findings[*]'), lambda x: not {MISS.format("(x->>'$.target_variable')")}) l from ({_J}) where json_type(j,'$.data.main_findings')='ARRAY'), x as (select record_id, unnest(l) f, generate_subscripts(l,1)::int finding_index from k),
y as (select record_id, finding_index, f->>'$.dataset_used' dataset, f->>'$.target_variable' target, f->>'$.performance_metrics' m, list_slice(list_filter(list_transform(json_extract(f,'$.top_predictors[*]'), lambda p: p->>'$'), lambda p: not {MISS.format('p')}),1,5) preds from x)
select record_id, finding_index, {_DATA} dataset_used, trim(target) target_variable, array_to_string(preds,'; ') top_predictors, case when {MISS.format('m')} then 'Not reported' else trim(m) end performance_metrics, {_CONCLUSION} standardized_conclusion from y""")
def f16(spark, d):
    """Findings with defaults and conclusions."""
    r = _records(spark, d).select("record_id", F.posexplode(X.normalised_findings(F.col("r.data.main_findings"))).alias("pos", "f"))
    return r.select("record_id", (F.col("pos") + 1).alias("finding_index"), "f.dataset_used", "f.target_variable", F.array_join("f.top_predictors", "; ").alias("top_predictors"), "f.performance_metrics", "f.standardized_conclusion")


@BOOK.query("f18_inferred_context", f"select row_id, case {_sql_cases('title', X.TARGET_WORDS)} else 'Primary study outcome (heuristic migration)' end target, case when regexp_matches(title,'(?i)\\b((?:PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|Survey)\\s+(?:19|20)\\d{{2}})') then regexp_extract(title,'(?i)\\b((?:PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|Survey)\\s+(?:19|20)\\d{{2}})',1) when regexp_matches(title,'(?i)\\b(PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|OECD)\\b') then upper(regexp_extract(title,'(?i)\\b(PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|OECD)\\b',1)) when source_category in ('review_article','methodology_paper','technical_report') then 'ILSA literature synthesis (no single student-level dataset)' else 'ILSA assessment context not specified in extraction (heuristic migration)' end dataset from metadata where title is not null")
def f18(spark, d):
    """Data set and target read from context."""
    m = table(spark, d, "metadata").where("title is not null")
    return m.select("row_id", X.target_of(F.col("title")).alias("target"), X.dataset_of(F.col("title"), F.col("source_category")).alias("dataset"))


_PARTS = ", ".join(f"case when trim(j->>'$.{p}') != '' then trim(j->>'$.{p}') end" for p in ("metadata.title", "metadata.file_name", "data.sample_details.sample_filtering_criteria", "data.survey_design.weight_fields_interpretation", "data.outcome_summary", "data.null_fields_interpretation"))
_SOURCES = ", ".join(f"'{x}'" for x in X.NO_STUDY)


def _context_sql() -> str:
    phrase = f"left(string_split(trim(regexp_extract(blob,'{X.DATASET_PHRASE}',1)),chr(10))[1],120)"
    program = f"trim(upper(regexp_extract(blob,'{X.DATASET_PROGRAM}',1))||' '||regexp_extract(blob,'{X.DATASET_PROGRAM}',2))"
    whole = "concat_ws(chr(10), coalesce(outcome,''), blob)"
    target = " ".join(f"when regexp_matches({whole},'(?i){p}') then left(trim(regexp_extract({whole},'(?i){p}',0)),80)" for p in X.TARGET_PATTERNS)
    hits = f"list_transform(regexp_extract_all(coalesce(outcome,''),'{X.METRIC_SNIPPET}',1), lambda x: trim(x))"
    distinct = f"list_filter({hits}, lambda x, i: list_position({hits}, x) = i)"
    names = f"list_slice(list_filter(list_transform(confounders, lambda c: trim(coalesce(c->>'$.variable_name', c->>'$.variable_code'))), lambda n: not {MISS.format('n')}),1,5)"
    return f"""with b as (select record_id, concat_ws(chr(10), {_PARTS}) blob, j->>'$.data.outcome_summary' outcome, j->>'$.metadata.source_category' sc, coalesce((j->>'$.data.ml_techniques.primary') not in ('','[]'),false) or coalesce((j->>'$.data.ml_techniques.all_techniques') not in ('','[]'),false) has_ml, coalesce(json_extract(j,'$.data.confounders_identified[*]'),[]) confounders from ({_J}))
select record_id, case when {phrase} != '' then {phrase} when {program} != '' then {program} when sc in ({_SOURCES}) then '{X.SYNTHESIS_DATA}' else '{X.CONTEXT_DATA}' end dataset, case {target} when sc in ({_SOURCES}) then '{X.SYNTHESIS_TARGET}' when has_ml then '{X.MODEL_TARGET}' else '{X.STUDY_TARGET}' end target, array_to_string({names},'; ') predictors, case when len({hits})>0 then left(array_to_string({distinct},'; '),220) else 'Not reported' end metrics from b"""


@BOOK.query("f18_record_context", _context_sql())
def f18_records(spark, d):
    """Data set, target, predictors and results of every record, read from its texts."""
    r = _records(spark, d)
    given = lambda c: F.coalesce(~F.col(c).isin("", "[]"), F.lit(False))
    b = r.select("record_id", X.context(F.col("r")).alias("blob"), F.col("r.data.outcome_summary").alias("outcome"), F.col("r.metadata.source_category").alias("sc"), (given("r.data.ml_techniques.primary") | given("r.data.ml_techniques.all_techniques")).alias("has_ml"), F.col("r.data.confounders_identified").alias("c"))
    return b.select("record_id", X.inferred_dataset(F.col("blob"), F.col("sc")).alias("dataset"), X.inferred_target(F.col("outcome"), F.col("blob"), F.col("sc"), F.col("has_ml")).alias("target"), F.array_join(X.inferred_predictors(F.col("c")), "; ").alias("predictors"), X.metrics_in(F.coalesce("outcome", F.lit(""))).alias("metrics"))


@BOOK.query("f20_legacy_upgrade", _listed("main_findings") + " select record_id, i finding_index, f->>'$.target_variable' target_variable, f->>'$.dataset_used' dataset_used, coalesce(contains(lower(f->>'$.dataset_used'),'legacy migration'),false) or coalesce(contains(lower(f->>'$.target_variable'),'legacy migration'),false) upgraded from x")
def f20(spark, d):
    """Findings made by an older migration get their target and data set from the title; the others stay."""
    f = _records(spark, d).select("record_id", F.col("r.metadata.title").alias("title"), F.posexplode("r.data.main_findings").alias("pos", "f"))
    old = X.is_legacy(F.col("f"))
    return f.select("record_id", (F.col("pos") + 1).alias("finding_index"), F.when(old, X.target_of(F.col("title"))).otherwise(F.col("f.target_variable")).alias("target_variable"), F.when(old, X.dataset_of(F.col("title"), F.lit(None).cast("string"))).otherwise(F.col("f.dataset_used")).alias("dataset_used"), old.alias("upgraded"))


# fixed values: names and codes of countries and economies that take part in the surveys
COUNTRIES = (
    ("Albania", "ALB"), ("Argentina", "ARG"), ("Armenia", "ARM"), ("Australia", "AUS"), ("Austria", "AUT"), ("Azerbaijan", "AZE"), ("Bahrain", "BHR"), ("Belgium", "BEL"), ("Bosnia and Herzegovina", "BIH"), ("Brazil", "BRA"), ("Bulgaria", "BGR"), ("Canada", "CAN"), ("Chile", "CHL"), ("China", "CHN"),
    ("Chinese Taipei", "TWN"), ("Colombia", "COL"), ("Costa Rica", "CRI"), ("Croatia", "HRV"), ("Cyprus", "CYP"), ("Czech Republic", "CZE"), ("Denmark", "DNK"), ("Dominican Republic", "DOM"), ("Ecuador", "ECU"), ("Egypt", "EGY"), ("England", "ENG"), ("Estonia", "EST"), ("Finland", "FIN"), ("France", "FRA"),
    ("Georgia", "GEO"), ("Germany", "DEU"), ("Greece", "GRC"), ("Hong Kong SAR", "HKG"), ("Hungary", "HUN"), ("Iceland", "ISL"), ("Indonesia", "IDN"), ("Ireland", "IRL"), ("Israel", "ISR"), ("Italy", "ITA"), ("Japan", "JPN"), ("Jordan", "JOR"), ("Kazakhstan", "KAZ"), ("Kosovo", "XKX"), ("Kuwait", "KWT"),
    ("Latvia", "LVA"), ("Lebanon", "LBN"), ("Lithuania", "LTU"), ("Luxembourg", "LUX"), ("Macao SAR", "MAC"), ("Malaysia", "MYS"), ("Malta", "MLT"), ("Mexico", "MEX"), ("Moldova", "MDA"), ("Montenegro", "MNE"), ("Morocco", "MAR"), ("Netherlands", "NLD"), ("New Zealand", "NZL"), ("North Macedonia", "MKD"),
    ("Northern Ireland", "NIR"), ("Norway", "NOR"), ("Oman", "OMN"), ("Pakistan", "PAK"), ("Panama", "PAN"), ("Peru", "PER"), ("Philippines", "PHL"), ("Poland", "POL"), ("Portugal", "PRT"), ("Qatar", "QAT"), ("Republic of Korea", "KOR"), ("Romania", "ROU"), ("Russian Federation", "RUS"), ("Saudi Arabia", "SAU"),
    ("Scotland", "SCO"), ("Serbia", "SRB"), ("Singapore", "SGP"), ("Slovak Republic", "SVK"), ("Slovenia", "SVN"), ("South Africa", "ZAF"), ("Spain", "ESP"), ("Sweden", "SWE"), ("Switzerland", "CHE"), ("Thailand", "THA"), ("Tunisia", "TUN"), ("Turkey", "TUR"), ("Ukraine", "UKR"), ("United Arab Emirates", "ARE"),
    ("United Kingdom", "GBR"), ("United States", "USA"), ("Uruguay", "URY"), ("Uzbekistan", "UZB"), ("Viet Nam", "VNM"),
)
_COUNTRY_ROWS = ",".join(f"('{n}','{c}')" for n, c in COUNTRIES)
_TEXTS = "select record_id, concat_ws(' ', payload, title) text from (select record_id, payload, case when json_valid(payload) then payload::json->>'$.metadata.title' end title from article_records)"


@BOOK.query("f21_countries_in_text", f"with n(name,code) as (values {_COUNTRY_ROWS}), w as (select record_id, text, ' '||array_to_string(regexp_extract_all(lower(text),'\\p{{L}}+'),' ')||' ' folded from ({_TEXTS}) where text is not null) select record_id, string_agg(distinct code,'|' order by code) codes from w, n where contains(folded, ' '||lower(name)||' ') or regexp_matches(text,'\\b'||code||'\\b') group by 1")
def f21(spark, d):
    """Countries of the surveys named or coded in the text of a record."""
    names = spark.createDataFrame(list(COUNTRIES), "name string, code string")
    r = table(spark, d, "article_records").select("record_id", F.concat_ws(" ", "payload", F.get_json_object("payload", "$.metadata.title")).alias("text"))
    return X.countries_in(r, "record_id", "text", names).select("record_id", F.array_join("codes", "|").alias("codes"))


def _lit(col, words, signs):
    key = f"regexp_replace(lower({col}),'[- ]','_','g')"
    return f"case when {col} in ({','.join(repr(w) for w in words)}) then {col} {_sql_cases(key, [(l, p) for l, p in signs])} else 'not_reported' end"


@BOOK.query("f23_vocabulary_coercion", f"select {_lit('plausible_values_handling', X.PV_WORDS, X.PV_SIGNS)} pv, {_lit('missing_data_handling', X.MD_WORDS, X.MD_SIGNS)} md, count(*) n from core_data group by 1,2")
def f23(spark, d):
    c = table(spark, d, "core_data")
    return c.groupBy(X.literal(F.col("plausible_values_handling"), X.PV_WORDS, X.PV_SIGNS).alias("pv"), X.literal(F.col("missing_data_handling"), X.MD_WORDS, X.MD_SIGNS).alias("md")).agg(F.count("*").alias("n"))


_YEARS = "list_filter(list_transform(regexp_extract_all(concat_ws(' ', j->>'$.metadata.file_name', j->>'$.metadata.title'),'(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)',1), lambda x: x::int), lambda v: v between 1990 and 2035)[1]"


def _f24_sql() -> str:
    m = lambda p: f"(j->>'$.{p}')"
    name = BOOK.sql["f07_title_from_file_name"].replace("from metadata where file_name is not null", f"from (select record_id row_id, j->>'$.metadata.file_name' file_name from ({_J})) where file_name is not null")
    return f"""with t as ({name}) select record_id, {m('metadata.file_name')} file_name, regexp_replace(trim({m('metadata.doi')}),'(?i)^(https?://(dx\\.)?doi\\.org/|doi:?\\s*)','') doi, case when not {MISS.format(m('metadata.title'))} then {m('metadata.title')} else t.title end title_filled, coalesce(try_cast({m('metadata.year')} as int), {_YEARS}) year_filled,
 {_TRI.format(m('metadata.open_access'))} open_access, {_TRI.format(m('data.survey_design.student_weights_used'))} student_weights_used, {_lit(m('data.plausible_values_handling'), X.PV_WORDS, X.PV_SIGNS)} pv, {_lit(m('data.missing_data_handling'), X.MD_WORDS, X.MD_SIGNS)} md,
 coalesce({m('data.ml_techniques.primary')}, regexp_extract({m('data.ml_techniques.all_techniques')},'^\\["([^"]+)"\\]$',1)) ml_primary, try_cast(regexp_replace({m('data.sample_details.total_students')},'[^0-9]','','g') as bigint) total_students,
 case when json_type(j,'$.data.main_findings')='ARRAY' then json_array_length(j,'$.data.main_findings') else 0 end::int n_findings, case when json_type(j,'$.data.confounders_identified')='ARRAY' then json_array_length(j,'$.data.confounders_identified') else 0 end::int n_confounders from ({_J}) left join t on t.row_id = record_id"""


@BOOK.query("f24_sanitised_records", _f24_sql())
def f24(spark, d):
    """The whole repair of a record as one projection: coerced fields, filled title, bare DOI, vocabularies."""
    r = _records(spark, d)
    m = R.master(r.select("*"))
    more = r.select(
        "record_id", F.coalesce(F.when(~T.is_missing(F.col("r.metadata.title")), F.col("r.metadata.title")), X.title_from_file_name(F.col("r.metadata.file_name"))).alias("title_filled"), X.literal(F.col("r.data.plausible_values_handling"), X.PV_WORDS, X.PV_SIGNS).alias("pv"),
        X.literal(F.col("r.data.missing_data_handling"), X.MD_WORDS, X.MD_SIGNS).alias("md"), F.coalesce(F.col("r.metadata.year").try_cast("int"), T.year_of(F.concat_ws(" ", "r.metadata.file_name", "r.metadata.title"))).alias("year_filled"),
        F.coalesce(F.col("r.data.ml_techniques.primary"), F.regexp_extract("r.data.ml_techniques.all_techniques", r'^\["([^"]+)"\]$', 1)).alias("ml_primary"),
    )
    return m.join(more, "record_id").select("record_id", "file_name", "doi", "title_filled", "year_filled", "open_access", "student_weights_used", "pv", "md", "ml_primary", "total_students", "n_findings", "n_confounders")


_BLOB = ("metadata.title", "metadata.file_name", "metadata.doi", "metadata.venue", "data.outcome_summary", "data.null_fields_interpretation", "data.handling_not_reported_explanation", "data.survey_design.weight_fields_interpretation", "data.sample_details.sample_filtering_criteria")


def _f26_sql() -> str:
    m = lambda p: f"(j->>'$.{p}')"
    words = lambda ws: "(" + " or ".join(f"contains(blob,'{w}')" for w in ws) + ")"
    sizes = f"list_max(list_filter(list_transform(regexp_extract_all(blob,'{X.SAMPLE_OF}',1), lambda x: try_cast(regexp_replace(x,'[,\\s]','','g') as bigint)), lambda n: n > 0))"
    none = {"title": "coalesce(title,'')=''", "year": "yr is null", "doi": f"coalesce({m('metadata.doi')},'')=''", "total_students": "n is null", "ml_primary": f"coalesce({m('data.ml_techniques.primary')},'')=''"}
    tech = f"coalesce({m('data.ml_techniques.primary')},'')='' and coalesce({m('data.ml_techniques.all_techniques')},'') in ('','[]')"
    count = "+".join(f"({none[k]})::int" for k, _ in X.GAPS[:4]) + f"+({tech})::int"
    reasons = "array_to_string(list_filter([" + ", ".join(f"case when {none[k]} then '{t}' end" for k, t in X.GAPS) + "], lambda x: x is not null),'; ')"
    given, wfi, out = m("data.null_fields_interpretation"), m("data.survey_design.weight_fields_interpretation"), m("data.outcome_summary")
    name = BOOK.sql["f07_title_from_file_name"].replace("from metadata where file_name is not null", f"from (select record_id row_id, j->>'$.metadata.file_name' file_name from ({_J})) where file_name is not null")
    return f"""with t as ({name}), b as (select record_id, j, lower(concat_ws(' ', {', '.join(f"nullif(trim({m(p)}),'')" for p in _BLOB)})) blob, case when coalesce({m('metadata.title')},'')='' then t.title else {m('metadata.title')} end title, coalesce(try_cast({m('metadata.year')} as int), {_YEARS}) yr, {_TRI.format(m('data.survey_design.student_weights_used'))} sw, {_TRI.format(m('data.survey_design.replicate_weights_used'))} rw,
 try_cast(regexp_replace({m('data.sample_details.total_students')},'[^0-9]','','g') as bigint) n0 from ({_J}) left join t on t.row_id = record_id), c as (select *, coalesce(n0, {sizes}) n from b)
select record_id, yr as "year", title, coalesce(sw, case when {words(X.UNWEIGHTED)} then false when {words(X.WEIGHTED)} then true end) student_weights_used, coalesce(rw, case when contains(blob,'replicate weight') and contains(blob,'not') and contains(blob,'use') then false when {words(X.REPLICATED)} then true end) replicate_weights_used,
 coalesce(nullif({m('data.survey_design.weight_variable_name')},''), nullif(upper(regexp_extract(blob,'{X.WEIGHT_NAME}',1)),'')) weight_variable_name, n total_students,
 case when coalesce(length(trim({wfi}))>=80,false) or not coalesce(length(trim({out}))>=40,false) then {wfi} when coalesce(trim({wfi}),'')='' then '{X.SPARSE}'||left(trim({out}),400) else trim({wfi})||'{X.ADDED}'||left(trim({out}),400) end weight_fields_interpretation,
 case when {count} <= 3 or coalesce(length(trim({given}))>=40,false) then {given} else '{X.GAP_START}'||{reasons}||'{X.GAP_END}' end null_fields_interpretation from c"""


@BOOK.query("f26_gap_fill", _f26_sql())
def f26_records(spark, d):
    """What the texts of a record say about its empty fields: year, title, weights, sample size, and why others stay empty."""
    r = _records(spark, d)
    m, s = "r.metadata", "r.data.survey_design"
    blob = F.lower(F.concat_ws(" ", *[F.when(F.trim(f"r.{p}") != "", F.trim(f"r.{p}")) for p in _BLOB]))
    b = r.select("record_id", "r", blob.alias("blob"))
    student, replicate, name = X.weights_in(F.col("blob"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    total = F.coalesce(F.regexp_replace(F.col("r.data.sample_details.total_students"), "[^0-9]", "").try_cast("long"), X.largest_sample(F.col("blob")))
    c = b.select(
        "record_id", "r", F.coalesce(F.col(f"{m}.year").try_cast("int"), T.year_of(F.concat_ws(" ", f"{m}.file_name", f"{m}.title"))).alias("year"), F.when(empty(f"{m}.title"), X.title_from_file_name(F.col(f"{m}.file_name"))).otherwise(F.col(f"{m}.title")).alias("title"),
        F.coalesce(T.tri_bool(F.col(f"{s}.student_weights_used")), student).alias("student_weights_used"), F.coalesce(T.tri_bool(F.col(f"{s}.replicate_weights_used")), replicate).alias("replicate_weights_used"), F.coalesce(F.when(~empty(f"{s}.weight_variable_name"), F.col(f"{s}.weight_variable_name")), name).alias("weight_variable_name"),
        total.alias("total_students"), X.expanded_weight_text(F.col(f"{s}.weight_fields_interpretation"), F.col("r.data.outcome_summary")).alias("weight_fields_interpretation"),
    )
    missing = {"title": empty("title"), "year": F.col("year").isNull(), "doi": empty(f"{m}.doi"), "total_students": F.col("total_students").isNull(), "ml_primary": empty("r.data.ml_techniques.primary")}
    untold = missing["ml_primary"] & F.coalesce("r.data.ml_techniques.all_techniques", F.lit("")).isin("", "[]")
    return c.withColumn("null_fields_interpretation", X.explained_gaps(missing, untold, F.col("r.data.null_fields_interpretation"))).drop("r")


@BOOK.query("f27_report_predicates", f"""with p as (select record_id, lower(coalesce(j->>'$.metadata.publication_type','')) pub, {MISS.format("j->>'$.data.ml_techniques.primary'")} no_primary, {MISS.format("j->>'$.data.ml_techniques.all_techniques'")} or coalesce(j->>'$.data.ml_techniques.all_techniques'='[]',false) no_all, regexp_matches(lower(concat_ws(' ', j->>'$.metadata.title', j->>'$.metadata.file_name')),'technical report|national report|framework|user guide|manual') sig from ({_J}))
select record_id, no_primary and no_all and (pub='report' or (pub in ('book_chapter','') and sig)) official_report from p""")
def f27(spark, d):
    return _records(spark, d).select("record_id", X.is_official_report(F.col("r")).alias("official_report"))


@BOOK.query("f27_findings_rule", f"""with p as (select record_id, j, lower(coalesce(j->>'$.metadata.publication_type','')) pub, {MISS.format("j->>'$.data.ml_techniques.primary'")} no_primary, {MISS.format("j->>'$.data.ml_techniques.all_techniques'")} or coalesce(j->>'$.data.ml_techniques.all_techniques'='[]',false) no_all, regexp_matches(lower(concat_ws(' ', j->>'$.metadata.title', j->>'$.metadata.file_name')),'technical report|national report|framework|user guide|manual') sig,
 coalesce(json_array_length(j,'$.data.confounders_identified'),0)>0 conf, {MISS.format("j->>'$.data.sample_details.total_students'")} no_n, coalesce(length(trim(j->>'$.data.outcome_summary'))>=20,false) and not {MISS.format("j->>'$.data.outcome_summary'")} outc, coalesce(json_array_length(j,'$.data.main_findings'),0)=0 nof from ({_J})),
q as (select record_id, nof, not (no_primary and no_all and (pub='report' or (pub in ('book_chapter','') and sig))) and (outc or not no_primary or not no_all or conf or not no_n) need from p) select record_id, need requires_findings, need and nof violates_findings_rule from q""")
def f27b(spark, d):
    """Records that must have findings, and whether they break that rule; valid and broken ones are told apart, not dropped."""
    r = _records(spark, d)
    need = X.requires_findings(F.col("r"))
    none = F.coalesce(F.size("r.data.main_findings") == 0, F.lit(True))
    return r.select("record_id", need.alias("requires_findings"), (need & none).alias("violates_findings_rule"))


def _sentence_sql(lang: str) -> str:
    form = "case trend " + " ".join(f"when '{t}' then '{O.SENTENCES[lang][t]}'" for t in ("Positive", "Negative")) + f" else '{O.SENTENCES[lang]['Null']}' end"
    return f"replace(replace(replace({form}, '{{n}}', study_count::varchar), '{{method}}', replace(lower(\"method\"), '_', ' ')), '{{variable}}', replace(variable, '_', ' '))"


@BOOK.query("f44_template_sentences", f"select {_sentence_sql('tr')} sentence_tr, {_sentence_sql('en')} sentence_en from ({CUBE})")
def f44(spark, d):
    """A sentence on every row of the synthesis in both languages."""
    from ..operators import synthesis as Y

    made = lambda lang: O.sentence(lang, F.col("method"), F.col("variable"), F.col("trend"), F.col("study_count")).alias(f"sentence_{lang}")
    return Y.cube(coded(spark, d)).select(made("tr"), made("en"))
