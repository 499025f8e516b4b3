"""Text, rule and record queries over the evidence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions import text as T
from ..functions.rules import first_match
from ..session import table
from .base import Book, r6

BOOK = Book()
BLANK = "(({0}) is null or trim({0}) in ('','nan','NaN'))"
MISS = "(({0}) is null or trim({0}) in ('','nan','NaN') or lower(trim({0})) in ('','null','none','n/a','na','nan','not reported','not_reported','unknown') or starts_with(lower(trim({0})),'n/a:') or starts_with(lower(trim({0})),'not reported') or starts_with(lower(trim({0})),'missing'))"


def _sql_cases(expr: str, rules) -> str:
    return " ".join(f"when regexp_matches({expr}, '(?i){p}') then '{l}'" for l, p in rules)


def variable_sql(col: str) -> str:
    """SQL of ontology.variable without a context."""
    ignored = f"({col} is null or regexp_full_match({col}, '[\\s\\p{{Z}}]*') or regexp_matches(lower(trim(regexp_replace({col}, '[\\s\\p{{Z}}]+', ' ', 'g'))), '{O.IGNORED}'))"
    family = _sql_cases(col, O.joined(O.VARIABLES)).replace("then 'Self_Efficacy'", f"then case when regexp_matches({col}, '(?i){O.TEACHER_WORDS}') then 'Teacher_Efficacy_Workforce' else 'Self_Efficacy' end")
    meta = f"(trim({col}) in ('{O.META_EXACT[0]}') or {_sql_words(col, O.META_LABELS)} or regexp_matches(trim({col}), '(?i){_PROSE}'))"
    return f"case when {ignored} then '[IGNORE]' {family} {_sql_cases(col, O.joined(O.RESOLVER))} when {meta} then '{O.META}' else '{O.UNCATEGORIZED}' end"


_PROSE = "|".join(f"(?:{p})" for p in O.META_PROSE)


def _sql_words(expr: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({expr}),'{w}')" for w in words) + ")"


@BOOK.query("p03_blank_predicates", f"select count(*) n, sum({BLANK.format('doi')}::int)::bigint blank_doi, sum({MISS.format('doi')}::int)::bigint missing_doi, sum({BLANK.format('title')}::int)::bigint blank_title, sum({MISS.format('title')}::int)::bigint missing_title from metadata")
def p03(spark, d):
    m = table(spark, d, "metadata")
    one = lambda f, c, a: F.sum(f(F.col(c)).cast("long")).alias(a)
    return m.agg(F.count("*").alias("n"), one(T.is_blank, "doi", "blank_doi"), one(T.is_missing, "doi", "missing_doi"), one(T.is_blank, "title", "blank_title"), one(T.is_missing, "title", "missing_title"))


_TRI = "case when lower(trim({0})) in ('true','yes','1','1.0') then true when lower(trim({0})) in ('false','no','0','0.0') then false end"


@BOOK.query("t01_tri_state_bool", f"select {_TRI.format('student_weights_used')} weights, {_TRI.format('replicate_weights_used')} replicates, count(*) n from core_data group by 1,2")
def t01(spark, d):
    return table(spark, d, "core_data").groupBy(T.tri_bool(F.col("student_weights_used")).alias("weights"), T.tri_bool(F.col("replicate_weights_used")).alias("replicates")).agg(F.count("*").alias("n"))


@BOOK.query("p04_sentinel_fill", f"select row_id, case when {MISS.format('ml_technique_primary')} then 'Not reported' else ml_technique_primary end ml_primary, case when {_TRI.format('student_weights_used')} then 'TRUE' when not {_TRI.format('student_weights_used')} then 'FALSE' else 'UNKNOWN' end weights, case when {MISS.format('baseline_model')} then 'N/A: no baseline stated' else baseline_model end baseline from core_data")
def p04(spark, d):
    c = table(spark, d, "core_data")
    w = T.tri_bool(F.col("student_weights_used"))
    fill = lambda c_, label: F.when(T.is_missing(F.col(c_)), label).otherwise(F.col(c_))
    return c.select("row_id", fill("ml_technique_primary", "Not reported").alias("ml_primary"), F.when(w, "TRUE").when(~w, "FALSE").otherwise("UNKNOWN").alias("weights"), fill("baseline_model", "N/A: no baseline stated").alias("baseline"))


_CLASS = f"""case when pub in ('journal','conference') then 'empirical_article' when pub='report' or sc='technical_report' or (sc='methodology_paper' and pub in ('report','book_chapter')) or regexp_matches(concat_ws(' ',t,sc,pub), '{O.REPORT_SIGNAL}') or (regexp_matches(t,'\\btechnical\\b') and pub in ('report','book_chapter','')) or (regexp_matches(t,'\\breport\\b') and not contains(t,'self')) then 'technical_report' when regexp_matches(concat_ws(' ',pub,sc,lower(title)),'peer_reviewed|article') then 'empirical_article' else 'unclassified' end"""
_META = "select row_id, title, lower(coalesce(publication_type,'')) pub, lower(coalesce(source_category,'')) sc, " + "replace(" * len(O.FALSE_SIGNALS) + "lower(coalesce(title,''))" + "".join(f",'{p}',' ')" for p in O.FALSE_SIGNALS) + " t from metadata"


@BOOK.query("f28_document_class", f"select row_id, {_CLASS} document_class from ({_META})")
def f28(spark, d):
    m = table(spark, d, "metadata")
    return m.select("row_id", O.document_class(F.col("publication_type"), F.col("source_category"), F.col("title")).alias("document_class"))


@BOOK.query("f28_study_filter", f"""with c as (select *, {_CLASS} cls, regexp_matches(coalesce(title,''),'(?i)forest|boosting|neural|ridge|spline|tree') ml, {_sql_words("coalesce(title,'')", O.NATIONAL_REPORT)} nat from ({_META})),
f as (select case when pub in ('journal','conference') then (case when ml then 'Empirical ML' else 'Empirical Traditional' end) when sc='methodology_paper' then 'Technical/Assessment Framework' when cls='empirical_article' then (case when ml then 'Empirical ML' else 'Empirical Traditional' end) when cls='technical_report' or pub='report' then (case when nat then 'Descriptive National Report' else 'Technical/Assessment Framework' end) when pub in ('thesis','preprint','book_chapter') then (case when ml then 'Empirical ML' else 'Empirical Traditional' end) else 'Unclassified' end study_filter from c)
select study_filter, count(*) n from f group by 1""")
def f28b(spark, d):
    m = table(spark, d, "metadata")
    ml = F.coalesce(F.col("title"), F.lit("")).rlike("(?i)forest|boosting|neural|ridge|spline|tree")
    return m.groupBy(O.study_filter(F.col("publication_type"), F.col("source_category"), F.col("title"), ml).alias("study_filter")).agg(F.count("*").alias("n"))


@BOOK.query("p05_conditional_sentinels", f"select row_id, case when {MISS.format('doi')} then (case {_CLASS} when 'technical_report' then 'N/A: Technical Report' when 'empirical_article' then 'Missing: Not Reported' else 'N/A: Unclassified' end) else doi end doi_label from (select m.*, doi from ({_META}) m join metadata using (row_id))")
def p05(spark, d):
    m = table(spark, d, "metadata")
    cls = O.document_class(F.col("publication_type"), F.col("source_category"), F.col("title"))
    label = F.when(cls == "technical_report", "N/A: Technical Report").when(cls == "empirical_article", "Missing: Not Reported").otherwise("N/A: Unclassified")
    return m.select("row_id", F.when(T.is_missing(F.col("doi")), label).otherwise(F.col("doi")).alias("doi_label"))


_TARGET_AT = " ".join(f"when regexp_matches(title, '(?i){p}') then {k}" for k, (_, _, p) in enumerate(O.TARGETS))


@BOOK.query("f29_target_domain", f"with t as (select case {_TARGET_AT} end k from metadata where title is not null) select case k {' '.join(f'when {k} then {t[0]!r}' for k, t in enumerate(O.TARGETS))} else 'Other / Unspecified' end \"domain\", case k {' '.join(f'when {k} then {t[1]!r}' for k, t in enumerate(O.TARGETS))} else 'Unspecified' end dimension, count(*) n from t group by 1, 2")
def f29(spark, d):
    """Target domain and dimension: the first of ten rules."""
    m = table(spark, d, "metadata").where("title is not null")
    both = first_match(F.col("title"), [(f"{a}|{b}", p) for a, b, p in O.TARGETS], "Other / Unspecified|Unspecified")
    return m.groupBy(F.split_part(both, F.lit("|"), F.lit(1)).alias("domain"), F.split_part(both, F.lit("|"), F.lit(2)).alias("dimension")).agg(F.count("*").alias("n"))


@BOOK.query("f29_ml_family", f"select family, count(*) n from (select case when {MISS.format('technique')} then 'Not Reported: Likely Traditional Methods' {_sql_cases('technique', O.ML_FAMILIES)} else 'Other ML / Not Classified' end family from core_ml_techniques_all) group by 1")
def f29b(spark, d):
    c = table(spark, d, "core_ml_techniques_all")
    fam = F.when(T.is_missing(F.col("technique")), "Not Reported: Likely Traditional Methods").otherwise(first_match(F.col("technique"), O.ML_FAMILIES, "Other ML / Not Classified"))
    return c.groupBy(fam.alias("family")).agg(F.count("*").alias("n"))


def _sql_labels(col: str, labels: dict) -> str:
    return f"case when {MISS.format(col)} then 'Not Reported' " + " ".join(f"when regexp_replace(lower(trim({col})),' ','_','g')='{k}' then '{v}'" for k, v in labels.items()) + " else 'Other' end"


@BOOK.query("f29_vocabulary_labels", f"select {_sql_labels('plausible_values_handling', O.PV_LABELS)} pv, {_sql_labels('missing_data_handling', O.MD_LABELS)} md, count(*) n from core_data group by 1,2")
def f29c(spark, d):
    c = table(spark, d, "core_data")
    return c.groupBy(O.label_map(F.col("plausible_values_handling"), O.PV_LABELS, "Other", "Not Reported").alias("pv"), O.label_map(F.col("missing_data_handling"), O.MD_LABELS, "Other", "Not Reported").alias("md")).agg(F.count("*").alias("n"))


_IGNORED = "(title is null or regexp_full_match(title, '[\\s\\p{Z}]*') or regexp_matches(lower(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g'))), '" + O.IGNORED + "'))"
_FAMILY = f"case {_sql_cases('title', O.joined(O.VARIABLES))} end"
_CONTEXT_META = f"(trim(title) in ('{O.META_EXACT[0]}') or {_sql_words('title', O.META_LABELS)} or regexp_matches(trim(title), '(?i){_PROSE}') or lower(trim(coalesce(source_category, ''))) in {O.META_SOURCES} and (length(trim(title)) > 35 or regexp_matches(lower(trim(title)), '^(how |that |literature )')))"
_VAR = f"select row_id, case when {_IGNORED} then '[IGNORE]' when fam = 'Self_Efficacy' and regexp_matches(title, '(?i){O.TEACHER_WORDS}') then 'Teacher_Efficacy_Workforce' when fam is not null then fam {_sql_cases('title', O.joined(O.RESOLVER))} when {_CONTEXT_META} then 'Theoretical_and_Meta_Synthesis' else 'Uncategorized_Contextual' end v from (select *, {_FAMILY} fam from metadata)"
_METHOD = f"case when {MISS.format('technique')} then '[IGNORE]' " + " ".join(f"when {_sql_words('technique', w)} then '{l}'" for l, w in O.METHODS) + " else 'Uncategorized_Contextual' end"


@BOOK.query("f31_canonical_variable", f"select row_id, v canonical_variable, case when v='Theoretical_and_Meta_Synthesis' then 'theoretical_meta_synthesis' when v in ('[IGNORE]','Uncategorized_Contextual') then 'excluded' else 'empirical_finding' end filter_flag from ({_VAR})")
def f31(spark, d):
    """The variable family of every title in the context of its source, with the second pass and the synthesis test."""
    v = O.variable(F.col("title"), source_category=F.col("source_category"))
    return table(spark, d, "metadata").select("row_id", v.alias("canonical_variable")).withColumn("filter_flag", O.filter_flag(F.col("canonical_variable")))


@BOOK.query("f32_meta_labels", f"select corpus, count(*) n, sum({_CONTEXT_META}::int)::bigint n_meta from metadata where title is not null and trim(title) != '' group by 1")
def f32(spark, d):
    """Labels of a synthesis: exact, by substring, by prose, or by the source of their document."""
    m = table(spark, d, "metadata").where("title is not null and trim(title) != ''")
    return m.groupBy("corpus").agg(F.count("*").alias("n"), F.sum(O.meta_label(F.col("title"), source_category=F.col("source_category")).cast("int")).alias("n_meta"))


@BOOK.query("f33_canonical_method", f"select row_id, {_METHOD} canonical_method from core_ml_techniques_all")
def f33(spark, d):
    return table(spark, d, "core_ml_techniques_all").select("row_id", O.method(F.col("technique")).alias("canonical_method"))


def _score(col: str, pats) -> str:
    return "(" + "+".join(f"regexp_matches(lower({col}),'(?i){p}')::int" for p in pats) + ")"


@BOOK.query("f34_effect_trend", f"select doc_id, case when {MISS.format('text')} then 'Null' when {_score('text', O.POSITIVE)}>{_score('text', O.NEGATIVE)} then 'Positive' when {_score('text', O.NEGATIVE)}>{_score('text', O.POSITIVE)} then 'Negative' else 'Null' end trend from documents")
def f34(spark, d):
    return table(spark, d, "documents").select("doc_id", O.trend(F.col("text")).alias("trend"))


@BOOK.query("f30_predictor_category", f"select category, count(*) n from (select case {_sql_cases('lower(title)', O.PREDICTOR_WORDS)} else 'Student: Attitudinal/Behavioral' end category from metadata where title is not null) group by 1")
def f30(spark, d):
    return table(spark, d, "metadata").where("title is not null").groupBy(O.predictor_category(F.col("title")).alias("category")).agg(F.count("*").alias("n"))


@BOOK.query("f37_effect_predictor", f"select predictor, count(*) n from (select case {_sql_cases('title', O.PREDICTORS)} else 'OTHER' end predictor from metadata where title is not null) group by 1")
def f37(spark, d):
    return table(spark, d, "metadata").where("title is not null").groupBy(first_match(F.col("title"), O.PREDICTORS, "OTHER").alias("predictor")).agg(F.count("*").alias("n"))


_CYC = ",".join(map(str, O.CYCLES))


@BOOK.query("f36_evidence_signals", f"""select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text,'\\b((?:199|200|201|202)[0-9])\\b',1), lambda x: x::int), lambda y: y in ({_CYC})))),'|') cycles,
 case when {"+".join(f"contains(lower(text),'{w}')::int" for w in ("positive", "positively", "higher", "increase", "better", "improve"))} > {"+".join(f"contains(lower(text),'{w}')::int" for w in ("negative", "negatively", "inverse", "decrease", "lower", "worse"))} then '+'
 when {"+".join(f"contains(lower(text),'{w}')::int" for w in ("negative", "negatively", "inverse", "decrease", "lower", "worse"))} > {"+".join(f"contains(lower(text),'{w}')::int" for w in ("positive", "positively", "higher", "increase", "better", "improve"))} then '-' end direction from documents where text is not null""")
def f36(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.array_join(O.cycles(F.col("text")), "|").alias("cycles"), O.direction(F.col("text")).alias("direction"))


def _sql_first(rules, default) -> str:
    return "case " + " ".join("when " + " or ".join("contains(low,'" + w.replace("'", "''") + "')" for w in words) + f" then '{label}'" for label, words in rules) + f" else '{default}' end"


_NAMED = "concat_ws('|'," + ",".join("case when " + " or ".join(f"contains(low,'{w}')" for w in words) + f" then '{n}' end" for n, words in O.PROGRAM_WORDS) + ")"


@BOOK.query("f36_all_signals", f"select doc_id, {_NAMED} programs, {_sql_first(O.CONSTRUCT_WORDS, 'UNMATCHED')} construct, {_sql_first(O.OUTCOME_WORDS, 'unspecified')} outcome, {_sql_first(O.EFFECT_WORDS, 'associative')} effect_type, {_sql_first(O.LEVEL_WORDS, 'student')} analysis_level, cycles, direction from (select doc_id, lower(text) low from documents where text is not null) join ({BOOK.sql['f36_evidence_signals']}) using (doc_id)")
def f36b(spark, d):
    """All seven signals of a text."""
    t = table(spark, d, "documents").where("text is not null").withColumn("low", F.lower("text"))
    return t.select("doc_id", F.array_join(O.cycles(F.col("text")), "|").alias("cycles"), O.direction(F.col("text")).alias("direction"), *[c.alias(n) for n, c in O.signals(F.col("low")).items()])


@BOOK.query("f01_doi_bare", "select row_id, regexp_replace(trim(doi), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:?\\s*)', '') doi from metadata where doi is not null")
def f01(spark, d):
    return table(spark, d, "metadata").where("doi is not null").select("row_id", T.doi_bare(F.col("doi")).alias("doi"))


_TAIL = r"10\.[0-9]{4,9}/[^\s\"<>]+"


@BOOK.query("f02_document_doi", rf"""with c as (select row_id, list_filter(list_transform(list_concat(list_concat(regexp_extract_all(doi,'(?i)https?://(?:dx\.)?doi\.org/({_TAIL})',1), regexp_extract_all(doi,'(?i)doi[:\s]+({_TAIL})',1)), regexp_extract_all(doi,'(?i)\b({_TAIL})',1)), lambda x: lower(regexp_replace(x,'[.,;:)>\]}}]+$',''))), lambda x: length(x)>=12) l from metadata where doi is not null)
select row_id, l[1] doi from c""")
def f02(spark, d):
    return table(spark, d, "metadata").where("doi is not null").select("row_id", T.document_doi(F.col("doi")).alias("doi"))


def _at(p: str) -> str:
    return f"length(string_split_regex(raw_text,'{p}')[1])"


@BOOK.query("f03_sections", "with s as (select file_id, list_filter([" + ",".join(f"case when regexp_matches(raw_text,'{p}') then {{'pos':{_at(p)},'name':'{n}'}} end" for n, p in T.SECTIONS) + "], lambda x: x is not null) l from processed_pdf where raw_text is not null) select file_id, array_to_string(list_transform(list_sort(l), lambda x: x['name']),'>') sections, len(l)>=3 has_sections from s")
def f03(spark, d):
    p = table(spark, d, "processed_pdf").where("raw_text is not null")
    s = T.section_starts(F.col("raw_text"))
    return p.select("file_id", F.array_join(F.transform(s, lambda x: x["name"]), ">").alias("sections"), T.has_sections(F.col("raw_text")).alias("has_sections"))


_REFS = T.SECTIONS[-1][1]


@BOOK.query("f04_payload_and_tokens", f"select file_id, length(string_split_regex(raw_text,'{_REFS}')[1]) payload_chars, greatest(1, length(raw_text)//4) tokens from processed_pdf where raw_text is not null")
def f04(spark, d):
    p = table(spark, d, "processed_pdf").where("raw_text is not null")
    return p.select("file_id", F.length(T.before_references(F.col("raw_text"))).cast("long").alias("payload_chars"), T.token_estimate(F.col("raw_text")).alias("tokens"))


_SECTION = "case when regexp_matches(raw_text,'{p}') then {{'pos':{at},'name':'{n}'}} end"
_PARTS = "||".join(f"list_transform(list_filter(b, lambda x: x['name']='{n}'), lambda x: x['body'])" for n in T.INFORMATIVE)


@BOOK.query("f04_section_payload", "with s as (select file_id, raw_text, list_sort(list_filter([" + ",".join(_SECTION.format(p=p, at=_at(p), n=n) for n, p in T.SECTIONS) + rf"""], lambda x: x is not null)) l from processed_pdf where raw_text is not null),
e as (select file_id, raw_text, len(l)>=3 smart, list_transform(range(1,len(l)+1), lambda i: {{'name': l[i]['name'], 'body': regexp_replace(substring(raw_text, l[i]['pos']+1, coalesce(l[i+1]['pos'], length(raw_text))-l[i]['pos']), '^\s+|\s+$', '', 'g')}}) b from s),
p as (select file_id, smart, left(case when smart then array_to_string({_PARTS}, chr(10)||chr(10)) else regexp_replace(string_split_regex(raw_text,'{_REFS}')[1], '^\s+|\s+$', '', 'g') end, 400000) t from e) select file_id, smart, length(t) payload_chars, md5(t) payload_md5 from p""")
def f04b(spark, d):
    p = table(spark, d, "processed_pdf").where("raw_text is not null").select("file_id", T.payload(F.col("raw_text")).alias("p"))
    return p.select("file_id", "p.smart", F.length("p.text").cast("long").alias("payload_chars"), F.md5("p.text").alias("payload_md5"))


@BOOK.query("f05_cost", "select corpus, round(sum((prompt_tokens*2.5+completion_tokens*10.0)/1e6),6) cost_usd, round(avg(extraction_cost_usd),6) stated_avg from metadata group by corpus")
def f05(spark, d):
    return table(spark, d, "metadata").groupBy("corpus").agg(r6(F.sum(T.cost(F.col("prompt_tokens"), F.col("completion_tokens")))).alias("cost_usd"), r6(F.avg("extraction_cost_usd")).alias("stated_avg"))


@BOOK.query("f08_slug", "with s as (select distinct technique, left(regexp_replace(regexp_replace(lower(technique),'[^a-z0-9]+','_','g'),'^_+|_+$','','g'),48) s from core_ml_techniques_all where technique is not null) select technique, case when s='' then 'unnamed' else s end slug from s")
def f08(spark, d):
    return table(spark, d, "core_ml_techniques_all").where("technique is not null").select("technique").distinct().select("technique", T.slug(F.col("technique")).alias("slug"))


@BOOK.query("f09_name_fold", f"select row_id, regexp_replace(translate(lower(file_name),'{T._MARKED}','{T._FOLDED}'),'[^a-z0-9]','','g') name_key from metadata where file_name is not null")
def f09(spark, d):
    return table(spark, d, "metadata").where("file_name is not null").select("row_id", T.fold(F.col("file_name")).alias("name_key"))


@BOOK.query("f22_sample_size", r"with h as (select doc_id, list_filter(list_transform(list_concat(regexp_extract_all(text,'\b[Nn]\s*=\s*([0-9][0-9,]*)',1), regexp_extract_all(text,'(?i)\b([0-9][0-9,]*)\s+(?:students|pupils|schools|points)',1)), lambda x: try_cast(replace(x,',','') as bigint)), lambda n: n between 50 and 10000000) l from documents where text is not null) select doc_id, l[1] n from h")
def f22(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.sample_size(F.col("text")).alias("n"))


@BOOK.query("f26_year_fill", r"with y as (select row_id, pub_year, list_filter(list_transform(regexp_extract_all(coalesce(file_name,'')||' '||coalesce(title,''),'(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)',1), lambda x: x::int), lambda v: v between 1990 and 2035) l from metadata) select row_id, coalesce(pub_year, l[1]) filled_year from y where pub_year is null")
def f26(spark, d):
    m = table(spark, d, "metadata").where("pub_year is null")
    return m.select("row_id", F.coalesce(F.col("pub_year"), T.year_of(F.concat_ws(" ", F.coalesce("file_name", F.lit("")), F.coalesce("title", F.lit(""))))).alias("filled_year"))


@BOOK.query("f38_technique_mapping", "select technique, count(*) n from (select coalesce((select min(canonical_name) from canonical_terms c where kind='technique' and lower(c.canonical_name)=lower(trim(t.technique))), 'OTHER') technique from core_ml_techniques_all t where technique is not null) group by 1")
def f38(spark, d):
    names = table(spark, d, "canonical_terms").where("kind = 'technique'").groupBy(F.lower("canonical_name").alias("k")).agg(F.min("canonical_name").alias("name"))
    t = table(spark, d, "core_ml_techniques_all").where("technique is not null").withColumn("k", F.lower(F.trim("technique")))
    return t.join(names, "k", "left").groupBy(F.coalesce("name", F.lit("OTHER")).alias("technique")).agg(F.count("*").alias("n"))


@BOOK.query("f38_canonical_technique", f"""with k as (select lower(canonical_name) k, min(canonical_name) v from canonical_terms where kind='technique' and canonical_name<>'' group by 1), a as (select k, min(v) v from (select * from k union all select lower(short_form), min(canonical_name) from canonical_terms where kind='technique' and lower(short_form) not in (select k from k) group by 1) group by 1),
s as (select technique raw, count(*) n from core_ml_techniques_all group by 1), m as (select raw, n, trim(raw) t, lower(trim(raw)) l from s)
select technique, sum(n)::bigint n from (select n, case when {BLANK.format('raw')} then 'Not Reported' else coalesce((select v from a where a.k=m.l), (select arg_min(v, (-length(k.k), k.k)) from k where contains(m.l, k.k)), t) end technique from m) group by 1""")
def f38b(spark, d):
    """Exact name or short form, else the longest name inside the value, else the value itself; over distinct values."""
    s = table(spark, d, "core_ml_techniques_all").groupBy("technique").agg(F.count("*").alias("n"))
    named = s.select(O.canonical_technique(F.col("technique"), table(spark, d, "canonical_terms").where("kind = 'technique'")).alias("technique"), "n")
    return named.groupBy("technique").agg(F.sum("n").alias("n"))


@BOOK.query("f40_list_split", "with s as (select row_id, list_filter(list_transform(string_split(translate(authors,';|',',,'),','), lambda x: trim(x)), lambda x: x<>'') l from metadata where authors is not null) select row_id, len(l)::int n_authors, l[1] first_author from s")
def f40(spark, d):
    l = T.split_list(F.col("authors"))
    return table(spark, d, "metadata").where("authors is not null").select("row_id", F.size(l).alias("n_authors"), F.try_element_at(l, F.lit(1)).alias("first_author"))


@BOOK.query("f11_label_split", r"with s as (select distinct title from metadata where title is not null), l as (select title, list_filter(list_transform(string_split(regexp_replace(title,'\s+(?:and|&)\s+|\s*[;,]\s*','|','g'),'|'), lambda x: regexp_replace(trim(x),'(?i)^(?:the|an|a)\s+','')), lambda x: x<>'') l from s) select title, len(l)::int n_labels, l[1] first_label from l")
def f11(spark, d):
    l = T.split_labels(F.col("title"))
    return table(spark, d, "metadata").where("title is not null").select("title").distinct().select("title", F.size(l).alias("n_labels"), F.try_element_at(l, F.lit(1)).alias("first_label"))


_NAMES = "select distinct trim(weight_variable_name) \"name\" from core_data where trim(weight_variable_name) != '' union select unnest(['CNT','W_FSTURWT12','PV3MATH','PVREAD4','JKZONE','BSMMAT03','SPFWT17','PVLIT2','PV2CIV','IDCNTRY','PV5CT'])"
_PROGRAMS = ("PISA", "TIMSS", "PIRLS", "TALIS", "PIAAC", "ICCS", "ICILS")
_OWN = ", ".join(f"'{k}'" for k in O.WEIGHTS if k != "*")


def _role_sql() -> str:
    when = lambda p: f"program not in ({_OWN})" if p == "*" else f"program='{p}'"
    parts = [f"when upper(\"name\") in ({', '.join(repr(x) for x in O.COUNTRY_NAMES)}) then 'country'"]
    for k, label in ((0, "weight"), (1, "replicate")):
        parts += [f"when {when(p)} and regexp_matches(\"name\",'(?i){ws[k]}') then '{label}'" for p, ws in O.WEIGHTS.items()]
    parts += [f"when program='{p}' and regexp_matches(\"name\",'(?i){x}') then 'pv:{dom}'" for p, rules in O.PLAUSIBLE.items() for dom, x in rules]
    return "case " + " ".join(parts) + " else 'other' end"


@BOOK.query("f43_variable_roles", f"select \"name\", program, {_role_sql()} \"role\" from ({_NAMES}) cross join (select unnest({list(_PROGRAMS)}) program)")
def f43(spark, d):
    """The role of every variable name that was entered, and of some well-known ones, in each programme."""
    known = spark.createDataFrame([(n,) for n in ("CNT", "W_FSTURWT12", "PV3MATH", "PVREAD4", "JKZONE", "BSMMAT03", "SPFWT17", "PVLIT2", "PV2CIV", "IDCNTRY", "PV5CT")], "name string")
    names = table(spark, d, "core_data").select(F.trim("weight_variable_name").alias("name")).where("name != ''").unionByName(known).distinct()
    each = names.withColumn("program", F.explode(F.array(*[F.lit(p) for p in _PROGRAMS])))
    return each.select("name", "program", O.variable_role(F.col("name"), F.col("program")).alias("role"))


@BOOK.query("f42_catalog_paths", "select row_id, case when regexp_matches(file_name,'(?i)report') then 'report' else 'other' end kind, case when regexp_matches(p,'\\b(19[89][0-9]|20[012][0-9])\\b') then regexp_extract(p,'\\b(19[89][0-9]|20[012][0-9])\\b',1)::int end cycle, 'UNKNOWN_'||left(sha256(p),12) file_id, 'UNKNOWN' program, case when regexp_matches(p,'(?i)STU') then 'student' when regexp_matches(p,'(?i)SCH') then 'school' when regexp_matches(p,'(?i)TCH|TEACHER') then 'teacher' when regexp_matches(p,'(?i)PAR') then 'parent' when regexp_matches(p,'(?i)COG') then 'cognitive' when regexp_matches(p,'(?i)PRIN') then 'principal' else 'other' end \"role\" from (select row_id, file_name, replace(file_name,'_','-') p from metadata where file_name is not null)")
def f42(spark, d):
    m = table(spark, d, "metadata").where("file_name is not null").withColumn("p", F.replace("file_name", F.lit("_"), F.lit("-")))
    return m.select("row_id", F.when(F.col("file_name").rlike("(?i)report"), "report").otherwise("other").alias("kind"), O.path_cycle(F.col("p")).alias("cycle"), O.file_id(F.col("p")).alias("file_id"), O.path_program(F.col("p")).alias("program"), O.path_role(F.col("p")).alias("role"))


@BOOK.query("f46_control_strip", r"select doc_id, length(regexp_replace(text,'[\x00-\x08\x0b\x0c\x0e-\x1f]','','g'))::int n from documents where text is not null")
def f46(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(T.strip_control(F.col("text"))).alias("n"))
