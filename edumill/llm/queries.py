"""Queries of the llm subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, table
from . import canon
from .canon import mapped_rows
from .golden import DOI_FORM, PLACEHOLDERS, file_key, survivors, title_intact
from .langid import segments
from .leak import leaks
from .ledger import collapsed
from .packing import pack
from .scans import repair
from .subject import subjects


def _doi_intact():
    return F.col("doi").rlike(DOI_FORM)


def _file_intact():
    plain = F.lower(F.trim("file_name"))
    return ~F.col("file_shared") & ~plain.isin(*PLACEHOLDERS) & (file_key(F.col("file_name")) == plain)


def _title_intact():
    return title_intact(F.col("title")) & ~F.col("title_cut")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "metadata").select("row_id", "corpus", "file_name", "title", "doi", "extraction_timestamp")
    intact = {"file_name": _file_intact(), "doi": _doi_intact(), "title": _title_intact()}
    best = survivors(rows, table(spark, sf_dir, "corpus_trust"), {b: [b] for b in intact}, intact, {})
    return best.select("first_row_id", "file_name", F.lower("doi").alias("doi"), "title")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole surviving records: names and imprint are bundles that depend on the DOI."""
    rows = table(spark, sf_dir, "metadata")
    bundles = {"doi": ["doi"], "title": ["title", "title_lang"], "file_name": ["file_name"], "people": ["authors", "pub_year"], "imprint": ["venue", "publication_type", "source_category"]}
    intact = {"file_name": _file_intact(), "doi": _doi_intact(), "title": _title_intact(), "people": F.col("authors").isNotNull() & F.col("pub_year").isNotNull(), "imprint": F.col("venue").isNotNull() & F.col("publication_type").isNotNull()}
    return survivors(rows, table(spark, sf_dir, "corpus_trust"), bundles, intact, {"people": "doi", "imprint": "doi"})


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("metadata.title", "metadata", "row_id", "title_lang", "title"), ("survey_design.weight_fields_interpretation", "survey_design", "row_id", "text_lang", "weight_fields_interpretation"), ("documents.text", "documents", "doc_id", "lang", "text"))
    rows = None
    for name, source, key, label, text in fields:
        part = table(spark, sf_dir, source).select(F.lit(name).alias("field_name"), F.col(key).alias("row_id"), F.col(label).alias("label"), F.col(text).alias("text"), F.lit(name == "metadata.title").alias("is_title")).where("row_id is not null")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of all texts with their confidence."""
    return segments(_texts(spark, sf_dir)).drop("is_case")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(_texts(spark, sf_dir)).where("is_case").select("field_name", "row_id", "seg_no", "lang")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    core, every = table(spark, sf_dir, "core_data"), table(spark, sf_dir, "core_ml_techniques_all")
    fields = (("core_data.ml_technique_primary", core, "ml_technique_primary", "technique"), ("core_ml_techniques_all.technique", every, "technique", "technique"), ("core_data.weight_variable_name", core, "weight_variable_name", "weight"))
    rows = None
    for name, df, column, kind in fields:
        part = df.select(F.lit(name).alias("field_name"), "row_id", F.lit(kind).alias("kind"), F.col(column).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return mapped_rows(rows, table(spark, sf_dir, "canonical_terms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "metadata_blocks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "processed_pdf")).where("kind != 'text'").select("file_id", "field_name", "line_no", "kind", "fixed")


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable text of both fields."""
    return repair(table(spark, sf_dir, "processed_pdf")).where("kind = 'text'").select("file_id", "field_name", "repaired")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document and piece, for each budget."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused room per budget."""
    per = p8_containers(spark, sf_dir).groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    per = per.join(broadcast_if_small(table(spark, sf_dir, "pack_budgets")), "budget_id")
    return per.groupBy("budget_id", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("most_used"), (1 - F.sum("used") / (F.count("*") * F.first("capacity_tokens"))).alias("unused_share"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal and re-parameterised passages with the number of item words covered."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("kind = 'literal'").select("doc_id", "item_id")


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas with the number of paragraphs they fill and their largest share."""
    return subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_subjects(spark, sf_dir).select("doc_id", "subject_id")


P5_SQL = r"""
with k as (select block_id, [bare(file_name), bare(doi), bare(block->>'title'), bare(block->>'authors'), bare(block->>'year'),
  bare(block->>'venue'), bare(block->>'publication_type')] key from metadata_blocks)
select min(block_id) block_id, count(*)::int n_copies from k group by key having count(*) > 1
"""


def _bare(sql: str) -> str:
    """bare(x) written out, as the text is a single statement."""
    import re

    return re.sub(r"bare\(((?:[^()']|'[^']*')*)\)", r"regexp_replace(lower(\1), '[^\\p{L}\\p{N}]', '', 'g')", sql)


def _p1_sql() -> str:
    ws = "regexp_replace({0},'[\\s\\p{{Z}}]+',' ','g')"
    plain = f"lower(trim({ws}))"
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in PLACEHOLDERS)
    title = "regexp_replace(translate(replace(lower(title),'ß','ss'),'ı\u0307','i'),'[^\\p{L}\\p{N}]','','g')"
    name = f"regexp_replace({plain.format('file_name')},'^copy of\\s+','')"
    for tail in (r"[\s_-]+copy(?:\s*\(\d+\))?", r"\s*\(\d+\)"):
        name = f"regexp_replace({name},'{tail}(\\.[a-z0-9]+)$','\\1')"
    pick = "arg_min({0}, (coalesce(trust_rank, 2147483647), -epoch_us(coalesce(extraction_timestamp, timestamp '0001-01-01')), row_id)) filter ({1})"
    return f"""with recursive k as (select row_id, corpus, extraction_timestamp, file_name, doi, title,
  nullif(regexp_extract(regexp_replace(lower(doi),'[\\s\\p{{Z}}]+','','g'),'(10\\.[0-9]{{4,9}}/.*[a-z0-9])',1),'') d,
  case when {plain.format('title')} not in ({words}) and not regexp_matches(title,'(…|\\.\\.\\.|\\[\\.\\.\\.\\.\\]|\\[…\\])\\s*$') and not regexp_matches(title,'(?i)^\\s*(microsoft (word|powerpoint)|slide \\d|layout \\d|untitled)\\b') then nullif({title},'') end t,
  case when {plain.format('file_name')} not in ({words}) then nullif({name},'') end f from metadata where row_id is not null),
shared as (select f from k where f is not null group by 1 having min(d) < max(d)),
e as (select row_id u, 'd'||d key from k where d is not null union all select row_id, 't'||t from k where t is not null union all select row_id, 'f'||f from k where f is not null and f not in (select f from shared)),
l as (select distinct a.u, b.u v from e a join e b using (key) where a.u != b.u), reach as (select distinct u, u c from l union select l.v, reach.c from reach join l on l.u = reach.u where reach.c < l.v),
g as (select u row_id, min(c) comp from reach group by 1), m as (select k.*, comp, trust_rank, coalesce(f in (select f from shared), false) shared from k join g using (row_id) left join (select corpus, min(trust_rank) trust_rank from corpus_trust group by 1) using (corpus)),
c as (select comp, t, lead(t) over (partition by comp order by t) nxt from (select distinct comp, t from m where t is not null)), n as (select m.*, coalesce(starts_with(nxt, m.t), false) cut from m left join c on c.comp = m.comp and c.t = m.t)
select comp first_row_id, {pick.format('file_name', f"not shared and lower(trim(file_name)) not in ({words}) and f = lower(trim(file_name))")} file_name,
 lower({pick.format('doi', "regexp_full_match(doi,'10\\.[0-9]{4,9}/[^\\s\\p{Z}]*[A-Za-z0-9]')")}) doi,
 {pick.format('title', "t is not null and not cut and upper(title) != title and not regexp_matches(title,'^[\\s\\p{Z}]|[\\s\\p{Z}]$|[\\s\\p{Z}]{2}|[\\r\\n\\t\\x{A0}\\x{2009}]')")} title from n group by 1"""


def _p3_sql() -> str:
    compact = "regexp_replace({0},'[^\\p{{L}}\\p{{N}}]','','g')"
    toks = "list_distinct(list_transform(range(1, length({0})+2), lambda i: substr('^'||{0}||'$', i, 2)))"
    allowed = "case when length(r)<4 then 0 when length(r)<10 then 1 when length(r)<14 then 2 else 3 end"
    forms = ", ".join(compact.format(x) for x in ("p", "o", "n", "m", "b", "regexp_replace(b,'^([^,]+),\\s*(.+)$','\\2 \\1')"))
    return f"""with v as (select 'core_data.ml_technique_primary' field_name, row_id, 'technique' kind, ml_technique_primary v from core_data union all select 'core_ml_techniques_all.technique', row_id, 'technique', technique from core_ml_techniques_all union all select 'core_data.weight_variable_name', row_id, 'weight', weight_variable_name from core_data),
c as (select * from v where v is not null and not regexp_full_match(v,'[\\s\\p{{Z}}]*') and not exists (select 1 from canonical_terms t where t.kind = v.kind and t.canonical_name = v.v)),
a as (select kind, v, trim(regexp_replace(lower(v),'[\\s\\p{{Z}}_]+',' ','g')) p from (select distinct kind, v from c)),
b as (select *, regexp_replace(p,'{canon._REMARK}',' ','g') o, regexp_extract(p,'[(\\[{{]([^)\\]}}]*)',1) m from a), d as (select *, regexp_replace(o,'{canon._AHEAD}','') n from b), e as (select *, regexp_replace(n,'{canon._BEHIND}','') b from d),
l as (select kind, v, unnest(list_filter(list_distinct([{forms}]), lambda x: x != '')) l from e),
f as (select kind, term_id, false short, {compact.format('lower(canonical_name)')} r from canonical_terms union all select kind, term_id, true, {compact.format('lower(short_form)')} from canonical_terms where short_form is not null),
w as (select kind, l, r, term_id, case when l = r then 0 else damerau_levenshtein(l, r) end n from (select distinct kind, l from l) join f using (kind) where r != '' and (l = r or not short and abs(length(l)-length(r)) <= 3 and damerau_levenshtein(l, r) <= {allowed})),
j as (select kind, l, arg_min(term_id, (-len(list_intersect({toks.format('l')}, {toks.format('r')}))::double/(len({toks.format('l')})+len({toks.format('r')})-len(list_intersect({toks.format('l')}, {toks.format('r')}))), n, term_id)) term_id, min((-len(list_intersect({toks.format('l')}, {toks.format('r')}))::double/(len({toks.format('l')})+len({toks.format('r')})-len(list_intersect({toks.format('l')}, {toks.format('r')}))), n, term_id)) best from w group by 1,2),
m as (select kind, v, arg_min(term_id, best) term_id from l join j using (kind, l) group by 1,2)
select field_name, row_id, coalesce(m.term_id, 0)::int term_id from c left join m using (kind, v)"""


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p7_found": p7_found, "p7_repaired": p7_repaired, "p10_found": p10_found, "p10_subjects": p10_subjects, "p9_found": p9_found, "p9_leaks": p9_leaks, "p2_found": p2_found, "p2_segments": p2_segments, "p1_found": p1_found, "p1_survivors": p1_survivors, "p3_found": p3_found, "p5_found": p5_found}
SQL = {"p1_found": _p1_sql(), "p3_found": _p3_sql(), "p5_found": _bare(P5_SQL)}
