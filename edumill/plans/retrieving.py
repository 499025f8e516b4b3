"""Retrieval queries on embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as Q
from ..session import table
from .base import Book, r6
from .evidence import CUBE, coded
from ..operators import synthesis as Y

BOOK = Book()
COS = "1-list_dot_product(e.embedding::double[], q.embedding::double[])/(sqrt(list_dot_product(e.embedding::double[],e.embedding::double[]))*sqrt(list_dot_product(q.embedding::double[],q.embedding::double[])))"


@BOOK.query("q01_row_documents", f"select printf('Method: %s | Variable: %s | Trend: %s | Studies: %d', \"method\", variable, trend, study_count) doc, variable, study_count from ({CUBE})")
def q01(spark, d):
    c = Y.cube(coded(spark, d))
    return c.select(F.format_string("Method: %s | Variable: %s | Trend: %s | Studies: %d", "method", "variable", "trend", "study_count").alias("doc"), "variable", "study_count")


QUESTIONS = ("What is the effect of SES on outcomes?", "Traditional stats and mathematics achievement", "A systematic review of methods", "Does teacher efficacy or SES matter?", "Anything else")


def _asks(words) -> str:
    return "(" + " or ".join(f"contains(q,'{w}')" for w in words) + ")"


_MATH, _SES, _TEACHER = _asks(Q.ASKED_MATH), f"(regexp_matches(q,'\\bses\\b') or {_asks(Q.ASKED_SES)})", f"({_asks(Q.ASKED_TEACHER)} or contains(q,'{Q.TEACHER_TR}') and {_asks(Q.TEACHER_TOPICS)})"
_ASKED = ", ".join(f"('{x}')" for x in QUESTIONS)


@BOOK.query("q02_question_routing", f"with a as (select distinct title question, lower(title) q from metadata where title is not null union select question, lower(question) from (values {_ASKED}) t(question)), b as (select *, {_MATH}::int m, {_SES}::int s, {_TEACHER}::int t from a) select question, case when {_asks(Q.DEBATE)} then 'theoretical_meta_synthesis' else 'empirical_finding' end layer, case when {_asks(Q.ASKED_METHOD)} then 'Traditional_Stats' end as \"method\", case when m+s+t=1 then case when m=1 then 'Math_Achievement' when s=1 then 'SES' else 'Teacher_Efficacy_Workforce' end end variable from b")
def q02(spark, d):
    """Filters of some questions, and of every title taken as a question."""
    asked = spark.createDataFrame([(x,) for x in QUESTIONS], "question string").unionByName(table(spark, d, "metadata").where("title is not null").select(F.col("title").alias("question"))).distinct()
    return asked.select("question", Q.route(F.col("question")).alias("r")).select("question", "r.layer", "r.method", "r.variable")


@BOOK.query("q03_vector_search", f"with q as (select * from embeddings where vec_id%100=0), s as (select q.vec_id question_id, e.vec_id id, {COS} distance from q join embeddings e on e.label=q.label), r as (select *, row_number() over (partition by question_id order by distance, id) rank from s where distance is not null) select question_id, id, round(distance,6)+0.0 distance, rank::int rank from r where rank<=12 and distance<=0.72")
def q03(spark, d):
    e = table(spark, d, "embeddings")
    questions = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    hits = Q.vector_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), questions)
    return hits.select("question_id", "id", (r6("distance") + 0.0).alias("distance"), "rank")


@BOOK.query("q04_hits_by_trend", f"select trend, sum(study_count)::bigint n_studies, count(*) n_hits, case when count(*)=0 then 'No evidence found' end message from ({CUBE}) where variable='LARGE' group by 1")
def q04(spark, d):
    return Y.cube(coded(spark, d)).where("variable = 'LARGE'").groupBy("trend").agg(F.sum("study_count").alias("n_studies"), F.count("*").alias("n_hits")).withColumn("message", F.when(F.col("n_hits") == 0, "No evidence found"))


QUERY = "How do replicate weights and jackknife variance affect school achievement?"
_TOKENS = "['replicate','weights','jackknife','variance','affect','school','achievement']"


@BOOK.query("q05_keyword_search", f"select doc_id, score from (select doc_id, len(list_filter({_TOKENS}, lambda t: contains(lower(text),t)))::int score from documents where text is not null) where score>0 order by score desc, doc_id limit 8")
def q05(spark, d):
    return Q.keyword_search(table(spark, d, "documents"), QUERY, 8, "text", "doc_id").select("doc_id", "score")


_SCORED = "select {n} source, {key}::bigint id, len(list_filter({tokens}, lambda t: contains(lower({text}),t)))::int score from {table} where {text} is not null"
_THREE = (("documents", "text", "doc_id"), ("metadata", "title", "row_id"), ("subject_areas", "scope_note", "subject_id"))


@BOOK.query("t04_keyword_sources", "with s as (" + " union all ".join(_SCORED.format(n=n, key=k, tokens=_TOKENS, text=x, table=t) for n, (t, x, k) in enumerate(_THREE)) + ") select source::int source, id, score from s where score>0 order by score desc, source, id limit 8")
def t04(spark, d):
    """The best rows of documents, titles and subject notes together."""
    return Q.keyword_search_sources([(table(spark, d, t), x, k) for t, x, k in _THREE], QUERY)


def _lines_sql(tokens: str, k: int) -> str:
    return f"select left(text,120) line, row_number() over (order by score desc, doc_id) rank from (select text, doc_id, len(list_filter({tokens}, lambda t: contains(lower(text),t))) score from documents where text is not null) where score>0 order by score desc, doc_id limit {k}"


@BOOK.query("q06_hybrid", f"with a as ({_lines_sql(str(['invariance', 'measurement', 'plausible', 'values']), 6)}), b as ({_lines_sql(_TOKENS, 8)}), f as (select * from b where not exists (select 1 from a where contains(lower(a.line), left(lower(b.line),58)))) select line, source, rank from (select line, 0 source, rank from a union all select line, 1, rank from f) order by source, rank limit 10")
def q06(spark, d):
    docs = table(spark, d, "documents")
    lines = lambda query, k: Q.keyword_search(docs, query, k, "text", "doc_id").select(F.left("text", F.lit(120)).alias("line"), F.row_number().over(Q.Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))
    return Q.hybrid(lines("plausible values and measurement invariance", 6), lines(QUERY, 8), 6)  # windows over at most 8 rows
