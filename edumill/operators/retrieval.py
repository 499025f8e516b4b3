"""Retrieval over evidence: filtered cosine top-k, keyword scores, hybrid lists, routing of questions, no-evidence guard.

Top-k per question is an ordered aggregation: every task keeps the k best of its rows (a bounded heap in the sort's
limit or in the aggregate), so nothing grows with the corpus but the scan. Questions are a stated set joined by their label;
a question without one is asked of every label. They are broadcast only if they were counted to be few.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import contains_any
from ..session import broadcast_if_small


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, of another length or 0."""
    return F.when(F.size(a) == F.size(b), 1 - F.try_divide(dot(a, b), norm(a) * norm(b)))


def top_k(scored: DataFrame, question: str, order: list, k: int) -> DataFrame:
    """The first k rows of every question in the given order; partitions prune to k rows before the shuffle."""
    w = Window.partitionBy(question).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(rows: DataFrame, questions: DataFrame, k: int = 12, most_distance: float = 0.72) -> DataFrame:
    """(question_id, id, distance, rank): rows (id, vector, label) against questions (question_id, q, q_label): the label
    filter first, then the k nearest, then the distance bound."""
    every = rows.agg(F.collect_set("label")).scalar()  # as many labels as there are kinds of evidence
    asked = questions.withColumn("label", F.explode(F.when(F.col("q_label").isNull(), every).otherwise(F.array("q_label")))).drop("q_label")
    scored = rows.join(broadcast_if_small(asked), "label").select("question_id", "id", cosine_distance(F.col("vector"), F.col("q")).alias("distance")).where("distance is not null")
    return top_k(scored, "question_id", ["distance", "id"], k).where(F.col("distance") <= most_distance)


def keyword_score(low: Column, tokens: list[str]) -> Column:
    """How many tokens are part of a text in lower case."""
    return sum((low.contains(t).cast("int") for t in tokens), F.lit(0))


def keyword_search(rows: DataFrame, query: str, k: int = 8, text: str = "text", key: str = "id") -> DataFrame:
    """The k rows of highest keyword score for one question; ties by id."""
    tokens = sorted(set(re.findall("[a-z]{4,}", query.lower())))
    scored = rows.select(key, text, F.lower(text).alias("low_")).select(key, text, keyword_score(F.col("low_"), tokens).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def keyword_search_sources(sources: list[tuple[DataFrame, str, str]], query: str, k: int = 8) -> DataFrame:
    """(source, id, score) of the k best rows of several tables (df, text, id): by score, then by the order of the tables, then
    by id, as a stable sort of their rows one after the other gives."""
    every = None
    for n, (df, text, key) in enumerate(sources):
        part = keyword_search(df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), query, k).select(F.lit(n).alias("source"), "id", "score")
        every = part if every is None else every.unionByName(part)
    return every.orderBy(F.desc("score"), "source", "id").limit(k)


def hybrid(dense: DataFrame, keyword: DataFrame, k: int, extra: int = 4, core: int = 58) -> DataFrame:
    """Dense lines (line, rank), then keyword lines whose first core letters no dense line holds; at most k + extra lines."""
    d = dense.select("line", F.lit(0).alias("source"), "rank")
    w = keyword.select("line", F.lit(1).alias("source"), "rank")
    held = d.agg(F.collect_list(F.lower("line"))).scalar()  # at most k lines
    fresh = w.withColumn("held", held).where(~F.exists("held", lambda h: F.instr(h, F.left(F.lower(F.col("line")), F.lit(core))) > 0)).drop("held")
    return d.unionByName(fresh).orderBy("source", "rank").limit(k + extra)


#: fixed values: words by which a question asks for the debate layer, a method or one of three variables, in two languages
DEBATE = ("literatür tartışması", "literature debate", "policy debate", "politika tartışması", "systematic review", "metodoloji tartışması", "methodology debate", "framework discourse", "tarihsel gelişim", "historical development")
ASKED_METHOD = ("traditional_stats", "traditional stats", "geleneksel istatistik")
ASKED_MATH = ("math_achievement", "mathematics achievement", "matematik başarı")
ASKED_SES = ("socioeconomic", "sosyoekonomik", "escs", "hisei", "homepos", "ses-başarı", "ses-achievement")
ASKED_TEACHER = ("teacher_efficacy", "teacher efficacy", "iş tatmini")
TEACHER_TR, TEACHER_TOPICS = "öğretmen", ("efficacy", "yeterlik", "tatmin")


def route(question: Column) -> Column:
    """Filters read from a question: the evidence layer, a method, and a variable if exactly one family is named."""
    q = F.lower(question)
    math = contains_any(q, ASKED_MATH)
    ses = q.rlike(r"\bses\b") | contains_any(q, ASKED_SES)
    teacher = contains_any(q, ASKED_TEACHER) | F.contains(q, F.lit(TEACHER_TR)) & contains_any(q, TEACHER_TOPICS)
    one = math.cast("int") + ses.cast("int") + teacher.cast("int") == 1
    return F.struct(
        F.when(contains_any(q, DEBATE), "theoretical_meta_synthesis").otherwise("empirical_finding").alias("layer"),
        F.when(contains_any(q, ASKED_METHOD), "Traditional_Stats").alias("method"),
        F.when(one & math, "Math_Achievement").when(one & ses, "SES").when(one & teacher, "Teacher_Efficacy_Workforce").alias("variable"),
    )


def guard(hits: DataFrame, message: str = "No evidence found") -> DataFrame:
    """One row: the number of hits and a message where there are none."""
    return hits.agg(F.count("*").alias("n")).select("n", F.when(F.col("n") == 0, message).alias("message"))
