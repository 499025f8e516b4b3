"""Article records: nested JSON to typed records, master and child tables, linking of copies, completeness, findings.

Records come with flags and boolean-like words of any spelling, so every leaf is read as a string and coerced. A payload
that is no record gives a null record and is left out by parsed(); an article without findings keeps a place in the
master table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import broadcast_if_small, stage
from .components import components

RECORD = """metadata STRUCT<file_name STRING, title STRING, authors STRING, year STRING, doi STRING, venue STRING, publication_type STRING, source_category STRING, open_access STRING>,
data STRUCT<survey_design STRUCT<student_weights_used STRING, replicate_weights_used STRING, weight_variable_name STRING, weight_fields_interpretation STRING>,
plausible_values_handling STRING, missing_data_handling STRING, handling_not_reported_explanation STRING, research_design_type STRING, null_fields_interpretation STRING,
sample_details STRUCT<total_students STRING, sample_filtering_criteria STRING, countries STRING>,
ml_techniques STRUCT<`primary` STRING, all_techniques STRING>, confounders_identified ARRAY<STRUCT<variable_code STRING, variable_name STRING, category STRING>>,
main_findings ARRAY<STRUCT<dataset_used STRING, target_variable STRING, top_predictors STRING, performance_metrics STRING, standardized_conclusion STRING>>, outcome_summary STRING>"""


def text_list(c: Column) -> Column:
    """The texts of a JSON list, or of one text divided by commas; null for null."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.left(F.trim(c), F.lit(1)) == "[", F.from_json(c, "array<string>")).otherwise(parts)


def parsed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose payload is an object with metadata and data, with the column r: the record."""
    found = df.withColumn("r", F.from_json(payload, RECORD)).where("r.metadata is not null and r.data is not null")
    listed_ = F.transform("r.data.main_findings", lambda f: f.withField("top_predictors", text_list(f["top_predictors"])))
    return found.withColumn("r", F.col("r").withField("data.main_findings", listed_))


def master(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One flat row per record."""
    m, d = "r.metadata", "r.data"
    return records.select(
        key, F.col(f"{m}.file_name").alias("file_name"), F.col(f"{m}.title").alias("title"), F.col(f"{m}.year").try_cast("int").alias("year"), T.doi_bare(F.col(f"{m}.doi")).alias("doi"),
        F.col(f"{m}.publication_type").alias("publication_type"), T.tri_bool(F.col(f"{m}.open_access")).alias("open_access"), T.tri_bool(F.col(f"{d}.survey_design.student_weights_used")).alias("student_weights_used"),
        F.col(f"{d}.plausible_values_handling").alias("plausible_values_handling"), F.regexp_replace(F.col(f"{d}.sample_details.total_students"), "[^0-9]", "").try_cast("long").alias("total_students"),
        F.size(F.coalesce(F.col(f"{d}.main_findings"), F.array())).alias("n_findings"), F.size(F.coalesce(F.col(f"{d}.confounders_identified"), F.array())).alias("n_confounders"),
    )


def listed(c: Column, sep: str = ", ") -> Column:
    """The texts of a JSON list joined, blank ones left out; any other text as it stands; null for nothing."""
    items = F.filter(F.transform(F.from_json(c, "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    text = F.when(F.left(F.trim(c), F.lit(1)) == "[", F.array_join(items, sep)).otherwise(F.trim(c))
    return F.when(text != "", text)


def countries_formatted(c: Column) -> Column:
    """CODE (n), ... of a JSON list of country objects; entries that are no objects are left out."""
    objects = F.filter(F.from_json(c, "array<string>"), lambda x: F.left(x, F.lit(1)) == "{")

    def one(x: Column) -> Column:
        code, n = F.upper(F.trim(F.get_json_object(x, "$.country_code"))), F.trim(F.get_json_object(x, "$.n_students"))
        label = F.when(F.coalesce(code, F.lit("")) == "", "Unknown").otherwise(code)
        return F.when(F.coalesce(n, F.lit("")) == "", label).otherwise(F.concat(label, F.lit(" ("), n, F.lit(")")))

    text = F.array_join(F.transform(objects, one), ", ")
    return F.when((F.left(F.trim(c), F.lit(1)) == "[") & (text != ""), text)


def master_full(records: DataFrame, key: str = "record_id", corpus: str = "corpus") -> DataFrame:
    """The flat projection of a record in 27 columns, values as they were extracted, lists joined."""
    m, d = "r.metadata", "r.data"
    plain = {
        "file_name": f"{m}.file_name", "doi": f"{m}.doi", "title": f"{m}.title", "year": f"{m}.year", "publication_type": f"{m}.publication_type", "source_category": f"{m}.source_category", "venue": f"{m}.venue", "open_access": f"{m}.open_access",
        "student_weights_used": f"{d}.survey_design.student_weights_used", "replicate_weights_used": f"{d}.survey_design.replicate_weights_used", "weight_variable_name": f"{d}.survey_design.weight_variable_name", "weight_fields_interpretation": f"{d}.survey_design.weight_fields_interpretation",
        "plausible_values_handling": f"{d}.plausible_values_handling", "missing_data_handling": f"{d}.missing_data_handling", "handling_not_reported_explanation": f"{d}.handling_not_reported_explanation", "research_design_type": f"{d}.research_design_type", "outcome_summary": f"{d}.outcome_summary",
        "null_fields_interpretation": f"{d}.null_fields_interpretation", "ml_primary": f"{d}.ml_techniques.primary", "total_students": f"{d}.sample_details.total_students", "sample_filtering_criteria": f"{d}.sample_details.sample_filtering_criteria",
    }
    given = F.col(f"{d}.sample_details.countries")
    return records.select(
        key, *[F.col(path).alias(name) for name, path in plain.items()], listed(F.col(f"{m}.authors")).alias("authors"), listed(F.col(f"{d}.ml_techniques.all_techniques")).alias("ml_all_techniques"),
        F.col(corpus).alias("corpus_source"), F.concat(F.lit("record/"), F.col(key).cast("string")).alias("json_source_path"), countries_formatted(given).alias("countries_formatted"), F.when(~F.trim(given).isin("", "[]", "{}"), given).alias("countries_json"),
    )


def sentinels(master_rows: DataFrame, fills: dict[str, str], flags: tuple[str, ...], key: str = "record_id") -> DataFrame:
    """Blank cells of the master columns get their sentinel; flags become TRUE, FALSE or UNKNOWN, another word stays; the
    primary technique is the first of the list where it is blank."""
    filled = [F.when(T.is_blank(F.col(c)), v).otherwise(F.col(c)).alias(c) for c, v in fills.items()]
    low = lambda c: F.lower(c)
    told = [F.when(T.is_blank(F.col(c)), "UNKNOWN").when(low(c) == "true", "TRUE").when(low(c) == "false", "FALSE").otherwise(F.col(c)).alias(c) for c in flags]
    first = F.trim(F.split("ml_all_techniques", ",")[0])
    primary = F.when(~T.is_blank(F.col("ml_primary")), F.col("ml_primary")).otherwise(F.coalesce(F.when(first != "", first), F.lit("Not reported in extraction")))
    return master_rows.select(key, *filled, *told, primary.alias("ml_primary"))


def findings(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per finding with a target, numbered from 1 in written order, with at most five predictors."""
    f = records.select(key, F.posexplode("r.data.main_findings").alias("pos", "f")).where("f.target_variable is not null")
    return f.select(key, (F.col("pos") + 1).alias("finding_index"), "f.dataset_used", "f.target_variable", F.slice(F.coalesce("f.top_predictors", F.array()), 1, 5).alias("top_predictors"), "f.performance_metrics")


def confounders(records: DataFrame, key: str = "record_id") -> DataFrame:
    c = records.select(key, F.posexplode("r.data.confounders_identified").alias("pos", "c"))
    code = F.when(T.is_missing(F.col("c.variable_code")), T.slug(F.col("c.variable_name"))).otherwise(F.col("c.variable_code"))
    return c.select(key, (F.col("pos") + 1).alias("confounder_index"), code.alias("variable_code"), "c.variable_name", "c.category")


def merged_findings(found: DataFrame, key: str = "record_id") -> DataFrame:
    """Findings of a record with the same dataset and target, letter case and blanks aside, as one, metrics joined in order."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    g = found.groupBy(key, norm("dataset_used").alias("dataset"), norm("target_variable").alias("target")).agg(F.min("finding_index").alias("finding_index"), F.array_sort(F.collect_list(F.struct("finding_index", "performance_metrics"))).alias("m"))
    return g.select(key, "finding_index", "dataset", "target", F.array_join(F.array_distinct(F.filter(F.transform("m", lambda x: x["performance_metrics"]), lambda x: ~T.is_missing(x))), "; ").alias("metrics"))


def completeness(technical: Column) -> Column:
    """Share of filled fields of a record, out of 10 for technical documents, else 13, three decimals."""
    s = lambda c: (~T.is_blank(F.col(c))).cast("int")
    base = [s(f"r.metadata.{x}") for x in ("title", "doi", "year", "publication_type")] + [s(f"r.data.{x}") for x in ("plausible_values_handling", "missing_data_handling", "survey_design.weight_fields_interpretation", "survey_design.weight_variable_name", "sample_details.sample_filtering_criteria")]
    base.append(F.greatest(s("r.data.ml_techniques.primary"), s("r.data.ml_techniques.all_techniques")))
    more = [(F.size(F.coalesce("r.data.main_findings", F.array())) > 0).cast("int"), (F.size(F.coalesce("r.data.confounders_identified", F.array())) > 0).cast("int"), s("r.data.outcome_summary")]
    ten = sum(base[1:], base[0])
    return F.round(F.when(technical, ten / 10).otherwise((ten + sum(more[1:], more[0])) / 13), 3)


def linked_copies(rows: DataFrame, key: str, name: Column, doi: Column) -> DataFrame:
    """(key, component): rows joined by equal folded name or equal DOI, directly or through others.

    A name that rows of different DOIs carry is shared by unrelated articles and joins nothing.
    """
    keyed = stage(rows.select(key, T.fold(name).alias("n"), F.lower(T.doi_bare(doi)).alias("d")), "copy-keys")
    shared = keyed.where("n != ''").groupBy("n").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("n")
    own = keyed.join(broadcast_if_small(stage(shared, "shared-names")), "n", "left_anti")
    edges = None
    for tag, part in (("n", own), ("d", keyed)):
        part = part.where(f"{tag} is not null and {tag} != ''").select(F.col(key).alias("u"), F.concat(F.lit(tag), F.col(tag)).alias("k"))
        edges = part if edges is None else edges.unionByName(part)
    heads = edges.groupBy("k").agg(F.min("u").alias("v"), F.count("*").alias("c")).where("c > 1").select("k", "v")
    groups = components(edges.join(heads, "k").select("u", "v"))
    return rows.select(key).join(groups.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", F.col(key)).alias("component"))
