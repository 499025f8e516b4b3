"""Repair of extracted fields: titles, labels, codes, categories, findings, countries, vocabularies, report predicates.

Cascades are ordered rule tables compiled to columns; nothing is computed per row in Python. Null stays null unless the
function's text says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .rules import contains_any, first_match
from .text import is_missing, slug

# Titles


def title_from_text(c: Column) -> Column:
    """The longest capitalised line of 20 to 200 letters before the abstract, the first of equals."""
    head = F.element_at(F.split(c, r"(?m)^\s*(?:Abstract|ABSTRACT)\s*$", 2), 1)
    lines = F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(20, 200) & x.rlike(r"^\p{Lu}") & ~x.rlike(r"^(http|DOI|Available)"))
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    return F.when(c.rlike(r"(?m)^\s*(?:Abstract|ABSTRACT)\s*$"), F.try_element_at(F.filter(lines, lambda x: F.length(x) == longest), F.lit(1)))


#: fixed values: what an affiliation line holds, and character references in titles
AFFILIATION = ("@", "University", "Department", "School of", "Institute")
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def title_before_affiliation(c: Column, within: int = 40, before: int = 5) -> Column:
    """The longest capitalised line of 20 to 200 letters among those before the first affiliation line that has one."""
    lines = F.filter(F.transform(F.slice(F.split(c, "\n"), 1, within), lambda x: F.trim(x)), lambda x: x != "")
    good = lambda xs: F.filter(xs, lambda x: F.length(x).between(20, 200) & x.rlike(r"^\p{Lu}"))
    window = lambda i: good(F.slice(lines, F.greatest(i - before, F.lit(1)), i - F.greatest(i - before, F.lit(1))))
    marked = lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(m)), True) for m in AFFILIATION], F.lit(False))
    at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: marked(F.try_element_at(lines, i)) & (F.size(window(i)) > 0)), F.lit(1))
    found = window(at)
    longest = F.array_max(F.transform(found, lambda x: F.length(x)))
    return F.when(at.isNotNull(), F.try_element_at(F.filter(found, lambda x: F.length(x) == longest), F.lit(1)))


def document_title(given: Column, text: Column) -> Column:
    """The given title if it is longer than 10 letters, else one before the abstract, else one before the affiliation."""
    plain = F.trim(given)
    for mark, sign in REFERENCES:
        plain = F.replace(plain, F.lit(mark), F.lit(sign))
    return F.coalesce(F.when(F.length(plain) > 10, plain), title_from_text(text), title_before_affiliation(text))


def title_from_file_name(c: Column) -> Column:
    """A title of a file name: the part after 'Author (year).' or the name itself, if long enough."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\.pdf$", ""), r"^\d+\.\s*", ""))
    after = F.trim(F.regexp_extract(stem, r"^.+?\(\d{4}\)\.\s*(.+)$", 1))
    return F.when(after != "", F.when(F.length(after) >= 10, after)).when(stem.rlike(r"(?i)^978\d{10,13}(-en)?$"), F.concat(F.lit("OECD publication "), stem)).when(stem.rlike(r"(?i)^[\da-f]{6,12}-en$"), F.concat(F.lit("OECD document "), stem)).when(F.length(stem) >= 15, stem)


# Labels and codes


def condensed(c: Column, words: int = 8) -> Column:
    """A label with balanced brackets, without the start of a sentence, of at most so many words."""
    text = F.trim(c)
    count = lambda sign: F.length(text) - F.length(F.translate(text, sign, ""))
    text = F.when(count("(") < count(")"), F.trim(F.regexp_replace(text, r"\)+$", ""))).when(count("(") > count(")"), F.concat(text, F.repeat(F.lit(")"), count("(") - count(")")))).otherwise(text)
    for start in (r"(?i)^the\s+", r"(?i)^teacher[- ]related\s+variables\s+such\s+as\s+(?:the\s+)?", r"(?i)^students?'?\s+", r"(?i)^student'?s?\s+"):
        text = F.trim(F.regexp_replace(text, start, ""))
    short = F.array_join(F.slice(F.split(text, r"\s+"), 1, words), " ")
    return F.when(short == "", F.trim(c)).otherwise(short)


#: fixed values: words of raw log features, and of aggregates that are kept
MICRO_WORDS = ("slider", "tf-idf", "tfidf", "word2vec", "embedding", "action triple", "action frequency", "n-gram", "ngram", "keystroke", "button click", "state transition", "cosine similarity", "token weight", "behavior weight", "feature vector")
KEPT_WORDS = ("total time", "time on task", "response time", "total action", "number of visits", "visits per", "sequence length", "votat")
WEIGHT_NAMES = ("survey weight", "sampling weight", "student weight", "senate weight", "house weight", "replicate weight")


def is_micro_feature(name: Column, code: Column) -> Column:
    """Raw log actions and model inputs that are no predictors of a study; never null."""
    n, c = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.trim(F.coalesce(code, F.lit(""))))
    kept = contains_any(n, KEPT_WORDS) | c.isin("votat", "sequence_length", "seq_length")
    micro = c.rlike(r"^-?\d+_-?\d+_-?\d+$") | c.isin("start", "end", "reset", "click") | c.rlike(r"^(tfidf_|word2vec_|w2v_)|\d+_\d+_") | contains_any(n, MICRO_WORDS) | contains_any(c, MICRO_WORDS) | n.rlike(r"\d+_\d+_-?\d+")
    return ~kept & micro


def is_weight_variable(name: Column, code: Column) -> Column:
    """Sampling weights listed as predictors; never null. Without a code nothing is one."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return (c != "") & (c.rlike(r"WGT$|^W_|^(TOTWGT|FSTUWT|SCHWGT|HOUWGT|SENWGT|MATWGT|SCIWGT|REAWGT)$") | contains_any(F.coalesce(name, F.lit("")), WEIGHT_NAMES))


#: fixed values: common construct codes and their categories; a larger list is given as a table to confounder_category
CODES = {
    "socioeconomic": "ESCS HOMEPOS WEALTH HISEI HISCED MISCED FISCED HEDRES CULTPOSS PARED", "parent_home": "EMOSUPS FAMSUPSL", "demographic": "ITSEX IMMIG LANGN AGE GENDER", "student_attitude": "MATHEFF ANXMAT BELONG JOYREAD INTMAT",
    "student_behavior": "SMINS TMINS UNDREM METASUM", "ict": "ICTRES ICTHOME ICTSCH", "school": "SCHSIZE CLSIZE", "peer_effects": "DISCLIM DISCLIMA BULLIED",
}
CATEGORY_WORDS = (
    ("process_data", "log file|log-file|process data|n-gram|markov|sequence mining"), ("system_level", "gdp|gini|country-level|national policy|education expenditure|oecd average|tracking age|macro|economic indicator"),
    ("peer_effects", "peer|bullying|classroom climate|disciplinary climate|class-average|class average|class discipline"), ("prior_achievement", "prior|previous score|wle|plausible value|pv1|pv2"),
    ("socioeconomic", "escs|homepos|wealth|hisei|parental education|books at home|misced|fisced|hisced|socioeconomic"), ("demographic", "gender|immigrant|migration|language at home|age|grade level"),
    ("student_attitude", "self-efficacy|motivation|anxiety|enjoyment|belonging|self-concept|interest|confidence"), ("student_behavior", "homework|absenteeism|study time|learning time|reading habit"), ("teacher", "teacher|professional development|instructional|teaching practice"),
    ("school", "school type|class size|school resource|library|principal|school climate"), ("ict", "ict|computer|digital|internet|technology"), ("curriculum", "curriculum|instructional time|content coverage"), ("parent_home", "parent|family support|home environment"),
)
CATEGORIES = tuple(dict.fromkeys(c for c, _ in CATEGORY_WORDS))


def is_invented_code(c: Column) -> Column:
    """Codes that are prose or slugs rather than a survey's own; never null."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike(r"^[A-Z][A-Z0-9_]+$") & (t.rlike(r"(?i)[:;/ ]|\band\b") | t.rlike(r"(?i)meta[-_]?cognit") | F.lower(t).isin("remembering", "understanding"))


def repaired_code(code: Column, name: Column) -> Column:
    """A survey's own code stays; else UNDREM for metacognition, a code in brackets in the label, or the label's slug."""
    label = condensed(name)
    bracket = F.regexp_extract(F.concat_ws(" ", label, code), r"\(([A-Z][A-Z0-9_]{2,})\)", 1)
    made = F.when(F.concat_ws(" ", code, label).rlike(r"(?i)\b(meta[- ]?cognit\w*|understanding|remembering)\b") & ~is_missing(code), "UNDREM").when(bracket != "", bracket).otherwise(slug(label, default="unnamed_variable"))
    return F.when(is_missing(code) | is_invented_code(code), made).otherwise(F.trim(code))


def confounder_category(category: Column, name: Column, code: Column) -> Column:
    """Category by code, else the given one if it is valid, else by words of name and code, else student_behavior."""
    chain = None
    for cat, codes in CODES.items():
        hit = F.upper(F.trim(code)).isin(*codes.split())
        chain = F.when(hit, cat) if chain is None else chain.when(hit, cat)
    return F.coalesce(chain, F.when(category.isin(*CATEGORIES), category), first_match(F.concat_ws(" ", name, code), CATEGORY_WORDS, "student_behavior"))


# Findings


#: fixed output: sentences and clauses of a conclusion, what is taken off a given one, words of a clause on its meaning
NO_NARRATIVE = "results were reported without a clear narrative conclusion in the manuscript"
NO_MEANING = "these patterns have implications for educational policy and instructional practice, though cross-sectional ILSA designs cannot establish causality"
LEADS = r"(?i)^(the study found that |finding that |the study found )"
MEANING_WORDS = "policy|practice|equity|instruction|curriculum"


def mended(c: Column) -> Column:
    """'process the study' becomes 'process data, the study'."""
    return F.when(c.rlike(r"(?i)\bprocess\s+data,\s*the\s+study\b"), c).otherwise(F.regexp_replace(c, r"(?i)\bprocess\s+the\s+study\b", "process data, the study"))


def with_meaning(text: Column, hint: Column) -> Column:
    """A conclusion with a clause on its meaning: that of the hint, else the end of the hint or text if it speaks of policy or
    practice at some length, else a fixed one; a conclusion that has a clause keeps it."""
    hint = F.when(F.trim(hint) != "", hint)
    source = F.coalesce(hint, text)
    own = F.trim(F.regexp_replace(F.regexp_extract(hint, r"(?is)this\s+indicates\s+that\s+(.+?)(?:\.|$)", 1), r"\.+$", ""))
    tail = F.regexp_replace(F.trim(source), r"\.+$", "")
    meaning = F.when(own != "", own).when(F.lower(source).rlike(MEANING_WORDS) & (F.length(tail) > 40), F.right(tail, F.lit(220))).otherwise(NO_MEANING)
    plain = F.trim(text)
    whole = F.concat(F.regexp_replace(plain, r"\.+$", ""), F.lit(". This indicates that "), meaning, F.lit("."))
    return F.when(plain == "", plain).when(plain.rlike(r"(?i)\bthis\s+indicates\b"), mended(plain)).otherwise(mended(whole))


def conclusion(dataset: Column, predictors: Column, target: Column, given: Column) -> Column:
    """A sentence that names data, inputs, target and result, with a clause on its meaning.

    A given conclusion that names the data set stays, mended; else it becomes the result in the sentence.
    """
    given = F.when(~is_missing(given), F.trim(given))
    inputs = F.when(F.size(predictors) > 0, F.array_join(F.slice(predictors, 1, 3), ", ")).otherwise("the reported predictors")
    d = F.regexp_replace(F.trim(dataset), r"\.+$", "")
    clause = F.concat(F.lit("Using "), d, F.when(d.rlike(r"(?i)\bdata\b"), ",").otherwise(" data,"))
    effect = F.trim(F.regexp_replace(F.regexp_replace(given, r"\.+$", ""), LEADS, ""))
    sentence = mended(F.concat(clause, F.lit(" the study leveraged "), inputs, F.lit(" to predict "), target, F.lit(", finding that "), F.coalesce(effect, F.lit(NO_NARRATIVE)), F.lit(".")))
    using = mended(F.regexp_replace(F.concat(effect, F.lit(".")), r"(?i)\bdata,\s*the study", "the study"))
    built = F.when(F.startswith(F.lower(effect), F.lit("using ")), using).otherwise(sentence)
    keeps = F.coalesce((F.instr(F.lower(given), F.lower(dataset)) > 0) & ~given.rlike(r"(?i)\bdata,\s*the study"), F.lit(False))
    return with_meaning(F.when(keeps, mended(given)).otherwise(built), given)


def normalised_findings(c: Column) -> Column:
    """Findings with a target: dataset and metrics filled, at most five predictors, a conclusion."""
    def one(f):
        data = F.when(is_missing(f["dataset_used"]), "ILSA dataset not specified in manuscript").otherwise(F.trim(f["dataset_used"]))
        preds = F.slice(F.filter(F.coalesce(f["top_predictors"], F.array().cast("array<string>")), lambda p: ~is_missing(p)), 1, 5)
        return F.struct(data.alias("dataset_used"), F.trim(f["target_variable"]).alias("target_variable"), preds.alias("top_predictors"), F.when(is_missing(f["performance_metrics"]), "Not reported").otherwise(F.trim(f["performance_metrics"])).alias("performance_metrics"), conclusion(data, preds, F.trim(f["target_variable"]), f["standardized_conclusion"]).alias("standardized_conclusion"))

    return F.transform(F.filter(c, lambda f: ~is_missing(f["target_variable"])), one)


def dataset_of(c: Column, source_category: Column) -> Column:
    """The survey and year a text names, else the survey, else a label by the kind of source."""
    phrase = F.regexp_extract(c, r"(?i)\b((?:PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|Survey)\s+(?:19|20)\d{2})", 1)
    program = F.upper(F.regexp_extract(c, r"(?i)\b(PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|OECD)\b", 1))
    return F.when(phrase != "", phrase).when(program != "", program).when(source_category.isin("review_article", "methodology_paper", "technical_report"), "ILSA literature synthesis (no single student-level dataset)").otherwise("ILSA assessment context not specified in extraction (heuristic migration)")


#: fixed values: targets that a text describes, first match wins
TARGET_WORDS = (("mathematics achievement", "mathematic|numeracy|fraction|geometry|algebra"), ("reading achievement", "reading|literacy|vocabulary"), ("science achievement", "science|scientific|laboratory|photosynthesis"), ("civic knowledge", "civic|citizenship|voting"), ("digital literacy", "computer|digital|keyboard|tablet"), ("student well-being", "belonging|anxiety|well-?being|loneliness|bullying"), ("teacher practice", "teacher|staff|lesson"))


def target_of(c: Column) -> Column:
    return first_match(c, TARGET_WORDS, "Primary study outcome (heuristic migration)")


#: fixed values: how a text names a data set, its targets in the order of the tests, results, and sources that are no study
DATASET_PHRASE = r"(?i)\b((?:PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS)\s+20\d{2}(?:\s+[\w][\w\s\-]{2,40})?)"
DATASET_PROGRAM = r"(?i)\b(PISA|TIMSS|PIRLS|TALIS|PIAAC|ICILS|ICCS|OECD)\b(?:\s*[-–]?\s*(20\d{2}))?"
TARGET_PATTERNS = (
    r"predict(?:ing|ed|s)?\s+([^.;,\n]{5,70})", r"(?:math(?:ematics)?|science|reading)\s+(?:achievement|literacy|proficiency|performance|score)s?", r"academic\s+resilience", r"(?:student\s+)?well[- ]?being",
    r"creative\s+thinking(?:\s+score)?", r"problem[- ]solving(?:\s+success)?", r"environmental\s+action", r"job\s+satisfaction", r"item\s+difficulty",
)
METRIC_SNIPPET = r"(?i)(R[²2]\s*[=:]\s*[\d.]+|AUC\s*[=:]\s*[\d.]+|accuracy\s*[=:]\s*[\d.]+%?|RMSE\s*[=:]\s*[\d.]+|F1[- ]?score?\s*[=:]\s*[\d.]+|\d{1,3}(?:\.\d+)?\s*%\s+accuracy)"
NO_STUDY = ("review_article", "methodology_paper", "technical_report")
SYNTHESIS_DATA, CONTEXT_DATA = "ILSA literature synthesis (systematic review; no single student-level analytic micro-dataset)", "ILSA assessment context not specified in extraction (heuristic migration)"
SYNTHESIS_TARGET, MODEL_TARGET, STUDY_TARGET = "Literature synthesis outcome (not student-level prediction)", "Primary analytic outcome (inferred from extraction)", "Primary study outcome (heuristic migration)"


def context(r: Column) -> Column:
    """The texts of a record from which its data set and target are read, one after the other."""
    m, d = r["metadata"], r["data"]
    parts = (m["title"], m["file_name"], d["sample_details"]["sample_filtering_criteria"], d["survey_design"]["weight_fields_interpretation"], d["outcome_summary"], d["null_fields_interpretation"])
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def inferred_dataset(blob: Column, source_category: Column) -> Column:
    """The first phrase that names a survey and year, else the first survey named, else by the kind of source."""
    phrase = F.left(F.element_at(F.split(F.trim(F.regexp_extract(blob, DATASET_PHRASE, 1)), "\n"), 1), F.lit(120))
    program = F.trim(F.concat_ws(" ", F.upper(F.regexp_extract(blob, DATASET_PROGRAM, 1)), F.regexp_extract(blob, DATASET_PROGRAM, 2)))
    return F.when(phrase != "", phrase).when(program != "", program).when(source_category.isin(*NO_STUDY), SYNTHESIS_DATA).otherwise(CONTEXT_DATA)


def inferred_target(outcome: Column, blob: Column, source_category: Column, has_ml: Column) -> Column:
    """What the first pattern finds in the outcome and the other texts, else a label by source and models."""
    whole = F.concat_ws("\n", F.coalesce(outcome, F.lit("")), blob)
    found = [F.regexp_extract(whole, "(?i)" + p, 0) for p in TARGET_PATTERNS]
    return F.coalesce(*[F.when(x != "", F.left(F.trim(x), F.lit(80))) for x in found], F.when(source_category.isin(*NO_STUDY), SYNTHESIS_TARGET).when(has_ml, MODEL_TARGET).otherwise(STUDY_TARGET))


def inferred_predictors(confounders: Column, most: int = 5) -> Column:
    """The first names (else codes) of the confounders that are not marked as missing."""
    names = F.transform(confounders, lambda c: F.trim(F.coalesce(c["variable_name"], c["variable_code"])))
    return F.slice(F.coalesce(F.filter(names, lambda n: ~is_missing(n)), F.array().cast("array<string>")), 1, most)


def metrics_in(text: Column) -> Column:
    """The results that a text states, each once, at most 220 letters."""
    hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(METRIC_SNIPPET), F.lit(1)), lambda x: F.trim(x)))
    return F.when(F.size(hits) > 0, F.left(F.array_join(hits, "; "), F.lit(220))).otherwise("Not reported")


#: fixed values: how a text speaks of weights and of sample sizes, and the sentences of a gap fill
WEIGHT_NAME = r"(?i)\b(W_FSTUWT|TOTWGT|WGT|STUWT|FINWT|HOUWT|SENWT)\b"
WEIGHTED = ("w_fstuwt", "totwgt", "survey weight", "sampling weight", "weighted estimate", "used weights", "applied weights", "weight variable")
UNWEIGHTED = ("weights ignored", "without weights", "unweighted", "did not use weight", "no weight", "weights were not used")
REPLICATED = ("brr", "fay", "jackknife", "replicate weight")
SAMPLE_OF = r"(?i)(?:\bn\s*[=:]\s*|sample of\s+|total of\s+)(\d{1,3}(?:[,\s]\d{3})*)\s*(?:students|participants|learners|pupils)?"
GAPS = (("title", "title was not present in the extraction record"), ("year", "publication year could not be inferred from file_name or title"), ("doi", "DOI was not found in any field of this record"), ("total_students", "total sample size was not explicitly stated in outcome_summary or sample text"), ("ml_primary", "primary ML model was not identified in ml_techniques or outcome_summary"))
GAP_START, GAP_END = "Several bibliographic or analytic fields remain null after gap-fill because ", ". Values were not invented beyond what appears in this JSON record."
SPARSE, ADDED = "Weighting details were sparse in survey_design; outcome_summary states: ", " Additional context from outcome_summary: "


def weights_in(blob: Column) -> tuple[Column, Column, Column]:
    """(student weights used, replicate weights used, weight variable) that a text in lower case speaks of; null if it does not."""
    student = F.when(contains_any(blob, UNWEIGHTED), False).when(contains_any(blob, WEIGHTED), True)
    replicate = F.when(F.contains(blob, F.lit("replicate weight")) & F.contains(blob, F.lit("not")) & F.contains(blob, F.lit("use")), False).when(contains_any(blob, REPLICATED), True)
    name = F.upper(F.regexp_extract(blob, WEIGHT_NAME, 1))
    return student, replicate, F.when(name != "", name)


def largest_sample(blob: Column) -> Column:
    """The largest sample size that a text states; null if it states none."""
    sizes = F.transform(F.regexp_extract_all(blob, F.lit(SAMPLE_OF), F.lit(1)), lambda x: F.regexp_replace(x, r"[,\s]", "").try_cast("long"))
    return F.array_max(F.filter(sizes, lambda n: n > 0))


def expanded_weight_text(text: Column, outcome: Column) -> Column:
    """A text of less than 80 letters with the start of the outcome added, if that has 40 or more."""
    extra = F.left(F.trim(outcome), F.lit(400))
    grown = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.concat(F.lit(SPARSE), extra)).otherwise(F.concat(F.trim(text), F.lit(ADDED), extra))
    return F.when(F.coalesce(F.length(F.trim(text)) >= 80, F.lit(False)) | ~F.coalesce(F.length(F.trim(outcome)) >= 40, F.lit(False)), text).otherwise(grown)


def explained_gaps(missing: dict[str, Column], no_technique: Column, given: Column) -> Column:
    """Why fields are null, where more than three of the critical ones are and no text of 40 letters says so already.

    missing tells of each of GAPS whether it is null; a record without any technique counts as a gap of its own kind.
    """
    n = sum((missing[k].cast("int") for k, _ in GAPS[:4]), F.lit(0)) + no_technique.cast("int")
    reasons = F.array_join(F.array_compact(F.array(*[F.when(missing[k], text) for k, text in GAPS])), "; ")
    return F.when((n <= 3) | F.coalesce(F.length(F.trim(given)) >= 40, F.lit(False)), given).otherwise(F.concat(F.lit(GAP_START), reasons, F.lit(GAP_END)))


def is_legacy(finding: Column) -> Column:
    """A finding made by an older migration, to be inferred anew; never null."""
    return contains_any(F.coalesce(finding["dataset_used"], F.lit("")), ("legacy migration",)) | contains_any(F.coalesce(finding["target_variable"], F.lit("")), ("legacy migration",))


def countries_in(df: DataFrame, key: str, text: str, names: DataFrame, most: int = 80) -> DataFrame:
    """(key, codes): countries whose name of four letters or more stands in a text as words, or whose code does.

    names (name, code) is a fixed dimension. Runs of words up to its longest name are joined with it, signs between words
    do not count; of more than so many countries those of the longest names are kept, codes last.
    """
    dim = names.where(F.length("name") >= 4).select(F.concat_ws(" ", F.regexp_extract_all(F.lower("name"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("term"), "code", F.length("name").alias("long"))
    longest = dim.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    dim = dim.unionByName(names.select(F.concat(F.lit("#"), F.upper("code")).alias("term"), "code", F.lit(0).alias("long"))).distinct()
    found = df.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"), F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{3})\b"), F.lit(1)), lambda x: F.concat(F.lit("#"), x)).alias("c"))
    runs = [F.col("w")]
    for k in range(2, longest + 1):
        n = F.greatest(F.size("w") - (k - 1), F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), n), F.slice("w", F.lit(k), n), lambda x, y: F.concat_ws(" ", x, y)))
    terms = found.select(key, F.explode(F.array_distinct(F.concat(*runs, "c"))).alias("term"))
    hits = terms.join(broadcast_if_small(dim), "term").groupBy(key, "code").agg(F.max("long").alias("long"))
    kept = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("long")).alias("l"), "code"))), 1, most)
    return hits.groupBy(key).agg(F.sort_array(F.transform(kept, lambda x: x["code"])).alias("codes"))


#: fixed values: signs of how plausible values and missing data were handled, in the order of the tests
PV_SIGNS = (
    ("rubin_rules", "rubin|combined_estimates"), ("mitml", "mitml|mplus"), ("rubin_rules", "bifiesurvey|repest|intsvy|edsurvey|idb_analyzer|ralsa|lavaan\\.survey|wemix|five_pv|5_pv|five_plausible|ten_plausible|pv1_pv5|pv1_pv10|repeated_across_pvs"),
    ("not_applicable", "not_applicable|no_pv|no_plausible|does_not_use|process_data|log_file|review_paper|non_empirical"), ("wle", "wle|weighted_likelihood"), ("irt_theta", "irt_theta|theta|latent_trait"), ("single_pv", "first_plausible|single_pv|pv1_only|^pv1$|per_pv|one_pv|pv1math|pv1read|pv1scie"),
    ("all_pv", "all_pv|ten_pv|10_pv|pv1_through|pv1_to_pv10"), ("average_pv", "average.*pv|avg_pv|all_plausible|across_pv|mean_pv|averaged.*plausible"),
)
MD_SIGNS = (("listwise_deletion", "listwise|complete_case"), ("pairwise_deletion", "pairwise"), ("multiple_imputation", "multiple_imput|mice|mitml"), ("knn_imputation", "knn|nearest_neigh"), ("mean_imputation", "mean_imput|mean_subst"), ("single_imputation", "single_imput|regression_imput"))
PV_WORDS = ("rubin_rules", "single_pv", "average_pv", "all_pv", "mitml", "wle", "irt_theta", "not_applicable", "not_reported")
MD_WORDS = ("listwise_deletion", "pairwise_deletion", "mean_imputation", "single_imputation", "knn_imputation", "multiple_imputation", "not_reported")


def literal(c: Column, words: tuple[str, ...], signs: tuple[tuple[str, str], ...]) -> Column:
    """A value of a vocabulary from free text; not_reported for null and for anything else."""
    key = F.regexp_replace(F.lower(c), "[- ]", "_")
    return F.when(c.isin(*words), c).otherwise(F.coalesce(first_match(key, signs), F.lit("not_reported")))


# Predicates on article records (struct r: metadata, data)


def has_ml_signals(r: Column) -> Column:
    """A technique, confounder or sample size is given; never null."""
    d = r["data"]
    listed = ~is_missing(d["ml_techniques"]["all_techniques"]) & (d["ml_techniques"]["all_techniques"] != "[]")
    return ~is_missing(d["ml_techniques"]["primary"]) | listed | F.coalesce(F.size(d["confounders_identified"]) > 0, F.lit(False)) | ~is_missing(d["sample_details"]["total_students"])


def is_official_report(r: Column) -> Column:
    """Manuals, frameworks and national reports without a trained model; never null."""
    m, d = r["metadata"], r["data"]
    no_ml = is_missing(d["ml_techniques"]["primary"]) & (is_missing(d["ml_techniques"]["all_techniques"]) | (d["ml_techniques"]["all_techniques"] == "[]"))
    pub = F.lower(F.coalesce(m["publication_type"], F.lit("")))
    signal = F.lower(F.concat_ws(" ", m["title"], m["file_name"])).rlike(r"technical report|national report|framework|user guide|manual")
    return no_ml & ((pub == "report") | (pub.isin("book_chapter", "") & signal))


def requires_findings(r: Column) -> Column:
    """No official report, and an outcome text or model signals; never null."""
    outcome = F.coalesce(F.length(F.trim(r["data"]["outcome_summary"])) >= 20, F.lit(False)) & ~is_missing(r["data"]["outcome_summary"])
    return ~is_official_report(r) & (outcome | has_ml_signals(r))
