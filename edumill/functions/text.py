"""Column functions on text: blanks, coercion, identifiers, sections, metrics and labels. No Python per row.

Every function maps null to null unless its text says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that mean null in coerced fields
NULL_WORDS = ("", "null", "none", "n/a", "na", "nan", "not reported", "not_reported", "unknown")
TRUE_WORDS = ("true", "yes", "1", "1.0")
FALSE_WORDS = ("false", "no", "0", "0.0")


def is_blank(c: Column) -> Column:
    """Null, NaN text or white space; never null."""
    return F.coalesce(F.trim(c).isin("", "nan", "NaN"), F.lit(True))


def is_missing(c: Column) -> Column:
    """Blank or a word for a missing value or a label that starts like one; never null."""
    low = F.lower(F.trim(c))
    return is_blank(c) | F.coalesce(low.isin(*NULL_WORDS) | low.startswith("n/a:") | low.startswith("not reported") | low.startswith("missing"), F.lit(False))


def tri_bool(c: Column) -> Column:
    """true, false or null from free spellings of a boolean."""
    low = F.replace(F.lower(F.trim(c.cast("string"))), F.lit("-"), F.lit("_"))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def doi_bare(c: Column) -> Column:
    """A DOI without a resolver or label before it."""
    return F.regexp_replace(F.trim(c), r"(?i)^(https?://(dx\.)?doi\.org/|doi:?\s*)", "")


_DOI_TAIL = r"10\.[0-9]{4,9}/[^\s\"<>]+"


def doi_candidates(c: Column) -> Column:
    """DOIs in a text: resolver links, labelled ones, bare ones, without closing signs, 12 letters or more, distinct."""
    found = F.concat(
        F.regexp_extract_all(c, F.lit(r"(?i)https?://(?:dx\.)?doi\.org/(" + _DOI_TAIL + ")"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"(?i)doi[:\s]+(" + _DOI_TAIL + ")"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"(?i)\b(" + _DOI_TAIL + ")"), F.lit(1)),
    )
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[.,;:)>\]}]+$", ""))), lambda x: F.length(x) >= 12))


def document_doi(c: Column, head: int = 25_000, tail: int = 10_000, whole: int = 120_000) -> Column:
    """The first DOI of the head of a text, else of its tail, else of the whole text if it is not longer than whole."""
    first = lambda t: F.try_element_at(doi_candidates(t), F.lit(1))
    return F.coalesce(first(F.substring(c, 1, head)), first(F.right(c, F.lit(tail))), first(F.when(F.length(c) <= whole, c)))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def cost(tokens_in: Column, tokens_out: Column, per_million_in: float = 2.5, per_million_out: float = 10.0) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1e6


def slug(c: Column, length: int = 48, default: str = "unnamed") -> Column:
    """Letters and digits in lower case joined by underscores."""
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(length))
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


#: fixed values: Latin letters with marks and what they fold to
_MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿğşıœæß"
_FOLDED = "aaaaaaceeeeiiiinoooooouuuuyygsioas"


def fold(c: Column) -> Column:
    """Lower case letters and digits without marks; other signs vanish."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _FOLDED), "[^a-z0-9]", "")


#: fixed values: section names and the heads that open them
SECTIONS = (
    ("abstract", r"(?im)^\s*(?:[0-9]+\.?\s+)?abstract\s*$"),
    ("introduction", r"(?im)^\s*(?:[0-9]+\.?\s+)?(?:introduction|background)\s*$"),
    ("methods", r"(?im)^\s*(?:[0-9]+\.?\s+)?(?:methods?|methodology|data and methods)\s*$"),
    ("results", r"(?im)^\s*(?:[0-9]+\.?\s+)?(?:results|findings)\s*$"),
    ("discussion", r"(?im)^\s*(?:[0-9]+\.?\s+)?discussion\s*$"),
    ("conclusion", r"(?im)^\s*(?:[0-9]+\.?\s+)?conclusions?\s*$"),
    ("references", r"(?im)^\s*(?:[0-9]+\.?\s+)?(?:references|bibliography)\s*$"),
)


def section_starts(c: Column) -> Column:
    """array<struct<pos, name>> of the first head of each section, by position; 0-based character positions."""
    at = lambda p: F.length(F.element_at(F.split(c, p, 2), 1))
    found = F.array(*[F.when(c.rlike(p), F.struct(at(p).alias("pos"), F.lit(n).alias("name"))) for n, p in SECTIONS])
    return F.array_sort(F.array_compact(found))


def has_sections(c: Column, least: int = 3) -> Column:
    return F.size(section_starts(c)) >= least


def before_references(c: Column, most: int = 400_000) -> Column:
    """The text up to its references, at most so many characters."""
    return F.left(F.element_at(F.split(c, SECTIONS[-1][1], 2), 1), F.lit(most))


#: fixed values: the sections of a payload, in its order
INFORMATIVE = tuple(n for n, _ in SECTIONS if n != "references")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def payload(c: Column, most: int = 400_000, least: int = 3) -> Column:
    """struct<smart, text>: the informative sections joined by blank lines, without enough heads the text before the references; stripped, at most so many characters."""

    def of(starts: Column) -> Column:
        names = F.transform(starts, lambda x: x["name"])
        begins = F.transform(starts, lambda x: x["pos"])
        ends = F.concat(F.slice(begins, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.length(c)))
        parts = F.transform(F.arrays_zip(names.alias("name"), begins.alias("at"), ends.alias("end")), lambda x: F.struct(x["name"].alias("name"), stripped(F.substring(c, x["at"] + 1, x["end"] - x["at"])).alias("text")))
        return F.transform(F.array(parts), lambda p: F.array_join(F.filter(F.concat(*[F.transform(F.filter(p, _named(n)), lambda x: x["text"]) for n in INFORMATIVE]), lambda x: x.isNotNull()), "\n\n"))[0]

    def whole(starts: Column) -> Column:
        smart = F.size(starts) >= least
        return F.struct(smart.alias("smart"), F.left(F.when(smart, of(starts)).otherwise(stripped(F.element_at(F.split(c, SECTIONS[-1][1], 2), 1))), F.lit(most)).alias("text"))

    return F.when(c.isNotNull(), F.transform(F.array(section_starts(c)), whole)[0])  # the heads are looked for once


def _named(n: str):
    return lambda x: x["name"] == n


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def year_of(c: Column, lo: int = 1990, hi: int = 2035) -> Column:
    """The first year between lo and hi that a text names."""
    years = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(lo, hi))
    return F.try_element_at(years, F.lit(1))


def sample_size(c: Column, lo: int = 50, hi: int = 10_000_000) -> Column:
    """The first sample size stated as N = ... or as so many students, within bounds."""
    hits = F.concat(F.regexp_extract_all(c, F.lit(r"\b[Nn]\s*=\s*([0-9][0-9,]*)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(?i)\b([0-9][0-9,]*)\s+(?:students|pupils|schools|points)"), F.lit(1)))
    return F.try_element_at(F.filter(F.transform(hits, lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda n: n.between(lo, hi)), F.lit(1))


#: fixed values: labels of performance figures and how they are written
METRICS = (
    ("R2", r"(?i)\bR(?:2|²|-squared)\s*[:=]\s*(-?[0-9]*\.?[0-9]+)"),
    ("RMSE", r"(?i)\bRMSE\s*[:=]\s*([0-9]*\.?[0-9]+)"),
    ("MAE", r"(?i)\bMAE\s*[:=]\s*([0-9]*\.?[0-9]+)"),
    ("AUC", r"(?i)\bAUC\s*[:=]\s*([0-9]*\.?[0-9]+)"),
    ("Accuracy", r"(?i)\baccuracy\s*[:=]\s*([0-9]*\.?[0-9]+)"),
    ("F1", r"(?i)\bF1\s*[:=]\s*([0-9]*\.?[0-9]+)"),
    ("beta", r"(?i)\bbeta\s*[:=]\s*(-?[0-9]*\.?[0-9]+)"),
    ("d", r"\bd\s*[:=]\s*(-?[0-9]*\.?[0-9]+)"),
    ("r", r"\br\s*[:=]\s*(-?[0-9]*\.?[0-9]+)"),
    ("OR", r"\bOR\s*[:=]\s*([0-9]*\.?[0-9]+)"),
)


def metrics(c: Column) -> Column:
    """Figures as Label=value joined by '; ', a bare number as it is, else Not Reported."""
    found = F.array_distinct(F.concat(*[F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), _labelled(n)) for n, p in METRICS]))
    bare = F.trim(c)
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).when(bare.rlike(r"^-?[0-9]*\.?[0-9]+$"), bare).otherwise("Not Reported")


def _labelled(name: str):
    return lambda v: F.concat(F.lit(name + "="), v)


def split_list(c: Column) -> Column:
    """Packed values divided at ; | or ,; blanks left out."""
    return F.filter(F.transform(F.split(F.translate(c, ";|", ",,"), ","), lambda x: F.trim(x)), lambda x: x != "")


def split_labels(c: Column) -> Column:
    """Parts of a combined label divided at , ; & and the word and, without articles at their start."""
    parts = F.split(F.regexp_replace(c, r"\s+(?:and|&)\s+|\s*[;,]\s*", "|"), r"\|")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), r"(?i)^(?:the|an|a)\s+", "")), lambda x: x != "")
