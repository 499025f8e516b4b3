"""Free-entered values mapped to a canonical list (problem 3) by a prefix-filter set-similarity join.

Every distinct value and every canonical form becomes a set of character pairs. Pairs are ordered by global rarity;
only the rare prefix of each set that must meet is joined, length and positional filters drop candidates that cannot
reach the Jaccard they need, which is verified exactly on the rest, an exact check of the edit distance follows, and
the best form is kept. The Jaccard a pair needs follows from the edits that a name of its length is forgiven (0.25 for
four letters, 0.54 for nine, 0.4 for twenty), so no pair within these edits is missed, however short it is. Values are reduced to distinct ones first, so a value that a third of all
rows share is looked up once; the join back to the rows is a broadcast only if the distinct values were counted to
be few, else a shuffle that skew handling can split.

Before that a value is read in its possible forms: as it stands, without bracketed remarks, the remark alone, without
the words that are put around names (the, tuned, model, version marks ...), and with an inverted name (B, A) turned.

Defined results: null and blank values and exact canonical names are no case; a value that no form reaches gives
term_id 0; ties go to the higher Jaccard, then fewer edits, then the lower term_id; an empty list maps all to 0; very
long values are compared whole; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage

_AHEAD = r"^\s*(the|a|our|tuned|weight:|weighted by|variable|weight)\s+"
_BEHIND = r"(\s+-\s+.*|\s+with\s+.*|\s*,\s*(rescaled|normalised|final)|\s+v\d+|\s+(model|classifier|algorithm|method))[\s;.*]*$"
_REMARK = r"[(\[{][^)\]}]*[)\]}]"


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def readings(value: Column) -> Column:
    """The compact forms in which a value can be read, without blanks and signs, distinct and not empty."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"[\s\p{Z}_]+", " "))
    open_ = F.regexp_replace(plain, _REMARK, " ")
    named = F.regexp_replace(open_, _AHEAD, "")
    bare = F.regexp_replace(named, _BEHIND, "")
    turned = F.regexp_replace(bare, r"^([^,]+),\s*(.+)$", "$2 $1")
    forms = F.array(*[_compact(x) for x in (plain, open_, named, F.regexp_extract(plain, r"[(\[{]([^)\]}]*)", 1), bare, turned)])
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def pairs(form: Column) -> Column:
    """The set of character pairs of a form with marked ends."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(form) + 1), lambda i: F.substring(F.concat(F.lit("^"), form, F.lit("$")), i, F.lit(2))))


def allowed_edits(n: int) -> int:
    """Edits forgiven in a canonical name of so many letters; the shortest names must agree exactly, as short forms do."""
    return 0 if n < 4 else 1 if n < 10 else 2 if n < 14 else 3


def _allowed(n: Column) -> Column:
    return F.when(n < 4, 0).when(n < 10, 1).when(n < 14, 2).otherwise(3)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is larger; only cells within most of the diagonal count."""
    if a == b:
        return 0
    n, m, far = len(a), len(b), most + 1
    if abs(n - m) > most:
        return far
    before: dict[int, int] = {}
    last = {j: j for j in range(min(m, most) + 1)}
    for i in range(1, n + 1):
        row: dict[int, int] = {0: i} if i <= most else {}
        x, low = a[i - 1], far
        for j in range(max(1, i - most), min(m, i + most) + 1):
            y = b[j - 1]
            k = last.get(j - 1, far) + (x != y)
            k = min(k, last.get(j, far) + 1, row.get(j - 1, far) + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                k = min(k, before.get(j - 2, far) + 1)
            row[j] = k
            low = min(low, k)
        if min(low, row.get(0, far)) > most:
            return far
        before, last = last, row
    return min(last.get(m, far), far)


def _within_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (l, r) whose distance is allowed, with it."""
    for batch in batches:
        batch["n_edits"] = [edits(x, y, allowed_edits(len(y))) for x, y in zip(batch["l"], batch["r"], strict=True)]
        yield batch[batch["n_edits"] <= batch["r"].map(lambda y: allowed_edits(len(y)))].astype({"n_edits": "int32"})


def set_similarity_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of (kind, id, toks, lost) rows of equal kind that share enough of their tokens: kind, l, r, jaccard.

    left.l and right.r identify the rows; toks are token sets. A pair must share all tokens of the larger set but
    right.lost of them, which is a Jaccard of at least (m - lost) / (m + lost) for m tokens; left.lost is the most that
    any partner may forgive. So each side needs only its lost + 1 rarest tokens as prefix.
    """
    tokens = left.select("kind", F.explode("toks").alias("tok")).unionByName(right.select("kind", F.explode("toks").alias("tok")))
    freq = broadcast_if_small(stage(tokens.groupBy("kind", "tok").agg(F.count("*").alias("df")), "token-counts"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct("df", "tok")))  # global rarity, ties by the token
        ranked = df.select("kind", key, "lost", F.explode("toks").alias("tok")).join(freq, ["kind", "tok"]).groupBy("kind", key).agg(F.first("lost").alias("lost"), F.transform(order, lambda x: x["tok"]).alias("s"))
        keep = F.least(F.size("s"), F.col("lost") + 1)
        return ranked.select("kind", key, "s", "lost", F.posexplode(F.slice("s", F.lit(1), keep)).alias("pos", "tok"))

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = prefix(left, "l").select("kind", "l", F.col("s").alias("sa"), F.col("pos").alias("pa"), "tok").repartition(parts, "l")  # few bytes but much work
    b = prefix(right, "r").select("kind", "r", F.col("s").alias("sb"), F.col("lost").alias("forgiven"), F.col("pos").alias("pb"), "tok")
    na, nb = F.size("sa"), F.size("sb")
    need = F.greatest(na, nb) - F.col("forgiven")
    near = a.join(broadcast_if_small(b), ["kind", "tok"]).where(F.least(na, nb) >= need).where(1 + F.least(na - F.col("pa") - 1, nb - F.col("pb") - 1) + F.least("pa", "pb") >= need)
    common = F.size(F.array_intersect("sa", "sb"))
    pairs_ = near.select("kind", "l", "r", "sa", "sb", "forgiven").dropDuplicates(["kind", "l", "r"])
    return pairs_.where(common >= need).select("kind", "l", "r", (common / (na + nb - common)).alias("jaccard"))


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, value, term_id) for distinct (kind, value) rows; terms: term_id, kind, canonical_name, short_form."""
    forms = terms.select("kind", "term_id", F.explode(F.array(F.struct(F.lit(False).alias("short"), _compact(F.lower("canonical_name")).alias("r")), F.struct(F.lit(True).alias("short"), _compact(F.lower("short_form")).alias("r")))).alias("f")).select("kind", "term_id", "f.*").where("r is not null and r != ''")
    read = stage(values.select("kind", "value", F.explode(readings(F.col("value"))).alias("l")), "readings")
    # an edit changes at most three pairs of neighbours; a partner may be as many letters longer as it forgives edits
    left = read.select("kind", "l").distinct().select("kind", "l", pairs(F.col("l")).alias("toks"), (3 * _allowed(F.length("l") + 3)).alias("lost"))
    right = forms.groupBy("kind", "r").agg(F.min("short").alias("short")).select("kind", "r", pairs(F.col("r")).alias("toks"), F.when(F.col("short"), 0).otherwise(3 * _allowed(F.length("r"))).alias("lost"))
    near = set_similarity_join(left, right).join(broadcast_if_small(forms), ["kind", "r"])
    close = near.where("l != r and not short").where((F.abs(F.length("l") - F.length("r")) <= 3) & F.levenshtein("l", "r", 6).between(0, 6))  # a swap counts as two of these edits, so none is lost
    spread = close.select("kind", "l", "r", "term_id", "jaccard").repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes but much work
    checked = spread.mapInPandas(_within_edits, "kind string, l string, r string, term_id int, jaccard double, n_edits int")
    exact = near.where("l = r").select("kind", "l", "r", "term_id", "jaccard", F.lit(0).alias("n_edits")).unionByName(checked)
    best = exact.groupBy("kind", "l").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "n_edits", "term_id")).alias("best"))
    found = read.join(best, ["kind", "l"]).groupBy("kind", "value").agg(F.min("best").alias("best"))
    return values.join(found, ["kind", "value"], "left").select("kind", "value", F.coalesce("best.term_id", F.lit(0)).cast("int").alias("term_id"))


def mapped_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(field_name, row_id, term_id) for rows (field_name, row_id, kind, value) whose value is not a canonical name."""
    names = terms.select("kind", F.col("canonical_name").alias("value")).where("value is not null").distinct()
    cases = rows.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}]*$")).join(broadcast_if_small(names), ["kind", "value"], "left_anti")
    mapping = stage(map_values(cases.select("kind", "value").distinct(), terms), "value-map")
    return cases.join(broadcast_if_small(mapping), ["kind", "value"]).select("field_name", "row_id", "term_id")
