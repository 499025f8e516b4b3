"""Subject areas of documents (problem 10).

Curated subject terms of all languages are found by one multi-pattern automaton per worker, paragraph by paragraph. A
term has a curated weight of 2 or 3, which its rarity raises up to twofold (the rarer it is among all paragraphs of the
corpus that name any term, the more); of overlapping terms the longest from the left counts. The sum of a subject's
weights is divided by the paragraph's length, and its share of all subjects' weights is taken. A document gets every subject
whose share and density exceed the thresholds in at least one paragraph, so a passing mention inside a paragraph about
something else does not count. Both thresholds are calibrated on the hand-labelled documents, as the pair that gives
the best F1; without labels the defaults hold.

Only the hits of each paragraph are written and shuffled, never a text. Rarity counts and thresholds cover all rows.

Defined results: null and empty texts and paragraphs without terms give no subject; repeated documents each get their
rows; ties between subjects are all assigned where both exceed the thresholds; very long texts are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .subject_terms import TERMS

#: Thresholds where there are no labels, and the grids from which they are calibrated.
DEFAULT = (0.5, 0.02)
SHARES = (0.3, 0.4, 0.5, 0.6, 0.7)
DENSITIES = (0.0, 0.02, 0.05, 0.1)

_PARAGRAPH = re.compile(r"\n\s*\n|(?<=[.!?;:])[\"')\]]*[ \t]*\n")


def term_list() -> list[tuple[int, str, int]]:
    """(subject, term, curated weight), every term of a subject once with its largest weight; its place is its number."""
    out: dict[tuple[int, str], int] = {}
    for subject, by_weight in sorted(TERMS.items()):
        for weight, by_lang in sorted(by_weight.items(), reverse=True):
            for _, text in sorted(by_lang.items()):
                for t in text.split(";"):
                    if t.strip():
                        out.setdefault((subject, t.strip()), weight)
    return [(s, t, w) for (s, t), w in out.items()]


def automaton(terms: list[tuple[int, str, int]]):
    """One machine of all terms; a term of several subjects has one entry with all its numbers."""
    import ahocorasick

    entries: dict[str, list[tuple[int, bool]]] = {}
    for k, (_, term, _) in enumerate(terms):
        entries.setdefault(term.rstrip("$"), []).append((k, term.endswith("$")))
    machine = ahocorasick.Automaton()
    for word, numbers in entries.items():
        machine.add_word(word, (len(word), numbers))
    machine.make_automaton()
    return machine


def paragraphs(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    return [p for p in _PARAGRAPH.split(text) if p and not p.isspace()]


def term_hits(low: str, machine) -> list[int]:
    """Numbers of the terms in a text in lower case; of overlapping terms the longest from the left counts."""
    spans = []
    for end, (n, numbers) in machine.iter(low):
        start = end - n + 1
        if start and low[start - 1].isalnum():
            continue
        opened = end + 1 < len(low) and low[end + 1].isalnum()
        spans += [(start, -end, k) for k, whole in numbers if not (whole and opened)]
    out, last = [], (-1, -1)
    for start, end, k in sorted(spans):
        if start > last[1] or (start, -end) == last:
            out.append(k)
            last = (start, -end)
    return out


def paragraph_hits(text: str, machine) -> list[tuple[int, int, list[int]]]:
    """(paragraph number, words, numbers of the terms found) of paragraphs with a term."""
    out = []
    for no, p in enumerate(paragraphs(text), 1):
        low = " ".join(p.lower().replace("i\u0307", "i").split())
        if found := term_hits(low, machine):
            out.append((no, low.count(" ") + 1, found))
    return out


def hits(documents: DataFrame) -> DataFrame:
    """(doc_id, para_no, n_words, term) of every term found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(term_list())
        for batch in batches:
            rows = [(d, no, n, ks) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for no, n, ks in paragraph_hits(text, machine)]
            yield pd.DataFrame(rows, columns=["doc_id", "para_no", "n_words", "terms"]).astype({"doc_id": "int64", "para_no": "int32", "n_words": "int32"})

    found = documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0")
    return found.mapInPandas(run, "doc_id bigint, para_no int, n_words int, terms array<int>")


def paragraph_scores(found: DataFrame) -> DataFrame:
    """(doc_id, para_no, subject_id, share, density) from staged hits; weights are log rarities over all paragraphs."""
    terms = term_list()
    # one counter per curated term: bounded by the list
    counts = {r[0]: r[1] for r in found.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count().collect()}
    total = max(1, found.count())
    weights = [w * (1 + math.log(1 + total / (1 + counts.get(k, 0))) / math.log(2 + total)) for k, (_, _, w) in enumerate(terms)]
    sides = [s for s, _, _ in terms]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, no, n, ks in zip(batch["doc_id"], batch["para_no"], batch["n_words"], batch["terms"], strict=True):
                sums: dict[int, float] = {}
                for k in ks:
                    sums[sides[k]] = sums.get(sides[k], 0.0) + weights[k]
                every = sum(sums.values())
                rows += [(d, no, s, x / every, x / n) for s, x in sums.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "para_no", "subject_id", "share", "density"]).astype({"doc_id": "int64", "para_no": "int32", "subject_id": "int32"})

    return found.mapInPandas(run, "doc_id bigint, para_no int, subject_id int, share double, density double")


def calibrate(scores: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """The (share, density) thresholds of best F1 on the labelled documents; counts are aggregated, not collected."""
    truth = labels.select("doc_id", "subject_id").where("doc_id is not null and subject_id is not null").distinct()
    judged = scores.join(truth.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")  # the labels grow, so no side is sent whole
    grid = [(s, d) for s in SHARES for d in DENSITIES]
    passed = [F.max(((F.col("share") >= s) & (F.col("density") >= d)).cast("int")).alias(f"g{k}") for k, (s, d) in enumerate(grid)]
    per = judged.groupBy("doc_id", "subject_id").agg(*passed).join(truth.withColumn("y", F.lit(1)).hint("merge"), ["doc_id", "subject_id"], "full_outer")
    row = per.agg(F.sum("y").alias("y"), *[F.sum(f"g{k}").alias(f"p{k}") for k in range(len(grid))], *[F.sum(F.when(F.col("y") == 1, F.col(f"g{k}"))).alias(f"t{k}") for k in range(len(grid))]).first()
    if not row["y"]:
        return DEFAULT
    f1 = [2 * (row[f"t{k}"] or 0) / ((row[f"p{k}"] or 0) + row["y"]) for k in range(len(grid))]
    top = max(f1)
    near = [g for g, f in zip(grid, f1, strict=True) if f >= top - 1e-3]  # of equally good pairs the one next to the defaults
    return min(near, key=lambda g: (abs(g[0] - DEFAULT[0]), abs(g[1] - DEFAULT[1])))


def subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject_id, n_paragraphs, share): areas that are the main matter of at least one paragraph."""
    found = stage(hits(documents), "subject-hits")
    scores = paragraph_scores(found)
    share, density = calibrate(scores, labels)
    return scores.where((F.col("share") >= share) & (F.col("density") >= density)).groupBy("doc_id", "subject_id").agg(F.count("*").alias("n_paragraphs"), F.max("share").alias("share"))
