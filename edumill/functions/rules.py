"""Ordered rule tables compiled to columns: the first rule that matches gives the label.

A rule is (label, pattern): one regular expression per label, its alternatives joined. Tables of more than GROUP rules
are compiled in groups, each its own expression, so that generated code stays below the size that the JVM compiles.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 25


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule whose pattern is found in text; case does not matter."""
    parts = []
    for k in range(0, len(rules), GROUP):
        chain = None
        for label, pattern in rules[k : k + GROUP]:
            hit = text.rlike("(?i)" + pattern)
            chain = F.when(hit, label) if chain is None else chain.when(hit, label)
        parts.append(chain)
    return F.coalesce(*parts, F.lit(default)) if parts else F.lit(default)


_LITERAL = re.compile(r"[a-z0-9 -]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def any_of(low: Column, patterns: Sequence[str]) -> Column:
    """Is one of the patterns found in a text in lower case? Those without signs are searched as plain text, many times faster."""
    hit = F.lit(False)
    for p in patterns:
        if _LITERAL.fullmatch(p):
            hit = hit | F.contains(low, F.lit(p))
    rest = [p for p in patterns if not _LITERAL.fullmatch(p)]
    return hit | low.rlike("|".join(f"(?:{p})" for p in rest)) if rest else hit


def folded_once(text: Column, rule: Callable[[Column], Column]) -> Column:
    """rule of the text with A to Z in lower case, which is worked out once however often the rule looks at it."""
    return F.transform(F.array(F.translate(text, _UPPER, _LOWER)), rule)[0]


def first_listed(low: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first rule of which a pattern is found in a text in lower case; null if none is."""
    chain = None
    for label, patterns in rules:
        hit = any_of(low, patterns)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(None).cast("string") if chain is None else chain


def contains_any(text: Column, words: Sequence[str]) -> Column:
    low, hit = F.lower(text), F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def pattern_score(text: Column, patterns: Sequence[str], folded: bool = False) -> Column:
    """How many of the patterns are found; case does not matter, folded: the text is in lower case already."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike(p if folded else "(?i)" + p), F.lit(False)).cast("int")
    return total


def load_rules(path: str) -> list[tuple[str, str]]:
    """Rules from a JSON file: a list of [label, [pattern, ...]]; large tables are given this way."""
    with open(path, encoding="utf-8") as f:
        return [(label, "|".join(f"(?:{p})" for p in patterns)) for label, patterns in json.load(f)]
