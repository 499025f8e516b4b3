"""Evaluation texts leaking into training text (problem 9): template canonicalisation and window joins.

Numbers, names and units of the items are replaced by typed placeholders; what counts as a name or unit is learned from
all items (words with a capital inside a sentence; words that follow a number). In a document a number stands for any
number, a word that no item has for any name, or for any unit if it follows a number: so a question is found again
when it was filled with names and units of its own. All template windows of WINDOW words of the items form a hash table
that the documents' template windows are joined with. At a hit the slots are checked for consistency: the same value
everywhere is a literal anchor; a re-parameterised passage must put one value for one value, in both directions for
names, and the same value wherever the item repeats a number or unit. Literal anchors are then checked exactly by
growing them in both directions with at most EDITS words changed, left out or put in, until LEAST words of the item are
covered. An item passage of LEAST words with EDITS edits has a clean run of more than WINDOW - 1 words, so no such
passage is missed.

The items are a stated query set. Up to BLOCK of them their table is sent to all tasks, and the documents are neither
shuffled nor joined. Beyond that their windows are a distributed table: the documents are read once, only the windows
that pass a filter of fixed size (FILTER_BITS bits, set by the items' windows) are shuffled to it, and the
pairs found are checked exactly. The vocabulary of the items (one number per word) is all that is sent to the tasks
then; both ways give the same rows.

Defined results: null and empty texts leak nothing; items of fewer than LEAST words cannot leak; each pair comes out
once, however often the passage is repeated; repeated documents each get their rows; whole texts are read; letter
case, punctuation, markup entities and line breaks are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

LEAST = 20
EDITS = 2
WINDOW = 6
BLOCK = 5_000
FILTER_BITS = 1 << 26

_WORD = re.compile(r"[^\W_]+")
#: The numbers of the placeholders; other words follow.
NUM, NAME, UNIT, FIRST = 0, 1, 2, 3


def tokens(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text).replace("&", " and ")
    return _WORD.findall(text.lower())


def word_roles(text: str) -> dict[str, tuple[int, int, int]]:
    """word -> (times, times with a capital inside a sentence, times after a number) in an item."""
    out: dict[str, tuple[int, int, int]] = {}
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        ws = _WORD.findall(sentence)
        for k, w in enumerate(ws):
            n, inside, after = out.get(w.lower(), (0, 0, 0))
            out[w.lower()] = (n + 1, inside + (k > 0 and w[:1].isupper()), after + (k > 0 and ws[k - 1].isdigit()))
    return out


def role(word: str, n: int, inside: int, after: int) -> int:
    """NUM, NAME, UNIT or FIRST for any other word."""
    return NUM if word.isdigit() else NAME if inside else UNIT if after >= 0.5 * n else FIRST


def kinds_of(roles: dict[str, int]) -> dict[str, int]:
    """word -> number of its placeholder, or its own number from FIRST on, in the order of the alphabet."""
    out, nxt = {}, FIRST
    for w in sorted(roles):
        out[w] = roles[w]
        if roles[w] == FIRST:
            out[w], nxt = nxt, nxt + 1
    return out


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], dtype=np.uint64)


def window_hashes(kinds: np.ndarray) -> np.ndarray:
    """A hash for every window of WINDOW numbers."""
    n = len(kinds) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = (kinds.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        h = sum(mixed[i : i + n] * _POWERS[i] for i in range(WINDOW))
        return (h ^ (h >> np.uint64(31))).view(np.int64)


class Vocabulary:
    """Numbers of the items' words and of any document's words."""

    def __init__(self, kinds: dict[str, int]) -> None:
        self.kinds = kinds

    def encode(self, ws: list[str]) -> np.ndarray:
        get = self.kinds.get
        out = [get(w, -1) for w in ws]
        for k, x in enumerate(out):
            if x < 0:
                w = ws[k]
                out[k] = NUM if w.isdigit() else UNIT if k and ws[k - 1].isdigit() else NAME
        return np.array(out, dtype=np.int64)


class Templates:
    """The hash table of some items; vocabulary is that of all items."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: Vocabulary | None = None) -> None:
        self.vocabulary = vocabulary or Vocabulary(lexicon([t for _, t in items]))
        self.items = {item: (ws, self.vocabulary.encode(ws).tolist()) for item, text in items if len(ws := tokens(text)) >= LEAST}
        self.table: dict[int, list[tuple[int, int]]] = {}
        for item, (_, kinds) in self.items.items():
            for p, h in enumerate(window_hashes(np.array(kinds)).tolist()):
                self.table.setdefault(h, []).append((item, p))
        self.hashes = np.array(sorted(self.table), dtype=np.int64)

    def leaks(self, text: str) -> list[tuple[int, str, int]]:
        """(item, kind, words covered): literal for passages of LEAST words with at most EDITS edits, template for
        passages whose slots were filled anew, one value for one value."""
        doc = tokens(text)
        if len(doc) < LEAST - EDITS or not len(self.hashes):
            return []
        codes = self.vocabulary.encode(doc)
        hashed = window_hashes(codes)
        spots = np.flatnonzero(self.hashes[np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)] == hashed)
        kinds = codes.tolist()
        literal: dict[int, int] = {}
        filled: dict[int, int] = {}
        done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the run last looked at
        for q in spots.tolist():
            for item, p in self.table[int(hashed[q])]:
                if done.get((item, q - p), -1) >= q + WINDOW:
                    continue
                ws, mine = self.items[item]
                end_p, end_q = p, q
                while end_p < len(ws) and end_q < len(kinds) and mine[end_p] == kinds[end_q]:
                    end_p, end_q = end_p + 1, end_q + 1
                done[item, q - p] = end_q
                same = [doc[q + k] == ws[p + k] for k in range(end_p - p)]
                run = 0
                for k, s in enumerate([*same, False]):  # clean runs are the literal anchors
                    if s:
                        run += 1
                        continue
                    if run >= WINDOW and item not in literal:
                        n = covered(ws, doc, p + k - run, q + k - run, run)
                        if n >= LEAST:
                            literal[item] = n
                    run = 0
                if end_p - p >= LEAST and consistent(mine[p:end_p], ws[p:end_p], doc[q:end_q]):
                    filled[item] = max(filled.get(item, 0), end_p - p)
        return [(i, "literal", n) for i, n in sorted(literal.items())] + [(i, "template", n) for i, n in sorted(filled.items()) if i not in literal]


def lexicon(texts: list[str]) -> dict[str, int]:
    """word -> number, learned from items at hand."""
    total: dict[str, tuple[int, int, int]] = {}
    for text in texts:
        for w, x in word_roles(text).items():
            total[w] = tuple(a + b for a, b in zip(total.get(w, (0, 0, 0)), x, strict=True))
    return kinds_of({w: role(w, *x) for w, x in total.items()})


def consistent(kinds: list[int], item: list[str], doc: list[str]) -> bool:
    """Slot consistency of a passage: a value of the item has one value in the document, names also the other way round,
    and at least half of the words are no slots."""
    there: list[dict[str, str]] = [{}, {}, {}]
    back: dict[str, str] = {}
    slots = 0
    for k, x, y in zip(kinds, item, doc, strict=True):
        if k < FIRST:
            slots += 1
            if there[k].setdefault(x, y) != y or k == NAME and back.setdefault(y, x) != x:
                return False
    return 2 * slots <= len(kinds)


def _reach(ws: list[str], doc: list[str], i: int, j: int, step: int, left: int) -> list[int]:
    """Most item words that follow (i, j) in a direction, by number of edits spent, 0 to left."""
    best = [0] * (left + 1)
    n = 0
    while 0 <= i < len(ws) and 0 <= j < len(doc) and ws[i] == doc[j]:
        i, j, n = i + step, j + step, n + 1
    best = [n] * (left + 1)
    if left and 0 <= i < len(ws):
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            ni, nj = i + step * di, j + step * dj
            if di and dj and not 0 <= j < len(doc):
                continue
            rest = _reach(ws, doc, ni, nj, step, left - 1)
            for e in range(1, left + 1):
                best[e] = max(best[e], n + di + rest[e - 1])
    return best


def covered(ws: list[str], doc: list[str], p: int, q: int, run: int) -> int:
    """Item words covered by a clean run at (p, q) grown both ways with at most EDITS edits in all."""
    ahead, behind = _reach(ws, doc, p + run, q + run, 1, EDITS), _reach(ws, doc, p - 1, q - 1, -1, EDITS)
    return max(behind[e] + run + ahead[EDITS - e] for e in range(EDITS + 1))


SCHEMA = "doc_id bigint, item_id bigint, kind string, n_words int"


def _found(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "n_words"]).astype({"doc_id": "int64", "item_id": "int64", "n_words": "int32"})


def vocabulary(items: DataFrame) -> dict[str, int]:
    """word -> number over all items; the counts are aggregated by word, one row per word of the items reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, *x) for text in batch["text"] for w, x in word_roles(text).items()], columns=["word", "n", "inside", "after"])

    per = items.mapInPandas(run, "word string, n bigint, inside bigint, after bigint").groupBy("word").agg(F.sum("n"), F.sum("inside"), F.sum("after"))
    return kinds_of({r[0]: role(r[0], *r[1:]) for r in per.collect()})


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, n_words) of every document and item it leaks."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0")
    ordered = items.select("item_id", "text").where("item_id is not null and text is not null")
    words = spark.sparkContext.broadcast(vocabulary(ordered))
    if ordered.limit(BLOCK + 1).count() > BLOCK:
        return _by_join(texts, ordered, words)
    table = spark.sparkContext.broadcast(Templates([(r[0], r[1]) for r in ordered.orderBy("item_id").collect()], Vocabulary(words.value)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _found([(d, *x) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for x in table.value.leaks(text)])

    return texts.mapInPandas(run, SCHEMA)


def _by_join(texts: DataFrame, items: DataFrame, words) -> DataFrame:
    """The same rows with the items' windows as a distributed table."""
    spark = texts.sparkSession

    def windows(key: str, passes):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Vocabulary(words.value)
            for batch in batches:
                found = [(k, np.unique(window_hashes(known.encode(tokens(text))))) for k, text in zip(batch[key], batch["text"], strict=True)]
                found = [(k, h[passes(h)]) for k, h in found]
                yield pd.DataFrame({key: np.repeat([k for k, _ in found], [len(h) for _, h in found]).astype("int64"), "h": np.concatenate([h for _, h in found] or [np.zeros(0, dtype=np.int64)])})

        return run

    held = stage(items.mapInPandas(windows("item_id", lambda h: np.ones(len(h), dtype=bool)), "item_id bigint, h bigint"), "item-windows")
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)  # a table of fixed size, however many items there are
    place = F.pmod("h", F.lit(FILTER_BITS))
    for r in held.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) & 63 as int))"))).toLocalIterator():
        bits[r[0]] = np.uint64(r[1] & (1 << 64) - 1)
    shared = spark.sparkContext.broadcast(bits)

    def passes(h: np.ndarray) -> np.ndarray:
        at = np.mod(h, FILTER_BITS)
        return (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    keyed = stage(texts.withColumn("no", F.monotonically_increasing_id()), "leak-texts")  # repeated ids are told apart
    seen = keyed.mapInPandas(windows("no", passes), "no bigint, h bigint")
    pairs = seen.join(held, "h").select("no", "item_id").distinct()
    both = pairs.join(keyed, "no").join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary(words.value)
        for batch in batches:
            yield _found([(d, *x) for d, text, i, item in zip(batch["doc_id"], batch["text"], batch["item_id"], batch["item"], strict=True) for x in Templates([(i, item)], known).leaks(text)])

    return both.select("doc_id", "text", "item_id", "item").mapInPandas(check, SCHEMA)
