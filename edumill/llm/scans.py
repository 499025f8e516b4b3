"""Noise in text from scanned pages (problem 7).

Method: word counts of the whole corpus give the frequent words; skip-gram vectors of the frequent words are learned
from all texts; a rare word is linked to the frequent words that it becomes by plausible glyph edits (such as rn for m
or 1 for l), and the context decides: of several the one whose vector fits the words around it best is taken, and a
form made of letters only, which may be a rare word in its own right, is corrected only where the words around it fit
the frequent word (FIT). A digit or sign inside a word needs no such proof. Furniture (running heads, page numbers) is
then removed, divided words are joined and the lines reflowed into paragraphs.

The frequent words are the VOCABULARY most frequent ones with at least LEAST_COUNT tokens: a number that is the same for
every size of the corpus; a word is none of them if a single glyph edit makes it one that is MISREAD times as frequent.
With their vectors they are the only thing that is sent to all tasks. Documents are repaired where they lie, without a
shuffle; only counts are shuffled. A word's candidates and a line's corrections are worked out once per worker.

Defined results: null and empty texts give no row and no repaired text; a divided word at the very end of a text stays
as it is; words without a frequent neighbour stay; a form of letters only without words around it that have vectors
stays; ties between corrections go to the more frequent word, then to the alphabet; equal findings of a line come out
once; repeated files each get their rows; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Most frequent words, the least count of one in small corpora, and how much rarer than a neighbour a misreading is.
VOCABULARY = 50_000
LEAST_COUNT = 6
MISREAD = 50
#: Length of the vectors, words on each side from which they are learned, words on each side at a correction, and the
#: cosine of a word and the mean of the words around it from which they fit (that of a word in its place is lower in
#: about one place of fifty).
VECTOR = 16
WINDOW = 2
AROUND = 4
FIT = -0.1

#: fixed values: what a glyph is read as -> what it may be
GLYPHS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("2", "z"), ("4", "a"), ("|", "l"), ("!", "l"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("li", "h"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("iii", "m"), ("lc", "k"), ("fi", "h"), ("ti", "n"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("l", "t"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"), ("o", "a"), ("a", "o"), ("u", "n"), ("n", "u"), ("u", "v"), ("q", "g"), ("g", "q"), ("j", "i"), ("s", "5"),
)
#: fixed values: section headings
HEADINGS = "abstract|introduction|background|literature review|theory|method|methods|methodology|data|data and methods|results|findings|discussion|conclusion|conclusions|limitations|references|bibliography|appendix|annex|acknowledgements|keywords"

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_DIVIDED = re.compile(r"([^\W_]+(?:['’-][^\W_]+)*)[-­¬‐]\s*$")
_DIVIDERS = frozenset("-\u00ad¬‐")
_FIRST = re.compile(r"\s*([^\W_]+(?:['’-][^\W_]+)*)")
_PAGE = re.compile(r"^[\W_]*(?:page|pg|p|seite|página|sayfa)?\.?[\W_]*\d{1,4}(?:\s*(?:/|of|von|de)\s*\d{1,4})?[\W_]*$", re.I)
_VOLUME = re.compile(r",?\s*\b(?:v[o0ac][l1i]|volume|no|issue|issn)\b\.?\s*\d+", re.I)
_HEADING = re.compile(rf"^\s*(?:\d+(?:\.\d+)*\.?\s+)?(?:{HEADINGS})\s*:?\s*$", re.I)
_REFERENCE = re.compile(r"^\s*[^\W\d_][\w'’-]+, [^\W\d_]\.")


_NO_LETTERS = re.compile(r"[\W\d_]+")
_CUT = re.compile(r"[-\u00ad¬‐][^\S\n]*\n\s*")
_LAST = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*$")
_STOP = re.compile(r"[.!?]['\"”’)]*\s+$")


@lru_cache(maxsize=20_000)
def _letters(s: str) -> str:
    return _NO_LETTERS.sub("", s.lower())


_SAME = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("0", "o"), ("1", "i"), ("l", "i"), ("5", "s"), ("9", "g"), ("c", "e"), ("f", "t"), ("b", "h"), ("v", "y"), ("o", "a"))


@lru_cache(maxsize=20_000)
def _glyphs(s: str) -> str:
    """Letters and digits with glyphs that are misread for each other made equal."""
    s = "".join(c for c in s.lower() if c.isalnum())
    for a, b in _SAME:
        s = s.replace(a, b)
    return s


_AUTHOR = re.compile(r"^.{2,40}\bet al\.?\s*\|\s*")
_PAGED = re.compile(r"^\d{1,4}\s+|\s*\|?\s+\d{1,4}$")


def _ends(line: str) -> bool:
    """Does a line end a sentence, quotes and brackets aside?"""
    return line.rstrip().rstrip("'\"”’)")[-1:] in (".", "!", "?", ":")


@lru_cache(maxsize=20_000)
def _running(s: str, title: str) -> bool:
    """Is a line the start of the title, with or without an author before it and a page number beside it?"""
    rest = _AUTHOR.sub("", s) if "et al" in s else s
    if rest[:1].isdigit() or rest[-1:].isdigit():
        rest = _PAGED.sub("", rest)
    if not title.startswith(_glyphs(rest[:14])[:5]):  # five glyphs come from the first fourteen signs
        return False
    mine = _glyphs(rest)
    return len(mine) >= 8 and title.startswith(mine) and not rest.endswith(".") and (rest[:1].isupper() or rest != s)


@lru_cache(maxsize=20_000)
def _alone(s: str) -> str:
    """What a line says about itself, whatever stands around it: page_no, heading, volume, reference or text."""
    short, digit = len(s) < 90, any(c.isdigit() for c in s)
    if digit and short and _PAGE.match(s) and not s.endswith((".", ",", ";", ":")):
        return "page_no"
    if short and _HEADING.match(s):
        return "heading"
    if digit and short and _VOLUME.search(s) and not _ends(s) and (s.upper() == s or sum(w[:1].isupper() for w in s.split()) >= 0.4 * len(s.split())):
        return "volume"
    return "reference" if _REFERENCE.match(s) else "text"


def line_kinds(lines: list[str], title: str) -> list[str]:
    """blank, title, authors, heading, reference, header, page_no or text for every line."""
    kinds, key, head, refs = [], _letters(title), _glyphs(title), False
    repeated: Counter | None = None
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            kinds.append("blank")
            continue
        kind = _alone(s)
        if i == 0 and _letters(s) == key:
            kind = "title"
        elif i == 1 and kinds[0] == "title" and kind != "heading" and not _ends(s) and all(w[:1].isupper() for w in s.split() if w[:1].isalpha()):
            kind = "authors"
        elif kind == "page_no":
            pass
        elif kind == "heading":
            refs = bool(re.search(r"references|bibliography", s, re.I))
        elif kind == "volume" or i and _running(s, head):
            kind = "header"
        elif s.upper() == s and len(_letters(s)) >= 8:
            if repeated is None:
                repeated = Counter(_letters(x.strip()) for x in lines if not _ends(x))
            if repeated[_letters(s)] >= 3:
                kind = "header"
        if kind == "text" and refs and re.search(r"\(\d{4}\)", s):
            kind = "reference"
        kinds.append(kind)
    return kinds


def next_text(kinds: list[str], i: int) -> int | None:
    """The line on which the text of line i goes on."""
    return next((j for j in range(i + 1, len(kinds)) if kinds[j] not in ("blank", "header", "page_no")), None)


def counted_words(text: str) -> Counter:
    """Words of a text in lower case; the two parts of a divided word do not count."""
    low = text.lower()
    out = Counter(_WORD.findall(low))
    for m in _CUT.finditer(low):
        left, right = _LAST.search(low[low.rfind("\n", 0, m.start()) + 1 : m.start()]), _WORD.match(low, m.end())
        if left and right:
            out[left[0]] -= 1
            out[right[0]] -= 1
    return +out


@lru_cache(maxsize=200_000)
def variants(word: str) -> tuple[tuple[str, int], ...]:
    """(form, position of the first edit) of a word by one glyph edit."""
    out = {}
    for seen, meant in GLYPHS:
        at = word.find(seen)
        while at >= 0:
            out.setdefault(word[:at] + meant + word[at + len(seen) :], at)
            at = word.find(seen, at + 1)
    return tuple(out.items())


class Corrector:
    """Corrections of rare words by frequent neighbours; frequent maps a word to its count, vectors to its vector."""

    def __init__(self, frequent: dict[str, int], vectors: dict[str, np.ndarray]) -> None:
        self.frequent, self.vectors, self.cache = frequent, vectors, {}
        self.lines: dict[tuple, tuple[tuple[int, int, str], ...]] = {}

    def line(self, line: str, start: int, stop: int, opens: bool) -> tuple[tuple[int, int, str], ...]:
        """line_fixes, worked out once for a line of both fields of a file."""
        key = (line, start, stop, opens)
        if key not in self.lines:
            if len(self.lines) > 5_000:
                self.lines.clear()
            self.lines[key] = line_fixes(line, start, stop, opens, self)
        return self.lines[key]

    def candidates(self, word: str) -> list[str]:
        """Frequent words that a rare word in lower case becomes by one glyph edit, else by two."""
        if word not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            found: list[str] = []
            if word not in self.frequent and len(word) >= 3 and not word.isdigit():
                once = [v for v, _ in variants(word)]
                found = sorted({v for v in once if v in self.frequent and len(v) >= 3})
                if not found and len(word) >= 5:
                    found = sorted({v for x in once for v, _ in variants(x) if v in self.frequent and len(v) >= 4 and v != word})
            self.cache[word] = found
        return self.cache[word]

    def fits(self, cands: list[str], around: list[str]) -> dict[str, float]:
        """Cosine of each candidate that has a vector and the mean of the words around it."""
        vs = [self.vectors[w] for w in around if w in self.vectors]
        if not vs:
            return {}
        mean = np.mean(vs, axis=0)
        mean = mean / (np.linalg.norm(mean) + 1e-9)
        return {w: float(mean @ self.vectors[w]) for w in cands if w in self.vectors}

    def best(self, word: str, around: list[str]) -> str | None:
        """The frequent word that a rare word in lower case stands for among the words around it, or None."""
        cands = self.candidates(word)
        if not cands:
            return None
        fit = self.fits(cands, around)
        top = max(sorted(cands), key=lambda w: (fit.get(w, 0.0), self.frequent[w]))
        return top if not word.isalpha() or fit.get(top, -1.0) >= FIT else None


def cased(word: str, right: str, opens: bool) -> str:
    """right with the letter case of word; opens: the word opens a sentence."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    if word[:1].isupper() or opens and not word[:1].isalpha():
        return right[:1].upper() + right[1:]
    if len(right) == len(word):
        return "".join(r.upper() if w.isupper() else r for w, r in zip(word, right, strict=True))
    return right


def line_fixes(line: str, start: int, stop: int, opens: bool, fix: Corrector) -> tuple[tuple[int, int, str], ...]:
    """(from, to, right word) of the corrections in line[start:stop]; opens: the first word opens a sentence."""
    if fix.frequent.keys() >= set(_WORD.findall(line[start:stop].lower())):
        return ()
    spans = [(m.start() + start, m.end() + start) for m in _WORD.finditer(line[start:stop])]
    lows = [line[a:b].lower() for a, b in spans]
    out = []
    for k, (a, b) in enumerate(spans):
        if lows[k] in fix.frequent:
            continue
        word = line[a:b]
        first = opens if k == 0 else bool(_STOP.search(line[:a]))
        if word[:1].isupper() and not first and not any(c.isdigit() for c in word):
            continue  # a name
        around = lows[max(0, k - AROUND) : k] + lows[k + 1 : k + 1 + AROUND]
        right = fix.best(lows[k], around)
        if right is None and "-" in word:
            parts = [p if p in fix.frequent else fix.best(p, around) or p for p in lows[k].split("-")]
            right = "-".join(parts) if "-".join(parts) != lows[k] else None
        if right is not None and (right := cased(word, right, first)) != word:
            out.append((a, b, right))
    return tuple(out)


def whole_word(a: str, b: str, around: list[str], fix: Corrector) -> str:
    """The word whose parts a and b stand on two lines, with a hyphen if it has one of its own."""
    known = lambda w: fix.frequent.get(w.lower(), 0)
    joined, apart = a + b, f"{a}-{b}"
    if known(joined) or known(apart):
        return joined if known(joined) >= known(apart) else apart
    if right := fix.best(joined.lower(), around):
        return cased(joined, right, False)
    if right := fix.best(apart.lower(), around):
        return cased(apart, right, False)
    return apart if "-" in a or known(a) and known(b) and min(len(a), len(b)) > 3 else joined


def repaired(text: str, title: str, fix: Corrector) -> tuple[list[tuple[int, str, str]], str]:
    """Findings (line_no, kind, fixed) and the repaired text."""
    lines = text.split("\n")
    kinds = line_kinds(lines, title)
    found: dict[tuple[int, str, str], None] = {}
    whole: dict[int, tuple[int, str, int]] = {}  # line with a divided word -> line with its rest, the whole word, its start
    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        if kind in ("header", "page_no"):
            found[i + 1, kind, ""] = None
        elif kind in ("text", "reference") and line.rstrip()[-1:] in _DIVIDERS and (m := _DIVIDED.search(line)) and (j := next_text(kinds, i)) is not None and kinds[j] == kind and (n := _FIRST.match(lines[j])):
            around = _WORD.findall(line[: m.start()].lower())[-AROUND:] + _WORD.findall(lines[j][n.end() :].lower())[:AROUND]
            word = whole_word(m[1], n[1], around, fix)
            found[i + 1, "hyphen", word] = None
            whole[i] = (j, word, m.start())
    rest = {j for j, _, _ in whole.values()}
    # correct the words of paragraphs in their context
    out: list[str] = []
    flow: list[str] = []
    ends = True
    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        if kind in ("header", "page_no"):
            continue
        if kind != "text":
            if kind != "blank" or ends:  # a blank line inside a sentence is a page break
                if flow:
                    out.append(" ".join(flow))
                flow = []
                if kind != "blank":
                    out.append(line.strip())
                    ends = True
            continue
        last, stop = len(_FIRST.match(line)[0]) if i in rest else 0, whole[i][2] if i in whole else len(line)
        last = min(last, stop)
        pieces = []
        for a, b, right in fix.line(line, last, stop, ends and i not in rest):
            found[i + 1, "char", right] = None
            pieces += [line[last:a], right]
            last = b
        pieces += [line[last:stop], whole[i][1] if i in whole else ""]
        if (piece := " ".join("".join(pieces).split())) and i in rest and flow and not piece[0].isalnum():
            flow[-1] += piece  # the sign after a divided word
        elif piece:
            flow.append(piece)
        ends = _ends(line)
    if flow:
        out.append(" ".join(flow))
    return list(found), "\n\n".join(out)


def word_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["raw_text"]:
                total.update(counted_words(text))
            if len(total) > 300_000:
                yield pd.DataFrame(list(total.items()), columns=["word", "n"])
                total = Counter()
        yield pd.DataFrame(list(total.items()), columns=["word", "n"])

    return texts.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def skip_grams(texts: DataFrame, frequent: dict[str, int], least: int) -> dict[str, np.ndarray]:
    """Unit vectors of the frequent words, learned from all texts; least is the count of the rarest of them."""
    from pyspark.ml.feature import Word2Vec

    tokens = F.expr(r"filter(split(lower(regexp_replace(raw_text, '[-¬­‐]\\s*\\n\\s*', '')), '[^\\p{L}\\p{N}\'’-]+'), x -> x != '')")
    parts = max(1, min(64, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = texts.select(tokens.alias("tokens"))
    learner = Word2Vec(vectorSize=VECTOR, minCount=least, numPartitions=parts, maxIter=1, windowSize=WINDOW, seed=11, inputCol="tokens", outputCol="v")
    try:
        model = learner.fit(rows)
    except IllegalArgumentException as e:
        if "vocabulary size" not in str(e):
            raise
        return {}  # no token is as frequent as a word, as tokens are cut a little differently
    return {r["word"]: (v := r["vector"].toArray().astype(np.float32)) / (np.linalg.norm(v) + 1e-9) for r in model.getVectors().collect() if r["word"] in frequent}


def corrector(pdfs: DataFrame) -> Corrector:
    texts = pdfs.select("raw_text").where("length(raw_text) > 0")
    counts = checkpointed(word_counts(texts))
    frequent = {r[0]: r[1] for r in counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()}
    if not frequent:
        return Corrector({}, {})
    least = min(frequent.values())
    misread = [w for w, n in frequent.items() if any(frequent.get(v, 0) >= MISREAD * n for v, _ in variants(w))]
    vectors = skip_grams(texts, frequent, least)
    for w in misread:  # no word of its own, unless the context says so
        del frequent[w]
    return Corrector(frequent, vectors)


def repair(pdfs: DataFrame) -> DataFrame:
    """(file_id, field_name, line_no, kind, fixed, repaired): findings with line numbers, and one row of kind text with
    the repaired text per field."""
    spark = pdfs.sparkSession
    shared = spark.sparkContext.broadcast(corrector(pdfs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, raw, extraction in zip(batch["file_id"], batch["raw_text"], batch["extraction_text"], strict=True):
                title = (raw or extraction or "").split("\n", 1)[0]
                for name, text in (("raw_text", raw), ("extraction_text", extraction)):
                    if text:
                        found, clean = repaired(text, title, shared.value)
                        rows += [(file_id, name, no, kind, fixed, None) for no, kind, fixed in found]
                        rows.append((file_id, name, 0, "text", None, clean))
            yield pd.DataFrame(rows, columns=["file_id", "field_name", "line_no", "kind", "fixed", "repaired"]).astype({"file_id": "int64", "line_no": "int32"})

    source = pdfs.select("file_id", "raw_text", "extraction_text").where("file_id is not null")
    return source.mapInPandas(run, "file_id bigint, field_name string, line_no int, kind string, fixed string, repaired string")
