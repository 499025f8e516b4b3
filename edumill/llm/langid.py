"""Missing or wrong document language labels (problem 2): hierarchical discrimination with linear SVMs.

A sentence is placed in a language family first, by one-versus-one linear support vector machines between families;
one-versus-one machines then separate the closely related languages inside the family. All machines are linear in
character n-grams of words, so the contribution of a word to every machine is worked out once per worker and summed
over the words of a sentence; whole texts are read. A segment is a longest run of whole sentences of one language (in
a title: of whole titles, which stand beside each other with a separator), with the confidence of its decision.

The machines are trained on a bounded sample of labelled texts (SAMPLE_TEXTS per language, chosen by hash, at most
SAMPLE_SENTENCES sentences each); sentences whose first model contradicts their label are dropped before the second
training, as some labels are wrong. The confidence is the probability that a decision of its margin is right, read
from a fifth of the sample that machines were not trained on. A sentence without a clear decision whose words are hardly
known in any of the languages is in none of them and gets the label und. Everything else runs over all rows.

Defined results: null, blank and placeholder texts and texts without letters give no segment; a sentence without
words, or a short one without a clear decision, goes with its neighbours; ties go to the language named first in
FAMILIES; repeated rows each get their rows; an empty table gives none; without any labelled text nothing is decided.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: fixed values: the languages of the tables by family
FAMILIES = {"germanic": ("en", "de"), "romance": ("fr", "es", "pt"), "turkic": ("tr",)}
SAMPLE_TEXTS = 1200
SAMPLE_SENTENCES = 8
DIMENSIONS = 1 << 16
EPOCHS = 5
#: A title of several languages is split only where each part has so many words.
LEAST_WORDS = 3
#: The label of any other language: of a sentence of so many words fewer than this share stand in the training sentences
#: of any one language, and the decision has a margin under 1.
OTHER, OTHER_WORDS, OTHER_SHARE = "und", 6, 0.15

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|\n\s*\n")
_TITLE = re.compile(r"\s+[/=|–—]\s+|(?<=[.?!])\s+|\s*\n\s*")


def languages() -> list[str]:
    return [x for f in FAMILIES.values() for x in f]


def machines() -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(languages on the plus side, on the minus side) of every machine: family pairs, then language pairs in a family."""
    fams = list(FAMILIES.values())
    out = [(a, b) for i, a in enumerate(fams) for b in fams[i + 1 :]]
    return out + [((a,), (b,)) for f in fams for i, a in enumerate(f) for b in f[i + 1 :]]


def features(word: str) -> list[int]:
    w = f"^{word}$"
    return [crc32(w[i : i + n].encode()) % DIMENSIONS for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [crc32(w.encode()) % DIMENSIONS] * 3


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def _vector(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(np.array([f for w in ws for f in features(w)]), return_counts=True)
    return ids, counts / len(ws)


@dataclass(frozen=True)
class Model:
    """weights: (machines, dimensions + 1); seen: word -> bits of the languages in whose sentences it stands;
    slope, offset: probability that a decision of a margin is right."""

    weights: np.ndarray
    seen: dict[str, int]
    slope: float
    offset: float


def train(samples: list[tuple[str, str]]) -> Model:
    """The machines of (text, language) pairs; hinge loss with L2 norm, averaged passes."""
    labels: dict[tuple[str, ...], Counter] = {}
    for text, lang in samples:
        for s in sentences(text)[:SAMPLE_SENTENCES]:
            ws = tuple(words(s))
            if len(ws) >= 3:
                labels.setdefault(ws, Counter())[lang] += 1
    data = []
    for ws, votes in sorted(labels.items()):  # the same words count once, in the language that most labels give
        (lang, n), *rest = votes.most_common(2)
        if not rest or n > 2 * rest[0][1]:
            data.append((*_vector(list(ws)), lang, ws))
    first = _machines(data)
    data = [d for d in data if _decided(first, d)[0] == d[2]]
    seen: dict[str, int] = {}
    for *_, lang, ws in data:
        for w in ws:
            seen[w] = seen.get(w, 0) | 1 << languages().index(lang)
    # confidence: margins of every fifth sentence under machines that have not seen it
    part = _machines([d for k, d in enumerate(data) if k % 5])
    judged = [(*_decided(part, d), d[2]) for d in data[::5]]
    return Model(_machines(data), seen, *_calibrated([m for _, m, _ in judged], [lang == right for lang, _, right in judged]))


def _machines(data: list[tuple]) -> np.ndarray:
    weights = np.zeros((len(machines()), DIMENSIONS + 1), dtype=np.float64)
    for k, (plus, minus) in enumerate(machines()):
        mine = [(i, c, 1.0 if lang in plus else -1.0) for i, c, lang, _ in data if lang in plus or lang in minus]
        if mine:
            weights[k] = _svm(mine)
    return weights.astype(np.float32)


def _decided(weights: np.ndarray, d: tuple) -> tuple[str, float]:
    return decide((weights[:, d[0]] * d[1]).sum(1) + weights[:, -1])


def _calibrated(margins: list[float], right: list[bool]) -> tuple[float, float]:
    """(slope, offset) of a logistic curve through the margins by Newton steps; two pseudo-cases keep it finite."""
    x = np.array([*margins, 0.0, 0.0, 2.0])
    y = np.array([*map(float, right), 0.0, 1.0, 1.0])
    a, b = 3.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -2, 2)
    return max(0.1, float(a)), float(b)


def _svm(data: list[tuple[np.ndarray, np.ndarray, float]], penalty: float = 2e-3) -> np.ndarray:
    w, total, t = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1), 0
    sides = {y: max(1, sum(1 for d in data if d[2] == y)) for y in (1.0, -1.0)}
    rng, scale = np.random.default_rng(7), 1.0
    for _ in range(EPOCHS):
        for j in rng.permutation(len(data)):
            i, c, y = data[j]
            t += 1
            rate = 1.0 / (penalty * (t + 1000))
            scale *= 1 - rate * penalty
            if y * scale * (w[i] @ c + w[-1] * 0.1) < 1:
                step = rate * y * len(data) / (2 * sides[y]) / scale
                w[i] += step * c
                w[-1] += step * 0.1
        total += w * scale
    out = total / EPOCHS
    out[-1] *= 0.1
    return out


def decide(scores: np.ndarray) -> tuple[str, float]:
    """(language, margin): votes between families, then between the languages of the best family."""
    fams, k = list(FAMILIES.values()), 0
    strength = [0.0] * len(fams)
    for i in range(len(fams)):
        for j in range(i + 1, len(fams)):
            s = max(-1.0, min(1.0, float(scores[k])))
            strength[i] += s
            strength[j] -= s
            k += 1
    best = max(range(len(fams)), key=lambda i: (strength[i], -i))
    margin = strength[best] - max(s for i, s in enumerate(strength) if i != best) if len(fams) > 1 else 1.0
    for f, fam in enumerate(fams):
        inner = [0.0] * len(fam)
        for i in range(len(fam)):
            for j in range(i + 1, len(fam)):
                if f == best:
                    s = max(-1.0, min(1.0, float(scores[k])))
                    inner[i] += s
                    inner[j] -= s
                k += 1
        if f == best:
            top = max(range(len(fam)), key=lambda i: (inner[i], -i))
            if len(fam) > 1:
                margin = min(margin, inner[top] - max(s for i, s in enumerate(inner) if i != top))
            return fam[top], margin
    raise AssertionError


class Decider:
    """Decisions for many sentences at once; keeps the contribution of every word that it has met."""

    def __init__(self, model: Model, most_words: int = 400_000) -> None:
        self.model, self.weights, self.most = model, model.weights, most_words
        self.ids: dict[str, int] = {}
        self.bits = np.arange(len(languages()))
        self.rows = np.zeros((1024, len(self.weights) + len(self.bits)), dtype=np.float32)

    def _known(self, word: str) -> int:
        at = len(self.ids)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        n = len(self.weights)
        self.rows[at, :n] = self.weights[:, features(word)].sum(1)
        self.rows[at, n:] = self.model.seen.get(word, 0) >> self.bits & 1
        self.ids[word] = at
        return at

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """(parts, machines + languages): scores, and the share of words that were seen in each language; a part without
        words scores 0."""
        if len(self.ids) > self.most:
            self.ids.clear()
        ids, known = self.ids, self._known
        flat = [ids[w] if w in ids else known(w) for ws in parts for w in ws]
        sizes = np.array([len(ws) for ws in parts])
        out = np.zeros((len(parts), self.rows.shape[1]), dtype=np.float32)
        full = np.flatnonzero(sizes)
        if len(flat):
            starts = (np.cumsum(sizes) - sizes)[full]
            out[full] = np.add.reduceat(self.rows[np.array(flat)], starts) / sizes[full, None]
            out[full, : len(self.weights)] += self.weights[:, -1]
        return out

    def decide(self, scores: np.ndarray, n: int) -> tuple[str, float]:
        """(language, margin) of a part of n words; a part of OTHER_WORDS or more of which hardly any was seen in
        any one language is in another one."""
        lang, margin = decide(scores)
        if n >= OTHER_WORDS and margin < 1 and scores[len(self.weights) :].max() < OTHER_SHARE:
            return OTHER, 1.0
        return lang, margin

    def confidence(self, lang: str, margin: float) -> float:
        """The calibrated probability that a decision is right; 0.5 for another language, which is not told further."""
        return 0.5 if lang == OTHER else 1 / (1 + math.exp(-(self.model.slope * margin + self.model.offset)))


def _runs(langs: list[tuple[str | None, float, int]], least: float = 0.5) -> list[tuple[str, float]]:
    """Runs of one language from (language, margin, words) per part; unclear short parts go with their neighbours."""
    clear = [k for k, (lang, m, n) in enumerate(langs) if lang is not None and n and m >= least]
    if not clear:
        best = max((x for x in langs if x[0] is not None and x[2]), key=lambda x: x[1], default=None)
        return [(best[0], best[1])] if best else []
    runs: list[list] = []
    for k in clear:
        lang, m, n = langs[k]
        if runs and runs[-1][0] == lang:
            runs[-1][1] += m * n
            runs[-1][2] += n
        else:
            runs.append([lang, m * n, n])
    return [(lang, m / n) for lang, m, n in runs]


def _joined(parts: list[list[str]]) -> list[list[str]]:
    """Parts of a title, those of too few words put to the part before them (the first to the one after)."""
    out: list[list[str]] = []
    for ws in parts:
        if out and (len(ws) < LEAST_WORDS or len(out[-1]) < LEAST_WORDS):
            out[-1] = out[-1] + ws
        else:
            out.append(list(ws))
    return out


def segments_of(texts: list[str], titles: list[bool], decider: Decider) -> list[list[tuple[str, float]]]:
    """The segments (language, confidence) of every text, in order."""
    parts, owner = [], []
    for t, (text, title) in enumerate(zip(texts, titles, strict=True)):
        pieces = [p for p in (_TITLE.split(text) if title else sentences(text)) if p]
        split = [words(p) for p in pieces]
        if title:
            split = _joined(split)
        parts += split
        owner += [t] * len(split)
    scores = decider.scores(parts)
    marked: list[list[tuple[str | None, float, int]]] = [[] for _ in texts]
    for t, ws, s in zip(owner, parts, scores, strict=True):
        marked[t].append((*(decider.decide(s, len(ws)) if ws else (None, 0.0)), len(ws)))
    return [[(lang, decider.confidence(lang, m)) for lang, m in _runs(x)] for x in marked]


PLACEHOLDER = r"(?i)^[\s\p{Z}]*(n/?a|none|null|nan|-+|\?+|unknown|untitled|untitled document|\[?no title\]?|title|not available|not reported|microsoft (word|powerpoint).*)?[\s\p{Z}]*$"


def label_of(column: str):
    clean = F.lower(F.trim(F.col(column)))
    return F.when(clean.isin(*languages()), clean)


def training_sample(texts: DataFrame) -> list[tuple[str, str]]:
    """About SAMPLE_TEXTS different labelled texts per language, chosen by the hash of the text; the same ones at every run."""
    known = texts.withColumn("l", label_of("label")).where("l is not null")
    counts = {r[0]: r[1] for r in known.groupBy("l").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE_TEXTS / n)))])
    pick = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("l")] * F.lit(float(1 << 30))
    return [(r[0], r[1]) for r in known.where(pick).select("text", "l").distinct().orderBy(F.xxhash64("text"), "l").limit(SAMPLE_TEXTS * len(languages())).collect()]


def segments(texts: DataFrame) -> DataFrame:
    """(field_name, row_id, seg_no, lang, confidence, is_case) for rows (field_name, row_id, label, text, is_title)."""
    spark = texts.sparkSession
    real = texts.where(F.col("text").isNotNull() & ~F.col("text").rlike(PLACEHOLDER) & F.col("text").rlike(r"\p{L}"))
    samples = training_sample(real)
    model = spark.sparkContext.broadcast(train(samples) if samples else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decider = Decider(model.value) if model.value is not None else None
        for batch in batches:
            out = []
            for at in slices(batch["text"].tolist()) if decider else ():
                part = batch.iloc[at]
                found = segments_of(part["text"].tolist(), part["is_title"].tolist(), decider)
                for f, i, label, segs in zip(part["field_name"], part["row_id"], part["label"], found, strict=True):
                    case = len(segs) > 1 or bool(segs) and (label or "").strip().lower() != segs[0][0]
                    out += [(f, i, k, lang, c, case) for k, (lang, c) in enumerate(segs, 1)]
            yield pd.DataFrame(out, columns=["field_name", "row_id", "seg_no", "lang", "confidence", "is_case"]).astype({"row_id": "int64", "seg_no": "int32", "confidence": "float64", "is_case": "bool"})

    return real.select("field_name", "row_id", "label", "text", "is_title").mapInPandas(run, "field_name string, row_id bigint, seg_no int, lang string, confidence double, is_case boolean")
