"""Filling fixed-capacity containers with items (problem 8) along a space-filling curve.

Every document becomes a hashed word vector, projected to AXES dimensions; the position on the Hilbert curve through
those dimensions is its sort key, so documents that use similar words lie next to each other. Keys and token counts
(no texts) are range-sorted with the document id as a tie-break, so equal documents, however many, spread over several
partitions. Each partition then packs the documents in the order of the curve: an item goes to the fullest of the OPEN
containers that it fits; when too many are open the fullest is closed. Items larger than the capacity are split into
full containers and a rest, others never. The few containers left open at the ends of the partitions are merged in a
second, small round.

Sizes are tokens of a public byte-level tokenizer, whose vocabulary file is a parameter. The tokenizer never joins
words, so each distinct word is counted once per worker.

Defined results: null and empty texts have no tokens and take no room, they get no row; repeated documents are packed
each; budgets without a positive capacity get no containers; empty tables give none; ties go to the lower container.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from .batches import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how byte-level BPE of this vocabulary divides a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HASHED, AXES, BITS, OPEN = 64, 3, 10, 64


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, axes) with so many bits per axis.

    The points' bits are turned into the curve's transposed Gray code from the top bit down, then interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(n):
            set_ = (x[i] & step) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn = np.where((x[n - 1] & step) > 0, turn ^ (step - 1), turn)
        step >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Sizer:
    """Token counts and curve keys of texts; keeps the count and the hashed place of every word it has met."""

    def __init__(self, vocabulary: bytes, most_words: int = 500_000) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN).findall
        self.most, self.words = most_words, {}
        self.sizes: list[int] = []
        self.places: list[int] = []
        rng = np.random.default_rng(5)
        self.axes = rng.choice([-1.0, 1.0], size=(HASHED, AXES))

    def _known(self, word: str) -> int:
        from zlib import crc32

        at = self.words[word] = len(self.sizes)
        self.sizes.append(len(self.encode(word)))
        h = crc32(word.strip().lower().encode("utf-8", "surrogatepass"))
        self.places.append((h % HASHED) * 2 + (h >> 20 & 1))
        return at

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, curve keys) of texts."""
        if len(self.words) > self.most:
            self.words, self.sizes, self.places = {}, [], []
        words, known = self.words, self._known
        ids = [[words[w] if w in words else known(w) for w in self.split(t)] for t in texts]
        sizes, places = np.array(self.sizes, dtype=np.int64), np.array(self.places, dtype=np.int64)
        tokens, points = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), AXES))
        for k, row in enumerate(ids):
            if row:
                at = np.array(row)
                tokens[k] = sizes[at].sum()
                seen = np.bincount(places[at], minlength=2 * HASHED).reshape(HASHED, 2)
                v = np.log1p(seen[:, 0]) - np.log1p(seen[:, 1])
                points[k] = (v / (np.linalg.norm(v) or 1.0)) @ self.axes
        cells = np.array([[0.5 * (1 + math.erf(x / math.sqrt(2))) for x in p] for p in points]).reshape(len(texts), AXES)
        return tokens, hilbert_key(np.minimum((cells * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, curve_key) of documents with text; the driver reads the tokenizer's file and sends it, as it is,
    to the workers, which need no path to it."""
    with open(path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(shared.value)
        for batch in batches:
            texts = batch["text"].tolist()
            for at in slices(texts):
                tokens, keys = sizer.measure(texts[at])
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "n_tokens": tokens, "curve_key": keys})

    return documents.select("doc_id", "text").where("doc_id is not null and length(text) > 0").mapInPandas(run, "doc_id bigint, n_tokens bigint, curve_key bigint")


class Packer:
    """Containers of one capacity, some of them open; items come in order."""

    def __init__(self, capacity: int, first: int = 0, open_: int = OPEN) -> None:
        self.capacity, self.most, self.next = capacity, open_, first
        self.free: list[tuple[int, int]] = []  # (room, container) of the open ones, least room first

    def full(self) -> int:
        """A container that one piece fills."""
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> int:
        from bisect import bisect_left, insort

        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, at = self.free.pop(k)
        else:
            room, at = self.capacity, self.full()
        if room > size:
            insort(self.free, (room - size, at))
            if len(self.free) > self.most:
                self.free.pop(0)
        return at


def pack(documents: DataFrame, budgets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(budget_id, container_id, doc_id, piece_no, n_tokens): the container of every document, or of its pieces.

    budgets: budget_id, capacity_tokens; a small parameter table.
    """
    spark = documents.sparkSession
    caps = sorted((r[0], r[1]) for r in budgets.select("budget_id", "capacity_tokens").where("budget_id is not null and capacity_tokens > 0").distinct().collect())
    sizes = stage(sized(documents, path), "sizes")
    ordered = sizes.where("n_tokens > 0").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        packers = [(b, Packer(c, first)) for b, c in caps]
        for batch in batches:
            out = []
            for doc, n in zip(batch["doc_id"].tolist(), batch["n_tokens"].tolist(), strict=True):
                for b, p in packers:
                    whole, rest = divmod(n, p.capacity)
                    for piece in range(whole):
                        out.append((b, p.full(), doc, piece + 1, p.capacity, False))
                    if rest:
                        out.append((b, p.place(rest), doc, whole + 1, rest, False))
            yield pd.DataFrame(out, columns=["budget_id", "container_id", "doc_id", "piece_no", "n_tokens", "left"])
        left = [(b, at, None, None, p.capacity - room, True) for b, p in packers for room, at in p.free]
        yield pd.DataFrame(left, columns=["budget_id", "container_id", "doc_id", "piece_no", "n_tokens", "left"]).astype({"doc_id": "Int64", "piece_no": "Int64"})

    packed = stage(ordered.select("doc_id", "n_tokens").mapInPandas(run, "budget_id int, container_id bigint, doc_id bigint, piece_no int, n_tokens bigint, left boolean"), "packed")
    # at most OPEN containers a budget and partition are left; they are merged in groups of partitions
    left = packed.where("left").select("budget_id", "container_id", "n_tokens", (F.shiftright("container_id", 32) / 256).cast("int").alias("g"))
    by = dict(caps)

    def merge(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["n_tokens", "container_id"], ascending=[False, True])
        packer = Packer(by[int(batch["budget_id"].iloc[0])], open_=len(batch))
        at = [packer.place(int(n)) for n in batch["n_tokens"]]
        names: dict[int, int] = {}
        return pd.DataFrame({"budget_id": batch["budget_id"], "container_id": batch["container_id"], "merged_id": [names.setdefault(a, c) for a, c in zip(at, batch["container_id"], strict=True)]})

    merged = left.groupBy("budget_id", "g").applyInPandas(merge, "budget_id int, container_id bigint, merged_id bigint").where("container_id != merged_id")
    return packed.where("not left").join(broadcast_if_small(stage(merged, "merged")), ["budget_id", "container_id"], "left").select(
        "budget_id", F.coalesce("merged_id", "container_id").alias("container_id"), "doc_id", "piece_no", "n_tokens"
    )
