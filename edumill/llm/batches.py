"""Slices of a batch of texts, so that a worker holds the words of a bounded amount of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Letters of text whose words are held at once; one longer text is a slice of its own.
LETTERS = 2_000_000


def slices(texts: list[str], letters: int = LETTERS) -> Iterator[slice]:
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > letters:
            yield slice(start, k)
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
