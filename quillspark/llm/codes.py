"""Batches of texts as arrays of code points, for vectorised features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points that a step works on, unless one text alone is longer.
STEP = 1_000_000


def steps(texts: list[str], most: int = STEP) -> Iterator[tuple[int, list[str]]]:
    """``(index of the first, texts)`` of runs with at most ``most`` code points each, or a single longer text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, texts[first:]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the text number of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
