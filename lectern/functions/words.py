"""Words, word hashes and shingle hashes, computed for whole Arrow batches at a time.

A word is a longest run of letters and digits in lower case. The functions work on the flat array
of all words of a batch, so that the per-word work is done by numpy and not by Python loops.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Words of one pass through numpy; longer batches are worked off in several passes.
PASS_WORDS = 1_000_000


def words_of(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: list[str]) -> np.ndarray:
    """One unsigned 64-bit hash per word, the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    codes, unique = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(unique, categorize=False)[codes]


def shingle_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words, by start."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _MULT + hashed[j : j + n]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def passes(texts: pd.Series, tokenise: Callable[[str | None], list[str]] = words_of, limit: int = PASS_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, number of words of each text, hashes of all their words), pass by pass."""
    first, sizes, flat = 0, [], []
    for i, text in enumerate(texts):
        own = tokenise(text)
        sizes.append(len(own))
        flat += own
        if len(flat) >= limit:
            yield first, np.array(sizes, np.int64), hash_words(flat)
            first, sizes, flat = i + 1, [], []
    if sizes:
        yield first, np.array(sizes, np.int64), hash_words(flat)


def runs(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``length`` words that lie within one text, and the text of each."""
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.empty(0, np.int64)
    within = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.empty(0, np.int64), counts)
    return begin[text] + within, text
