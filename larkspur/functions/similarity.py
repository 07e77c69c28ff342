"""String similarities from 0 to 100, on the length of the longest common subsequence.

The subsequence is computed bit-parallel (Hyyrö), a whole string in one integer; Arrow batches reach
Python, and each distinct pair of a batch is scored once; workers keep the last 65,536 pairs. Definitions
are in the docstrings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty strings are equal."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """100 if one side's words hold the other's; else the best of the shared words with each rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, rest_x, rest_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not rest_x or not rest_y):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    long_x, long_y = shared + gap + len(rest_x), shared + gap + len(rest_y)
    best = 100.0 * (1 - (len(rest_x) + len(rest_y) - 2 * common(rest_x, rest_y)) / (long_x + long_y))
    if shared:
        best = max(best, 100.0 * (1 - (gap + len(rest_x)) / (shared + long_x)), 100.0 * (1 - (gap + len(rest_y)) / (shared + long_y)))
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one of at most its length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    ends = [(max(0, i - len(a)), i) for i in range(1, len(b) + len(a))]
    return max(ratio(a, b[s : min(e, len(b))]) for s, e in ends if s < len(b))


def partial_tokens(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return partial(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted(a: str, b: str) -> float:
    """The best of several ratios; parts count less the more the lengths differ."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if times < 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * partial_tokens(a, b))


def words(a: str, b: str) -> float:
    """Mean of the sorted-words and the word-set ratio: the score of candidates."""
    return (token_sort(a, b) + token_set(a, b)) / 2.0


@lru_cache(maxsize=1 << 16)
def _words(a: str, b: str) -> float:
    return words(a, b)


@lru_cache(maxsize=1 << 16)
def _all(a: str, b: str) -> tuple[float, float, float]:
    return words(a, b), ratio(a, b), weighted(a, b)


def _udf(score: Callable[[str, str], float]):
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
        codes, distinct = pairs.factorize()
        return pd.Series([score(*p) for p in distinct], dtype=float).take(codes).reset_index(drop=True)

    return of


def char_similarity(a: Column, b: Column) -> Column:
    return _udf(ratio)(a, b)


def word_similarity(a: Column, b: Column) -> Column:
    return _udf(_words)(a, b)


def weighted_similarity(a: Column, b: Column) -> Column:
    return _udf(weighted)(a, b)


def similarities(a: Column, b: Column) -> Column:
    """Words, characters and weighted: all three in one pass through Python."""

    @F.pandas_udf("words double, characters double, weighted double")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")]).factorize()
        found = pd.DataFrame([_all(*p) for p in distinct], columns=["words", "characters", "weighted"], dtype=float)
        return found.take(codes).reset_index(drop=True)

    return of(a, b)
