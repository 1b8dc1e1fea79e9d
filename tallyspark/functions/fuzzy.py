"""Partial similarity of a heading and a keyword: the only Python code on the default path. It runs on the few
heading texts of a document's columns, never on tokens, and a worker scores a text once for all documents."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heading texts and needles whose scores and bit masks a worker remembers.
MEMO = 1 << 16


@lru_cache(MEMO)
def _masks(needle: str) -> dict[str, int]:
    """The places of each character, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(needle):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a whole row of the table at once as bits."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        if hit := masks.get(c, 0) & row:
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _best(needle: str, text: str) -> float:
    n = len(needle)
    spans = [text[max(i, 0) : i + n] for i in range(1 - n, len(text))]
    return max((200.0 * common_length(needle, w) / (n + len(w)) for w in dict.fromkeys(spans) if w), default=0.0)


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: how well the shorter text fits the best window of the longer, windows over an end included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_best(a, b), _best(b, a))
    return _best(a, b) if len(a) < len(b) else _best(b, a)


def most(a: str, b: str) -> float:
    """What partial_ratio() can be at most, by the characters that both have: a window of no others would fit best."""
    shared = (Counter(a) & Counter(b)).total()
    return 200.0 * shared / (min(len(a), len(b)) + shared) if shared else 0.0


@lru_cache(MEMO)
def _scores(text: str, keywords: tuple[tuple[str, ...], ...], least: float) -> list[float]:
    return [max(partial_ratio(text, k) if most(text, k) >= least else 0.0 for k in words) for words in keywords]


def role_scores(texts: Column, vocabulary: dict[str, tuple[str, ...]], roles: tuple[str, ...], least: float) -> Column:
    """For each of a document's texts the best score of each role's keywords, as an array in the order of roles; null for
    a null or empty text. A keyword that can't reach least counts as 0."""
    keywords = tuple(tuple(k.lower() for k in vocabulary[r]) for r in roles)

    @F.pandas_udf("array<array<double>>")
    def scores(docs: pd.Series) -> pd.Series:
        return docs.map(lambda held: [_scores(t, keywords, least) if t else None for t in held], na_action="ignore")

    # declared as not deterministic, so that no optimiser rule moves it into a lambda, where it couldn't be evaluated
    return scores.asNondeterministic()(texts)
