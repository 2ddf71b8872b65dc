"""M8: Ratcliff-Obershelp similarity, the one measure Spark has no built-in for."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Second texts of this length and more have popular letters set aside by the measure's definition.
POPULAR_FROM = 200
#: Pairs that are measured together; they are sorted by length, so their tables have little padding.
TOGETHER = 4_096


def _letters(texts: list[str], width: int, padding: int) -> np.ndarray:
    """Code points, one row per text, padded by a number that no letter has."""
    codes = np.array(texts, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.where(np.arange(codes.shape[1]) < lengths[:, None], codes, np.uint32(padding))


def matched_letters(first: list[str], second: list[str]) -> np.ndarray:
    """Letters in the matching blocks of each pair: the longest common block, then the same left and right of it.

    Of equally long blocks the one that begins first in ``first`` counts, then first in ``second``. The open
    stretches of all pairs are searched side by side, one letter of the first text at a time.
    """
    n1, n2 = (np.fromiter(map(len, x), np.int64, len(x)) for x in (first, second))
    a = _letters(first, int(n1.max(initial=0)), 0x110001)
    b = _letters(second, int(n2.max(initial=0)), 0x110002)
    total = np.zeros(len(first), np.int64)
    pair, a_from, a_to, b_from, b_to = np.arange(len(first)), np.zeros_like(n1), n1, np.zeros_like(n2), n2
    while True:
        open_ = (a_from < a_to) & (b_from < b_to)
        pair, a_from, a_to, b_from, b_to = (x[open_] for x in (pair, a_from, a_to, b_from, b_to))
        if not len(pair):
            return total
        wide = np.arange(int((b_to - b_from).max()))
        place = b_from[:, None] + wide
        inside = np.where(place < b_to[:, None], b[pair[:, None], np.minimum(place, b.shape[1] - 1)], np.uint32(0x110002))
        ending = np.zeros((len(pair), len(wide) + 1), np.int16)
        best, a_end, b_end = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(int((a_to - a_from).max())):
            at = a_from + i
            letter = np.where(at < a_to, a[pair, np.minimum(at, a.shape[1] - 1)], np.uint32(0x110001))
            ending[:, 1:] = np.where(inside == letter[:, None], ending[:, :-1] + 1, 0)
            longest = ending.max(1)
            better = np.flatnonzero(longest > best)
            best[better], a_end[better], b_end[better] = longest[better], i + 1, ending[better].argmax(1)
        np.add.at(total, pair, best)
        hit = best > 0
        pair, a_from, a_to, b_from, b_to, best, a_end, b_end = (x[hit] for x in (pair, a_from, a_to, b_from, b_to, best, a_end, b_end))
        a_end, b_end = a_from + a_end, b_from + b_end
        pair = np.concatenate([pair, pair])
        a_from, a_to = np.concatenate([a_from, a_end]), np.concatenate([a_end - best, a_to])
        b_from, b_to = np.concatenate([b_from, b_end]), np.concatenate([b_end - best, b_to])


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Twice the matched letters over all letters; two empty texts are equal."""
    out = np.ones(len(pairs))
    sizes = np.fromiter((len(x) + len(y) for x, y in pairs), np.int64, len(pairs))
    plain = np.fromiter((len(y) < POPULAR_FROM and len(x) < 1 << 15 for x, y in pairs), np.bool_, len(pairs))
    for i in np.flatnonzero(~plain):
        out[i] = SequenceMatcher(None, *pairs[i]).ratio()
    order = np.flatnonzero(plain & (sizes > 0))
    order = order[np.argsort(sizes[order], kind="stable")]
    for k in range(0, len(order), TOGETHER):
        own = order[k:k + TOGETHER]
        out[own] = 2.0 * matched_letters(*map(list, zip(*(pairs[i] for i in own), strict=True))) / sizes[own]
    return out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Argument order matters; each distinct pair of a batch is measured once, nulls stay null."""
    pairs = list(zip(first, second))
    distinct = [p for p in dict.fromkeys(pairs) if p[0] is not None and p[1] is not None]
    known = dict(zip(distinct, ratios(distinct), strict=True))
    return pd.Series([known.get(p) for p in pairs], index=first.index, dtype="float64")


# Not for its result: this keeps the optimizer from copying the call into filters.
sequence_ratio = sequence_ratio.asNondeterministic()
