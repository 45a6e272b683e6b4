"""Partial ratio: the best window's normalised indel similarity, 0 to 100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters of a name that fit one lane.
LANE = 64
#: Texts that share one pass over their windows.
CHUNK = 4096


def _common(bits: dict[str, int], n: int, window: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    row = full = (1 << n) - 1
    for char in window:
        match = row & bits.get(char, 0)
        row = ((row + match) | (row - match)) & full
    return n - row.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / lengths of the best window of the longer string: all of the shorter one's length, and cut-off ones at both ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n:
        return 0.0
    if n == m:
        return max(_best(short, long), _best(long, short))
    return _best(short, long)


def _best(short: str, long: str) -> float:
    n, m = len(short), len(long)
    bits: dict[str, int] = {}
    for i, char in enumerate(short):
        bits[char] = bits.get(char, 0) | 1 << i
    windows = {long[max(0, end - n) : end] for end in range(1, m + 1)} | {long[a:] for a in range(max(0, m - n), m)}
    best = 0.0
    for window in sorted(windows, key=len, reverse=True):
        # no window can beat 2 * its length
        if 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, 200.0 * _common(bits, n, window) / (n + len(window)))
    return best


def partial_ratios(name: str, texts: list[str]) -> np.ndarray:
    """partial_ratio of a name with each text.

    A name of up to 64 characters meets all windows of all longer texts at once: a window is a lane of 64-bit rows.  Between
    texts lie places that match nothing, so windows cut off at a text's ends are lanes like any other.
    """
    out = np.zeros(len(texts))
    n = len(name)
    laned = [i for i, t in enumerate(texts) if 0 < n <= LANE and len(t) > n]
    for i in set(range(len(texts))).difference(laned):
        out[i] = partial_ratio(name, texts[i])
    if not laned:
        return out
    sizes = np.array([len(texts[i]) for i in laned])
    codes = np.frombuffer("".join(texts[i] for i in laned).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, place = np.unique(codes, return_inverse=True)
    places = [sum(1 << i for i, c in enumerate(name) if ord(c) == code) for code in found.tolist()]
    lanes = sizes + n - 1
    first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
    matches = np.zeros(lanes.sum() + n - 1, np.uint64)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    matches[np.repeat(first, sizes) + n - 1 + within] = np.array(places, np.uint64)[place]

    full = np.uint64((1 << n) - 1)
    row = np.full(lanes.sum(), full)
    for step in range(n):
        match = row & matches[step : step + len(row)]
        row = ((row + match) | (row - match)) & full
    start = np.arange(len(row)) - np.repeat(first, lanes) - (n - 1)
    width = np.minimum(np.repeat(sizes, lanes), start + n) - np.maximum(start, 0)
    out[laned] = np.maximum.reduceat(200.0 * (n - np.bitwise_count(row).astype(np.int64)) / (n + width), first)
    return out


@F.pandas_udf(DoubleType())
def _ratio(names: pd.Series, texts: pd.Series) -> pd.Series:
    out = np.full(len(names), np.nan)
    for name, rows in names.groupby(names).indices.items():
        code, known = pd.factorize(texts.iloc[rows].fillna(""))
        known = known.tolist()
        ratios = np.concatenate([partial_ratios(name, known[a : a + CHUNK]) for a in range(0, len(known), CHUNK)])
        out[rows] = ratios[code]
    return pd.Series(out)


def partial_ratio_column(name: Column, text: Column) -> Column:
    """0 to 100; null where there is no name."""
    return _ratio(name, text)


def levenshtein_ratio(name: Column, text: Column) -> Column:
    """An all-SQL stand-in: the best edit similarity of the name to windows of its length in the text, 0 to 100."""
    n = F.length(name)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    distance = F.array_min(F.transform(starts, lambda i: F.levenshtein(name, F.substr(text, i, n))))
    return F.when(n > 0, F.lit(100.0) * (F.lit(1.0) - distance / F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0))


def pieces(name: Column, least: float) -> Column:
    """The name cut so that an edit similarity of ``least`` to a window leaves one piece as it is: one more than there may be edits."""
    n = F.length(name)
    cuts = F.floor(n * F.lit(1 - least / 100) + 1e-9).cast("int") + 1
    place = lambda i: F.floor(i * n / cuts).cast("int")
    return F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substr(name, place(i) + 1, place(i + 1) - place(i)))
