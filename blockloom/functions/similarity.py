"""Sequence similarity: twice the matched characters over the total length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def within_length_bound(a: Column, b: Column, threshold: float) -> Column:
    """False only if the two lengths alone rule out a ratio above the threshold."""
    return F.lit(2.0) * F.least(a, b) > F.lit(threshold) * (a + b)


class Comparer:
    """Ratios against one second sequence, whose index is built once."""

    def __init__(self, second: str, threshold: float, autojunk: bool):
        from difflib import SequenceMatcher

        self.second, self.threshold = second, threshold
        self.matcher = SequenceMatcher(None, "", second, autojunk)
        self.places: dict[str, int] = {}
        for i, char in enumerate(second):
            self.places[char] = self.places.get(char, 0) | (1 << i)

    def common(self, first: str) -> int:
        """Length of the longest common subsequence, a machine word of columns at a time."""
        full = (1 << len(self.second)) - 1
        row = full
        for char in first:
            hit = row & self.places.get(char, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(self.second) - row.bit_count()

    def above(self, first: str) -> bool:
        """Whether the ratio is above the threshold. Matched blocks form a common subsequence, which bounds them."""
        need = self.threshold * (len(first) + len(self.second))
        if first == self.second:
            return 2.0 * len(first) > need or not first
        if 2.0 * self.common(first) <= need:
            return False
        self.matcher.set_seq1(first)
        return self.matcher.ratio() > self.threshold


def any_above(threshold: float = 0.8, autojunk: bool = True):
    """Pandas UDF (firsts, seconds) -> whether any first has a ratio above the threshold with any second.

    Both are arrays; the comparison is not symmetric. Null arrays compare with nothing.
    """

    def flags(firsts: pd.Series, seconds: pd.Series) -> pd.Series:
        from functools import lru_cache

        @lru_cache(maxsize=512)
        def comparer(second: str) -> Comparer:
            return Comparer(second, threshold, autojunk)

        def found(these, those) -> bool:
            if these is None or those is None:
                return False
            return any(comparer(b).above(a) for b in those for a in these)

        return pd.Series([found(*row) for row in zip(firsts, seconds)], dtype=bool)

    return F.pandas_udf(flags, "boolean")
