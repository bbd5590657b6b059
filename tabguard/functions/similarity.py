"""Similarity of texts by longest matching blocks; batches go through Arrow."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: dict, b: dict) -> int:
    if len(b) < len(a):
        a, b = b, a
    get = b.get
    return sum(min(n, get(k, 0)) for k, n in a.items())


class _Matcher:
    """Ratios of pairs; those that the pieces in common already rule out are 0."""

    def __init__(self, least: float):
        self.least, self.known, self.letters, self.pairs = least, {}, {}, {}

    def __call__(self, a: str, b: str) -> float:
        found = self.known.get((a, b))
        if found is None:
            found = self.known[a, b] = 0.0 if self.least > 0 and a and b and self._apart(a, b) else SequenceMatcher(None, a, b).ratio()
        return found

    def _apart(self, a: str, b: str) -> bool:
        """A ratio t of n characters needs t n / 2 in common, in 1 + (1 - t) n blocks at most, so as many pairs of neighbours less."""
        n = len(a) + len(b)
        pairs = self.least * n / 2 - 1 - (1 - self.least) * n
        if pairs > 0 and _common(self._pairs(a), self._pairs(b)) < pairs - 1e-9:
            return True
        return _common(self._letters(a), self._letters(b)) < self.least * n / 2 - 1e-9

    def _letters(self, x: str) -> dict:
        if x not in self.letters:
            self.letters[x] = Counter(x)
        return self.letters[x]

    def _pairs(self, x: str) -> dict:
        if x not in self.pairs:
            self.pairs[x] = Counter(map(add, x, x[1:]))
        return self.pairs[x]


def ratio(a: Column, b: Column, least: float = 0) -> Column:
    """2 * matches / total length, in the blocks of difflib; the order of the arguments matters.

    What is certainly below least may come out as 0.
    """

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        match = _Matcher(least)
        return pd.Series([None if a is None or b is None else match(a, b) for a, b in zip(x, y)], dtype="float64")

    return run(a, b)


def length_bound(a: Column, b: Column) -> Column:
    """An upper bound of ratio() from the lengths alone, to filter by first."""
    least, total = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * least / total)


def normalised(name: Column) -> Column:
    """Lower case; anything but word characters and spaces becomes a space; single spaces."""
    text = F.regexp_replace(F.lower(name.cast("string")), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def name_similarity(a: Column, b: Column, least: float = 0) -> Column:
    """0 to 100 with two decimals; 0 if a side is empty. What is certainly below least may come out as 0."""
    x, y = normalised(F.coalesce(a, F.lit(""))), normalised(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.round(100 * ratio(x, y, (least - 0.01) / 100), 2))
