"""Similarity of short texts by what stands in both in the same order: twice the longest common subsequence over both lengths."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a column of the table at a time as bits of one whole number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def aligned(a: str, b: str) -> float:
    """2 L / (n + m), 1 for two empty texts."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def in_order(text: str) -> str:
    """The words of a text, parted by white space, in order of code points, with one space between."""
    return " ".join(sorted(text.split()))


def by_words(a: str, b: str) -> float:
    """aligned, of the words in order."""
    return aligned(in_order(a), in_order(b))


def by_word_sets(a: str, b: str) -> float:
    """1 if the words of one are all in the other; else the best of aligned over the shared words alone, and with each text's own ones."""
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    if not (x and y):
        return 0.0
    one, other = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [aligned(one, other)]
    if both:
        found += [aligned(both, one), aligned(both, other)]
    return max(found)


def _column(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    def apply(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if s is None or t is None else f(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

        return run(a, b)

    return apply


#: The same of columns, in Arrow batches; null where one text is.
ratio, word_ratio, word_set_ratio = _column(aligned), _column(by_words), _column(by_word_sets)


def words_in_order(c: Column) -> Column:
    """in_order of a column, for texts whose white space is that of ASCII."""
    return F.array_join(F.array_sort(F.filter(F.split(c, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")), " ")
