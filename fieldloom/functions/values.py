"""Column helpers for loosely filled records: blanks count as missing, columns may be absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first of several texts that is not blank."""
    return F.coalesce(*[filled(c) for c in columns])


def select_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns with their types (name -> type); those that df lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def fill_blanks(df: DataFrame, other: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """df with blank columns taken from the row of `other` that has the same key."""
    more = other.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(more, key, "left")
    return joined.select(*[F.coalesce(filled(F.col(c)), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def round_even(c: Column, digits: int = 0) -> Column:
    """Rounds halves to even."""
    return F.bround(c, digits)


def distinct_names(names: Column) -> Column:
    """The names of an array in order, of names alike but for case and surrounding space the first; blank and null ones are left out."""
    some = F.filter(F.transform(names, strip), lambda n: n.isNotNull() & (n != ""))
    keys = F.array_distinct(F.transform(some, lambda n: F.lower(n)))
    return F.transform(keys, lambda k: F.element_at(F.filter(some, lambda n: F.lower(n) == k), 1))


def without_confidence(c: Column) -> tuple[Column, Column]:
    """A reply before its tag [CONFIDENCE: HIGH, MEDIUM or LOW], without reasoning blocks, and whether it is sure: HIGH, or no tag."""
    tag = r"(?i)\[CONFIDENCE:\s*(HIGH|MEDIUM|LOW)\]"
    bare = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    return F.regexp_replace(bare, rf"(?s)\s*{tag}.*$", ""), ~bare.rlike(tag) | (F.upper(F.regexp_extract(bare, tag, 1)) == "HIGH")
