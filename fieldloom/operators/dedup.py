"""Deduplication, suppression and conflicts over records in a given order (column seq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How records of each type rank (fixed values); unknown types come last.
TYPE_PRIORITY = {"primary": 0, "secondary": 1, "uncertain": 2, "": 3}


def type_priority(c: Column) -> Column:
    out = None
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for name, rank in TYPE_PRIORITY.items():
        out = F.when(low == name, rank) if out is None else out.when(low == name, rank)
    return out.otherwise(3)


def best_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; row_number = 1 lets Spark drop all but that row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def priority_dedup(df: DataFrame, keys: Sequence[str], priority: Column, evidence: Column, seq: str = "seq") -> DataFrame:
    """One row for each key: of lowest priority number, then longest evidence, then first seen; with first_seq, the place of the
    key's first row, by which the result was ordered when it was read one by one. A null key is a key like any other, a null evidence
    is empty; an empty table gives an empty result. One aggregation, with partial ones before the shuffle."""
    rank = F.struct(priority.alias("priority"), (-F.length(F.coalesce(evidence, F.lit("")))).alias("longest"), F.col(seq).alias("seq"))
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min_by(row, rank).alias("__row"), F.min(seq).alias("first_seq"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns], "first_seq")


def first_of_each(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The first row of each key."""
    return best_of_each(df, keys, [F.col(seq).asc()])


def suppress_general(df: DataFrame, name: str, general: Column) -> DataFrame:
    """Without rows at a general place (or none) whose name also has a specific one."""
    flagged = df.withColumn("__general", F.coalesce(general, F.lit(True)))
    known = flagged.where(~F.col("__general")).select(name).distinct()
    kept = flagged.where("__general").join(known, name, "left_anti")
    return flagged.where(~F.col("__general")).unionByName(kept).drop("__general")


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of two or more rows that give more than one value, with the values in order."""
    values = F.sort_array(F.collect_set(F.lower(F.col(value))))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), values.alias("values")).where((F.col("n") >= 2) & (F.size("values") > 1))


def stated_count(text: Column, pattern: str, most: int = 5000) -> Column:
    """The largest number that a pattern captures in a text, between 1 and `most`, both left out; null if none."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_max(F.filter(numbers, lambda x: (x > 1) & (x < most)))
