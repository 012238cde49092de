"""Joins of names that are alike, as equi-joins on the few rarest parts that two such names must share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.similarity import ratio


def _numbered(pieces: Column) -> Column:
    """Pieces with their number among equal ones before, so that a repeated piece counts as often as it occurs."""
    return F.transform(pieces, lambda p, i: F.concat(p, F.lit("\x00"), F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda o: o == p)).cast("string")))


def _grams(key: Column, size: int) -> Column:
    return F.when(F.length(key) >= size, F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda i: F.substring(key, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _shared(n: Column, size: int, least: float) -> Column:
    """Pieces that a key of n characters shares at least with any key at a ratio of least.

    With L common characters, 2 L >= least * (n + m), and m >= n * least / (2 - least). Single characters shared are L at least. Each
    character of one key that the other lacks breaks two pairs of characters, each that it gains one at most: L * 3 - n - m - 1.
    """
    both = n * (1 + least / (2 - least))
    return F.ceil(both * least / 2 - 1e-9) if size == 1 else F.ceil(both * (1.5 * least - 1) - 1 - 1e-9)


def similar(queries: DataFrame, names: DataFrame, query: str, name: str, least: float) -> DataFrame:
    """Pairs of a distinct query and a distinct name whose ratio (similarity.aligned) is least or more: q, n and score.

    Null and empty texts pair with none; least is over a half. Every key is cut into single characters and pairs of them; of these, as
    many of the rarest as must hold one that both share go into the join, pairs of characters where the query is long enough for that
    to be certain. Candidates are then compared exactly; none is left out, and no pair meets that shares no rare part.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5 and at most 1")
    q = queries.select(F.col(query).alias("q")).where("q <> ''").distinct()
    d = names.select(F.col(name).alias("n")).where("n <> ''").distinct()

    def cut(df: DataFrame, key: str, size: int) -> DataFrame:
        return df.select(key, F.lit(size).alias("size"), F.explode(_numbered(_grams(F.col(key), size))).alias("piece"))

    sizes = (1, 2) if least > 2 / 3 else (1,)
    by_pairs = _shared(F.length("q"), 2, least) >= 1 if 2 in sizes else F.lit(False)
    asked = cut(q.where(~by_pairs), "q", 1)
    held = cut(d, "n", 1)
    if 2 in sizes:
        asked = asked.unionByName(cut(q.where(by_pairs), "q", 2))
        held = held.unionByName(cut(d, "n", 2))
    often = held.groupBy("size", "piece").agg(F.count("*").alias("often"))

    def rarest(df: DataFrame, key: str) -> DataFrame:
        n = F.length(key)
        must = F.greatest(F.lit(1), F.when(F.col("size") == 1, _shared(n, 1, least)).otherwise(_shared(n, 2, least)))
        of_key = df.join(often, ["size", "piece"], "left").groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "piece"))).alias("pieces"))
        return of_key.select(key, "size", F.explode(F.slice("pieces", F.lit(1), F.greatest(F.lit(1), F.size("pieces") - must + 1).cast("int"))["piece"]).alias("piece"))

    met = rarest(asked, "q").join(rarest(held, "n"), ["size", "piece"]).select("q", "n")
    met = met.where(2 * F.least(F.length("q"), F.length("n")) >= least * (F.length("q") + F.length("n")) - 1e-9).distinct()
    return met.withColumn("score", ratio(F.col("q"), F.col("n"))).where(F.col("score") >= least - 1e-12)


def most_similar(queries: DataFrame, names: DataFrame, query: str, name: str, least: float) -> DataFrame:
    """For each distinct query that has a similar name the one of highest score, the smallest of equal ones: q, n and score."""
    best = similar(queries, names, query, name, least).groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "n")).alias("b"))
    return best.select("q", F.col("b.n").alias("n"), (-F.col("b.s")).alias("score"))
