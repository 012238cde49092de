"""Scans, filters and counts over records, as a view or a batch job asks for them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.values import filled, select_or_null


def latest(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Rows from the latest to the first (null last), all of them, range-sorted, or the latest n as a report."""
    out = df.orderBy(F.desc_nulls_last(by))
    return out if n is None else out.limit(n)


def live(df: DataFrame, status: str, rejected: str = "rejected", keep_null: bool = True) -> DataFrame:
    """Rows that are not rejected; a null status stays, or with keep_null off drops out, as by a bare comparison."""
    other = F.col(status) != rejected
    return df.where(other | F.col(status).isNull() if keep_null else other)


def of_key(df: DataFrame, key: str, value: object, columns: Mapping[str, str], defaults: Mapping[str, object], by: str | None = None, most: int | None = None) -> DataFrame:
    """Rows of one key with the given columns (name to type; missing ones null) and defaults for nulls, the first `most` by `by`."""
    rows = select_or_null(df.where(F.col(key) == value), dict(columns)).na.fill(dict(defaults))
    return rows.orderBy(by).limit(most) if most is not None else rows


def first_rows(df: DataFrame, key: str, condition: Column, by: str) -> DataFrame:
    """The first row (by `by`) of each key that fulfils a condition; a null key is a key like any other."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.where(condition).groupBy(key).agg(F.min_by(row, by).alias("r")).select(key, "r.*")


def hierarchy(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The distinct paths of a hierarchy, blanks for nulls."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels]).distinct()


def without_place(df: DataFrame, lat: str, lon: str, place: str, status: str, keep_null: bool = True) -> DataFrame:
    """Live rows that name a place but lack a coordinate: those that a geocoder can fill."""
    return live(df.where((F.col(lat).isNull() | F.col(lon).isNull()) & filled(F.col(place)).isNotNull()), status, keep_null=keep_null)


def chosen(df: DataFrame, choices: Mapping[str, Sequence[object]]) -> DataFrame:
    """Rows within the choices of each column; empty choices and missing columns do not filter."""
    for column, some in choices.items():
        if some and column in df.columns:
            df = df.where(F.col(column).isin(*some))
    return df


def containing(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """Rows of which any of the columns matches a pattern, whatever the case; null is no match."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(hit)


def primary_only(df: DataFrame, kind: str, wanted: str = "primary") -> DataFrame:
    """Rows of one type, whatever its case and surrounding space; null is none."""
    return df.where(F.lower(F.trim(F.col(kind))) == wanted)


def gated(df: DataFrame, key: str, mark: Column, most: int) -> DataFrame:
    """Rows with a mark, and all rows of groups of at most `most`."""
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    return df.join(n, F.col(key).eqNullSafe(F.col("__k"))).where(F.coalesce(mark, F.lit(False)) | (F.col("__n") <= most)).drop("__k", "__n")


def statistics(df: DataFrame, key: str, distinct: Sequence[str], filled_columns: Sequence[str]) -> DataFrame:
    """For each key n, the distinct values of columns (n_x; nulls do not count), and the share of rows, in percent with one digit, in
    which a column is filled (pct_x)."""
    share = lambda c: F.bround(100 * F.count_if(filled(F.col(c).cast("string")).isNotNull()) / F.count("*"), 1)
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct], *[share(c).alias(f"pct_{c}") for c in filled_columns])


def most_confirmed(atoms: DataFrame, times: str, key: str, confidence: str | None = None, k: int = 10) -> DataFrame:
    """The k atoms confirmed most often, ties by confidence, then key."""
    order = [F.desc(times), *([F.desc(confidence)] if confidence else []), F.col(key)]
    return atoms.orderBy(*order).limit(k)


def last_stages(df: DataFrame, key: str, stage: str, order: Column) -> DataFrame:
    """stage and n: the last stage that each key has reached, counted."""
    return df.groupBy(key).agg(F.max_by(stage, order).alias(stage)).groupBy(stage).agg(F.count("*").alias("n"))


def co_occurring(pairs: DataFrame, name: str, least: float = 1.0) -> DataFrame:
    """other and weight: what occurs with a name (a, b, weight), from a least weight, the heaviest first, ties by name."""
    both = pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")).toDF("own", "other", "weight")
    return both.where((F.col("own") == name) & (F.col("weight") >= least)).orderBy(F.desc("weight"), "other").select("other", "weight")


def abbreviated(text: Column) -> Column:
    """Names with an abbreviated genus in a text, in order, once each, with the genus of the first full name that begins with its
    letter: an array of (given, name), name null where no full name does."""
    genera = F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}])([A-Z][a-z]{2,}) [a-z]{4,}"), F.lit(1))
    short = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}.])([A-Z]\. ?[a-z]{3,})"), F.lit(1)))
    genus = lambda s: F.try_element_at(F.filter(genera, lambda g: F.substring(g, 1, 1) == F.substring(s, 1, 1)), F.lit(1))
    return F.transform(short, lambda s: F.struct(s.alias("given"), F.concat(genus(s), F.lit(" "), F.regexp_replace(s, r"^[A-Z]\. ?", "")).alias("name")))


def first_by_canonical(df: DataFrame, doc: str, name: str, canonical: Column, seq: str, blocked: Sequence[str] = ()) -> DataFrame:
    """Of each document the first row of each canonical name, without names whose first word is blocked."""
    genus = F.lower(F.split(F.col(name), " ")[0])
    some = df.where(~genus.isin(*[b.lower() for b in blocked])) if blocked else df
    w = Window.partitionBy(doc, "__canon").orderBy(seq)
    return some.withColumn("__canon", canonical).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__canon")
