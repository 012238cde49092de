"""Records on their way into the store: normalising, validating, overlays, review staging and commits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.names import is_placeholder
from fieldloom.functions.values import filled, first_filled
from fieldloom.operators.dedup import first_of_each

TYPES = ("Primary", "Secondary", "Uncertain")


def normalise(df: DataFrame, aliases: Mapping[str, Sequence[str]], longest: Mapping[str, int], required: str) -> DataFrame:
    """Each target column from the first filled of its aliases, cut to its longest size; rows without `required` are left out."""
    have = set(df.columns)
    out = df
    for target, names in aliases.items():
        some = [F.col(n).cast("string") for n in names if n in have]
        value = first_filled(*some) if some else F.lit(None).cast("string")
        out = out.withColumn(f"__{target}", F.substring(value, 1, longest[target]) if target in longest else value)
    keep = [c for c in df.columns if not any(c in names for names in aliases.values())]
    return out.select(*keep, *[F.col(f"__{t}").alias(t) for t in aliases]).where(F.col(required).isNotNull())


def record_type(c: Column) -> Column:
    """A known type, whatever its case, else Uncertain."""
    named = F.initcap(F.trim(c))
    return F.when(named.isin(*TYPES), named).otherwise("Uncertain")


def validated(name: Column, place: Column, confidence: Column, suspicious: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Confidence and flags: none without a name, half at most without a place, .4 at most for a suspicious one; coordinates out of
    range are flagged."""
    no_name, no_place = filled(name).isNull(), filled(place).isNull()
    score = F.when(no_name, 0.0).when(no_place, F.least(confidence, F.lit(0.5))).when(suspicious, F.least(confidence, F.lit(0.4))).otherwise(confidence)
    flags = F.array_compact(F.array(
        F.when(no_name, "no_name"), F.when(no_place, "no_place"), F.when(suspicious, "suspicious_place"), F.when(~lat.between(-90, 90), "latitude_range"), F.when(~lon.between(-180, 180), "longitude_range"),
    ))
    return score, flags


def drop_placeholders(df: DataFrame, name: str) -> DataFrame:
    return df.where(~is_placeholder(F.col(name)))


def stamp_citation(c: Column, title: Column, document: Column) -> Column:
    """The document's citation where the record's is blank, equals the title, is a file name or is short, if the former is long."""
    poor = filled(c).isNull() | (F.trim(c) == F.trim(title)) | c.rlike(r"(?i)\.(pdf|txt|md|docx?)$") | (F.length(c) < 20)
    return F.when(F.coalesce(poor, F.lit(True)) & (F.length(document) > 20), document).otherwise(c)


def overlay(df: DataFrame, patch: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """df with the patch's non-null values in place of its own, and without deleted keys. Tables of files take no UPDATE; the
    result is written as the next version."""
    columns = [c for c in patch.columns if c != key]
    more = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(more, key, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    return out if deleted is None else out.join(deleted.select(key), key, "left_anti")


def stage(batch: DataFrame, staged: DataFrame, name: str, place: str, seq: str, confidence: Column) -> DataFrame:
    """The rows of a batch to be reviewed: no placeholders, none already staged (and not committed), the first of equals."""
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    new = batch.where(~is_placeholder(F.col(name))).withColumn("__n", key(name)).withColumn("__p", key(place))
    open_ = staged.where("status <> 'committed'").select(key(name).alias("__n"), key(place).alias("__p"))
    new = first_of_each(new.join(open_, ["__n", "__p"], "left_anti"), ["__n", "__p"], seq)
    return new.drop("__n", "__p").withColumn("status", F.lit("pending")).withColumn("confidence", F.coalesce(confidence, F.lit(0.0)))


def commit(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that go to the main table, and the staging table after: verified and edited rows are committed."""
    ready = F.col("status").isin("verified", "edited")
    return staged.where(ready).withColumn("status", F.lit("verified")), staged.withColumn("status", F.when(ready, "committed").otherwise(F.col("status")))


def merge_text(old: Column, new: Column) -> Column:
    """A section after new text: blank takes it, one that holds it stays, else it follows after an empty line."""
    return F.when(filled(old).isNull(), new).when(filled(new).isNull() | F.contains(old, F.trim(new)), old).otherwise(F.concat(old, F.lit("\n\n"), new))


def new_by_hash(df: DataFrame, seen: DataFrame, content: str, hash_column: str = "content_hash") -> DataFrame:
    """Rows whose content hash has not been seen."""
    return df.withColumn(hash_column, F.substring(F.sha1(F.coalesce(F.col(content), F.lit(""))), 1, 16)).join(seen.select(hash_column), hash_column, "left_anti")
