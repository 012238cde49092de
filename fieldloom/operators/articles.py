"""Articles kept as append-only versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.values import filled


def versions(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Every update as the next version of its article."""
    return updates.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(seq)))


def current(history: DataFrame, key: str) -> DataFrame:
    """The latest version of each article."""
    columns = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*columns), "version").alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in columns])


def rollback(history: DataFrame, key: str, to: DataFrame) -> DataFrame:
    """The history with, for each (key, to_version), the body of that version appended as a new one."""
    last = history.groupBy(key).agg(F.max("version").alias("__last"))
    back = history.join(to, key).where(F.col("version") == F.col("to_version")).join(last, key)
    back = back.withColumn("version", (F.col("__last") + 1).cast("int")).select(*history.columns)
    return history.unionByName(back)


def fold(rows: DataFrame, key: str, seq: str, scalars: Sequence[str] = (), lists: Sequence[str] = (), longest: Sequence[str] = ()) -> DataFrame:
    """Rows of an article as one: the first filled value of scalars, distinct values of lists in the order first seen, and the longest
    text (the first of equals)."""
    seen = rows.groupBy(key).agg(
        *[F.min_by(filled(F.col(c).cast("string")), F.when(filled(F.col(c).cast("string")).isNotNull(), F.col(seq))).alias(c) for c in scalars],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.length(c), -F.col(seq)))).alias(c) for c in longest],
    ) if scalars or longest else rows.select(key).distinct()
    for c in lists:
        first = rows.where(filled(F.col(c).cast("string")).isNotNull()).groupBy(key, c).agg(F.min(seq).alias("__s"))
        joined = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__s"), F.col(c).alias("v")))).alias("__l")).select(key, F.col("__l.v").alias(c))
        seen = seen.join(joined, key, "left")
    return seen


def unique_items(rows: DataFrame, key: str, seq: str, by: Column, item: Sequence[str], most: int | None = None, keep_blank: bool = False) -> DataFrame:
    """key and items: of the rows of an article whose `by` is equal the first, in the order of seq (equal ones by item), the last `most`
    of them. Rows whose `by` is null or blank are left out, or all kept with keep_blank. With `most`, rows are cut before they are
    collected."""
    own = rows.select(key, F.col(seq).alias("__seq"), filled(by.cast("string")).alias("__by"), F.struct(*item).alias("__item"))
    one = own.where("__by is not null").groupBy(key, "__by").agg(F.min(F.struct("__seq", "__item")).alias("r")).select(key, "r.*")
    if keep_blank:
        one = one.unionByName(own.where("__by is null").select(key, "__seq", "__item"))
    if most is not None:
        late = Window.partitionBy(key).orderBy(F.desc("__seq"), F.desc("__item"))
        one = one.withColumn("__n", F.row_number().over(late)).where(F.col("__n") <= most)
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__seq", "__item"))).alias("l")).select(key, F.col("l.__item").alias("items"))


def union_lists(a: Column, b: Column) -> Column:
    """The elements of both lists in order, each once."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def richer(a: Column, b: Column) -> Column:
    """The longer text, the first of equals."""
    return F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)


def replace_by(store: DataFrame, new: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """The store with a source's rows replaced by its new ones; without a source nothing is deleted."""
    gone = new.where(filled(F.col(source)).isNotNull()).select(*keys).distinct()
    return store.join(gone, list(keys), "left_anti").unionByName(new)
