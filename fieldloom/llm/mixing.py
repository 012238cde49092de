"""Mixing sources to target weights by a time-varying curriculum: schedules are integrated, cumulative token demand is inverted
to training positions, and documents are range-sorted by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._spark import written

#: Documents of one fine bucket, about, and fine buckets of one coarse bucket: no window holds more rows than that.
FINE, COARSE = 128, 4096
#: Words: runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def position(share: Column, slope: Column) -> Column:
    """When the given share of a source's demand is reached, 0 to 1, if its weight is 1 + slope * (2t - 1) at time t.

    The weight's integral is t + slope * (t² - t); this is its inverse.
    """
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, share).otherwise(root + 0.0)  # no negative zero


def targets(sizes: DataFrame, weights: tuple[int, ...], slopes: tuple[float, ...], most: int) -> DataFrame:
    """sizes (key, source, docs, source_size), one row for each source, with weight, slope and target.

    Sources take the weights in turn by code point, null last, and share the sum of all sizes by them. A target stops at `most`
    times its source's size; what is above is shared again among the others. Sorted by size for weight, the sources that stop
    are those that stop at the share left to them and all after them. One row a source goes through one task.
    """
    n = len(weights)
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % n
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), turn + 1)
    s = sizes.withColumn("weight", pick(weights, "int")).withColumn("slope", pick(slopes, "double")).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    left, rest = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("stops", F.col("cap") / F.col("weight") <= left / rest)
    free = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(everything)
    free_weights = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(everything)
    s = s.withColumn("free", free).withColumn("free_weights", free_weights)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise((F.col("free") * F.col("weight")).cast("double") / F.col("free_weights"))
    return s.select("key", "docs", "source_size", "weight", "slope", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5),
    most: int = 3,
    keep: tuple[str, ...] = ("doc_id", "source"),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The columns keep, size (words), source_size, target (of the source), copies, taken (size * copies) and positions, the
    training positions of the copies, range-sorted by the first; documents not taken come last.

    Each source's documents stand in an order that a hash of their ids fixes, one pass after the other; a copy is taken if
    its middle lies before the source's target, so that the words taken miss the target by half a document at most and no
    document is taken more than `most` times. Its position is the time when the source's demand reaches its start.

    Null texts have size 0; a null source is one of its own, the last; a null id counts as its text. Every row gives a row.
    Prefix sums go over hashed buckets on three levels, so that no source, however large, is ordered in one task.
    """
    key = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))
    names = [f"__k{i}" for i in range(len(keep))]
    base = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], key.alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit("")).cast("binary")).alias("h"),
    )
    base = written(base, "sizes")
    sizes = base.groupBy("key").agg(F.first("source").alias("source"), F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    goal = written(targets(sizes, weights, slopes, most), "targets")

    number = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    fine = F.ceil(F.col("docs") / FINE).cast("long")
    rows = base.drop("source").join(goal, "key").withColumn("f", F.shiftright(number * fine, 32)).withColumn("c", F.floor(F.col("f") / COARSE))
    by_fine = rows.groupBy("key", "c", "f").agg(F.sum("size").alias("n"))
    by_coarse = by_fine.groupBy("key", "c").agg(F.sum("n").alias("n"))
    ahead = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    by_coarse = by_coarse.select("key", "c", F.coalesce(F.sum("n").over(ahead("key").orderBy("c")), F.lit(0)).alias("coarse"))
    by_fine = by_fine.select("key", "c", "f", F.coalesce(F.sum("n").over(ahead("key", "c").orderBy("f")), F.lit(0)).alias("fine"))
    offsets = by_fine.join(by_coarse, ["key", "c"]).select("key", "c", "f", (F.col("coarse") + F.col("fine")).alias("offset"))
    inner = F.coalesce(F.sum("size").over(ahead("key", "c", "f").orderBy("h", *names, "size")), F.lit(0))
    rows = rows.withColumn("inner", inner).join(offsets, ["key", "c", "f"]).withColumn("start", F.col("offset") + F.col("inner"))

    passes = F.ceil((F.col("target") - F.col("start") - F.col("size") / 2) / F.col("source_size"))
    copies = F.when(F.col("source_size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), passes)))
    rows = rows.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
    share = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + F.col("start")) / F.col("target"))
    each = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(share(k), F.col("slope")))).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("positions", each)
    out = rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "size", "source_size", "target", "copies", "taken", "positions", F.try_element_at("positions", F.lit(1)).alias("__first"), F.col("h").alias("__h"))
    return out.orderBy(F.asc_nulls_last("__first"), "__h").drop("__first", "__h")
