"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._spark import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node with an edge to another; root is the smallest node reachable.

    Edges hold two columns of one orderable type; loops, repeats and rows with a null end are ignored, an empty table gives
    an empty result. Each step links nodes to the smallest neighbour known, so a component of n nodes ends as a star after
    about log n rounds; minima are pre-aggregated, and what joins them back is an equi-join that adaptive execution can
    split where one node has very many neighbours. Every round is written to the shared folder and the one before deleted.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    work = written(pair.where(pair[2]).select("u", "v").distinct(), "edges")
    seen = _signature(work)
    while seen[0]:
        both = work.select("u", "v").union(work.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every pair now points from the larger node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, work, before = work, written(small, "edges"), seen
        dropped(last)
        seen = _signature(work)
        if seen == before:
            break
    out = work.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.__dict__["written_to"] = work.__dict__["written_to"]  # for `dropped`
    return out


def _signature(edges: DataFrame) -> tuple:
    """Tells whether a round changed anything: the count of edges and two sums over their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first())
