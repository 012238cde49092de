"""Coordinates for records by one tool after the other, each asked only for the places that none before it knew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.calls import answered
from fieldloom.functions.geo import parse_degrees
from fieldloom.operators import lookup, mentions
from fieldloom.sources.tables import cut

#: A tool takes distinct places (column place) and gives place, lat, lon and source for those it knows, one row for each.
Tool = Callable[[DataFrame], DataFrame]
#: Feature classes of a gazetteer in the order in which exact names count: settlements, waters, areas.
CLASSES = ("P", "H", "A")


def code_in(text: Column) -> Column:
    """The first postal code of six digits in a text, which does not begin with 0 and is no part of a longer number or word; else null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b([1-9][0-9]{5})\b", 1), F.lit(""))


def by_names(names: DataFrame, name: str, ident: str, lat: str, lon: str, label: str, least: float = 0.8) -> Tool:
    """A tool over a table of named places: lookup.cascade, with source label_how_score. Of equal ids the smallest coordinates count."""

    def find(places: DataFrame) -> DataFrame:
        known = names.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        at = known.groupBy(F.col(ident).cast("string").alias("id")).agg(F.min(F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))).alias("p"))
        hits = lookup.cascade(places, known, "place", name, ident, least).where("how <> 'none'").join(at, "id")
        return hits.select(F.col("q").alias("place"), "p.lat", "p.lon", F.concat_ws("_", F.lit(label), "how", F.round("score").cast("int")).alias("source"))

    return find


def by_gazetteer(gazetteer: DataFrame, label: str = "gazetteer", most: int = mentions.MOST_NAMES) -> Tool:
    """A tool over a gazetteer (name, ascii, alternates, lat, lon, feature, population).

    A place that is a name or its plain form counts first, by class of feature, then population; else one that stands anywhere in the
    alternate names, whatever the case, by population. Ties go to the smaller name, then coordinates. Rows without coordinates know
    nothing. Alternate names are read once for each `most` places, by one automaton over these.
    """
    rows = gazetteer.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("name", "ascii", "alternates", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "feature", F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("population"))
    rank = F.coalesce(*[F.when(F.col("feature") == c, i) for i, c in enumerate(CLASSES)], F.lit(len(CLASSES)))
    best = lambda df, order, key: df.groupBy(key).agg(F.min(F.struct(order.alias("rank"), (-F.col("population")).alias("p"), "name", "lat", "lon")).alias("b"))

    def find(places: DataFrame) -> DataFrame:
        named = rows.select(F.explode(F.array_distinct(F.array("name", "ascii"))).alias("place"), "*").where("place <> ''")
        exact = best(named, rank, "place").join(places, "place", "left_semi")
        rest = cut(places.join(exact, "place", "left_anti").withColumn("part", F.lit(0)), "places")
        parts = -(-rest.count() // most)
        low = rows.where("alternates <> ''").select(F.struct("alternates", "name", "lat", "lon", "population", "feature").alias("row"), "alternates")
        found = None
        for k in range(parts):
            asked = rest.where(F.pmod(F.xxhash64("place"), F.lit(parts)) == k)
            some = mentions.spans(low, asked, "row", "alternates", "place", whole_words=False, most=2 * most).select("form", "row.*").distinct()
            found = some if found is None else found.unionByName(some)
        hits = exact
        if found is not None:
            within = best(found, F.lit(0), "form")
            hits = exact.unionByName(rest.select("place", F.lower("place").alias("form")).join(within, "form").select("place", "b"))
        return hits.select("place", "b.lat", "b.lon", F.lit(label).alias("source"))

    return find


def by_provider(call: Callable[[str], tuple[float, float] | None], label: str, workers: int = 4, rate: float | None = None, tries: int = 2) -> Tool:
    """A tool that asks an injected function for the coordinates of each place, spaced and bounded as calls.answered has it. Places it
    does not know, and those for which it raises, stay unknown. The answers are written before they are used, so none is asked for twice."""

    def ask(place: str) -> str | None:
        found = call(place)
        return None if found is None else f"{float(found[0])!r} {float(found[1])!r}"

    def find(places: DataFrame) -> DataFrame:
        told = cut(answered(places.select("place"), "place", ask, workers, rate, tries=tries), "answers")
        at = F.split("answer", " ")
        return told.where("answer is not null").select("place", at[0].cast("double").alias("lat"), at[1].cast("double").alias("lon"), F.lit(label).alias("source"))

    return find


def geocoded(records: DataFrame, place: str, lat: str, lon: str, tools: Sequence[Tool], given: str = "given") -> DataFrame:
    """records with lat and lon as numbers and coordinate_source.

    Coordinates come as degrees, minutes and seconds, or as numbers; where both can be read they stay, with source `given`. The distinct
    places of all other rows, trimmed, go from tool to tool, each residue written once, and only what no tool before knew goes on. Rows
    without coordinates and with a place that is null, blank or unknown keep nulls. A hot place costs no more than any other: rows
    meet the answers in one join by place, in which adaptive execution splits skewed keys. Other columns stay as they are.
    """
    a, b = parse_degrees(F.col(lat).cast("string"), True), parse_degrees(F.col(lon).cast("string"), False)
    rows = records.withColumns({"__a": a, "__b": b})
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    rows = rows.withColumn("__place", F.when(~known, F.nullif(F.trim(F.col(place)), F.lit(""))))
    residue = cut(rows.where("__place is not null").select(F.col("__place").alias("place")).distinct(), "residue")
    found = None
    for tool in tools:
        hits = cut(tool(residue).select("place", "lat", "lon", "source"), "found")
        found = hits if found is None else found.unionByName(hits)
        residue = cut(residue.join(hits, "place", "left_anti"), "residue")
    out = [c for c in records.columns if c not in (lat, lon)]
    if found is None:
        return rows.select(*out, F.when(known, F.col("__a")).alias(lat), F.when(known, F.col("__b")).alias(lon), F.when(known, given).alias("coordinate_source"))
    found = found.select(F.col("place").alias("__place"), F.struct("lat", "lon", "source").alias("__hit"))
    both = rows.join(found, "__place", "left")
    return both.select(*out, F.when(known, F.col("__a")).otherwise(F.col("__hit.lat")).alias(lat), F.when(known, F.col("__b")).otherwise(F.col("__hit.lon")).alias(lon), F.when(known, given).otherwise(F.col("__hit.source")).alias("coordinate_source"))


def with_district(found: DataFrame, gazetteer: DataFrame, first: str = "admin1", second: str = "admin2") -> DataFrame:
    """found with district: the name of the gazetteer's area of the second order (feature A, code ADM2) with the same two codes, the
    smallest of several; null where there is none or a code is missing."""
    areas = gazetteer.where("feature = 'A' and code = 'ADM2'").groupBy(first, second).agg(F.min("name").alias("district"))
    return found.join(areas, [first, second], "left")

