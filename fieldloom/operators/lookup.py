"""Lookup cascades: each key tries one way after the other and takes the first hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.phonetic import sounds
from fieldloom.operators.fuzzy import similar


def canonical(c: Column) -> Column:
    """For comparison: lower case, parentheses dropped, other than letters and digits dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""), "[^a-z0-9]", "")


def cascade(queries: DataFrame, names: DataFrame, query: str, name: str, ident: str, least: float = 0.8, short: int = 4, short_least: float = 0.92, order: Column | None = None) -> DataFrame:
    """For each distinct query: id, how (exact 100, canonical 95, fuzzy, phonetic 75, code 90, or none) and score; the first way that
    hits counts.

    Of rows with the same key the first in the given order counts (by default the smallest id as text), of rows with the same code
    the last. Null queries and names take no part; names without a letter or digit of a-z, 0-9 have no canonical key and are only found
    exactly; an id that is no number has no code. Fuzzy matches are the best by ratio (see fuzzy.similar) of canonical forms, the smallest of
    equal ones; short keys need a better match. Phonetic ones have the same first code of the double metaphone. Every way is an equi-join.
    """
    q = queries.select(F.col(query).alias("q")).where(F.col("q").isNotNull()).distinct().withColumn("cq", F.nullif(canonical(F.col("q")), F.lit("")))
    d = names.select(F.col(name).alias("n"), F.col(ident).cast("string").alias("id"), (F.col(ident).cast("string") if order is None else order).alias("o"))
    d = d.where(F.col("n").isNotNull()).withColumn("cn", F.nullif(canonical(F.col("n")), F.lit("")))
    first = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", F.struct("o", "id")).alias("id"))
    way = lambda df, rank, how, score: df.select("q", F.struct(F.lit(rank).alias("rank"), (-score).alias("s"), (F.col("cn") if rank == 2 else F.lit("")).alias("cn"), F.lit(how).alias("how"), F.col("id")).alias("hit"))

    exact = way(q.join(first(d, "n"), q["q"] == F.col("n")), 0, "exact", F.lit(100.0))
    canon = way(q.join(first(d, "cn"), q["cq"] == F.col("cn")), 1, "canonical", F.lit(95.0))
    rest = q.where(F.col("cq").isNotNull()).join(exact.unionByName(canon).select("q"), "q", "left_anti")

    keys = first(d, "cn")
    close = similar(rest, keys, "cq", "cn", least).withColumnRenamed("q", "cq").withColumnRenamed("n", "cn")
    close = close.where(F.col("score") >= F.when(F.length("cq") <= short, short_least).otherwise(least)).join(keys, "cn").join(rest, "cq")
    fuzzy = way(close, 2, "fuzzy", F.bround(F.col("score") * 100, 4))

    sound = lambda c: F.coalesce(F.try_element_at(sounds(F.col(c)), F.lit(1)), F.col(c))  # noqa: E731  the key itself where nothing sounds
    heard = first(d.withColumn("s", sound("cn")), "s")
    phonetic = way(rest.where(F.length("cq") > short).withColumn("s", sound("cq")).join(heard, "s"), 3, "phonetic", F.lit(75.0))
    code = d.withColumn("code", F.col("id").try_cast("long")).where("code is not null").groupBy("code").agg(F.max_by("id", F.struct("o", "id")).alias("id"))
    number = F.nullif(F.regexp_extract("q", "([0-9]{6})", 1), F.lit("")).try_cast("long")
    coded = way(q.join(code, number == F.col("code")), 4, "code", F.lit(90.0))
    best = exact.unionByName(canon).unionByName(fuzzy).unionByName(phonetic).unionByName(coded).groupBy("q").agg(F.min("hit").alias("hit"))
    return q.select("q").join(best, "q", "left").select("q", F.col("hit.id").alias("id"), F.coalesce("hit.how", F.lit("none")).alias("how"), F.coalesce(-F.col("hit.s"), F.lit(0.0)).alias("score"))


def office_match(queries: DataFrame, offices: DataFrame, query: str, office: str, seq: str) -> DataFrame:
    """Each distinct query with the row of offices whose name equals it, whatever the case, else of the first one (by seq) that it is
    within or that is within it, both blank never; queries without a hit stay, with nulls.

    Containment is an equi-join: the first three characters of what is contained (or all, if it is shorter) are among the pieces of
    that length of the other.
    """
    q = queries.select(F.trim(F.lower(F.col(query))).alias("q"), F.col(query).alias("__given")).where("q <> ''").distinct()
    o = offices.withColumn("__name", F.lower(F.col(office))).where("__name <> ''")
    first = o.groupBy("__name").agg(F.min_by(F.struct(*offices.columns), seq).alias("row"), F.min(seq).alias("__seq"))
    of_size = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, n))
    grams = lambda c: F.array_distinct(F.concat(*[of_size(c, n) for n in (1, 2, 3)]))
    shorter = q.select("q", F.explode(grams(F.col("q"))).alias("g")).join(first.select("__name", F.substring("__name", 1, 3).alias("g")), "g").where(F.contains("q", "__name"))
    longer = q.select("q", F.substring("q", 1, 3).alias("g")).join(first.select("__name", F.explode(grams(F.col("__name"))).alias("g")), "g").where(F.contains("__name", "q"))
    hits = shorter.select("q", "__name").union(longer.select("q", "__name")).distinct().join(first, "__name")
    best = hits.groupBy("q").agg(F.min_by("row", F.struct((F.col("q") != F.col("__name")).alias("other"), F.col("__seq").alias("seq"))).alias("row"))
    return q.join(best, "q", "left").select(F.col("__given").alias(query), "row.*")


def boxes_of(points: DataFrame, keys: list[str], lat: str, lon: str, margin: float) -> DataFrame:
    """The box of each key (in capitals), widened by a margin: district boxes take one of 0.1. Null coordinates take no part."""
    up = [F.upper(F.col(k)).alias(k) for k in keys]
    edge = lambda f, c, by: (f(c) + F.lit(by)).alias(f"{c}_{'max' if by > 0 else 'min'}")
    return points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*up).agg(edge(F.min, lat, -margin), edge(F.max, lat, margin), edge(F.min, lon, -margin), edge(F.max, lon, margin))


def code_boxes(points: DataFrame, code: str, seq: str, lat: str, lon: str, margin: float = 0.15) -> DataFrame:
    """The box around the last row (by seq) of each code, codes filled with zeros to six digits."""
    last = points.groupBy(F.lpad(F.trim(F.col(code).cast("string")), 6, "0").alias(code)).agg(F.max_by(F.struct(lat, lon), seq).alias("p"))
    return last.select(code, *[(F.col(f"p.{c}") + by).alias(f"{c}_{n}") for c in (lat, lon) for by, n in ((-margin, "min"), (margin, "max"))])


def named_in(text: Column, names: tuple[str, ...]) -> Column:
    """The first of the names, in the order given, that a text contains, whatever the case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), n) for n in names])


def resolved_stations(df: DataFrame, place: str, stations: DataFrame, doc: str) -> DataFrame:
    """df with station_place: that of the first station (doc, seq, id, place) of the document whose id is within the record's place, or
    within which it is, in capitals; blank places none. Stations of a document are few: they are gathered in one array."""
    some = stations.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", F.upper("id").alias("id"), F.col("place").alias("place")))).alias("__stations"))
    own = F.upper(F.trim(F.col(place)))
    hit = F.filter("__stations", lambda s: (own != "") & (F.contains(own, s["id"]) | F.contains(s["id"], own)))
    return df.join(some, doc, "left").withColumn("station_place", F.try_element_at(hit, F.lit(1))["place"]).drop("__stations")


def top_candidate(matches: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first candidate of each key in the given order."""
    return matches.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def nearest_before(points: DataFrame, marks: DataFrame, key: str, at: str, value: str, within: float) -> DataFrame:
    """points with the value of the last mark at or before each (ties: the largest value), if not farther than `within`: an as-of join
    as one sort over both tables, no pair is ever made."""
    both = points.withColumn("__v", F.lit(None).cast(dict(marks.dtypes)[value])).withColumn("__m", F.lit(0)).select(*points.columns, "__v", "__m")
    mark = marks.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(t).alias(c) for c, t in points.dtypes], F.col(value).alias("__v"), F.lit(1).alias("__m"))
    w = Window.partitionBy(key).orderBy(F.col(at).asc(), F.col("__m").desc(), F.col("__v").asc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.unionByName(mark).withColumn("__last", F.last(F.when(F.col("__m") == 1, F.struct(F.col(at).alias("at"), F.col("__v").alias("v"))), ignorenulls=True).over(w))
    near = (F.col(at) - F.col("__last.at")) <= within
    return seen.where("__m = 0").select(*points.columns, F.when(near, F.col("__last.v")).alias(f"near_{value}"))


def nearest(points: DataFrame, marks: DataFrame, key: str, at: str, value: str, within: float) -> DataFrame:
    """points with the value of the mark of least distance on either side, if not farther than `within`; ties: the earlier mark, of
    marks at one place the smallest value. Two running windows, one in each direction; no pair is ever made."""
    places = marks.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.min(value).alias("__v"))
    both = points.withColumn("__v", F.lit(None).cast(dict(marks.dtypes)[value])).withColumn("__m", F.lit(0))
    mark = places.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(t).alias(c) for c, t in points.dtypes], "__v", F.lit(1).alias("__m"))
    own = F.when(F.col("__m") == 1, F.struct(F.col(at).alias("at"), F.col("__v").alias("v")))
    seen = both.unionByName(mark)
    for name, order in (("__before", F.col(at).asc()), ("__after", F.col(at).desc())):
        seen = seen.withColumn(name, F.last(own, ignorenulls=True).over(Window.partitionBy(key).orderBy(order, F.col("__m").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    before, after = F.col(at) - F.col("__before.at"), F.col("__after.at") - F.col(at)
    first = (before <= within) & F.coalesce(before <= after, F.lit(True))
    return seen.where("__m = 0").select(*points.columns, F.when(first, F.col("__before.v")).when(after <= within, F.col("__after.v")).alias(f"near_{value}"))


def fill_from_box(df: DataFrame, boxes: DataFrame, code: Column, lat: str, lon: str) -> DataFrame:
    """Coordinates checked against, or filled with the centre of, the box (key, lat_min, lat_max, lon_min, lon_max) of a code."""
    j = df.withColumn("__code", code).join(boxes, F.col("__code") == F.col("key"), "left")
    inside = F.col(lat).between(F.col("lat_min"), F.col("lat_max")) & F.col(lon).between(F.col("lon_min"), F.col("lon_max"))
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    note = F.when(F.col("key").isNull(), "no_box").when(missing, "filled").when(inside, "inside").otherwise("outside")
    centre = lambda a, b: F.bround((F.col(a) + F.col(b)) / 2, 6)
    fill = missing & F.col("key").isNotNull()
    return j.select(*[c for c in df.columns if c not in (lat, lon)], F.when(fill, centre("lat_min", "lat_max")).otherwise(F.col(lat)).alias(lat), F.when(fill, centre("lon_min", "lon_max")).otherwise(F.col(lon)).alias(lon), note.alias("note"))
