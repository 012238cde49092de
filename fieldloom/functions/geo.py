"""Coordinates and places as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say a place is at sea (fixed values).
MARINE_WORDS = ("sea", "ocean", "marine", "offshore", "pelagic", "benthic", "reef", "coral", "deep", "trawl", "demersal", "littoral", "intertidal", "subtidal", "mangrove", "estuary", "coastal", "gulf", "bay", "island", "archipelago", "atoll", "seamount", "abyssal")

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_DMS = rf"^\s*([NSEWnsew])?\s*{_NUMBER}\s*[°º]\s*(?:{_NUMBER}\s*['′’]\s*)?(?:{_NUMBER}\s*(?:\"|″|”|'')\s*)?([NSEWnsew])?\s*$"
_DECIMAL = r"^\s*([NSEWnsew])?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*°?\s*([NSEWnsew])?\s*$"

#: Signs taken for minute and second marks, and for blanks (fixed values).
MINUTE_SIGNS, SECOND_SIGNS, BLANK_SIGNS = "\u2032\u02bc\u2019", "\u2033\u201d", "\u00a0\u200b\u200c\u200d\ufeff"
#: A degree mark read as a zero after a hemisphere, or as an O; letters for degrees, minutes and seconds, one after the other.
SCAN_DAMAGE = (
    ("([NSEW])\\s*([0-9]{1,3})0([0-9]{2}')", "$1 $2°$3"),
    ("(?<=[0-9])O(?=[0-9])", "°"),
    ("(?<=[0-9])\\s*[dD](?=\\s*[0-9]+\\s*[mM'])", "°"),
    ("°\\s*([0-9]+)\\s*[mM](?=\\s*[0-9.]+\\s*[sS\"])", "°$1'"),
    ("'\\s*([0-9.]+)\\s*[sS]", "'$1\""),
)


def repair_marks(c: Column) -> Column:
    """Degree, minute and second marks that scanning has damaged, or that are spaces after a hemisphere; seconds without a mark get one."""
    c = F.translate(c, MINUTE_SIGNS + SECOND_SIGNS + BLANK_SIGNS, "'" * len(MINUTE_SIGNS) + '"' * len(SECOND_SIGNS) + " " * len(BLANK_SIGNS))
    for pattern, by in SCAN_DAMAGE:
        c = F.regexp_replace(c, pattern, by)
    c = F.regexp_replace(c, r"^\s*([NSEWnsew])\s*(\d{1,3})\s+(\d{1,2})(?=\s|$)", "$1 $2°$3'")
    c = F.regexp_replace(c, r"^\s*([NSEWnsew])\s*(\d{1,3})\s+(?=\d{1,2}\s*')", "$1 $2°")
    c = F.regexp_replace(c, r"('\s*\d+(?:\.\d+)?)\s*(?=[NSEWnsew]?\s*$)", "$1\"")
    c = F.regexp_replace(c, "[−–](?=[0-9])", "-")
    c = F.regexp_replace(c, r"(?<=[0-9])\s*(?:deg\.?|degrees)\s*", "°")
    c = F.regexp_replace(c, r"(?<=[0-9])[oO](?=\s*[0-9])", "°")
    c = F.regexp_replace(c, "[`´‘]", "'")
    return F.regexp_replace(c, "[“”]", '"')


def parse_degrees(c: Column, latitude: bool) -> Column:
    """Degrees, minutes and seconds, or decimal degrees, the hemisphere before or after, as a number of seven digits; S and W are
    negative, null if implausible."""
    c = repair_marks(c)
    part = lambda i: F.nullif(F.regexp_extract(c, _DMS, i), F.lit("")).cast("double")
    side = lambda pattern, after: F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.regexp_extract(c, pattern, after))
    sign = lambda h: F.when(F.upper(h).isin("S", "W"), -1.0).otherwise(1.0)
    dms = (part(2) + F.coalesce(part(3), F.lit(0.0)) / 60 + F.coalesce(part(4), F.lit(0.0)) / 3600) * sign(side(_DMS, 5))
    decimal = F.nullif(F.regexp_extract(c, _DECIMAL, 2), F.lit("")).cast("double") * sign(side(_DECIMAL, 3))
    value = F.coalesce(F.when(c.rlike(_DMS), dms), decimal)
    most = 90 if latitude else 180
    return F.when(value.between(-most, most), F.bround(value, 7))


def coordinate_pairs(c: Column) -> Column:
    """Pairs of decimal numbers of three digits or more after the point, within range, in the order of the text."""
    pattern = r"(?<![0-9.])(-?[0-9]{1,2}\.[0-9]{3,})\s*[,;]\s*(-?[0-9]{1,3}\.[0-9]{3,})"
    first, second = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(first, second, lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon")))
    return F.filter(pairs, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))


def at_sea(*fields: Column) -> Column:
    """Whether any of the words occurs, also within others, in the fields taken together."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.exists(F.array(*[F.lit(w) for w in MARINE_WORDS]), lambda w: F.contains(text, w))


def in_box(lat: Column, lon: Column, box: Column, margin: float = 0.0) -> Column:
    return lat.between(box["lat_min"] - margin, box["lat_max"] + margin) & lon.between(box["lon_min"] - margin, box["lon_max"] + margin)


def checked(lat: Column, lon: Column, at_sea_: Column, boxes: Column, margin: float = 0.5) -> Column:
    """A note on a pair of coordinates: one out of range or missing spoils both; on land they must lie in one of the boxes."""
    bad = lat.isNull() | lon.isNull() | ~lat.between(-90, 90) | ~lon.between(-180, 180)
    inside = F.exists(boxes, lambda b: in_box(lat, lon, b, margin))
    return F.when(bad, "invalid").when(at_sea_, "marine").when(inside, "valid").otherwise("outside")


def split_places(c: Column, shortest: int = 4) -> Column:
    """The parts of a compound place: at and, semicolons, ampersands, commas before a capital, and what stands in parentheses."""
    inner = F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), F.lit(1))
    outer = F.split(F.regexp_replace(c, r"\([^)]*\)", ""), r"\s+and\s+|\s*;\s*|\s*&\s*|,\s*(?=[A-Z])")
    parts = F.transform(F.concat(outer, inner), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= shortest))


#: Words that make a part of a place a wider place (fixed values).
WIDER_PLACES = (
    "gulf", "bay", "sea", "ocean", "coast", "island", "district", "taluk", "tehsil", "state", "province", "india", "gujarat", "kerala", "karnataka", "maharashtra", "tamil", "andhra", "odisha",
    "goa", "lakshadweep", "andaman", "nicobar", "bengal", "assam",
)


def separate_places(c: Column, wider: tuple[str, ...] = WIDER_PLACES) -> Column:
    """The places in a list by commas or semicolons: one if it has parentheses, or if half of its parts (rounded down) or more name a
    wider place; null gives null."""
    whole = F.array(F.trim(c))
    parts = F.split(c, r"[;,]\s*")
    hits = F.size(F.filter(parts, lambda p: F.exists(F.array(*[F.lit(w) for w in wider]), lambda w: F.contains(F.lower(p), w))))
    one = c.rlike("[()]") | (F.size(parts) <= 1) | (hits >= F.floor(F.size(parts) / 2))
    return F.when(c.isNull(), F.lit(None).cast("array<string>")).when(one, whole).otherwise(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def completed_place(place: Column, *wider: Column) -> Column:
    """A place followed by its wider ones (district, state, country) that it does not name already, joined by commas."""
    out = place
    for w in wider:
        out = F.when(w.isNull() | (w == "") | F.contains(F.lower(out), F.lower(w)), out).otherwise(F.concat(out, F.lit(", "), w))
    return out


def enhanced_place(place: Column, study_area: Column, short: int = 12) -> Column:
    """A short or empty place with the study area of its document, if that is known and not named already."""
    bare = F.regexp_replace(F.lower(F.coalesce(place, F.lit(""))), r"^(?:at|near|in|off|from|the)\s+", "")
    return F.when((F.length(bare) >= short) | study_area.isNull() | F.contains(bare, F.lower(study_area)), place).when(bare == "", study_area).otherwise(F.concat(place, F.lit(", "), study_area))
