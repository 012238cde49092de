"""Names of organisms and places: canonical forms, slugs, ids and scores, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.values import strip

_AUTHOR_YEAR = r"\s+\(?\p{Lu}[\p{L}.'-]*(?:\s+(?:&\s+|et\s+|and\s+|in\s+)?\p{Lu}[\p{L}.'-]*)*,?\s*(?:1[789]|20)[0-9]{2}\)?"
_OPEN = r"(^|\s)(cf|aff|sp|spp|nr|gen|indet|ssp|var)\.?(?=\s|$)"
#: Placeholder names of failed recognition.
PLACEHOLDER = r"(?i)^_+candidate_"
#: Terms that name a stage of life or a size, not an organism (fixed values).
LIFE_STAGES = (
    "medusa", "medusae", "ephyra", "ephyrae", "strobila", "strobilae", "scyphistoma", "scyphistomae", "polyp", "polyps", "veliger", "veligers", "trochophore", "trochophores", "larva", "larvae",
    "larval", "juvenile", "juveniles", "adult", "adults", "egg", "eggs", "egg mass", "egg masses", "embryo", "embryos", "spat", "post-larva", "post-larvae", "post-larval", "recruit", "recruits",
    "metamorphose", "metamorphosis", "nauplius", "nauplii", "zoea", "zoeas", "megalopa", "pluteus", "bipinnaria", "auricularia", "doliolaria", "immature", "mature", "subadult", "hatchling",
    "hatchlings", "nymph", "nymphs", "pup", "pups", "fry", "small", "large", "tiny", "minute",
)


def canon_name(c: Column, strict: bool = False) -> Column:
    """A name for comparison: without author and year, parentheses and open nomenclature, spaces collapsed, in lower case; strict
    keeps all but case and surrounding space."""
    c = strip(F.coalesce(c, F.lit("")))
    if not strict:
        c = F.regexp_replace(c, _AUTHOR_YEAR, "")
        c = F.regexp_replace(c, r"\s*\([^)]+\)", "")
        c = F.regexp_replace(c, _OPEN, "")
        c = strip(F.regexp_replace(c, r"\s{2,}", " "))
    return F.regexp_replace(F.lower(c), r"^[.,;\- ]+|[.,;\- ]+$", "")


def canon_place(c: Column) -> Column:
    """A place for comparison: lower case, punctuation and repeated spaces as one space, the usual abbreviation of district spelt out."""
    c = strip(F.lower(F.coalesce(c, F.lit(""))))
    c = strip(F.regexp_replace(F.regexp_replace(c, "[,;.]+", " "), r"\s{2,}", " "))
    return F.replace(c, F.lit(" dist "), F.lit(" district "))


def slug(c: Column, sep: str = "_", longest: int = 80, collapse: bool = False) -> Column:
    """Lower case with every other character than letters and digits (or every run of them) as a separator."""
    s = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]" + ("+" if collapse else ""), sep)
    return F.substring(F.regexp_replace(s, f"^[{sep}]+|[{sep}]+$", "") if collapse else s, 1, longest)


def short_hash(*parts: Column, size: int = 16) -> Column:
    """A content address: the head of SHA-1 over the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, size)


def is_placeholder(c: Column) -> Column:
    """Names that are no candidates: placeholders, blanks, under four characters, or short remains of markup or lists."""
    n = strip(F.coalesce(c, F.lit("")))
    return n.rlike(PLACEHOLDER) | (F.length(n) < 4) | ((F.length(n) < 8) & n.rlike(r"^[\[{\"0-9]"))


def is_life_stage(c: Column, terms: tuple[str, ...] = LIFE_STAGES) -> Column:
    """Whether the whole name or its first word is a stage of life."""
    n = canon_name(c)
    return n.isin(*terms) | F.split(n, " ")[0].isin(*terms)


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces of a text in lower case, from its characters side by side: linear in its length."""
    n = F.lower(c)
    own, join = F.slice(F.split(n, ""), F.lit(1), F.length(n)), lambda a, b: F.concat(a, b)
    pieces = F.zip_with(F.zip_with(own, F.slice(own, F.lit(2), F.length(n)), join), F.slice(own, F.lit(3), F.length(n)), join)
    return F.when(F.length(n) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(pieces, lambda p: p.isNotNull())))


def trigram_score(c: Column, known: Column) -> Column:
    """The share of a text's trigrams that are known ones."""
    own = trigrams(c)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, known)) / F.size(own)).otherwise(0.0)


def cardinality(c: Column) -> Column:
    """Words of a name without open nomenclature, 1 for a genus, 2 for a species."""
    return F.size(F.filter(F.split(F.regexp_replace(strip(c), _OPEN, ""), r"\s+"), lambda w: w != ""))


def rank_map(path: Column, ranks: Column) -> Column:
    """Two bar-separated lists, of names and of their ranks, as a map from rank to name; of equal ranks the last wins."""
    pairs = F.arrays_zip(F.transform(F.split(ranks, r"\|"), lambda r: F.lower(r)).alias("k"), F.split(path, r"\|").alias("v"))
    pairs = F.filter(pairs, lambda p: (p["k"].isNotNull()) & (p["k"] != "") & p["v"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def match_confidence(first: Column, parsed: Column, second: Column, exact: Column, third: Column, fourth: Column) -> Column:
    """Evidence of several authorities: .40 for the first, .30 of the parser's score at most, .15 or .08 for the second (exact or
    not), .10 for the third and .05 for the fourth; at most 1, three digits."""
    total = F.when(first, 0.4).otherwise(0.0) + F.least(F.lit(0.3), F.coalesce(parsed, F.lit(0.0)) * 0.3) + F.when(second, F.when(exact, 0.15).otherwise(0.08)).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), total + F.when(third, 0.1).otherwise(0.0) + F.when(fourth, 0.05).otherwise(0.0)), 3)


def relation_type(c: Column, known: tuple[str, ...]) -> Column:
    """A relation in capitals; one that contains a known relation becomes that one, others stay."""
    up = F.upper(strip(c))
    out = F.when(up.isin(*known), up)
    for k in known:
        out = out.when(F.contains(up, F.lit(k)), F.lit(k))
    return out.otherwise(up)


def citation(authors: Column, year: Column, title: Column, journal: Column) -> Column:
    """Authors (the first four, then et al.), year, title and journal as one line."""
    who = F.array_join(F.slice(authors, 1, 4), ", ")
    return F.concat_ws(" ", F.concat(who, F.when(F.size(authors) > 4, " et al.").otherwise("")), F.concat(F.lit("("), year.cast("string"), F.lit(").")), F.concat(title, F.lit(".")), F.concat(journal, F.lit(".")))
