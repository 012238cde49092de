"""Rules that rewrite records: authority of sources, places that are none, spans with offsets, joins by mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.values import filled, strip

_AUTHOR = r"([A-Z][A-Za-z'-]+)"
_YEAR = "(19[5-9][0-9]|20[0-2][0-9])"
#: Phrases before a cited author (fixed values).
_CUES = "according to|reported by|recorded by|described by|as per|cited in|sensu"


def author(citation: Column) -> Column:
    """The first capitalised word of a citation, null if there is none."""
    return F.nullif(F.regexp_extract(citation, _AUTHOR, 1), F.lit(""))


def year(citation: Column) -> Column:
    return F.nullif(F.regexp_extract(citation, _YEAR, 1), F.lit("")).cast("int")


def reconciled(df: DataFrame, kind: str, cited: str, evidence: str, document: Column) -> DataFrame:
    """df with Primary records made Secondary, and rules, the names of all that say so: the record cites another author than the
    document's; its evidence refers to another one; its evidence names a year over one before the document's.

    A record is judged by its first type, so all three rules may hold; case does not matter in evidence.
    """
    low = F.lower(F.coalesce(F.col(evidence), F.lit("")))
    own, own_year = author(document), year(document)
    other = F.lower(author(F.col(cited))) != F.lower(own)
    named = F.nullif(F.regexp_extract(low, rf"(?:^|[^a-z])(?:{_CUES})\s+([a-z]+)", 1), F.lit(""))
    years = F.transform(F.regexp_extract_all(low, F.lit(r"(?:^|[^0-9a-z])((?:18|19)[0-9]{2}|20[0-2][0-9])(?![0-9a-z])"), F.lit(1)), lambda y: y.cast("int"))
    early = F.exists(years, lambda y: y < own_year - 1)
    found = F.array_compact(F.array(F.when(other, "citation"), F.when(named != F.lower(own), "evidence"), F.when(early, "year")))
    df = df.withColumn("rules", F.when(F.col(kind) == "Primary", found).otherwise(F.array().cast("array<string>")))
    return df.withColumn(kind, F.when(F.size("rules") > 0, "Secondary").otherwise(F.col(kind)))


def place_class(place: Column, anatomy: tuple[str, ...], habitat_lead: tuple[str, ...], habitat_words: tuple[str, ...], skipped: tuple[str, ...] = ("not reported", "unknown", "")) -> Column:
    """What a place text is: null for a place, else morphology (a measurement, or an anatomical term, also within words), habitat, or
    habitat_with_place (it begins like a habitat but holds a capitalised name)."""
    text = strip(F.coalesce(place, F.lit("")))
    low = F.lower(text)
    measure = low.rlike(r"[0-9]\s*(mm|cm|µm|um)([^a-z]|$)")
    body = F.filter(F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: w != "")
    lead = low.rlike(f"^({'|'.join(habitat_lead)})([^a-z]|$)")
    named = F.regexp_replace(text, r"^\S+", "").rlike("(^|[^A-Za-z])[A-Z][a-z]{2,}")
    return (
        F.when(low.isin(*skipped), F.lit(None).cast("string"))
        .when(measure | F.exists(F.array(*[F.lit(a) for a in anatomy]), lambda a: F.contains(low, a)), "morphology")
        .when(lead, F.when(named, "habitat_with_place").otherwise("habitat"))
        .when((F.size(body) > 0) & F.forall(body, lambda w: w.isin(*habitat_words)), "habitat")
    )


def place_in_habitat(place: Column) -> Column:
    """The capitalised name after a preposition in a habitat text, null if there is none."""
    return F.nullif(strip(F.regexp_extract(place, r"(?:^|\s)(?:at|near|in|off|from)\s+([A-Z][A-Za-z\s,]*[A-Za-z])(?:\s*[,;.]|$)", 1)), F.lit(""))


def guarded_places(df: DataFrame, place: str, habitat: str, **terms: tuple[str, ...]) -> DataFrame:
    """df with places that are none emptied, their text moved to a blank habitat, and place_note, what they were; nothing is dropped."""
    what = place_class(F.col(place), **terms)
    df = df.withColumn("place_note", what).withColumn("__old", F.col(place))
    df = df.withColumn(habitat, F.when(F.col("place_note").startswith("habitat"), F.coalesce(filled(F.col(habitat)), F.col("__old"))).otherwise(F.col(habitat)))
    return df.withColumn(place, F.when(F.col("place_note") == "habitat_with_place", place_in_habitat(F.col("__old"))).when(F.col("place_note").isNull(), F.col("__old"))).drop("__old")


def spans(text: Column, pattern: str, label: str) -> Column:
    """All matches of a pattern with a label: start and end (code points, end exclusive) and text. Places come from the lengths of
    what lies between the matches, so no Python is needed."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g")))

    def add(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["g"], a["at"] + x["g"] + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(label).alias("label"), x["v"].alias("text")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,label:string,text:string>>").alias("out"))
    return F.aggregate(parts, zero, add, lambda a: a["out"])


def tagged(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with spans of all labels, by start, then end."""
    every = F.concat(*[spans(F.col(text), p, label) for label, p in patterns.items()])
    return df.withColumn("spans", F.array_sort(every))


def kind_from_context(context: Column, first: str, second: str) -> Column:
    """Primary or Secondary by which signals are more frequent, else Uncertain."""
    a, b = F.regexp_count(F.lower(context), F.lit(first)), F.regexp_count(F.lower(context), F.lit(second))
    return F.when(a > b, "Primary").when(b > a, "Secondary").otherwise("Uncertain")


def merged_spans(df: DataFrame, doc: str, gap: int = 2) -> DataFrame:
    """Spans (doc, start, end, label) of the same label joined where at most `gap` characters lie between: runs by a window. A span
    within another does not shorten the run."""
    w = Window.partitionBy(doc).orderBy("start", "end")
    turn = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1))
    same = df.withColumn("__turn", turn).withColumn("__stretch", F.sum("__turn").over(w))  # spans of one label in a row
    own = Window.partitionBy(doc, "__stretch").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(1))
    run = same.withColumn("__new", new).withColumn("run", F.struct("__stretch", F.sum("__new").over(own).alias("part")))
    return run.groupBy(doc, "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("pieces"))


def co_mentions(texts: DataFrame, names: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """doc and name where a text mentions a one-word name, whatever the case: a join on words, not a comparison of all pairs."""
    words = texts.select(doc, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z0-9]+"))).alias("w")).where("w <> ''")
    return words.join(names.select(F.col(name)).distinct().withColumn("w", F.lower(F.col(name))), "w").select(doc, name)


def stations(text: Column) -> Column:
    """Station ids and the places they stand for, from lines such as `Station 1: Place` or `St. 2 (Place)`, as a map; of equal ids the
    first counts."""
    pattern = r"(?:Station|Stn|St)\.?\s*([0-9]+[A-Za-z]?)\s*(?:[:=\-–]|\()\s*([A-Z][A-Za-z ]+)"
    ids, places = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(ids.alias("i"), places.alias("p"))
    keys = F.array_distinct(ids)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: strip(F.element_at(F.filter(pairs, lambda x: x["i"] == k), 1)["p"])))


def first_class(text: Column, classes: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first class any word of which a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in classes.items():
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def with_document_context(df: DataFrame, doc: str, role: str, body: str, sources: tuple[str, ...], targets: tuple[str, ...], pattern: str, most: int = 10) -> DataFrame:
    """Sections with context: what a pattern finds in a document's source sections (distinct, the first `most`) before target ones."""
    found = df.where(F.col(role).isin(*sources)).groupBy(doc).agg(F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", body))), lambda s: F.regexp_extract_all(s[body], F.lit(pattern), F.lit(0))))), 1, most).alias("context"))
    return df.join(found, doc, "left").withColumn("context", F.when(F.col(role).isin(*targets), F.coalesce("context", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def folded(c: Column) -> Column:
    """A place name for comparison: marks dropped from Latin letters, lower case, no parentheses and administrative words."""
    plain = F.translate(F.lower(c), "āáàâäãåīíìîïūúùûüēéèêëōóòôöõñçśṣḍṭṇṛḥ", "aaaaaaaiiiiiuuuuueeeeeooooooncssdtnrh")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", ""), r"\s(?:tahsil|taluka|tal|district|dist|village|vill|post)(?=\s|$)", "")
    return strip(F.regexp_replace(plain, r"\s+", " "))


#: Spellings of one sound, each rewritten in this order (fixed values): long vowels, aspirates, consonants taken for one another.
SPELLINGS = (
    ("aa", "a"), ("ee", "i"), ("oo", "u"), ("ii", "i"), ("uu", "u"),
    ("kh", "k"), ("gh", "g"), ("ch", "c"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"),
    ("v", "b"), ("w", "b"), ("sh", "s"),
)


def spelling_key(c: Column) -> Column:
    """One key for variant spellings: SPELLINGS rewritten, then an h after a vowel, repeats and spaces left out."""
    out = folded(c)
    for spelling, by in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(by))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "(?<=[aeiou])h", ""), r"(.)\1+", "$1"), " ", "")


def approval(score: Column, match: Column, least: float) -> Column:
    """What a reviewer sees first: approved for a sure exact or fuzzy match, none where nothing matches, else review."""
    return F.when(F.coalesce(match, F.lit("NONE")) == "NONE", "none").when(match.isin("EXACT", "FUZZY") & (score >= least), "approved").otherwise("review")


def auto_approved(status: Column, score: Column, match: Column, other_id: Column, least: float) -> Column:
    """Whether a match goes through without review: exact or fuzzy, and either accepted with a high score or known to the other authority
    by an id that is not blank. Null counts as no."""
    sure = F.coalesce((status == "ACCEPTED") & (score >= least), F.lit(False))
    known = F.coalesce(F.trim(other_id.cast("string")) != "", F.lit(False))
    return F.coalesce(match.isin("EXACT", "FUZZY"), F.lit(False)) & (sure | known)


#: Months, and capitalised words that begin no place (fixed values).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NO_PLACES = ("Table", "Figure", "Methods", "Results", "Discussion", "Abstract", "Introduction", "Section", "Appendix", "Supplementary", "Data", "Note", "Text", "Plate", "Volume", "Number", "Species", "Family", "Order", "Class", "Phylum", "Kingdom", "Genus")


_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
_METRES = r"[0-9]+(?:\.[0-9]+)?\s*m(?:et(?:er|re)s?)?\b"
#: Up to four capitalised words, with `of` between some; a month and a year, or two years; a depth, or a range of metres.
_PLACE = r"(?<!\w)(?:\p{Lu}\p{Ll}{2,}(?:\s+of)?\s+){0,3}\p{Lu}\p{Ll}{2,}(?!\w)"
_PERIOD = rf"(?i)\b(?:{_MONTH})\s+[0-9]{{4}}\b|\b[0-9]{{4}}[-–/][0-9]{{2,4}}\b"
_DEPTH = rf"(?i)\b(?:at\s+)?(?:a\s+)?depth\s+of\s+{_METRES}|\b[0-9]+(?:\.[0-9]+)?\s*[-–]\s*{_METRES}"


def study_facts(body: Column) -> Column:
    """places (the first 10), dates and depths (the first 5 of each) that a text names, each once; null gives empty lists."""
    text = F.coalesce(body, F.lit(""))
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    places = F.filter(every(_PLACE), lambda p: ~F.get(F.split(p, r"\s"), F.lit(0)).isin(*NO_PLACES))
    dates, depths = every(_PERIOD), every(_DEPTH)
    return F.struct(F.slice(places, 1, 10).alias("places"), F.slice(dates, 1, 5).alias("dates"), F.slice(depths, 1, 5).alias("depths"))


def with_study_context(df: DataFrame, doc: str, sources: tuple[str, ...] = ("METHODS", "ABSTRACT"), targets: tuple[str, ...] = ("RESULTS", "DISCUSSION", "TAXONOMY", "TABLES"), most: int = 1500) -> DataFrame:
    """Sections (doc, section, heading, role, body) with context: what the source sections of a document say of places, dates and depths,
    `most` characters, for its target sections; empty for others, and where no source names a place or a date."""
    f = study_facts(F.col("body"))
    line = lambda name, items, by: F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, by)))
    part = F.concat_ws("\n", F.concat(F.lit("[STUDY CONTEXT from "), F.coalesce("heading", F.lit("")), F.lit(" section]")), line("Localities", f["places"], ", "), line("Collection period", f["dates"], "; "), line("Depth range", f["depths"], "; "))
    told = df.where(F.col("role").isin(*sources)).where((F.size(f["places"]) > 0) | (F.size(f["dates"]) > 0)).select(doc, "section", part.alias("part"))
    joined = told.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n\n").alias("__context"))
    context = F.when(F.col("role").isin(*targets), F.substring("__context", 1, most))
    return df.join(joined, doc, "left").withColumn("context", F.coalesce(context, F.lit(""))).drop("__context")


def ticked(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Rows that the decisions (key, keep) keep."""
    return df.join(decisions.where("keep").select(key), key, "left_semi")


def sure_entities(df: DataFrame, doc: str, label: str = "LIVB", least: float = 0.8, longer_than: int = 3) -> DataFrame:
    """doc and its distinct texts of one label, of a high score and over three characters."""
    return df.where((F.col("label") == label) & (F.col("score") >= least) & (F.length("text") > longer_than)).select(doc, "text").distinct()


def related(df: DataFrame, key: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Keys of relations (key, rel, value) that for each predicate wanted have a value containing one of its words."""
    out = df.select(key).distinct()
    for rel, words in wanted.items():
        if words:
            hit = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("value"), w))
            out = out.join(df.where((F.col("rel") == rel) & hit).select(key), key, "left_semi")
    return out
