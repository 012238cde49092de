"""Relation triples out of replies, and the tables that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import repair
from fieldloom.functions.names import relation_type
from fieldloom.functions.values import strip

#: Relations that a triple may have (fixed values).
RELATIONS = ("FOUND_AT", "CO_OCCURS_WITH", "INHABITS", "FEEDS_ON", "PARASITE_OF", "OBSERVED_AT_DEPTH", "SYMBIONT_OF", "COMPETITOR_OF")
_ITEM = "subject string, relation string, object string, evidence string, confidence string"


def asked(text: Column, known: Column, most_names: int = 20, most_chars: int = 4000) -> Column:
    """What goes to the callable that reads relations: the distinct names, stripped, in order, and the text, both capped, as a struct;
    null, so that nothing is called, where there are no names or the text is blank."""
    names = F.array_distinct(F.filter(F.transform(known, lambda n: strip(n)), lambda n: n != ""))
    ready = (F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0) & (strip(F.coalesce(text, F.lit(""))) != "")
    return F.when(ready, F.struct(F.slice(names, 1, most_names).alias("names"), F.substring(text, 1, most_chars).alias("text")))


def clamped(c: Column) -> Column:
    """A confidence between 0 and 1; 1 where it is missing or no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(1.0))))


def triples(reply: Column, least: float = 0.5) -> Column:
    """The triples (subject, relation, object, evidence, confidence) of a reply, in its order: of the list it is or holds. Those with
    a blank subject or object, or a confidence under `least`, are left out; relations are capitals, repaired where they contain a known
    one; confidence is cut to 0 to 1 after that. A reply that is no list, blank or null gives none."""
    items = F.transform(repair.only_list(reply), lambda o: F.from_json(o, _ITEM))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    sure = lambda x: F.coalesce(x["confidence"].try_cast("double"), F.lit(1.0))
    kept = F.filter(items, lambda x: x.isNotNull() & (text(x["subject"]) != "") & (text(x["object"]) != "") & (sure(x) >= least))
    return F.transform(kept, lambda x: F.struct(
        text(x["subject"]).alias("subject"), relation_type(text(x["relation"]), RELATIONS).alias("relation"), text(x["object"]).alias("object"),
        text(x["evidence"]).alias("evidence"), clamped(x["confidence"]).alias("confidence"),
    ))


def relation_rows(df: DataFrame, reply: str, keep: Sequence[str]) -> DataFrame:
    """One row for each triple of each reply: the columns keep (citation, hash of the file), its place in the reply, and its fields."""
    return df.select(*keep, F.posexplode(triples(F.col(reply))).alias("pos", "t")).select(*keep, "pos", "t.*")


def skip_existing(new: DataFrame, stored: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """New rows whose keys are not stored yet, of equal ones the first; null keys are keys like any other."""
    same = lambda d: d.select("*", F.struct(*[F.col(k).isNull() for k in keys], *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("__key"))
    left = same(new).join(same(stored).select("__key").distinct(), "__key", "left_anti")
    row = F.struct(*new.columns)
    return left.groupBy("__key").agg(F.min_by(row, seq).alias("r")).select("r.*")
