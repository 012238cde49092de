"""Chunks for extraction: sentence packing, ranking, quotas, parents and batches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import text as texts
from fieldloom.sources.tables import dealt


def packed_ranges(lengths: Sequence[int], budget: int, again: int = 0, again_chars: int = 400) -> list[tuple[int, int]]:
    """First sentence (from 0) and number of sentences of each chunk: sentences joined by one character while they fit the budget; one that is
    longer by itself is a chunk of its own. With `again`, a chunk begins with the last sentence of the one before, if that had several
    and it has no more than again_chars: each adds a new one."""
    out: list[tuple[int, int]] = []
    first = size = new = 0
    for k, n in enumerate(lengths):
        if k > first and size + 1 + n > budget:
            out.append((first, k - first))
            last = lengths[k - 1]
            over = again and new > 1 and last <= again_chars and last + 1 + n <= budget
            first, size, new = (k - 1, last, 0) if over else (k, 0, 0)
        size += n + (k > first)
        new += 1
    return [*out, (first, len(lengths) - first)] if len(lengths) else out


def pack_sentences(sentences: Sequence[str], budget: int, again: int = 0, again_chars: int = 400) -> list[str]:
    """The chunks of packed_ranges, joined by spaces."""
    return [" ".join(sentences[k : k + n]) for k, n in packed_ranges([len(s) for s in sentences], budget, again, again_chars)]


#: What Python's strip takes for white space.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"


def sentence_chunks(df: DataFrame, keep: tuple[str, ...], text: str, budget: int = 1800, context: str | None = None, again: int = 0) -> DataFrame:
    """keep, pos and chunk: sentences packed greedily; a text within the budget is one chunk as it is. With a column of context, its
    length and 200 characters are taken off the budget (one sentence goes through all the same), and it stands before each chunk. Null
    and blank texts give no rows. What fits depends on all before it, so Python does it, on the sentences' lengths alone: texts
    stay where they are, and a batch is a few numbers for each of its rows."""
    before = F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    room = F.lit(budget) - (F.length(before) + 200 if context else 0)
    blank = lambda s: s.rlike(rf"\A{_BLANK}\z")
    own = df.select(*keep, F.col(text).alias("__text"), before.alias("__before"), room.alias("__room")).where(F.col("__text").isNotNull() & ~blank(F.col("__text")))
    whole = F.length("__text") <= F.col("__room")
    own = own.withColumn("__sentences", F.when(whole, F.array("__text")).otherwise(F.filter(texts.sentences(F.col("__text")), lambda s: ~blank(s)))).drop("__text")

    @F.pandas_udf("array<struct<first:int,n:int>>")
    def ranges(lengths: pd.Series, rooms: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "n": n} for a, n in packed_ranges(x.tolist(), room, again)] for x, room in zip(lengths, rooms, strict=True)], dtype=object)

    cut = own.withColumn("__ranges", ranges(F.transform("__sentences", lambda s: F.length(s)), F.col("__room")))
    joined = F.array_join(F.slice("__sentences", F.col("__r.first") + 1, F.col("__r.n")), " ")
    chunk = F.when(F.col("__before") != "", F.concat("__before", F.lit("\n\n"), joined)).otherwise(joined)
    return cut.select("*", F.posexplode("__ranges").alias("pos", "__r")).select(*keep, "pos", chunk.alias("chunk"))


def ranked(df: DataFrame, key: str, score: str, text: str, seq: str, least: float = 0.25, most: int = 6, prefix: int = 120) -> DataFrame:
    """Rows of each key with a score of at least `least`, the best first (ties by seq), of equal beginnings one, `most` at most; with
    rank. Rows are cut to the best of each beginning before any window."""
    some = df.where(F.col(score) >= least)
    row = F.struct(*df.columns)
    one = some.groupBy(key, F.substring(text, 1, prefix).alias("__p")).agg(F.min_by(row, F.struct((-F.col(score)).alias("s"), F.col(seq).alias("q"))).alias("r")).select("r.*")
    w = Window.partitionBy(key).orderBy(F.desc(score), F.col(seq))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def by_keywords(df: DataFrame, key: str, seq: str, text: str, keywords: Sequence[str], most: int = 4) -> DataFrame:
    """Of each key the rows that contain most keywords, ties by seq, `most` at most (rows without any may be among them); with hits."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc("hits"), F.col(seq))
    return df.withColumn("hits", hits).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")


def quotas(df: DataFrame, key: str, seq: str, text: str, budget: int = 3000, least: int = 200) -> DataFrame:
    """Each text cut to an equal share of the key's budget, `least` characters at least, in order until the budget is reached."""
    n = df.groupBy(key).agg(F.count("*").alias("__n"))
    cut = df.join(n, key).withColumn(text, F.substring(F.col(text), F.lit(1), F.greatest(F.lit(least), F.floor(F.lit(budget) / F.col("__n"))).cast("int")))
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__before", before).where(F.col("__before") < budget).drop("__before", "__n")


def with_parent(sentences: DataFrame, paragraphs: DataFrame, doc: str, prefix: int = 300, of: DataFrame | None = None) -> DataFrame:
    """sentences (doc, start, end, parent: the beginning of their paragraph's text) with para: the first paragraph (doc, para, start, end,
    text) of the document that begins with it, else the one in whose range the sentence lies (paragraphs do not overlap), else null.

    Both are windows over both tables, dealt out once by document, not a comparison of all pairs. With `of`, a table of about as many rows,
    it is its size that says to how many tasks.
    """
    found = F.struct(F.col("para").alias("para"), F.col("end").cast("long").alias("stop"))
    mark = paragraphs.select(*[F.col(c) if c in (doc, "start") else F.lit(None).cast(t).alias(c) for c, t in sentences.dtypes], F.substring("text", 1, prefix).alias("__begin"), found.alias("__p"), F.lit(0).alias("__s"))
    own = sentences.withColumn("__begin", F.col("parent")).withColumn("__p", F.lit(None).cast(mark.schema["__p"].dataType)).withColumn("__s", F.lit(1))
    both = own.unionByName(mark)
    both = dealt(both, doc, of=of) if of is not None else both.repartition(doc)
    by_text = F.when(F.col(doc).isNotNull() & F.col("__begin").isNotNull(), F.min("__p.para").over(Window.partitionBy(doc, "__begin")))
    w = Window.partitionBy(doc).orderBy("start", "__s").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__by_text", by_text).withColumn("__last", F.last("__p", ignorenulls=True).over(w)).where("__s = 1")
    within = F.when(F.col("end") <= F.col("__last.stop"), F.col("__last.para"))
    return seen.select(*sentences.columns, F.coalesce("__by_text", within).cast("long").alias("para"))


def extraction_batches(paragraphs: DataFrame, sentences: DataFrame, doc: str, intro: int = 400, near: int = 5) -> DataFrame:
    """doc, para, text, intro and places: each paragraph (doc, para, section, text) with the first characters of its section, and the
    sentences with a place (doc, para, pos, text, has_place) up to `near` before and after its middle sentence, in order."""
    first = paragraphs.groupBy(doc, "section").agg(F.substring(F.min_by("text", "para"), 1, intro).alias("intro"))
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(-near, near)
    around = sentences.withColumn("places", F.collect_list(F.when(F.col("has_place"), F.col("text"))).over(w))
    order = F.row_number().over(Window.partitionBy(doc, "para").orderBy("pos"))
    size = F.count("*").over(Window.partitionBy(doc, "para"))
    middle = around.withColumn("__n", order).withColumn("__of", size).where(F.col("__n") == F.floor(F.col("__of") / 2) + 1).select(doc, "para", "places")
    return paragraphs.join(first, [doc, "section"]).join(middle, [doc, "para"]).select(doc, "para", "text", "intro", "places")


def priority(role: Column) -> Column:
    """How urgent a section is: 1 for results and taxonomy, .6 for any other."""
    return F.when(role.isin("RESULTS", "TAXONOMY"), 1.0).otherwise(0.6)
