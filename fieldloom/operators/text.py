"""Texts to sections, paragraphs, sentences and chunks: native where a fixed frame will do, Arrow batches where packing is greedy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Section roles by words of their headings, the first that fits (fixed values).
ROLES = (("ABSTRACT", "abstract|summary"), ("METHODS", "method|material|study area|sampling"), ("RESULTS", "result|finding"), ("DISCUSSION", "discussion"), ("TAXONOMY", "taxonom|systematic|checklist"), ("REFERENCES", "reference|bibliograph|literature cited"))
BREAK = "\x01"


#: Abbreviations after whose full stop a sentence goes on (fixed values).
ABBREVIATIONS = ("Fig", "Figs", "sp", "spp", "cf", "aff", "et al", "var", "subsp", "Dr", "Prof", "No", "vol", "pp", "ca", "approx", "viz", "nov", "i.e", "e.g", "St", "Mt")


def sentences(c: Column, guard: bool = True) -> Column:
    """Split after a full stop, question or exclamation mark followed by white space; with guard, not after an abbreviation or an
    initial. No sentence is empty but that of an empty text; null gives null."""
    cut = F.regexp_replace(c, r"([.!?])\s+", f"$1{BREAK}")
    if guard:  # the search is for the break itself; what stands before it is only looked at there
        before = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
        cut = F.regexp_replace(cut, rf"\.{BREAK}(?<=(?:^|[^A-Za-z])(?:{before}|[A-Z])\.{BREAK})", ". ")
    return F.split(cut, BREAK)


def paragraphs(c: Column, longer_than: int = 20) -> Column:
    """Split at empty lines; short ones are left out."""
    return F.filter(F.split(c, r"\n\s*\n"), lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", "")) > longer_than)


def role(heading: Column) -> Column:
    low = F.lower(heading)
    out = None
    for name, pattern in ROLES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("OTHER")


def fixed_windows(df: DataFrame, text: str, size: int, overlap: int, least_step: int = 500) -> DataFrame:
    """One row for each window of `size` characters (column chunk, from offset), each `overlap` into the one before."""
    step = max(size - overlap, least_step)
    at = F.explode(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>")))
    return df.withColumn("offset", at).withColumn("chunk", F.substring(F.col(text), F.col("offset") + 1, F.lit(size))).drop(text)


def levels(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, level (0 section lead, 1 paragraph, 2 sentence), pos and text of each unit: the first 2000 characters, paragraphs of over
    20 and sentences of over 10."""
    lead = df.select(doc, F.lit(0).alias("level"), F.lit(0).alias("pos"), F.substring(text, 1, 2000).alias("text"))
    para = df.select(doc, F.lit(1).alias("level"), F.posexplode(paragraphs(F.col(text))).alias("pos", "text"))
    sent = df.select(doc, F.lit(2).alias("level"), F.posexplode(F.filter(sentences(F.col(text)), lambda s: F.length(s) > 10)).alias("pos", "text"))
    return lead.unionByName(para).unionByName(sent)


def nearby(df: DataFrame, doc: str, pos: str, flag: str, text: str, span: int = 5) -> DataFrame:
    """With near, the flagged texts up to `span` units before and after, in order."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(-span, span)
    return df.withColumn("near", F.collect_list(F.when(F.col(flag), F.col(text))).over(w))


def sections(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, section, heading, role, lines and body (these joined) by headings of one to four hashes; lines before the first make
    section 0 without a heading."""
    line = df.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    head = F.regexp_extract("line", r"^#{1,4}\s+(.*)$", 1)
    line = line.withColumn("heading", F.nullif(head, F.lit(""))).withColumn("section", F.count("heading").over(Window.partitionBy(doc).orderBy("n")).cast("int"))
    out = line.groupBy(doc, "section").agg(F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("body"), F.count_if(F.col("heading").isNull()).alias("lines"))
    return out.withColumn("role", role(F.coalesce("heading", F.lit(""))))


def table_stats(df: DataFrame, text: str) -> DataFrame:
    """With bars (their share of characters), rows (lines with two bars or more) and has_table (three such lines or more)."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2)
    bars = F.length(text) - F.length(F.replace(F.col(text), F.lit("|"), F.lit("")))
    return df.withColumn("bars", F.when(F.length(text) > 0, F.bround(bars / F.length(text), 4)).otherwise(0.0)).withColumn("rows", F.size(lines)).withColumn("has_table", F.col("rows") >= 3)


def is_table(piece: str) -> bool:
    return sum(line.count("|") >= 2 for line in piece.split("\n")) >= 2


def pack(pieces: list[str], most: int, overlap: int = 0, joint: str = "\n\n", uncut: Callable[[str], bool] = lambda piece: False) -> list[str]:
    """Greedy packing of pieces into chunks of at most `most` characters, each begun with the end of the one before (as much of it, up to
    `overlap`, as fits); a longer piece is cut. No chunk is longer than `most`, but for a piece that must stay uncut, which is a chunk of
    its own."""
    out: list[str] = []
    now = ""
    for piece in pieces:
        for part in [piece] if uncut(piece) else [piece[k : k + most] for k in range(0, len(piece), most)]:
            if now and len(now) + len(joint) + len(part) > most:
                out.append(now)
                room = min(overlap, most - len(joint) - len(part))
                now = now[-room:] + joint + part if room > 0 else part
            else:
                now = now + joint + part if now else part
    return [*out, now] if now else out


def keep_tables(text: str) -> list[str]:
    """Paragraphs of a text, in which lines of a bar table stay together with the heading right before them."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        if out and is_table(block) and out[-1].startswith("#") and "\n" not in out[-1]:
            out[-1] += "\n" + block
        elif block.strip():
            out.append(block)
    return out


def packed(df: DataFrame, keep: tuple[str, ...], text: str, most: int = 6000, overlap: int = 400, tables: bool = True) -> DataFrame:
    """keep, pos, chunk and oversize: paragraphs packed greedily, with overlap; with `tables` these stay uncut, and a chunk that is longer
    than `most` for that is oversize. What fits depends on all before it, so Arrow batches do it. Null and blank texts give no rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", pos int, chunk string, oversize boolean"
    cuts = lambda t: pack(keep_tables(t), most, overlap, uncut=is_table) if tables else pack([p for p in re.split(r"\n\s*\n", t) if p.strip()], most, overlap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [cuts(t) for t in f.pop("__text").fillna("")]
            f = f.assign(pos=[list(range(len(c))) for c in cut], chunk=cut)
            f = f[f["chunk"].map(len) > 0].explode(["pos", "chunk"])
            f = f.astype({"pos": "int32"}) if len(f) else f.iloc[:0].astype({"pos": "int32", "chunk": "object"})
            yield f.assign(oversize=f["chunk"].map(len).astype("int64") > most)

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)


def relevance(text: Column, full: Column, head: Column, tail: Column) -> Column:
    """How much a text is about a two-part name: .5 for all of it, .3 for the first part, .15 for its initial with the second, .05 for
    the second; 1 at most."""
    low = F.lower(text)
    has = lambda c, v: F.when(F.contains(low, F.lower(c)), v).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), has(full, 0.5) + has(head, 0.3) + has(F.concat(F.substring(head, 1, 1), F.lit(". "), tail), 0.15) + has(tail, 0.05)), 4)


def budgeted(df: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows of each key in order while their characters fit the budget; the last is cut."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).where(F.col("__before") < budget).withColumn(text, F.substring(F.col(text), F.lit(1), (budget - F.col("__before")).cast("int"))).drop("__before")


def page_range(chunk: Column, marker: str, share: Column, pages: Column) -> Column:
    """First and last page that markers in a chunk name; without markers the page at that share of the document, at least the first."""
    found = F.transform(F.regexp_extract_all(chunk, F.lit(marker), F.lit(1)), lambda p: p.try_cast("int"))
    guess = F.greatest(F.lit(1), F.bround(share * pages).cast("int"))
    return F.struct(F.coalesce(F.array_min(found), guess).alias("first"), F.coalesce(F.array_max(found), guess).alias("last"))
