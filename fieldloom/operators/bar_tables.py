"""Sections with headings of both styles, bar tables, and what chunks are told of them. Null and empty texts have no rows."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.text import pack

#: Share of bars above which a text is mostly a table, and data rows that make one (fixed values).
DENSE, LEAST_ROWS = 0.07, 3

_HASHES = re.compile(r"#{1,4}\s+(\S.*)")
_UNDERLINE = re.compile(r"[=-]{3,}")
_RULE = re.compile(r"\|[\s:|-]+\|\s*")
_ROW = re.compile(r"\|[^\n]+\|")
TABLE = "array<struct<section:string,header:string,rows:int,text:string>>"


def headings(lines: list[str]) -> list[tuple[int, str]]:
    """(line, title) of headings with hashes, and of lines of 4 to 81 characters from a capital on that are underlined."""
    out = []
    for n, line in enumerate(lines):
        if found := _HASHES.match(line):
            out.append((n, found.group(1).strip()))
        elif re.fullmatch(r"[A-Z].{3,80}", line) and n + 1 < len(lines) and _UNDERLINE.match(lines[n + 1]):
            out.append((n, line.strip()))
    return out


def split_sections(text: str) -> list[tuple[str, str]]:
    """(title, text) of each section, its heading included; what stands before the first one is the preamble."""
    lines = text.split("\n")
    heads = headings(lines)
    cuts = [n for n, _ in heads] + [len(lines)]
    out = [(title, "\n".join(lines[n:end]).strip()) for (n, title), end in zip(heads, cuts[1:], strict=True)]
    before = "\n".join(lines[: cuts[0]]).strip()
    return [("Preamble", before), *out] if before and heads else out


def cut_sections(text: str, most: int, overlap: int) -> list[tuple[str, str]]:
    """(title, chunk): sections, each begun with the end of the one before; longer ones are packed by paragraphs and numbered. A text
    without headings is packed as a whole. No chunk is longer than `most`."""
    pieces = lambda t: pack([p for p in re.split(r"\n\s*\n", t) if p.strip()], most, overlap)
    out: list[tuple[str, str]] = []
    tail = ""
    for title, own in split_sections(text) or [("", text)]:
        whole = tail + "\n\n" + own if tail else own
        parts = [whole] if len(whole) <= most and whole.strip() else pieces(whole)
        out += [(title + (f" [{k}]" if len(parts) > 1 else ""), p) for k, p in enumerate(parts, 1)]
        tail = own[-overlap:] if overlap else ""
    return out


def section_chunks(df: DataFrame, keep: tuple[str, ...], text: str, most: int = 6000, overlap: int = 400) -> DataFrame:
    """keep, pos, section and chunk: whole texts cut at their headings. What a chunk holds depends on all before it, so Arrow batches do
    it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", pos int, section string, chunk string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [cut_sections(t, most, overlap) for t in f.pop("__text").fillna("")]
            f = f.assign(pos=[list(range(len(c))) for c in cut], section=[[s for s, _ in c] for c in cut], chunk=[[c for _, c in x] for x in cut])
            f = f[f["chunk"].map(len) > 0].explode(["pos", "section", "chunk"])
            yield f.astype({"pos": "int32"}) if len(f) else f.iloc[:0].astype({"pos": "int32", "section": "object", "chunk": "object"})

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)


def found_tables(text: str | None, near: int = 500) -> list[tuple[str, str, int, str]]:
    """(section, header, rows, text) of tables with a header, a line of dashes and three rows or more. The section is the last heading
    that begins up to `near` characters before, else that of the table before."""
    lines = (text or "").split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    heads = [(n, m.group(1).strip()) for n, x in enumerate(lines) if (m := _HASHES.match(x))]
    at = [n for n, _ in heads]
    out: list[tuple[str, str, int, str]] = []
    section, n = "Unknown Section", 0
    while n < len(lines):
        if n + 2 < len(lines) and _ROW.fullmatch(lines[n].rstrip()) and _RULE.fullmatch(lines[n + 1]):
            end = n + 2
            while end < len(lines) and _ROW.fullmatch(lines[end].rstrip()):
                end += 1
            if end - n - 2 >= LEAST_ROWS:
                k = bisect_left(at, n) - 1
                if k >= 0 and starts[at[k]] >= starts[n] - near:
                    section = heads[k][1]
                out.append((section, lines[n].strip(), end - n - 2, "\n".join(lines[n:end])))
            n = max(end, n + 1)
        else:
            n += 1
    return out


def tables_of(text: Column) -> Column:
    """The bar tables of a text."""

    @F.pandas_udf(TABLE)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("section", "header", "rows", "text"), x, strict=True)) for x in found_tables(t)])

    return find(text)


def with_headers(chunks: DataFrame, doc: str, chunk: str, tables: DataFrame) -> DataFrame:
    """chunks, where one that begins within a table (it has rows but no line of dashes, and its first line is in the table) gets the
    table's section and header before it. `tables` has one row (doc, tables) for each document; chunks without one stay."""
    own, empty = F.regexp_replace(F.col(chunk), r"^\s+|\s+$", ""), F.array().cast(TABLE)
    first = F.get(F.split(own, "\n", 2), F.lit(0))
    cut = F.col(chunk).rlike(r"(?m)^\|.+\|") & ~F.col(chunk).rlike(r"(?m)^\|[\s\-:|]+\|") & (first != "")
    hit = F.get(F.filter(F.coalesce("__tables", empty), lambda t: F.contains(t["text"], first)), F.lit(0))
    bars = F.length(hit["header"]) - F.length(F.replace(hit["header"], F.lit("|"), F.lit("")))
    before = F.concat(F.lit("[TABLE HEADER — '"), hit["section"], F.lit("']\n"), hit["header"], F.lit("\n|"), F.repeat(F.lit("---|"), bars - 1), F.lit("\n\n"))
    joined = chunks.join(tables.select(doc, F.col("tables").alias("__tables")), doc, "left")
    return joined.withColumn(chunk, F.when(cut & hit.isNotNull(), F.concat(before, F.col(chunk))).otherwise(F.col(chunk))).select(*chunks.columns)


def described(text: Column) -> Column:
    """dense (over 7 % bars), rows, header (the first row) and binomial (whether there is a two-part name) of a text; null gives null."""
    rows = F.regexp_extract_all(text, F.lit(r"(?m)^(\|.+\|)"), F.lit(1))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    known = F.struct(
        (bars > F.length(text) * DENSE).alias("dense"), F.size(rows).alias("rows"), F.coalesce(F.trim(F.get(rows, F.lit(0))), F.lit("")).alias("header"),
        text.rlike(r"\b[A-Z][a-z]{2,}\s+[a-z]{3,}\b").alias("binomial"),
    )
    return F.when(text.isNotNull(), known)


def prefixed(text: Column, citation: Column, rules: str) -> Column:
    """A text that is mostly a table after the number of its rows, its header, its source and the reader's rules; others as they are."""
    d = described(text)
    lines = F.filter(
        F.array(F.concat(F.lit("[TABLE CHUNK — "), d["rows"], F.lit(" rows detected]")), F.concat(F.lit("Source: "), F.nullif(citation, F.lit(""))), F.concat(F.lit("Column headers: "), F.nullif(d["header"], F.lit(""))), F.lit(rules)),
        lambda x: x.isNotNull() & (x != ""),
    )
    return F.when(d["dense"], F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), text)).otherwise(text)
