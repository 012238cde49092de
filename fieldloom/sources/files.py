"""Sources and sinks: lines of tables with unsure headers, cached documents, scanned text, exports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.values import select_or_null
from fieldloom.sources.tables import shared_dir


def read_tsv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A tab-separated file with a header, all strings; a mark of byte order is dropped, missing columns are an error."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def mapped(header: Sequence[str], wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """For each wanted column the first header that contains one of its words, whatever the case."""
    out = {}
    for name, words in wanted.items():
        out[name] = next((h for h in header if any(w in h.lower() for w in words)), "")
    return {k: v for k, v in out.items() if v}


def parse_lines(lines: DataFrame, header: Sequence[str], wanted: Mapping[str, Sequence[str]], types: Mapping[str, str], sep: str = "\t") -> DataFrame:
    """Wanted columns of separated lines (column value), coerced; what cannot be is null."""
    place = {h: i for i, h in enumerate(header)}
    parts = F.split(F.regexp_replace("value", "^﻿", ""), sep)
    return lines.select(*[F.get(parts, F.lit(place[h])).try_cast(types[name]).alias(name) for name, h in mapped(header, wanted).items()])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of any kind with their cache key: the hash of size and first four megabytes."""
    df = spark.read.format("binaryFile").load(path)
    return df.withColumn("cache_key", F.sha2(F.concat(F.col("length").cast("string").cast("binary"), F.substring("content", 1, 4 << 20)), 256))


def first_parse(df: DataFrame, content: str, parsers: Sequence) -> DataFrame:
    """df with text, from the first of several functions of a binary column that gives more than blanks."""
    tries = [F.nullif(F.regexp_replace(p(F.col(content)), r"^\s+|\s+$", ""), F.lit("")) for p in parsers]
    return df.withColumn("text", F.coalesce(*tries))


def is_scanned(pages: Column, least: int = 80) -> Column:
    """Whether an array of page texts has fewer characters a page than a text layer would."""
    return F.aggregate(pages, F.lit(0), lambda a, p: a + F.length(p)) / F.greatest(F.lit(1), F.size(pages)) < least


def clean_scan(c: Column, trim_lines: bool = True) -> Column:
    """Form feeds as empty lines, three line breaks or more as two, hyphens at line ends joined, blanks at line ends dropped."""
    c = F.replace(c, F.lit("\f"), F.lit("\n\n"))
    c = F.regexp_replace(c, "([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, "(?m)[ \t]+$", "") if trim_lines else c


def write_csv(df: DataFrame, columns: Sequence[str], order: Sequence[str], path: str) -> None:
    """The columns in the given order of rows as CSV files with headers."""
    df.select(*columns).orderBy(*order).write.csv(path, header=True, quoteAll=True)


#: Columns of an export of memory rows, in order (fixed values).
EXPORT_COLUMNS = (
    "atom_id", "session_id", "valid_name", "recorded_name", "phylum", "class_", "order_", "family_", "taxon_rank", "taxonomic_status", "worms_id", "itis_id", "name_according_to", "locality",
    "latitude", "longitude", "geocoding_src", "habitat", "occurrence_type", "sampling_date", "depth_m", "method", "raw_evidence", "source_citation", "confidence", "times_confirmed",
    "first_seen", "last_seen",
)


def export_rows(df: DataFrame) -> DataFrame:
    """The 28 columns of an export in their order, as text; those that df lacks are null, further ones are left out."""
    return select_or_null(df, dict.fromkeys(EXPORT_COLUMNS, "string"))


def write_export(df: DataFrame, path: str) -> None:
    """The export as CSV files, by phylum, family_ and valid_name, rows with equal ones by atom_id."""
    write_csv(export_rows(df), EXPORT_COLUMNS, ("phylum", "family_", "valid_name", "atom_id"), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_graphml(lines: DataFrame, path: str) -> None:
    """Lines with part and key as text files; their names sort as the lines do."""
    lines.orderBy("part", "key").select("line").write.text(path)


def round_trip_csv(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What write_csv has written, read again with the types of df."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom/export-{uuid.uuid4().hex}"
    write_csv(df, columns, order, path)
    return spark.read.csv(path, header=True, schema=df.select(*columns).schema)
