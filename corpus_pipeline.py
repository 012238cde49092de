"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, and the mix of sources, in this order.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of documents, extra ones included (the last one: the
mix). It works on all rows its predecessor kept; an empty table gives an empty one. Rows with a null id are documents of their own,
told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontamination, mixing, pii, quality, simhash
from fieldloom.llm._spark import dropped, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_quality(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of several rows with this id, one.

    Near-duplicates are texts of a similarity of 0.8 or more in five-word shingles. None below it is linked; above it candidates are found by
    min-hashes, so that a few links may be missed (97 % or more are found at 0.8, see the README).
    """
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit no word, or under one word in twenty; null and empty texts stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows included, personal data replaced by its kind, n_chars counted anew; a null text stays null."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: copies, words taken and first position of each document, by position."""
    found = mixing.mix(docs)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", F.try_element_at("positions", F.lit(1)).alias("position"))


STAGES = [("quality", classify), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("personal data", mask), ("mix", mix)]

#: The quality model and the fingerprints have no SQL form; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what a stage gave is deleted once the next one's result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
