"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def dealt(df: DataFrame, *keys: str, of: DataFrame | None = None, rows: int = 500_000) -> DataFrame:
    """df dealt out by keys to as many partitions as leave each about `rows` rows of the table `of` (df itself by default), which is counted:
    a table as read costs only its footers. What a task holds then does not grow with the table, nor do few files leave tasks idle."""
    n = (df if of is None else of).count()
    return df.repartition(max(1, -(-n // rows)), *keys)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written and read again: its lineage ends, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/fieldloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
