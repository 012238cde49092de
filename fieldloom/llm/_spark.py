"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode, where the session names none, as in tests.

    On a cluster a missing setting is an error: what one executor writes to its own disk, others cannot read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table written to the shared folder and read again: the lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` gave, once nothing reads them any more; other tables are left alone."""
    for df in tables:
        if path := df.__dict__.pop("written_to", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of df followed by the columns of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def hash_share(key: Column, share: float) -> Column:
    """Whether a 64-bit hash of key falls in the lowest share of its range: the same rows at every run, whatever their order."""
    return F.xxhash64(key.cast("string"), F.lit("share")).cast("double") < -(2.0**63) + min(1.0, share) * 2.0**64
