"""Incremental state: buffers that flush, caches that age, windows; the same functions take streams where Spark allows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def flushed_by_count(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """With flush, the number of the group of n rows in which each row of a key leaves the buffer."""
    return df.withColumn("flush", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / n).cast("int"))


def flushed_by_size(df: DataFrame, key: str, order: str, text: str, chars: int, rows: int) -> DataFrame:
    """key, order and flush: a buffer empties when it holds so many characters or rows; what is left goes last.

    Where a group ends depends on where the last one did, so rows of a key are read in order, as a stream of batches that carry
    three numbers from one to the next.
    """
    sized = df.select(key, order, F.coalesce(F.length(text), F.lit(0)).alias("__n")).repartition(key).sortWithinPartitions(key, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(key, order).schema) + ", flush int"

    def run(frames):
        now, held, count, flush = object(), 0, 0, 0
        for f in frames:
            out = []
            for k, n in zip(f[key], f["__n"], strict=True):
                if k != now:
                    now, held, count, flush = k, 0, 0, 0
                out.append(flush)
                held, count = held + n, count + 1
                if held >= chars or count >= rows:
                    held, count, flush = 0, 0, flush + 1
            yield f[[key, order]].assign(flush=pd.array(out, "int32"))

    return sized.mapInPandas(run, schema)


def fresh(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of a cache not older than so many days."""
    return df.where((F.col(at) < now) & (F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")))


def windowed_counts(df: DataFrame, at: str, size: str, *keys: str, late: str | None = None) -> DataFrame:
    """Rows in each tumbling window; on a stream, rows later than `late` are left out and windows close."""
    if df.isStreaming and late:
        df = df.withWatermark(at, late)
    return df.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def new_documents(stream: DataFrame, content: str, at: str, late: str) -> DataFrame:
    """Each content once, within the time that duplicates may come late."""
    return stream.withColumn("doc_hash", F.sha1(F.col(content))).withWatermark(at, late).dropDuplicatesWithinWatermark(["doc_hash"])


def write_each(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream whose batches a function writes; the checkpoint makes each batch count once."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def buffered(stream: DataFrame, key: str, order: str, text: str, chars: int, rows: int, at: str, late: str, idle: int) -> DataFrame:
    """A stream's buffers: key, flush (its number), texts (in the order they came), n and chars, one row whenever a buffer is emptied.

    A key's buffer empties when it holds so many characters or rows, as flushed_by_size has it, and with what is left once the watermark
    (`late` behind the latest `at`) has passed its last row by `idle` seconds. State of a key holds fewer rows and characters than a flush,
    and the number of flushes; within one batch, rows of a key are taken by order. Null texts count as empty; a null key is a key;
    rows with a null `at` are left out. Append mode; a restart from the checkpoint goes on where it was.
    """
    rows_in = stream.select(F.col(key).alias("key"), F.col(order).alias("order"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(at).cast("timestamp").alias("at"))
    rows_in = rows_in.where("at is not null").withWatermark("at", late)
    kind = dict(rows_in.dtypes)["key"]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        texts, size, flush, last = state.get if state.exists else ([], 0, 0, 0)
        texts, out = list(texts), []

        def emptied() -> None:
            nonlocal texts, size, flush
            out.append((group[0], flush, texts, len(texts), size))
            texts, size, flush = [], 0, flush + 1

        if state.hasTimedOut:
            if texts:
                emptied()
            state.update((texts, size, flush, last))
        else:
            for row in pd.concat(list(frames)).sort_values("order", kind="stable").itertuples(index=False):
                texts.append(row.text)
                size += len(row.text)
                last = max(last, int(row.at.timestamp() * 1000))
                if size >= chars or len(texts) >= rows:
                    emptied()
            state.update((texts, size, flush, last))
            if texts:
                state.setTimeoutTimestamp(max(last + 1000 * idle, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "flush", "texts", "n", "chars"])

    return rows_in.groupBy("key").applyInPandasWithState(run, f"key {kind}, flush int, texts array<string>, n int, chars int", "texts array<string>, size int, flush int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def looked_up(stream: DataFrame, key: str, at: str, late: str, call: Callable[[str], str | None], keep: int) -> DataFrame:
    """A cache as stream state: key, at, value and cached for each request of a stream, which asks call for a key only if its last answer
    is `keep` seconds old or more, or if there is none.

    Requests of a key within one batch are answered in order of `at`. An answer that is None is kept as well; where call raises, the value is
    null and nothing is kept, so that the next request tries again. Old answers leave the state once the watermark has passed their
    end. Null keys are answered null without a call; rows with a null `at` are left out. State is as large as the keys asked for lately.
    """
    rows_in = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).where("at is not null").withWatermark("at", late)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, since, known = (*state.get, True) if state.exists else (None, 0, False)
        out = []
        for when in sorted(x for f in frames for x in f["at"]):
            ms = int(when.timestamp() * 1000)
            fresh_one = known and ms - since < 1000 * keep
            if not fresh_one and group[0] is not None:
                try:
                    value, since, known = call(group[0]), ms, True
                except Exception:  # noqa: BLE001  whatever an injected call raises
                    value, known = None, False
            out.append((group[0], when, value, fresh_one))
        if known:
            state.update((value, since))
            state.setTimeoutTimestamp(max(since + 1000 * keep, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at", "value", "cached"])

    return rows_in.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, value string, cached boolean", "value string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def refreshed(stream: DataFrame, keys: list[str], source: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a stream of changes that refreshes derived rows: for the dirty keys of each batch, source computes them anew, and they are
    written to path/batch=<number>.

    A batch that is run again after a failure overwrites its own folder, so its rows are there once. latest reads the newest rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        dirty = batch.select(*keys).distinct()
        source(dirty).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write_each(stream, write, checkpoint)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of the newest batch of each key that refreshed has written; null keys are one key."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("__newest"))
    same = [rows[k].eqNullSafe(newest[k]) for k in keys]
    return rows.join(newest, reduce(and_, same) & (rows["batch"] == newest["__newest"]), "left_semi").drop("batch")
