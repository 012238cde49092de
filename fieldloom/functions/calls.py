"""Callables of models, networks and parsers as columns; the engine's results never need one."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(call: Callable[[str], str | None], default: str | None = None) -> Callable[[Column], Column]:
    """A function of one text as a function of columns, called in Arrow batches, once for each distinct text of a batch; where it
    raises, the default is taken, so that one failing call does not stop a job."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        seen: dict = {}
        for t in texts.unique():
            try:
                seen[t] = None if t is None else call(t)
            except Exception:  # noqa: BLE001  whatever an injected call raises
                seen[t] = default
        return texts.map(seen)

    return run


def label_in(reply: Column, labels: tuple[str, ...], default: str) -> Column:
    """The first label that a reply contains, whatever the case."""
    low = F.lower(F.coalesce(reply, F.lit("")))
    out = None
    for label in labels:
        out = F.when(F.contains(low, F.lit(label.lower())), label) if out is None else out.when(F.contains(low, F.lit(label.lower())), label)
    return out.otherwise(default)


def traits(reply: Column, names: tuple[str, ...], default: float = 0.5) -> Column:
    """Named numbers of a JSON reply between 0 and 1, the default where one is missing, in the order of the names."""
    m = F.from_json(reply, "map<string,double>")
    return F.array(*[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(default)))) for n in names])


def corrected(texts: DataFrame, extract: Callable[[DataFrame], DataFrame], doc: str, key: str, stated: Column, share: float = 0.95, tries: int = 2) -> DataFrame:
    """What `extract` finds in texts, again for documents where it found fewer than `share` of the stated number, at most so often more;
    rows of all rounds, each (doc, key) once."""
    found = extract(texts).dropDuplicates([doc, key])
    wanted = texts.select(doc, stated.alias("__stated"))
    for _ in range(tries):
        n = found.groupBy(doc).agg(F.count("*").alias("__n"))
        short = wanted.join(n, doc, "left").where(F.coalesce("__n", F.lit(0)) < share * F.col("__stated")).select(doc)
        again = extract(texts.join(short, doc, "left_semi"))
        found = found.unionByName(again.join(found.select(doc, key), [doc, key], "left_anti").dropDuplicates([doc, key]))
    return found


class Bucket:
    """Lets calls through at a rate a second, up to `burst` at once after a pause; shared by the threads of one worker."""

    def __init__(self, rate: float, burst: int):
        self.rate, self.burst, self.held, self.at = rate, burst, float(burst), time.monotonic()
        self.lock = threading.Lock()

    def wait(self) -> None:
        """Returns when the caller's turn has come; turns are given in the order they are asked for."""
        with self.lock:
            now = time.monotonic()
            self.held = min(self.burst, self.held + (now - self.at) * self.rate) - 1
            self.at = now
            pause = max(0.0, -self.held / self.rate)
        time.sleep(pause)


def answered(df: DataFrame, key: str, call: Callable[[str], str | None], workers: int = 4, rate: float | None = None, burst: int = 1, tries: int = 1) -> DataFrame:
    """The columns of df with answer and error: what call returns for each row's key, at most `workers` calls at once in a task.

    rate (calls a second, for each task, so a limit for the whole job is it times the tasks that run at once) and burst space the calls.
    A call that raises is tried again up to `tries` times in all; then answer is null and error its message, and other rows go on. Null
    keys are not asked. Rows keep their order, an empty table gives an empty result, and columns called answer or error are refused. A
    task that is run again asks again: give distinct keys, and write the result.
    """
    if {"answer", "error"} & {c.lower() for c in df.columns}:
        raise ValueError("a column is called answer or error, as a result is")
    at, names = df.columns.index(key), [*df.columns, "answer", "error"]
    schema = df.select("*").schema.add("answer", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(rate, burst) if rate else None

        def one(k: str | None) -> tuple[str | None, str | None]:
            if k is None:
                return None, None
            for left in range(tries - 1, -1, -1):
                if bucket:
                    bucket.wait()
                try:
                    return call(k), None
                except Exception as e:  # noqa: BLE001  whatever an injected call raises
                    if not left:
                        return None, str(e) or type(e).__name__
            return None, None

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                for k in range(0, len(b), 1024):
                    part = b.slice(k, 1024)
                    found = list(pool.map(one, part.column(at).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=names)

    return df.mapInArrow(run, schema)
