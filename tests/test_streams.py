"""Stream state over several batches: buffers, a cache with an end, refreshed rows; and restarts."""

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldloom.streaming import state

BEGIN = datetime(2024, 1, 1)
SCHEMA = "k string, i long, t string, at timestamp"


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"k": k, "i": i, "t": t, "at": (BEGIN + timedelta(seconds=s)).isoformat()}) for k, i, t, s in rows]
    file = folder / f"{number:03}.json"
    file.write_text("\n".join(lines))
    os.utime(file, (1_700_000_000 + 10 * number,) * 2)  # batches come in this order


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def ran(df, tmp_path, name):
    query = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_buffers_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", "c", None]), i, None if i % 17 == 0 else "x" * r.randrange(9), i) for i in range(120)]
    for n in range(6):
        put(tmp_path / "in", n, rows[20 * n : 20 * n + 20])
    flushes = lambda: state.buffered(read(spark, tmp_path / "in"), "k", "i", "t", 20, 6, "at", "1 second", 30)
    ran(flushes(), tmp_path, "out")
    table = spark.createDataFrame([(k, i, t) for k, i, t, _ in rows], "k string, i long, t string")
    whole = state.flushed_by_size(table, "k", "i", "t", 20, 6).join(table.drop("k"), "i").groupBy("k", "flush").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("chars"))
    expected = {(x["k"], x["flush"], x["n"], x["chars"]) for x in whole.collect()}
    first = {(x["key"], x["flush"], x["n"], x["chars"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert first and all(n >= 6 or c >= 20 for _, _, n, c in first) and first == {x for x in expected if x[2] >= 6 or x[3] >= 20}
    # one late row of another key moves the watermark on: after a restart what was left goes by its timeout
    put(tmp_path / "in", 7, [("z", 900, "late", 500)])
    put(tmp_path / "in", 8, [("z", 901, "later", 501)])
    ran(flushes(), tmp_path, "out")
    rows_out = [(x["key"], x["flush"], x["n"], x["chars"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(rows_out) == len(set(rows_out)) and {x for x in rows_out if x[0] != "z"} == expected


def test_answers_are_kept_for_a_time(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def call(key):
        if key == "bad":
            raise ValueError(key)
        (log / f"{key}-{random.random()}").write_text("")
        return f"<{key}>"

    def asked():
        return state.looked_up(read(spark, tmp_path / "in"), "k", "at", "1 second", call, 60)

    put(tmp_path / "in", 0, [("a", 0, "", 0), ("a", 1, "", 30), ("b", 2, "", 31), ("bad", 3, "", 32), (None, 4, "", 33)])
    put(tmp_path / "in", 1, [("a", 5, "", 59), ("bad", 6, "", 59)])
    ran(asked(), tmp_path, "out")
    put(tmp_path / "in", 2, [("a", 7, "", 60), ("b", 8, "", 61)])  # after a restart: a is too old, b is not
    ran(asked(), tmp_path, "out")
    ran(asked(), tmp_path, "out")
    got = sorted((x["key"] or "", (x["at"] - BEGIN).total_seconds(), x["value"], x["cached"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("", 33, None, False), ("a", 0, "<a>", False), ("a", 30, "<a>", True), ("a", 59, "<a>", True), ("a", 60, "<a>", False),
        ("b", 31, "<b>", False), ("b", 61, "<b>", True), ("bad", 32, None, False), ("bad", 59, None, False),
    ]
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == ["a", "a", "b"]


def test_dirty_keys_are_refreshed_once(spark, tmp_path):
    table = {"a": 1, "b": 1, "c": 1}

    def source(dirty):
        return dirty.join(spark.createDataFrame(list(table.items()), "k string, v int"), "k")

    def go():
        state.refreshed(read(spark, tmp_path / "in"), ["k"], source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    put(tmp_path / "in", 0, [("a", 0, "", 0), ("a", 1, "", 1), ("b", 2, "", 2)])
    go()
    table["a"] = 2
    put(tmp_path / "in", 1, [("a", 3, "", 3), ("c", 4, "", 4)])
    go()
    go()
    assert sorted(tuple(r) for r in state.latest(spark, str(tmp_path / "out"), ["k"]).collect()) == [("a", 2), ("b", 1), ("c", 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
