"""Periodic runs against plain comparison at every distance."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import periodicity
from fieldloom.llm._arrays import text_arrays

SCHEMA = "doc_id long, text string, start int, words string"


def plain_runs(w, least=24, times=3):
    out, seen = [], set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= max(least, times * q):
                    out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(r):
    n, letters = r.randrange(0, 120), r.choice([1, 2, 2, 3, 5, 20])
    w = [r.randrange(letters) for _ in range(n)]
    if r.random() < 0.5 and n > 10:
        a = r.randrange(n)
        p = 1 + (n - a) // (3 + r.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    if r.random() < 0.2 and n:
        w = (w[: r.randrange(1, 8)] * r.randrange(1, 6) + [r.randrange(letters)]) * r.randrange(1, 5) + w
    return w


@pytest.mark.parametrize("least", [3, 8, 24])
def test_runs_equal_plain_ones(least):
    r = random.Random(least)
    for _ in range(1500):
        w = sequence(r)
        assert periodicity.runs(w, least) == plain_runs(w, least)


def test_long_sequences():
    assert periodicity.runs([1] * 200_000) == [(0, 200_000, 1)]
    assert periodicity.runs(list(range(6000)) * 3) == [(0, 18_000, 6000)]
    block = (list(range(100)) * 5 + [-1]) * 8
    assert periodicity.runs(block) == plain_runs(block) and len(periodicity.runs(block)) == 9


def test_only_suspects_hold_runs():
    r = random.Random(9)
    docs = [sequence(r) for _ in range(800)]
    buf, offsets = text_arrays(pa.array([" ".join(map(str, w)) for w in docs]))
    found = set(periodicity._suspects(buf, offsets, 24, 3).tolist())
    with_runs = {k for k, w in enumerate(docs) if plain_runs(w)}
    assert with_runs <= found and len(found) < 700


def made(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not w or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_documents_with_everything(spark):
    r = random.Random(2)
    spaces = [" ", "\n", "\t ", "\x0b", "\r\n"]
    texts = ["".join(f"é{x}" + r.choice(spaces) for x in sequence(r)) for _ in range(200)]
    texts += [None, "", " \n", "a\x85b c " * 30, "x" * 5000, "a b " * 4000, texts[0], texts[0]]
    rows = [(None if k % 37 == 3 else k, t, 1, "w") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = periodicity.find_runs(periodicity.made_periodic(df), keep=("doc_id", "start", "words"))
    found = found.withColumn("top", periodicity.strongest(F.col("runs")))
    got = sorted((str(x["doc_id"]), [tuple(y) for y in x["runs"]], x["collapsed"], x["top"] and tuple(x["top"])) for x in found.collect())
    expected = []
    for doc_id, text, *_ in rows:
        w = made(doc_id, text)
        own = plain_runs(w)
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        top = min(own, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        expected.append((str(doc_id), own, " ".join(x for i, x in enumerate(w) if i not in gone), top))
    assert got == sorted(expected)
    assert len([x for x in got if x[1]]) > 30


def test_refusals_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periodicity.find_runs(periodicity.made_periodic(empty)).collect() == []
    with pytest.raises(ValueError):
        periodicity.find_runs(empty.withColumn("runs", F.lit(1)), keep=("runs",))
    with pytest.raises(ValueError):
        periodicity.find_runs(empty, times=2)


def test_query_on_a_small_table(spark):
    """Every column of the registered query against plain ones."""
    from fieldloom.llm import queries

    rows = {x["doc_id"]: x for x in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w, x = made(d["doc_id"], d["text"]), rows[d["doc_id"]]
        own = plain_runs(w)
        gone = {i for s, n, q in own for i in range(s + q, s + n)}
        assert x["n_runs"] == len(own)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(" ".join(y for i, y in enumerate(w) if i not in gone).encode()).hexdigest()
        top = min(own, key=lambda y: (-Fraction(y[1], y[2]), y[0], y[2]), default=None)
        assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
