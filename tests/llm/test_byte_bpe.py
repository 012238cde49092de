"""Byte-level BPE against the library whose ids it gives, and back."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldloom.llm import byte_bpe

SCHEMA = "doc_id long, text string, n_tokens int"


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe._bpe("byte_bpe_multi_50k.tiktoken", P.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})


def some_text(r):
    m = r.random()
    if m < 0.3:
        points = [r.choice([r.randrange(32, 127), r.randrange(0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x20000)]) for _ in range(r.randrange(1, 30))]
        return "".join(map(chr, points))
    if m < 0.6:
        return "".join(r.choice("aabeth  ing\n\t\x1c\x85　'sS12") for _ in range(r.randrange(1, 60)))
    return "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 80)))


def test_ids_equal_the_library_s(bpe, library):
    r = random.Random(1)
    for t in [some_text(r) for _ in range(20_000)] + ["", " ", "  ", " a", "a ", "a\n b", "a\n  b", "a \n b  c", "x\x1c y\x85 z", "<|endoftext|> it's", "a‍b", "퟿", "\U0001f600 \U00033400x"]:
        assert bpe.ids(t).tolist() == library.encode_ordinary(t)
        assert byte_bpe._decoder("byte_bpe_multi_50k.tiktoken").decoded(bpe.ids(t)) == t.encode()


def test_long_runs_take_linear_time(bpe, library):
    for t in ("a" * 50_000, " " * 20_000 + "x", "ab" * 30_000, "=-" * 20_000, "0123456789abcdef" * 5000, "etaoin" * 20_000):
        assert bpe.ids(t).tolist() == library.encode_ordinary(t)


def test_backtracking_on_made_up_ranks(tmp_path):
    """Ranks in which longest matches are often wrong, against plain merging of the whole."""
    import base64

    r = random.Random(7)
    for trial in range(12):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 300:
            t = r.choice(tokens[97:100] + tokens[256:]) + r.choice(tokens[97:100] + tokens[256:])
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        extra = tokens[256:]
        r.shuffle(extra)  # some can then no longer be made by merging
        file = tmp_path / f"{trial}.tiktoken"
        file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens[:256] + extra)))
        own = byte_bpe.ByteBPE(str(file), "[abc]+|[^abc]+")
        library = tiktoken.Encoding("own", pat_str="[abc]+|[^abc]+", mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
        for _ in range(600):
            t = "".join(r.choice("abc") for _ in range(r.randrange(1, 40)))
            assert own.ids(t).tolist() == library.encode_ordinary(t)


def test_round_trip(spark, library):
    r = random.Random(3)
    texts = [some_text(r) for _ in range(300)] + [None, "", "x" * 9000, "le chat été " * 30_000, "same", "same"]
    df = spark.createDataFrame([(None if k % 40 == 1 else k, t, 7) for k, t in enumerate(texts)], SCHEMA)
    found = byte_bpe.decode(byte_bpe.encode(df, keep=("doc_id", "text", "n_tokens"))).collect()
    assert len(found) == len(texts)
    for x in found:
        assert x["ids"] == library.encode_ordinary(x["text"] or "") and bytes(x["decoded"]) == (x["text"] or "").encode() and x["n_tokens"] == 7


def test_small_batches_and_nulls(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"word {k}") for k in range(50)], "doc_id long, text string")
    assert byte_bpe.encode(df).count() == 50
    ids = spark.createDataFrame([(1, [72, 101]), (2, None), (3, [])], "k int, ids array<int>")
    assert sorted((x["k"], x["decoded"] is not None and bytes(x["decoded"])) for x in byte_bpe.decode(ids).collect())[1:] == [(2, False), (3, b"")]
    for bad in ([[60_000]], [[-1]], [[None]]):
        with pytest.raises(Exception, match="id"):
            byte_bpe.decode(spark.createDataFrame([(x,) for x in bad], "ids array<int>")).collect()


def test_refusals_and_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decode(byte_bpe.encode(empty)).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.encode(empty.withColumn("ids", F.lit(1)), keep=("ids",))
    with pytest.raises(ValueError):
        byte_bpe.decode(empty.select(F.array(F.lit(1)).alias("ids"), F.lit(1).alias("decoded")))
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), "(a)|b")
