"""The cascade of coordinates: order of the tools, what each is asked, and what they find; bounded calls; names in texts."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import calls
from fieldloom.operators import geocode, mentions

GAZETTEER = "name string, ascii string, alternates string, lat double, lon double, feature string, population string, admin1 string, admin2 string, code string"


def test_tools_are_asked_in_order_and_for_the_rest_only(spark, tmp_path):
    rows = [
        (1, "Long Bay", "12°30'N", "77°15'E", "x"), (2, "Long Bay", "12.5", "77.25", "x"), (3, "Harbour", None, "77", "x"), (4, "HARBOUR!", "", None, "x"), (5, "at 415612 road", None, None, "x"),
        (6, "Seaview", None, None, "x"), (7, "old seaview", None, None, "x"), (8, "Elsewhere", None, None, "x"), (9, " Elsewhere ", None, None, "x"), (10, "Nowhere", None, None, "x"),
        (11, " ", None, None, "x"), (12, None, None, None, "x"), (13, "broken", None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "id long, where string, lat string, lon string, place string")
    names = spark.createDataFrame([("Harbour", 7, 1.0, 2.0), ("Harbour", 8, 9.0, 9.0), ("Else Post", 415612, 3.0, 4.0), ("Seaview", 9, None, 1.0)], "n string, id int, la double, lo double")
    gazetteer = spark.createDataFrame([
        ("Seaview", "Seaview", "", 5.0, 5.0, "A", "900", "1", "2", "ADM2"), ("Seaview", "Seaview", None, 6.0, 6.0, "P", "10", "1", "2", "PPL"), ("Seaview", "Seaview", "", 7.0, 7.0, "P", "x", "1", "3", "PPL"),
        ("New Town", "New Town", "Newtown,Old Seaview Point", 8.0, 8.0, "P", "5", "1", "2", "PPL"), ("Big", "Big", "the OLD SEAVIEW", 8.5, 8.5, "H", "50", "1", "2", "LK"), ("Nowhere", "", "", None, 1.0, "P", "1", "1", "1", "PPL"),
    ], GAZETTEER)

    def call(place):
        (tmp_path / f"{place}-{time.time_ns()}").write_text("")
        if place == "broken":
            raise RuntimeError(place)
        return (10.0, 20.0) if place == "Elsewhere" else None

    tools = [geocode.by_names(names, "n", "id", "la", "lo", "code"), geocode.by_gazetteer(gazetteer), geocode.by_provider(call, "provider")]
    out = geocode.geocoded(df, "where", "lat", "lon", tools)
    assert out.columns == ["id", "where", "place", "lat", "lon", "coordinate_source"]
    got = {r["id"]: (r["lat"], r["lon"], r["coordinate_source"]) for r in out.collect()}
    assert got == {
        1: (12.5, 77.25, "given"), 2: (12.5, 77.25, "given"), 3: (1.0, 2.0, "code_exact_100"), 4: (1.0, 2.0, "code_canonical_95"), 5: (3.0, 4.0, "code_code_90"), 6: (6.0, 6.0, "gazetteer"),
        7: (8.5, 8.5, "gazetteer"), 8: (10.0, 20.0, "provider"), 9: (10.0, 20.0, "provider"), **{k: (None, None, None) for k in (10, 11, 12, 13)},
    }
    out.count()
    asked = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert asked == ["Elsewhere", "Nowhere", "broken", "broken"]  # each once, and once more where it failed
    assert geocode.geocoded(df, "where", "lat", "lon", []).where("lat is not null").count() == 2
    assert geocode.geocoded(df.limit(0), "where", "lat", "lon", tools).collect() == []
    small = geocode.by_gazetteer(gazetteer, most=1)(spark.createDataFrame([("Newtown",), ("old seaview",), ("zz",)], "place string"))
    assert {r["place"]: r["lat"] for r in small.collect()} == {"Newtown": 8.0, "old seaview": 8.5}
    assert {r["name"]: r["district"] for r in geocode.with_district(gazetteer.where("feature <> 'A'"), gazetteer).where("admin2 <> '1'").select("name", "district").distinct().collect() if r["district"]} == {"Seaview": "Seaview", "New Town": "Seaview", "Big": "Seaview"}


def test_postal_codes(spark):
    df = spark.createDataFrame([("Ratnagiri 415612",), ("x4156123",), ("012345 or 234567.",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(geocode.code_in(F.col("t"))).collect()] == ["415612", None, "234567", None, None]


def test_calls_are_bounded_spaced_and_in_order(spark, tmp_path):
    def call(key):
        begun = time.time_ns()
        time.sleep(0.05)
        (tmp_path / f"{key}-{threading.get_ident()}-{begun}-{time.time_ns()}").write_text("")
        if key == "k3":
            raise ValueError("no")
        return key.upper()

    df = spark.createDataFrame([(i, None if i == 5 else f"k{i}") for i in range(20)], "i int, k string").coalesce(1)
    rows = calls.answered(df, "k", call, workers=3, rate=25, burst=2, tries=2).collect()
    assert [r["i"] for r in rows] == list(range(20))
    assert [r["answer"] for r in rows] == [None if i in (3, 5) else f"K{i}" for i in range(20)] and rows[3]["error"] == "no" and rows[5]["error"] is None
    spans = sorted(tuple(map(int, p.name.split("-")[2:])) for p in tmp_path.iterdir())
    assert len(spans) == 20  # 18 keys once, one that fails twice
    assert max(sum(a <= x < b for a, b in spans) for x, _ in spans) <= 3
    assert spans[-1][0] - spans[0][0] >= 0.9 * 1e9 * (20 - 2) / 25
    assert calls.answered(df.limit(0), "k", call).collect() == []
    with pytest.raises(ValueError):
        calls.answered(df.withColumn("error", F.lit(1)), "k", call)


def test_names_in_texts_equal_plain_search(spark):
    r = random.Random(2)
    words = ["sea", "reef", "a", "ab", "é", "coral", "sea reef", "reef a", "b.c"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(12))) + r.choice(["", ".", "sea"]) for _ in range(200)] + [None, "", "SEA reef"]
    names = ["Sea", "sea", "REEF A", "ab", "é", "b.c", None, " ", "unknown"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "d long, t string, start int")
    known = spark.createDataFrame([(n,) for n in names], "n string")

    def plain(t, whole):
        out = []
        for n in {n.lower() for n in names if n and n.strip()}:
            at = t.find(n)
            while at >= 0:
                end = at + len(n)
                inside = at and t[at - 1].isalnum() and t[at].isalnum() or end < len(t) and t[end].isalnum() and t[end - 1].isalnum()
                if not (whole and inside):
                    out.append((at, end, n))
                at = t.find(n, at + 1)
        return out

    for whole in (True, False):
        got = sorted((x["d"], x["start"], x["end"], x["form"]) for x in mentions.spans(df, known, "d", "t", "n", whole).collect())
        assert got == sorted((k, *s) for k, t in enumerate(texts) for s in plain((t or "").lower(), whole))
    assert mentions.spans(df, known.limit(0), "d", "t", "n").collect() == [] and mentions.spans(df.limit(0), known, "d", "t", "n").collect() == []
    with pytest.raises(ValueError):
        mentions.spans(df, known, "d", "t", "n", most=2)


def test_words_of_sentences_carry_no_text(spark, monkeypatch):
    """The rows that meet names are as many as words, none of them with its sentence."""
    long = " ".join(f"w{k}" for k in range(3000)) + " elysia obtusa"
    df = spark.createDataFrame([(1, long), (2, "Elysia obtusa. xelysia obtusa")], "d long, t string")
    names = spark.createDataFrame([("Elysia obtusa",), ("obtusa",)], "n string")
    expected = [(1, 0, "Elysia obtusa"), (1, 0, "obtusa"), (2, 0, "Elysia obtusa"), (2, 0, "obtusa"), (2, 1, "obtusa")]
    for most in (100, 1):  # by an automaton, and by joins
        monkeypatch.setattr(mentions, "MOST_NAMES", most)
        assert sorted(tuple(r) for r in mentions.sentence_mentions(df, names, "d", "t", "n").collect()) == expected
    assert mentions.sentence_mentions(df, names.limit(0), "d", "t", "n").collect() == []
