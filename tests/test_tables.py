"""Bar tables, sections, study context, unique items, approval, exports and coordinates as scanned: cases and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators import articles, bar_tables, verify
from fieldloom.operators import review_rules as rules
from fieldloom.sources import files


@pytest.mark.parametrize(
    ("given", "expected"),
    [("N 17047'13.3", 17.7870278), ("E 73009'13.8", 73.1538333), ("17d47m13s", 17.7869444), ("S 12 30 36", -12.51), ("12O30'", 12.5), ("W 45.5", -45.5), ("−45.5", -45.5), ("N 12°30′36″", 12.51),
     ("12°30'36\" S", -12.51), ("12 30", None), ("12° 30", None), ("", None), (None, None)],
)
def test_scanned_degrees(spark, given, expected):
    assert spark.createDataFrame([(given,)], "c string").select(geo.parse_degrees(F.col("c"), False)).first()[0] == expected


def test_sections():
    text = "before\n\n# One\na\n\nTwo things\n----------\nb\n| - |\n#### Four\nc\n##### five"
    assert bar_tables.split_sections(text) == [("Preamble", "before"), ("One", "# One\na"), ("Two things", "Two things\n----------\nb\n| - |"), ("Four", "#### Four\nc\n##### five")]
    assert bar_tables.cut_sections(text, 100, 3)[1:3] == [("One", "ore\n\n# One\na"), ("Two things", "e\na\n\nTwo things\n----------\nb\n| - |")]
    assert bar_tables.cut_sections("", 10, 3) == bar_tables.cut_sections(" \n\n ", 10, 3) == []
    assert bar_tables.cut_sections("a\n\nb", 10, 3) == [("", "a\n\nb")]
    assert [s for s, _ in bar_tables.cut_sections("# A\n" + "x" * 30, 20, 4)] == ["A [1]", "A [2]"]


def test_no_section_is_lost():
    """No chunk is too long, and without overlap the chunks hold every character that is not white space, in order."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["# H\n", "Title\n===\n", "word ", "\n\n", "\n", "long" * 20]) for _ in range(rng.randrange(30)))
        for overlap in (0, 7):
            chunks = [c for _, c in bar_tables.cut_sections(text, 50, overlap)]
            assert all(len(c) <= 50 for c in chunks)
            if not overlap:
                assert "".join("".join(chunks).split()) == "".join(text.split())


def test_section_chunks(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, ""), (1, "# A\nx")], "id int, text string")
    assert sorted(map(tuple, bar_tables.section_chunks(df, ("id",), "text").collect())) == [(1, 0, "A", "# A\nx")] * 2
    assert bar_tables.section_chunks(df.where("id > 9"), ("id",), "text").count() == 0


def test_tables(spark):
    rows = "\n".join(f"| Elysia viridis | {k} |" for k in range(3))
    text = f"# Far\n{'y' * 600}\n| a | b |\n|---|---|\n{rows}\n\n## Near\n| c | d |\n|:-:|---|\n{rows}\n\n| e | f |\n|---|---|\n| 1 | 2 |"
    assert [(s, h, n) for s, h, n, _ in bar_tables.found_tables(text)] == [("Unknown Section", "| a | b |", 3), ("Near", "| c | d |", 3)]
    assert bar_tables.found_tables(None) == bar_tables.found_tables("") == []
    docs = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    tables = docs.select("id", bar_tables.tables_of(F.col("text")).alias("tables"))
    parts = ["| Elysia viridis | 2 |\nmore", "no table", None, "", "| a | b |\n|---|---|\n| x | y |", "| not there |"]
    df = spark.createDataFrame([(k, p) for k in (1, 2, 3) for p in parts], "id int, chunk string")
    got = bar_tables.with_headers(df, "id", "chunk", tables).collect()
    changed = [tuple(r) for r in got if r["chunk"] not in parts]
    assert len(got) == 18 and changed == [(1, "[TABLE HEADER — 'Unknown Section']\n| a | b |\n|---|---|\n\n" + parts[0])]
    told = spark.createDataFrame([(rows,), ("plain text here",), ("",), (None,)], "t string")
    said = [r[0] for r in told.select(bar_tables.prefixed(F.col("t"), F.lit("C 2020"), "")).collect()]
    assert said == [f"[TABLE CHUNK — 3 rows detected]\nSource: C 2020\nColumn headers: | Elysia viridis | 0 |\n\n{rows}", "plain text here", "", None]


def test_study_context(spark):
    body = "Collected at Gulf of Mannar and Gulf of Mannar near Table Two in May 2019, 2018-2019, at a depth of 5 m and 3-12 m"
    rows = [("d", 1, "Abstract", "ABSTRACT", "nothing"), ("d", 2, "Methods", "METHODS", body), ("d", 3, "R", "RESULTS", "x"), ("d", 4, "Other", "OTHER", "x"), ("e", 1, None, "RESULTS", None), ("e", 2, None, "METHODS", None)]
    df = spark.createDataFrame(rows, "doc string, section int, heading string, role string, body string")
    got = {(r["doc"], r["section"]): r["context"] for r in rules.with_study_context(df, "doc").collect()}
    assert got[("d", 3)] == "[STUDY CONTEXT from Methods section]\nLocalities: Collected, Gulf of Mannar, May\nCollection period: May 2019; 2018-2019\nDepth range: at a depth of 5 m; 3-12 m"
    assert {k: v for k, v in got.items() if v} == {("d", 3): got[("d", 3)]}


def test_unique_items(spark):
    rows = [("a", 1, "V1"), ("a", 2, "v1"), ("a", 3, None), ("a", 4, " "), ("a", 5, "v2"), ("b", 1, None), (None, 1, "v1")]
    df = spark.createDataFrame(rows, "k string, seq int, number string")
    got = lambda **more: {r["k"]: [i["seq"] for i in r["items"]] for r in articles.unique_items(df, "k", "seq", F.lower("number"), ["seq"], **more).collect()}
    assert got() == {"a": [1, 5], None: [1]}
    assert got(keep_blank=True) == {"a": [1, 3, 4, 5], "b": [1], None: [1]}
    assert got(keep_blank=True, most=2) == {"a": [4, 5], "b": [1], None: [1]}


def test_auto_approval(spark):
    rows = [("ACCEPTED", 90, "EXACT", None, True), ("ACCEPTED", 70, "EXACT", None, False), ("SYNONYM", None, "FUZZY", "12", True), ("SYNONYM", 99, "FUZZY", " ", False), ("ACCEPTED", 99, "HIGHERRANK", "1", False), (None, None, None, None, False)]
    df = spark.createDataFrame(rows, "status string, score int, match string, id string, expected boolean")
    assert df.where(rules.auto_approved(F.col("status"), F.col("score"), F.col("match"), F.col("id"), 80) != F.col("expected")).count() == 0


def test_authorities_in_their_own_order(spark):
    a = spark.createDataFrame([("elysia viridis", "Ax", "Ay", 0.9)], "key string, x string, y string, score double")
    b = spark.createDataFrame([("elysia viridis", "Bx", "By", 1.0)], "key string, x string, y string, score double")
    df = spark.createDataFrame([("Elysia viridis", "own", None), (None, "own", None)], "name string, x string, y string")
    got = lambda first: {r["name"]: (r["x"], r["y"]) for r in verify.verified(df, "name", {"a": a, "b": b}, ["x", "y"], first=first).collect()}
    assert got(None) == {"Elysia viridis": ("own", "Ay"), None: ("own", None)}
    assert got({"x": ("b",), "y": ("b",)}) == {"Elysia viridis": ("Bx", "By"), None: ("own", None)}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("2", "M", "b", 1), ("1", "M", "a", 2), ("3", "A", "z", 3)], "atom_id string, phylum string, valid_name string, extra int")
    files.write_export(df, f"file://{tmp_path}/out")
    lines = [x for p in sorted((tmp_path / "out").glob("part-*.csv")) for x in p.read_text().splitlines()]
    assert lines[0] == ",".join(files.EXPORT_COLUMNS) or lines[0].replace('"', "") == ",".join(files.EXPORT_COLUMNS)
    assert [x.split(",")[0].strip('"') for x in lines if "atom_id" not in x] == ["3", "1", "2"]


def test_fields_of_descriptions(spark):
    """Own sentences for each field of a description."""
    from fieldloom.operators import morphology

    text = (
        "Glossodoris rufa n. sp. (Rüppell & Leuckart, 1828). Type locality: the outer reef of Marsa Bay; length 12.5 to 30 mm alive. Holotype: USNM 12345, paratypes NHM/MOLL/77. "
        "Radula 45 x 20.1.20. Leg. A. B. Müller Nair, kept in the Natural History Museum. Also AB-2020.5512, re-described later."
    )
    f = spark.createDataFrame([(text,), ("",), (None,), ("Re-described by none",), ("First record of it, up to 4 mm",)], "t string").select(morphology.fields(F.col("t")).alias("f"), morphology.signal(F.col("t")).alias("s")).select("f.*", "s").collect()
    first = f[0]
    assert first["authority"] == "(Rüppell & Leuckart, 1828)" and first["status"] == "sp. nov." and first["type_status"] == "holotype" and first["type_place"] == "the outer reef of Marsa Bay"
    assert first["size_mm"] == [12.5, 30.0] and first["radula"] == "45 x 20.1.20" and first["collector"] == "A. B. Müller Nair" and first["repository"] == "Natural History Museum" or first["repository"] == "USNM"
    assert first["vouchers"] == ["USNM 12345", "NHM/MOLL/77", "AB-2020.5512"] and first["s"] == 11
    assert f[1]["status"] is None and f[2]["size_mm"] is None and f[3]["status"] == "re-description" and f[4]["status"] == "new record" and f[4]["s"] == 3
    around = spark.createDataFrame([("İİİ x Name y", "NAME")], "t string, n string").select(morphology.around(F.col("t"), F.col("n"), 2)).first()[0]
    assert around == "x Name y"
