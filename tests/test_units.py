"""Cases of single functions that the driver's tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import calls, geo, names, repair, values
from fieldloom.operators import articles, chunks, dedup, graph, lookup, mentions, memory, morphology, records, relations, review_rules, text, verify
from fieldloom.streaming import state
from fieldloom.plans import graph_queries, rule_queries, text_queries  # noqa: F401
from fieldloom.plans.registry import QUERIES


def one(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "expected"), [("Elysia obtusa Baba, 1938", "elysia obtusa"), ("Elysia (Genus) cf. obtusa", "elysia obtusa"), ("  ", ""), ("A.  b;", "a. b")])
def test_canon_name(spark, given, expected):
    assert one(spark, names.canon_name(F.col("c")), c=given) == expected


def test_priority_dedup_ties(spark):
    df = spark.createDataFrame([(0, "a", "secondary", "long text"), (1, "a", "primary", "x"), (2, "a", "Primary", "y"), (3, "b", None, None), (4, "b", "uncertain", "")], "seq int, k string, type string, text string")
    got = {r["k"]: (r["seq"], r["first_seq"]) for r in dedup.priority_dedup(df, ["k"], dedup.type_priority(F.col("type")), F.col("text")).collect()}
    assert got == {"a": (1, 0), "b": (4, 3)}


def test_blank_and_missing(spark):
    assert one(spark, values.first_filled(F.col("a"), F.col("b")), a=" \t", b=" x ") == "x"
    df = spark.createDataFrame([(1,)], "a int")
    assert values.select_or_null(df, {"a": "long", "b": "string"}).first().asDict() == {"a": 1, "b": None}
    assert one(spark, values.round_even(F.lit(2.5))) == 2


@pytest.mark.parametrize(("given", "expected"), [("12°30'S", -12.5), ("12 deg 30' 36\" N", 12.51), ("-45.5", -45.5), ("95.0", None), ("abc", None), ("0.0", 0.0)])
def test_degrees(spark, given, expected):
    assert one(spark, geo.parse_degrees(F.col("c"), True), c=given) == expected


def test_json_repair(spark):
    assert one(spark, F.size(repair.objects(F.col("c"), 1)), c='<think>{"a":1}</think>```json\n[{"b": 1}, {"b": 2}, {"b"') == 2
    nested = '[{"name":"E","taxonomy":{"phylum":"M"}},{"note":"a } b"}]'
    assert [json.loads(x) for x in one(spark, repair.objects(F.col("c")), c=nested)] == json.loads(nested)
    broken = 'so: {"name":"E","taxonomy":{"phylum":"M"}}, {"note":"a } b", "k": "\\"{"}, {"x": 1}, {"name": '
    assert [json.loads(x) for x in one(spark, repair.objects(F.col("c")), c=broken)] == [{"name": "E", "taxonomy": {"phylum": "M"}}, {"note": "a } b", "k": '"{'}]
    assert [json.loads(x) for x in one(spark, repair.objects(F.col("c")), c='{"n": 1, "items": [{"a": {"b": 2}}, 3], "more": []}')] == [{"a": {"b": 2}}]
    assert [json.loads(x) for x in one(spark, repair.objects(F.col("c")), c='{"a": {"b": 1}}')] == [{"a": {"b": 1}}]
    assert [json.loads(x) for x in one(spark, repair.objects(F.col("c")), c='Found: [ {"a": 1}, {"b": [1]} ] done')] == [{"a": 1}, {"b": [1]}]
    for empty in ("[]", "", None, "nothing", "[1, 2]"):
        assert spark.createDataFrame([(empty,)], "c string").select(F.size(repair.objects(F.col("c")))).first()[0] == 0
    assert one(spark, F.size(repair.objects(F.col("c"))), c="[]") == 0
    assert one(spark, F.size(repair.objects(F.col("c"), 2)), c='so {"a": 1}') == 0


def test_staging_and_commit(spark):
    batch = spark.createDataFrame([(1, "Elysia", "Bay"), (2, "elysia ", "bay"), (3, "__candidate_1", "x"), (4, "Nereis", "Reef")], "seq int, name string, place string")
    staged = spark.createDataFrame([("NEREIS", "reef", "pending")], "name string, place string, status string")
    assert [r["seq"] for r in records.stage(batch, staged, "name", "place", "seq", F.lit(None).cast("double")).collect()] == [1]
    main, after = records.commit(spark.createDataFrame([(1, "verified"), (2, "pending"), (3, "edited")], "id int, status string"))
    assert sorted(r["id"] for r in main.collect()) == [1, 3]
    assert {r["id"]: r["status"] for r in after.collect()} == {1: "committed", 2: "pending", 3: "committed"}


def test_rollback_then_update(spark):
    history = articles.versions(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, seq int, body string"), "key", "seq")
    back = articles.rollback(history, "key", spark.createDataFrame([("k", 1)], "key string, to_version int"))
    assert [(r["version"], r["body"]) for r in back.orderBy("version").collect()] == [(1, "a"), (2, "b"), (3, "a")]


def test_co_occurrence_counts_pairs_once(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("h", "a"), ("i", "b"), ("i", "a")], "g string, x string")
    assert [tuple(r) for r in graph.co_occurrence(df, "g", "x").collect()] == [("a", "b", 2)]


def test_cascade_ways(spark):
    q = spark.createDataFrame([("Harbour",), ("HARBOUR!",), ("Harbor",), ("no such 123456 place",), ("zzz",), (None,)], "q string")
    n = spark.createDataFrame([("Harbour", 7), ("Harbour", 9), ("Else", 123456)], "n string, id int")
    got = {r["q"]: (r["how"], r["id"]) for r in lookup.cascade(q, n, "q", "n", "id").collect()}
    assert got == {"Harbour": ("exact", "7"), "HARBOUR!": ("canonical", "7"), "Harbor": ("fuzzy", "7"), "no such 123456 place": ("code", "123456"), "zzz": ("none", None)}


def test_nearest_before(spark):
    points = spark.createDataFrame([("k", 5.0), ("k", 30.0), ("m", 1.0)], "k string, at double")
    marks = spark.createDataFrame([("k", 4.0, "a"), ("k", 5.0, "b"), ("k", 6.0, "c")], "k string, at double, v string")
    assert {(r["k"], r["at"]): r["near_v"] for r in lookup.nearest_before(points, marks, "k", "at", "v", 10).collect()} == {("k", 5.0): "b", ("k", 30.0): None, ("m", 1.0): None}


def test_nearest_on_either_side(spark):
    points = spark.createDataFrame([("k", 5.0), ("k", 30.0), ("k", 8.0), ("k", 7.0), ("k", None), ("m", 1.0), (None, 1.0)], "k string, at double")
    marks = spark.createDataFrame([("k", 4.0, "a"), ("k", 10.0, "d"), ("k", 10.0, "c"), ("m", 2.0, "e"), ("m", None, "f"), (None, 3.0, "g")], "k string, at double, v string")
    expected = {("k", 5.0): "a", ("k", 30.0): None, ("k", 8.0): "c", ("k", 7.0): "a", ("k", None): None, ("m", 1.0): "e", (None, 1.0): None}
    assert {(r["k"], r["at"]): r["near_v"] for r in lookup.nearest(points, marks, "k", "at", "v", 10).collect()} == expected


def test_trigrams_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 250 + "xyz"), (2, "ab"), (3, None)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("ABCD",), ("bcde",)], "n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, "Abcx"), (2, "ab"), (3, "x" * 250 + "CDE")], "p_partkey int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert {r["doc_id"]: r["n"] for r in QUERIES["trigram_counts_whole"](spark, str(tmp_path)).where("doc_id < 3").collect()} == {1: 4, 2: 0}
    assert {r["p_partkey"]: (r["n"], r["score"]) for r in QUERIES["trigram_scores"](spark, str(tmp_path)).collect()} == {1: (2, 0.5), 2: (0, 0.0), 3: (4, 0.25)}


def test_all_spans_and_top_nodes(spark, tmp_path):
    spark.createDataFrame([(1, k, "a") for k in (1, 3, 5)], "user_id int, event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(900, 70), (900, 80), (901, 70)], "l_partkey int, l_suppkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(70, 1), (80, 1)], "s_suppkey int, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [(r["start"], r["end"], r["pieces"]) for r in QUERIES["merged_spans_all"](spark, str(tmp_path)).collect()] == [(1, 8, 3)]
    assert {(r["src"], r["tgt"]) for r in QUERIES["induced_top_subgraph"](spark, str(tmp_path)).collect()} == {("P900", "S70"), ("P900", "S80"), ("P901", "S70")}
    edges = spark.createDataFrame([("P1", "N1"), ("P2", "N1"), ("P2", "N2")], "src string, tgt string")
    assert [r["node_id"] for r in graph.top_by_degree(edges, 1, spark.createDataFrame([("P1",), ("P2",)], "node_id string")).collect()] == ["P2"]


def test_sentence_mentions(spark):
    texts = spark.createDataFrame([(1, "We saw ELYSIA obtusa here. Elysia was there! No obtusa."), (2, "Elysia. obtusa"), (3, None)], "d int, t string")
    names = spark.createDataFrame([("Elysia obtusa",), ("Elysia obtusa",), ("elysia",), (None,)], "name string")
    assert sorted((r["d"], r["sentence"], r["name"]) for r in mentions.sentence_mentions(texts, names, "d", "t", "name").collect()) == [(1, 0, "Elysia obtusa"), (1, 0, "elysia"), (1, 1, "elysia"), (2, 0, "elysia")]


def test_packing_keeps_tables():
    table = "# Heading\n\n" + "\n".join("| a | b |" for _ in range(30))
    chunks = text.pack(text.keep_tables("intro\n\n" + table + "\n\nend"), 60, uncut=text.is_table)
    assert any(c.count("| a | b |") == 30 and "# Heading" in c for c in chunks)
    assert text.pack(["x" * 100], 10) == ["x" * 10] * 10
    assert text.pack([], 10) == []


def test_size_buffer(spark):
    df = spark.createDataFrame([("a", i, "x" * 5) for i in range(5)] + [("b", 0, None)], "k string, i int, t string")
    got = {(r["k"], r["i"]): r["flush"] for r in state.flushed_by_size(df, "k", "i", "t", 10, 8).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 0): 0}


def test_search_falls_back(spark):
    df = spark.createDataFrame([("Elysia obtusa",), ("Nereis",)], "n string")
    assert [r["n"] for r in memory.search(df, "n", "elysia obtuza").collect()] == ["Elysia obtusa"]
    assert memory.search(df, "n", "zzzzzz").count() == 0


def test_search_of_all_names(spark, tmp_path):
    """The operator can give all hits, and the query does: 60 of 61 names."""
    import __spark_entry__

    df = spark.createDataFrame([(i, f"Widget {i}") for i in range(60)] + [(60, "other")], "p_partkey long, p_name string")
    assert memory.search(df, "p_name", "wIDGET").count() == 50
    assert memory.search(df, "p_name", "wIDGET", most=None).count() == 60
    assert [r["p_partkey"] for r in memory.search(df, "p_name", "othr", most=None).collect()] == [60]
    df.write.parquet(f"{tmp_path}/part.parquet")
    assert __spark_entry__.queries()["name_search"](spark, str(tmp_path)).count() == 60



def test_stream_counts(spark, tmp_path):
    spark.range(10).selectExpr("id", "timestamp_seconds(id * 600) AS ts", "'a' AS k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, k string").parquet(str(tmp_path / "in"))
    seen = []
    windowed = state.windowed_counts(stream, "ts", "1 hour", "k", late="1 hour")
    q = windowed.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum({(r["start"], r["k"]): r["n"] for r in seen}.values()) == 10


def test_calls_fail_softly(spark):
    def call(s):
        if s == "bad":
            raise ValueError(s)
        return s.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "s string")
    assert [r["x"] for r in df.select(calls.as_column(call, "?")(F.col("s")).alias("x")).collect()] == ["A", "?", None]
    assert one(spark, calls.traits(F.col("c"), ("a", "b", "c")), c='{"a": 2, "b": -1}') == [1.0, 0.0, 0.5]


def test_corrected_asks_again_where_few_are_found(spark):
    texts = spark.createDataFrame([(1, "2 of them"), (2, "1 of them")], "doc int, text string")
    rounds = []

    def extract(df):
        rounds.append(1)
        return df.select("doc", F.lit(f"name{len(rounds)}").alias("name"))

    got = calls.corrected(texts, extract, "doc", "name", F.regexp_extract("text", "([0-9]+)", 1).cast("int"), tries=1)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "name1"), (1, "name2"), (2, "name1")]


def test_spans_have_offsets(spark):
    got = one(spark, review_rules.spans(F.col("c"), "[0-9]+", "n"), c="é12 x 3")
    assert [(s["start"], s["end"], s["text"]) for s in got] == [(1, 3, "12"), (6, 7, "3")]


def test_graphml_lines(spark):
    nodes = spark.createDataFrame([("a", "x<y"), ("b", "z")], "node_id string, label string")
    edges = spark.createDataFrame([("a", "R", "b")], "src string, rel string, tgt string")
    lines = [r["line"] for r in graph.graphml(nodes, edges).orderBy("part", "key").collect()]
    assert lines[0].startswith("<graphml") and lines[-1] == "</graph></graphml>" and "x&lt;y" in lines[1] and len(lines) == 5


def test_dedup_keeps_null_keys(spark):
    df = spark.createDataFrame([(0, None, "secondary", "x"), (1, None, "primary", None), (2, "a", "primary", "y")], "seq int, k string, type string, text string")
    assert {(r["k"], r["seq"], r["first_seq"]) for r in dedup.priority_dedup(df, ["k"], dedup.type_priority(F.col("type")), F.col("text")).collect()} == {(None, 1, 0), ("a", 2, 2)}
    assert dedup.priority_dedup(df.limit(0), ["k"], dedup.type_priority(F.col("type")), F.col("text")).count() == 0


def test_cascade_keys(spark):
    names_ = spark.createDataFrame([("x1", "大阪", 1), ("100001", "Harbour", 5), ("100000", "Harbour", 2), ("z", "Longbeach", 3), ("z2", None, 4)], "id string, n string, seq int")
    q = spark.createDataFrame([("東京",), ("大阪",), ("harbour!",), ("Longbeech",), ("code 100001",), (None,), ("Harbour",)], "q string")
    got = {r["q"]: (r["id"], r["how"]) for r in lookup.cascade(q, names_, "q", "n", "id", order=F.col("seq")).collect()}
    assert got == {"東京": (None, "none"), "大阪": ("x1", "exact"), "harbour!": ("100000", "canonical"), "Longbeech": ("z", "fuzzy"), "code 100001": ("100001", "code"), "Harbour": ("100000", "exact")}


def test_fuzzy_matches_equal_all_pairs(spark):
    """The pieces on which queries and names meet lose no pair that is close enough."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(2, 14)))
    known = sorted({word() for _ in range(150)})
    asked = sorted({word() for _ in range(150)} - set(known))

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return 2 * row[-1] / (len(a) + len(b))

    expected = {}
    for a in asked:
        fits = [(-ratio(a, b), b) for b in known]
        fits = [f for f in fits if -f[0] >= (0.92 if len(a) <= 4 else 0.8)]
        if fits:
            expected[a] = min(fits)[1]
    names_ = spark.createDataFrame([(b, b) for b in known], "id string, n string")
    got = lookup.cascade(spark.createDataFrame([(a,) for a in asked], "q string"), names_, "q", "n", "id")
    assert {x["q"]: x["id"] for x in got.where("how = 'fuzzy'").collect()} == expected and expected


def test_replies_with_repeated_ranks(spark):
    reply = '{"usage": {"name": {"scientificName": "E v"}, "status": "ACCEPTED"}, "classification": [{"rank": "Phylum", "name": "A"}, {"rank": "PHYLUM", "name": "B"}, {"name": "C"}]}'
    assert one(spark, verify.parsed_reply(F.col("c"))["ranks"], c=reply) == {"phylum": "B"}
    table = spark.createDataFrame([("e v", "x", 0.5), ("e v", "y", 0.9), ("e v", "b", 0.9)], "key string, family string, score double")
    df = spark.createDataFrame([("E v",)], "name string")
    assert verify.verified(df, "name", {"one": table}, ["family"]).first()["family"] == "b"


def test_merged_spans_within_others(spark):
    df = spark.createDataFrame([("d", 0, 100, "L"), ("d", 5, 10, "L"), ("d", 101, 110, "L"), ("d", 120, 125, "L"), ("d", 126, 127, "M"), ("d", 128, 130, "L")], "doc string, start int, end int, label string")
    got = sorted((r["start"], r["end"], r["label"], r["pieces"]) for r in review_rules.merged_spans(df, "doc").collect())
    assert got == [(0, 110, "L", 3), (120, 125, "L", 1), (126, 127, "M", 1), (128, 130, "L", 1)]


def test_sentences_after_abbreviations(spark):
    assert one(spark, text.sentences(F.col("c")), c="See Fig. 2 of E. viridis. It was cf. red! Yes? No. 5 is sp. nov. here.") == ["See Fig. 2 of E. viridis.", "It was cf. red!", "Yes?", "No. 5 is sp. nov. here."]


@pytest.mark.parametrize("given", ["Elysia obtusa Rüppell, 1828", "Elysia obtusa (Ørsted & Åsmund, 1901)"])
def test_accented_authors(spark, given):
    assert one(spark, names.canon_name(F.col("c")), c=given) == "elysia obtusa"


def test_chunks_stay_in_their_budget():
    import random

    r = random.Random(2)
    for _ in range(300):
        pieces = ["x" * r.randrange(1, 90) for _ in range(r.randrange(0, 12))]
        most, overlap = r.randrange(5, 60), r.randrange(0, 30)
        chunks = text.pack(pieces, most, overlap)
        assert all(len(c) <= most for c in chunks)
        assert sum(c.count("x") for c in text.pack(pieces, most)) == sum(map(len, pieces))


def test_offices_and_boxes(spark):
    offices = spark.createDataFrame([(1, "Narara Bay"), (2, "Narara"), (3, "Oaks"), (4, ""), (5, None)], "seq int, office string")
    q = spark.createDataFrame([("narara",), ("Bay",), ("The Oaks Road",), ("zz",), ("",), (None,), ("a",)], "q string")
    got = {r["q"]: r["seq"] for r in lookup.office_match(q, offices, "q", "office", "seq").collect()}
    assert got == {"narara": 2, "Bay": 1, "The Oaks Road": 3, "zz": None, "a": 1}
    stations = spark.createDataFrame([("d", 1, "s1", "Harbour"), ("d", 2, "st", "Reef")], "doc string, seq int, id string, place string")
    df = spark.createDataFrame([("d", "Station S1"), ("d", "S"), ("d", ""), ("e", "S1"), ("d", "x")], "doc string, place string")
    assert {(r["doc"], r["place"]): r["station_place"] for r in lookup.resolved_stations(df, "place", stations, "doc").collect()} == {("d", "Station S1"): "Harbour", ("d", "S"): "Harbour", ("d", ""): None, ("e", "S1"): None, ("d", "x"): None}


def test_relation_triples(spark):
    got = lambda reply: [tuple(x) for x in spark.createDataFrame([(reply,)], "c string").select(relations.triples(F.col("c"))).first()[0]]
    assert got('[{"subject": "E", "relation": "  found_at  ", "object": "Bay", "confidence": 1.5}]') == [("E", "FOUND_AT", "Bay", "", 1.0)]
    assert got('[{"subject": "E", "relation": "IS FOUND_AT HERE", "object": "B", "evidence": " x ", "confidence": "0.7"}]') == [("E", "FOUND_AT", "B", "x", 0.7)]
    assert got('<think>[{"a": 1}]</think>```json\n[{"subject": "E", "relation": "PREVIOUSLY INHABITS", "object": "{x}"}]```') == [("E", "INHABITS", "{x}", "", 1.0)]
    assert got('[{"subject": "E", "relation": "unknown_rel", "object": "B", "confidence": null}, {"subject": "E", "relation": "x", "object": "B", "confidence": 0.4}, 7]') == [("E", "UNKNOWN_REL", "B", "", 1.0)]
    for none in ('[{"subject": " ", "relation": "X", "object": "B"}]', '[{"subject": "E", "object": "B"', "[]", "", None, '{"subject": "E", "relation": "R", "object": "B"}', '[{"subject": "E", "relation": "R", "object": "B", "confidence": -0.5}]'):
        assert got(none) == [], none
    calls = spark.createDataFrame([("text", ["A ", "A", "", "B"]), (" ", ["A"]), ("t", []), ("t", None), (None, ["A"])], "t string, k array<string>").select(relations.asked(F.col("t"), F.col("k")).alias("a")).collect()
    assert [c["a"] and tuple(c["a"]) for c in calls] == [(["A", "B"], "text"), None, None, None, None]
    new = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4)], "k string, seq int")
    assert {r["seq"] for r in relations.skip_existing(new, new.where("k = 'a'"), ["k"], "seq").collect()} == {1, 4}
    assert {r["seq"] for r in relations.skip_existing(new, new.where("k is null"), ["k"], "seq").collect()} == {3, 4}


def test_sentence_packing(spark):
    import random

    r = random.Random(3)
    for _ in range(200):
        sentences = ["w" * r.randrange(1, 40) + "." for _ in range(r.randrange(0, 15))]
        budget = r.randrange(5, 80)
        got = chunks.pack_sentences(sentences, budget)
        assert " ".join(got) == " ".join(sentences) and all(len(c) <= budget or " " not in c for c in got)
        for x, y in zip(got, got[1:], strict=False):  # greedy: the next sentence did not fit
            assert len(x) + 1 + len(y.split(" ")[0]) > budget
        over = chunks.pack_sentences(sentences, budget, again=1)
        assert all(len(c) <= budget or " " not in c for c in over) and [s for c in over for s in c.split(" ")][-1:] == sentences[-1:]
    df = spark.createDataFrame([(1, "One. Two here. Three.", "ctx"), (2, None, None), (3, " ", "c"), (4, "short", "c")], "id int, t string, c string")
    assert [(x["id"], x["pos"], x["chunk"]) for x in chunks.sentence_chunks(df, ("id",), "t", 10).orderBy("id", "pos").collect()] == [(1, 0, "One."), (1, 1, "Two here."), (1, 2, "Three."), (4, 0, "short")]
    assert chunks.sentence_chunks(df, ("id",), "t", 217, "c", 1).where("id = 1").count() == 2
    assert chunks.sentence_chunks(df.limit(0), ("id",), "t", 10).count() == 0


def test_sentence_chunks_send_lengths(spark):
    """Python gets the lengths of sentences, not the texts; chunks are those of packing sentence by sentence."""
    import random

    r = random.Random(5)
    rows = [(i, r.choice(["", " ", "\x1c\u2003"]) + r.choice([" ", "\n"]).join("w" * r.randrange(1, 30) + r.choice([".", "?", ". \u3000. ", ""]) for _ in range(r.randrange(0, 40))), r.choice([None, "", "c" * 9])) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, "\x1c\x85\u3000 ", "c"), (901, None, None)], "id int, t string, c string")
    sentences = {x["id"]: [s for s in x["s"] if s.strip()] for x in df.where("t is not null").select("id", text.sentences(F.col("t")).alias("s")).collect()}
    for context, again in ((None, 0), ("c", 1)):
        got = chunks.sentence_chunks(df, ("id",), "t", 300, context, again)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "ArrowEvalPython" in plan
        expected = []
        for i, t, c in rows:
            before = (c or "") if context else ""
            room = 300 - len(before) - 200 if context else 300
            if t.strip():
                own = [t] if len(t) <= room else chunks.pack_sentences(sentences[i], room, again)
                expected += [(i, k, before + "\n\n" + x if before else x) for k, x in enumerate(own)]
        assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 150



def test_recall_in_two_ways(spark):
    rows = spark.createDataFrame([(i, " ".join(w * (i % (k + 2)) for k, w in enumerate(("coral ", "reef ", "shore ", "tide "))) + f"word{i % 7}") for i in range(40)], "doc_id int, text string")
    index = memory.tokens(rows, "doc_id", "text")
    q = memory.tokens(rows.where("doc_id % 9 = 1").withColumnRenamed("doc_id", "qid"), "qid", "text").select("qid", "token", F.col("tf").alias("weight"))
    one, two = (sorted(map(tuple, x.select("qid", "doc_id", "rank").collect())) for x in (memory.recall(memory.tfidf(index, "doc_id"), q, "doc_id", "qid", 5), memory.recalled(index, q, "doc_id", "qid", 5)))
    assert one == two and one
    assert memory.recalled(index.limit(0), q, "doc_id", "qid", 5).count() == 0


def test_scores_by_common_and_rare_tokens(spark, tmp_path):
    """Scores are those of tfidf, whatever is broadcast; the count of matches orders no index by document, as a window did."""
    import __spark_entry__

    rows = spark.createDataFrame([(i % 37 if i else None, " ".join(f"word{j}" for j in range(1, 2 + i % 11)) + f" own{i} reef") for i in range(60)] + [(99, None), (98, "a b")], "doc_id int, text string")
    index = memory.whole_index(rows, "doc_id", "text")
    assert sorted(map(str, index.collect())) == sorted(map(str, memory.tokens(rows, "doc_id", "text").collect()))
    q = spark.createDataFrame([(1, "word3", 2), (1, "own7", 1), (2, "own8", 1), (2, "none", 1), (3, "reef", 1)], "qid int, token string, weight int")
    plain = memory.tfidf(index, "doc_id").join(q.withColumnRenamed("weight", "qw"), "token").where("doc_id is not null").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
    expected = sorted(map(tuple, plain.collect()))
    for common, few in ((1000, 100_000), (2, 100_000), (3, 0)):
        assert sorted(map(tuple, memory.scored(index, q, "doc_id", "qid", common, few).collect())) == expected
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word3 reef"), (2, "own8 nothing"), (3, "zz")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = __spark_entry__.queries()["tfidf_matches"](spark, str(tmp_path))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(1, 37), (2, 1)}



def test_scores_move_no_pairs(spark):
    """Postings of the queries' tokens go to the document's task, by the size of the index; pairs of query and document are summed there."""
    rows = spark.createDataFrame([(i % 50 if i else None, f"reef coral tide{i % 3} own{i} reef") for i in range(120)] + [(90, "zz"), (91, None)], "doc_id int, text string")
    index = memory.whole_index(rows, "doc_id", "text")
    q = spark.createDataFrame([(g, t, w) for g in range(8) for t, w in (("reef", 1), ("coral", g), (f"own{g}", 2), ("none", 1))] + [(None, "tide1", 1)], "qid int, token string, weight int")
    plain = memory.tfidf(index, "doc_id").join(q.withColumnRenamed("weight", "qw"), "token").where("doc_id is not null").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
    expected = sorted(map(str, plain.collect()))
    for few in (100_000, 0):
        assert sorted(map(str, memory.scored(index, q, "doc_id", "qid", 2, few, 40).collect())) == expected
    got = memory.scored(index, q, "doc_id", "qid", rows=40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan
    assert got.rdd.getNumPartitions() == -(-index.count() // 40) > 4



def test_morphology_around_names(spark):
    df = spark.createDataFrame([("a (b) c A (B)", "a (b)"), ("abc" * 2000, "zz"), (None, "x"), ("abc", ""), ("abc", None)], "t string, n string")
    got = [r["x"] for r in df.select(morphology.around(F.col("t"), F.col("n"), 2, 9).alias("x")).collect()]
    assert got == ["a (b) c c A (B)", "abcabcabc", "", "abc", "abc"]
    assert one(spark, morphology.sizes(F.col("c")), c="up to 3.5 – 10 mm, also 2 mm") == [2.0, 10.0]
    assert spark.createDataFrame([(None,)], "c string").select(morphology.fields(F.col("c")).alias("f")).select("f.*").first().asDict()["status"] is None


def test_morphology_of_few_files(spark, tmp_path):
    """Rows of one file go to several tasks, and the context of a name is found once, not by each field."""
    import __spark_entry__

    spark.range(12_000).selectExpr("id AS p_partkey", "concat('ring ', id) AS p_name", "cast(id % 40 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["morphology_fields"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in got.where("p_partkey = 11").collect()] == [(11, "Smith, 1900", "sp. nov.", "holotype", "ZSI/AB/11", "Rao Patel", 11, 16)]
    assert got.count() == 12_000
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1



def test_places_apart(spark):
    cases = {"Narara, Pirotan, Beyt Dwarka": 1, "Narara; Pirotan; Beyt; Dwarka": 4, "Narara Island, Gulf of Kutch": 1, "Site A (Narara, intertidal)": 1, "Narara": 1, "": 1}
    cases["Narara, Pirotan, Beyt Dwarka"] = 3
    for c, n in cases.items():
        assert one(spark, F.size(geo.separate_places(F.col("c"))), c=c) == n, c
    assert one(spark, values.distinct_names(F.col("c")), c=["b", " B", None, "", "a"]) == ["b", "a"]


def _members(spark, path):
    spark.createDataFrame([(g, i, i % 4 + 9 * ((g or 0) % 2), n, "A") for g, n, i in [(1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 1, 6), (2, 2, 5), (3, 1, 9), (None, 1, 5), (None, 2, 6)]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(10,), (11,)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")


def test_pairs_dealt_by_size(spark, tmp_path):
    """As many tasks make pairs as the table's size asks for; duplicates and groups without a key count as before."""
    from fieldloom.sources.tables import dealt

    assert dealt(spark.range(95), "id", rows=10).rdd.getNumPartitions() == 10 and dealt(spark.range(0), "id").rdd.getNumPartitions() == 1
    _members(spark, tmp_path)
    got = QUERIES["co_occurrence"](spark, str(tmp_path))
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(5, 6, 2)]


def test_parents_in_one_shuffle(spark, tmp_path):
    """Sentences find their paragraphs by windows of a document, not by joins; null documents have ranges but no beginnings."""
    p = spark.createDataFrame([("d", 1, 0, 9, "ab c"), ("d", 2, 10, 19, "ab d"), ("d", 3, 20, 29, "ab d"), ("e", 4, 0, 9, None), (None, 5, 0, 9, "ab")], "doc string, para long, start int, end int, text string")
    s = spark.createDataFrame([("d", 12, 15, "ab", 0), ("d", 25, 26, "ab d"[:2], 0), ("d", 25, 26, "zz", 1), ("d", 25, 31, "zz", 2), ("d", 9, 10, "zz", 3), ("e", 1, 2, None, 4), (None, 1, 2, "ab", 5), ("f", 1, 2, "ab", 6)], "doc string, start int, end int, parent string, own int")
    for of in (None, p):
        got = chunks.with_parent(s, p, "doc", prefix=2, of=of)
        assert sorted((r["own"], r["para"]) for r in got.collect() if r["own"] not in (2, 3, 6)) == [(0, 1), (0, 1), (1, 3), (4, 4), (5, 5)]
        assert [r["para"] for r in got.where("own in (2, 3, 6)").collect()] == [None] * 3 and got.columns == [*s.columns, "para"]
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_moved_edges_dealt_by_size(spark, tmp_path, monkeypatch):
    """Edges are dealt once as they are counted and once as they are moved, by the table's size; no other exchange holds them."""
    from functools import partial

    from fieldloom.sources.tables import dealt

    for place in (graph, graph_queries):
        monkeypatch.setattr(place, "dealt", partial(dealt, rows=2))
    _members(spark, tmp_path)
    got = QUERIES["repointed_edges"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 4), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2, plan
    assert sorted(tuple(r) for r in got.collect()) == [("P5", "FOUND_AT", "S1", 4.0), ("P6", "FOUND_AT", "S11", 1.0), ("P6", "FOUND_AT", "S2", 2.0), ("P9", "FOUND_AT", "S1", 1.0)]
