"""Queries on rules, spans, mentions and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators import mentions, review_rules as rules
from fieldloom.operators import text
from fieldloom.plans.registry import query

_TERMS = {"anatomy": ("tentacle", "bell"), "habitat_lead": ("intertidal", "rocky", "sandy"), "habitat_words": ("reef", "rocks", "mud", "flat", "dead", "coral")}


@query("""SELECT o_orderkey, CASE WHEN k IN (0, 1, 2) THEN 'Secondary' WHEN k = 3 THEN 'Primary' ELSE 'Uncertain' END AS kind, CASE k WHEN 0 THEN 'citation' WHEN 1 THEN 'evidence' WHEN 2 THEN 'citation,year' ELSE '' END AS rules FROM (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)""")
def reconciled_types(t, spark):
    """Records that rest on other sources are no first records."""
    k = F.col("o_orderkey") % 5
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    o = t("orders").select("o_orderkey", pick("Primary", "Primary", "Primary", "Primary", "Uncertain").alias("kind"), pick("Rao 1999", "Apte 2012", "Rao", "Apte", "Rao").alias("cited"), pick("seen", "according to Gravely here", "in 1941 seen", "seen in 2012", "in 1901").alias("evidence"))
    return rules.reconciled(o, "kind", "cited", "evidence", F.lit("Apte et al. 2012, Journal")).select("o_orderkey", "kind", F.array_join("rules", ",").alias("rules"))


@query("""SELECT c_custkey, [NULL, 'morphology', 'habitat', 'habitat_with_place', 'habitat', 'morphology'][c_custkey % 6 + 1] AS place_note, ['Narara Bay', NULL, NULL, 'Narara', NULL, NULL][c_custkey % 6 + 1] AS place, ['h', 'h', 'h', 'h', 'h', 'h'][c_custkey % 6 + 1] AS habitat FROM customer""")
def place_guard(t, spark):
    """Places that are measurements, anatomy or habitats are told and emptied, names in them kept."""
    p = F.element_at(F.array(*[F.lit(x) for x in ("Narara Bay", "10 cm wide", "Rocky shore", "intertidal reef at Narara", "dead coral flat", "Bell rounded")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return rules.guarded_places(t("customer").select("c_custkey", p.alias("place"), F.lit("h").alias("habitat")), "place", "habitat", **_TERMS).select("c_custkey", "place_note", "place", "habitat")


@query("""SELECT doc_id, count(*) AS n, CAST(sum(a) AS BIGINT) AS starts, CAST(sum(a + len(v)) AS BIGINT) AS ends FROM (
    SELECT doc_id, vs[i] AS v, list_sum([len(x) FOR x IN gs[1:i]]) + coalesce(list_sum([len(x) FOR x IN vs[1:i - 1]]), 0) AS a FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS vs, string_split_regex(text, '[0-9]+') AS gs FROM documents), unnest(range(1, len(vs) + 1)) AS u(i)) GROUP BY doc_id""")
def number_spans(t, spark):
    """labelled spans with offsets."""
    d = rules.tagged(t("documents").select("doc_id", "text"), "text", {"number": "[0-9]+"}).select("doc_id", F.explode("spans").alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends"))


@query("""WITH s AS (SELECT user_id, event_id AS a, event_id + 3 AS b, event_type AS label FROM events),
    f AS (SELECT *, CASE WHEN lag(label) OVER w = label AND a - lag(b) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS run FROM f)
    SELECT user_id, label, min(a) AS start, max(b) AS "end", count(*) AS pieces FROM r GROUP BY user_id, run, label""")
def merged_spans_all(t, spark):
    """neighbouring pieces of the same label as one, of all events."""
    s = t("events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 3).alias("end"), F.col("event_type").alias("label"))
    return rules.merged_spans(s, "user_id", 200).drop("run")


@query("""SELECT doc_id, w AS name FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w IN ('the', 'hein', 'ung', 'para')""")
def co_mentions(t, spark):
    """Texts that mention names, by a join on words."""
    names = spark.sql("SELECT * FROM VALUES ('the'), ('hein'), ('ung'), ('para'), ('the') AS t(name)")
    return rules.co_mentions(t("documents"), names, "doc_id", "text", "name")


_NAMES = "SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS name FROM benchmark WHERE len(string_split(text, ' ')) > 1"


@query(rf"""WITH n AS ({_NAMES}), s AS (SELECT doc_id, ss[i] AS s, i - 1 AS sentence FROM (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents), unnest(range(1, len(ss) + 1)) AS u(i))
    SELECT DISTINCT doc_id, CAST(sentence AS INT) AS sentence, name FROM s JOIN n ON contains(s, name) AND regexp_matches(s, '(^|[^a-z0-9])' || name)""")
def sentence_mentions(t, spark):
    """Sentences that contain names of two words, of a table: those that benchmark items begin with."""
    names = t("benchmark").where(F.size(F.split("text", " ")) > 1).select(F.lower(F.array_join(F.slice(F.split("text", " "), 1, 2), " ")).alias("name"))
    return mentions.sentence_mentions(t("documents"), names, "doc_id", "text", "name")


@query(rf"""WITH n AS ({_NAMES} UNION SELECT DISTINCT r_name FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}'))) AS r_name FROM benchmark)),
    p AS (SELECT doc_id, name, unnest(range(1, len(gs))) AS i, gs FROM (SELECT doc_id, name, string_split(lower(text), name) AS gs FROM documents, n WHERE contains(lower(text), name)))
    SELECT doc_id, count(*) AS n, CAST(sum(a) AS BIGINT) AS starts FROM (SELECT doc_id, name, lower(text) AS t, CAST(list_sum([len(x) FOR x IN gs[1:i]]) + (i - 1) * len(name) AS BIGINT) AS a FROM p JOIN documents USING (doc_id))
    WHERE NOT regexp_matches(substr(t, a, 1), '^[\p{{L}}\p{{N}}]$') AND NOT regexp_matches(substr(t, a + 1 + len(name), 1), '^[\p{{L}}\p{{N}}]$') GROUP BY doc_id""")
def name_spans(t, spark):
    """Every occurrence of the benchmark's long words and first pairs of words, by one automaton; counts and sums of offsets."""
    items = t("benchmark")
    names = items.where(F.size(F.split("text", " ")) > 1).select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name")).unionByName(items.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("name")))
    found = mentions.spans(t("documents"), names, "doc_id", "text", "name")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query("SELECT n_nationkey, 'Harbour' AS one, 'Long Bay' AS two FROM nation")
def station_map(t, spark):
    """Station ids resolved to the places they stand for."""
    m = rules.stations(F.concat(F.lit("Station 1: Harbour; St. 2 (Long Bay) and Stn 1 - Elsewhere in "), F.col("n_name")))
    return t("nation").select("n_nationkey", m["1"].alias("one"), m["2"].alias("two"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'round' WHEN contains(p_name, 'widget') OR contains(p_name, 'anvil') THEN 'solid' ELSE 'other' END AS class FROM part")
def word_classes(t, spark):
    """The first class with a word in the text."""
    return t("part").select("p_partkey", rules.first_class(F.col("p_name"), {"round": ("ring",), "solid": ("widget", "anvil")}, "other").alias("class"))


@query(r"""SELECT doc_id, CASE WHEN a > b THEN 'Primary' WHEN b > a THEN 'Secondary' ELSE 'Uncertain' END AS kind FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS a, len(regexp_extract_all(lower(text), 'and')) AS b FROM documents)""")
def context_kinds(t, spark):
    """the type that the signals in a context speak for."""
    return t("documents").select("doc_id", rules.kind_from_context(F.col("text"), "the", "and").alias("kind"))


@query("SELECT s_suppkey, ['asud', 'bada', 'bada', 'sribardan'][s_suppkey % 4 + 1] AS key FROM supplier")
def spelling_keys(t, spark):
    """one key for variant spellings of a place."""
    n = F.element_at(F.array(*[F.lit(x) for x in ("Aasood (Dapoli Tahsil)", "Wada dist", "Vāda", "Shrivardhan")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t("supplier").select("s_suppkey", rules.spelling_key(n).alias("key"))


@query("SELECT n_nationkey, 'METHODS' AS role, '' AS context FROM nation UNION ALL SELECT n_nationkey, 'RESULTS', '12 m,5 m' FROM nation")
def document_context(t, spark):
    """What a document's methods say goes with its results."""
    md = F.concat(F.lit("# Methods\nat 12 m and 5 m and 12 m\n# Results\nfound at "), F.col("n_name"))
    s = text.sections(t("nation").select("n_nationkey", md.alias("md")), "n_nationkey", "md").where("section > 0")
    return rules.with_document_context(s, "n_nationkey", "role", "body", ("METHODS",), ("RESULTS",), "[0-9]+ m").select("n_nationkey", "role", F.array_join("context", ",").alias("context"))


@query("SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 2 = 0 THEN ', ' || r_name ELSE '' END || ', Earth' AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def completed_places(t, spark):
    """a place with the wider ones it does not name."""
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name"))
    return j.select("n_nationkey", geo.completed_place(F.col("n_name"), region, F.lower("n_name"), F.lit("Earth")).alias("place"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'the reef, Long Bay' WHEN 1 THEN 'Long Bay' ELSE s_name END AS place FROM supplier")
def enhanced_places(t, spark):
    """short places with their document's study area."""
    p = F.when(F.col("s_suppkey") % 3 == 0, "the reef").when(F.col("s_suppkey") % 3 == 1, "").otherwise(F.col("s_name"))
    return t("supplier").select("s_suppkey", geo.enhanced_place(p, F.lit("Long Bay")).alias("place"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE greatest(1, CAST(round_even(doc_id % 10 / 10.0 * 7, 0) AS INT)) END AS \"first\", CASE WHEN doc_id % 2 = 0 THEN 12 ELSE greatest(1, CAST(round_even(doc_id % 10 / 10.0 * 7, 0) AS INT)) END AS \"last\" FROM documents")
def page_ranges(t, spark):
    """T4: pages by markers, else by the place in the document."""
    c = F.when(F.col("doc_id") % 2 == 0, "x [page 12] y [page 3]").otherwise("none")
    r = text.page_range(c, r"\[page ([0-9]+)\]", F.col("doc_id") % 10 / 10.0, F.lit(7))
    return t("documents").select("doc_id", r["first"].alias("first"), r["last"].alias("last"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size >= 25 AND p_size % 3 = 1 THEN 'approved' ELSE 'review' END AS first_view FROM part WHERE p_partkey % 2 = 0""")
def approval_gate(t, spark):
    """What is approved at once, and the rows that a reviewer has ticked."""
    match = F.when(F.col("p_size") % 3 == 1, "EXACT").when(F.col("p_size") % 3 == 2, "HIGHER")
    view = t("part").select("p_partkey", rules.approval(F.col("p_size"), match, 25).alias("first_view"))
    return rules.ticked(view, t("part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("keep")), "p_partkey")


@query("SELECT DISTINCT l_orderkey, 'flag ' || l_returnflag AS text FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 40")
def sure_entities(t, spark):
    """P20: entities of one label and a high score, each once."""
    e = t("lineitem").select("l_orderkey", F.col("l_linestatus").alias("label"), (F.col("l_quantity") / 50).alias("score"), F.concat(F.lit("flag "), F.col("l_returnflag")).alias("text"))
    return rules.sure_entities(e, "l_orderkey", "F", 0.8)


@query("""SELECT user_id FROM events WHERE event_type = 'click' AND (contains(props, '7') OR contains(props, '42')) INTERSECT SELECT user_id FROM events WHERE event_type = 'view' AND contains(props, '9')""")
def related_keys(t, spark):
    """Any of the words of a predicate, all of the predicates."""
    e = t("events").select("user_id", F.col("event_type").alias("rel"), F.col("props").alias("value"))
    return rules.related(e, "user_id", {"click": ("7", "42"), "view": ("9",), "error": ()})


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS first, arg_max(props, event_id) AS latest, count(*) AS offered FROM events GROUP BY ALL")
def first_and_latest(t, spark):
    """Relations of which the first stays, with how many were offered, and the latest record of each key."""
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.max_by("props", "event_id").alias("latest"), F.count("*").alias("offered"))
