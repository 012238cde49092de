"""Queries on the graph, memory and articles derived from records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import phonetic
from fieldloom.operators import articles, fuzzy, geocode, graph, lookup, memory
from fieldloom.operators import communities as modular
from fieldloom.operators import recall as two_stage
from fieldloom.plans.registry import query
from fieldloom.sources.tables import dealt

_FOUND = "SELECT 'P' || l_partkey AS src, 'FOUND_AT' AS rel, 'S' || l_suppkey AS tgt FROM lineitem"


def _edges(t):
    found = t("lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("src"), F.lit("FOUND_AT").alias("rel"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("tgt"))
    return graph.upsert_edges(dealt(found, "src", "tgt", of=t("lineitem")))


@query(f"SELECT src, rel, tgt, CAST(count(*) AS DOUBLE) AS weight FROM ({_FOUND}) GROUP BY ALL")
def graph_edges(t, spark):
    """Edges with a weight that grows by repeats."""
    return _edges(t)


@query("SELECT 'U' || user_id AS node_id, 'User' AS kind, arg_min(event_type, event_id) AS label, arg_max(props, event_id) AS props, count(*) AS times FROM events GROUP BY user_id")
def graph_nodes(t, spark):
    """Nodes keep their first label and take the last properties."""
    e = t("events").select(F.concat(F.lit("U"), F.col("user_id")).alias("node_id"), F.lit("User").alias("kind"), F.col("event_type").alias("label"), "props", F.col("event_id").alias("seq"))
    return graph.upsert_nodes(e)


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL""")
def co_occurrence(t, spark):
    """Pairs found together, with their weight."""
    return graph.co_occurrence(t("lineitem"), "l_orderkey", "l_partkey", of=t("lineitem"))


@query(f"SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM (SELECT DISTINCT * FROM ({_FOUND})) UNION ALL SELECT tgt FROM (SELECT DISTINCT * FROM ({_FOUND}))) GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 10")
def top_degree_nodes(t, spark):
    """A10, O1: the ten nodes of most edges, ties by id."""
    return graph.top_by_degree(_edges(t), 10)


@query(f"SELECT rel, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT src, rel, tgt, count(*) AS weight FROM ({_FOUND}) GROUP BY ALL) GROUP BY rel")
def relation_counts(t, spark):
    """A10: edges and weights by relation."""
    return _edges(t).groupBy("rel").agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("weight"))


@query(f"SELECT src, rel, tgt, CAST(sum(weight) AS DOUBLE) AS weight FROM (SELECT src, rel, CASE WHEN CAST(substr(tgt, 2) AS INT) % 10 = 0 THEN 'S1' ELSE tgt END AS tgt, 1 AS weight FROM ({_FOUND})) GROUP BY ALL")
def repointed_edges(t, spark):
    """Nodes move into another one, and their edges with them."""
    moves = t("supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("old_id"), F.lit("S1").alias("new_id"))
    return graph.repoint(_edges(t), moves, of=t("lineitem"))


_LOCATED = "SELECT 'S' || s_suppkey AS src, 'LOCATED_IN' AS rel, 'N' || s_nationkey AS tgt FROM supplier"


@query(f"""WITH e AS (SELECT DISTINCT * FROM ({_FOUND} UNION ALL {_LOCATED})), d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT tgt FROM e) GROUP BY node_id),
    n AS (SELECT node_id FROM d WHERE substr(node_id, 1, 1) IN ('P', 'S') ORDER BY degree DESC, node_id LIMIT 200) SELECT * FROM e WHERE src IN (SELECT node_id FROM n) AND tgt IN (SELECT node_id FROM n)""")
def induced_top_subgraph(t, spark):
    """K6: the part of a graph between its 200 nodes of most edges in the whole graph, of the kinds asked for."""
    located = t("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("src"), F.lit("LOCATED_IN").alias("rel"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("tgt"))
    edges = _edges(t).unionByName(graph.upsert_edges(located))
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("tgt")).distinct()
    nodes = graph.top_by_degree(edges, 200, ends.where(F.substring("node_id", 1, 1).isin("P", "S")))
    return graph.induced(edges, nodes).select("src", "rel", "tgt")


@query("SELECT 'S' || l_suppkey AS tgt, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS labels FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def species_at_place(t, spark):
    """The names found at each place, in order."""
    nodes = t("part").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("node_id"), F.lit("part").alias("kind"), F.col("p_name").alias("label"))
    return graph.neighbours(_edges(t), nodes, "FOUND_AT", "part").select("tgt", F.array_join("labels", ",").alias("labels"))


@query()
def communities(t, spark):
    """Communities of nations by trade, by modularity."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = graph.upsert_edges(o.select(F.concat(F.lit("C"), F.col("c_nationkey")).alias("src"), F.lit("TRADE").alias("rel"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("tgt")))
    return modular.communities(edges)


@query("SELECT user_id, min(value) AS min_x, max(value) AS max_x, min(event_id) AS min_y, max(event_id) AS max_y, count(*) AS n, min(event_id) AS first_seq FROM events GROUP BY user_id")
def bounding_boxes(t, spark):
    """The range of each key in space."""
    return graph.bounding_boxes(t("events"), "user_id", "value", "event_id", "event_id")


@query("SELECT substr(sha1(user_id || '|' || event_type), 1, 16) AS atom_id, user_id, event_type, arg_min(value, event_id) AS value, arg_min(props, event_id) AS props, count(*) AS times_confirmed, min(event_id) AS first_seq FROM events GROUP BY user_id, event_type")
def memory_merge(t, spark):
    """Facts merged by content address, the first row's fields kept."""
    return memory.merge(t("events"), ["user_id", "event_type"], ["value", "props"], "event_id")


@query("""WITH f AS (SELECT user_id, event_type, arg_min(props, event_id) AS stored, min(event_id) AS first FROM events GROUP BY ALL)
    SELECT user_id, event_type, event_id, stored, props AS given FROM events JOIN f USING (user_id, event_type) WHERE event_id > first AND props <> '' AND stored <> '' AND props <> stored""")
def memory_conflicts(t, spark):
    """Values that differ from the stored ones."""
    e = t("events")
    atoms = memory.merge(e, ["user_id", "event_type"], ["props"], "event_id")
    return memory.disagreements(e, atoms, ["user_id", "event_type"], "props", "event_id")


@query("""SELECT p_name, count(*) AS n, count(DISTINCT l_suppkey) AS n_places, max(l_quantity) AS best, arg_max(p_brand, (l_quantity, p_brand, p_type)) AS p_brand, arg_max(p_type, (l_quantity, p_brand, p_type)) AS p_type
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 10 GROUP BY p_name""")
def checklist(t, spark):
    """One row for each name, other columns from the row of the best score."""
    df = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return memory.checklist(df, "p_name", "l_suppkey", "l_quantity", ["p_brand", "p_type"], 10)


@query("SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents) WHERE length(token) > 2 GROUP BY ALL")
def token_index(t, spark):
    """An inverted index of tokens."""
    return memory.tokens(t("documents"), "doc_id", "text")


@query("""WITH x AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents) WHERE length(token) > 2 GROUP BY ALL),
    q AS (SELECT item_id, token, count(*) AS qw FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM benchmark) WHERE length(token) > 2 GROUP BY ALL),
    d AS (SELECT token, count(*) AS df FROM x GROUP BY token),
    w AS (SELECT doc_id, x.token, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT doc_id) FROM x)) / (1 + df)) + 1) AS w FROM x JOIN d USING (token)),
    l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id),
    s AS (SELECT item_id, doc_id, round(sum(w / l * qw), 6) AS score FROM w JOIN l USING (doc_id) JOIN q USING (token) GROUP BY ALL)
    SELECT item_id, count(*) AS n FROM s WHERE score > 0 GROUP BY item_id""")
def tfidf_matches(t, spark):
    """Documents that each query recalls, counted (the ranking is in tfidf_recall)."""
    q = memory.tokens(t("benchmark"), "item_id", "text").select("item_id", "token", F.col("tf").alias("weight"))
    return memory.scored(memory.whole_index(t("documents"), "doc_id", "text"), q, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("n"))


@query()
def tfidf_recall(t, spark):
    """The five documents nearest to each query by cosine."""
    q = memory.tokens(t("benchmark"), "item_id", "text").select("item_id", "token", F.col("tf").alias("weight"))
    return memory.recalled(memory.whole_index(t("documents"), "doc_id", "text"), q, "doc_id", "item_id", 5)


@query("SELECT p_partkey, p_name, 1.0 AS similarity FROM part WHERE lower(p_name) LIKE '%widget%'")
def name_search(t, spark):
    """A search by part of a name, all that have it, with the most similar name where nothing is found."""
    return memory.search(t("part").select("p_partkey", "p_name"), "p_name", "Widget", most=None)


@query("SELECT user_id, event_id, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS version FROM events")
def article_versions(t, spark):
    """Every update is the next version."""
    return articles.versions(t("events").select("user_id", "event_id", "props"), "user_id", "event_id")


@query("""WITH v AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)
    SELECT user_id, CAST(max(version) + 1 AS INT) AS version, arg_min(props, version) AS props FROM v GROUP BY user_id""")
def article_rollback(t, spark):
    """An old version becomes the newest; the current state is that of the highest version."""
    history = articles.versions(t("events").select("user_id", "event_id", "props"), "user_id", "event_id")
    back = articles.rollback(history, "user_id", history.select("user_id").distinct().withColumn("to_version", F.lit(1)))
    return articles.current(back, "user_id").select("user_id", "version", "props")


@query("""SELECT user_id, arg_min(event_type, event_id) AS event_type, array_to_string(list(props ORDER BY s), ';') AS props FROM (
      SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id, props, min(event_id) AS s FROM events GROUP BY user_id, props) GROUP BY user_id""")
def article_fold(t, spark):
    """Rows folded into one article: the first filled scalar, lists in the order first seen."""
    return articles.fold(t("events"), "user_id", "event_id", scalars=["event_type"], lists=["props"]).select("user_id", "event_type", F.array_join("props", ";").alias("props"))


@query("SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_id % 97 = 1 AND n.user_id = events.user_id AND n.event_type = events.event_type) UNION ALL SELECT user_id, event_type, event_id FROM events WHERE event_id % 97 = 1")
def replace_by_source(t, spark):
    """The rows of a source are replaced by its new ones."""
    e = t("events").select("user_id", "event_type", "event_id")
    return articles.replace_by(e.where("event_id % 2 = 0"), e.where("event_id % 97 = 1"), ["user_id", "event_type"], "event_type")


_CASCADE = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' WHEN 2 THEN p_name || 'x' WHEN 3 THEN 'zz' || p_name ELSE CAST(100000 + p_partkey AS VARCHAR) END"""


@query(f"""WITH q AS (SELECT DISTINCT {_CASCADE} AS q FROM part), n AS (SELECT p_name AS n, CAST(p_partkey AS VARCHAR) AS id FROM part)
    SELECT q, min(id) AS id, 'exact' AS how FROM q JOIN n ON q = n GROUP BY q
    UNION ALL SELECT q, min(id), 'canonical' FROM q JOIN n ON regexp_replace(lower(q), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n), '[^a-z0-9]', '', 'g') WHERE q NOT IN (SELECT n FROM n) GROUP BY q""")
def lookup_cascade_first_ways(t, spark):
    """Names looked up in several ways; the hits of the first two (all are in lookup_cascade)."""
    p = t("part")
    q = p.select(F.expr(_CASCADE.replace("VARCHAR", "STRING")).alias("q"))
    return lookup.cascade(q, p, "q", "p_name", "p_partkey").where(F.col("how").isin("exact", "canonical")).select("q", "id", "how")


@query()
def lookup_cascade(t, spark):
    """J9, 2.12: exact, canonical, fuzzy, phonetic and code matches, the first hit."""
    p = t("part")
    return lookup.cascade(p.select(F.expr(_CASCADE.replace("VARCHAR", "STRING")).alias("q")), p, "q", "p_name", "p_partkey")


@query("""SELECT event_id, user_id, CASE WHEN a.id IS NOT NULL AND e.event_id - a.id <= 500 THEN a.id END AS near_mark FROM events e ASOF LEFT JOIN (SELECT user_id AS u, event_id AS id FROM events WHERE event_type = 'signup') a
    ON e.user_id = a.u AND e.event_id >= a.id""")
def nearest_before(t, spark):
    """An as-of join: for each row the last mark at or before it, within a distance, as one sort (J12 takes either side: nearest_mark)."""
    e = t("events").select("event_id", "user_id")
    marks = t("events").where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("mark"))
    return lookup.nearest_before(e, marks, "user_id", "event_id", "mark", 500)


@query("""SELECT e.event_id, e.user_id, arg_min(m.id, 2 * abs(m.id - e.event_id) + CASE WHEN m.id > e.event_id THEN 1 ELSE 0 END) AS near_mark
    FROM events e LEFT JOIN (SELECT user_id AS u, event_id AS id FROM events WHERE event_type = 'signup') m ON e.user_id = m.u AND abs(m.id - e.event_id) <= 500 GROUP BY e.event_id, e.user_id""")
def nearest_mark(t, spark):
    """For each row the nearest mark on either side, within a distance, the earlier of two equally near."""
    e = t("events").select("event_id", "user_id")
    marks = t("events").where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("mark"))
    return lookup.nearest(e, marks, "user_id", "event_id", "mark", 500)


@query("""SELECT n_nationkey, s_suppkey FROM (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_acctbal DESC, s_suppkey) AS rn FROM nation JOIN supplier ON s_nationkey = n_nationkey) WHERE rn = 1""")
def ranked_candidate(t, spark):
    """The best candidate of a lookup by class, then size."""
    m = t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lookup.top_candidate(m, "n_nationkey", [F.when(F.col("s_acctbal") > 0, 0).otherwise(1), F.desc("s_acctbal"), F.col("s_suppkey")]).select("n_nationkey", "s_suppkey")


@query("""SELECT event_id, CASE WHEN b.user_id IS NULL THEN 'no_box' WHEN e.value < 2 THEN 'filled' WHEN e.value BETWEEN lo AND hi THEN 'inside' ELSE 'outside' END AS note
    FROM events e LEFT JOIN (SELECT user_id, 5.0 AS lo, 15.0 AS hi FROM events WHERE user_id % 2 = 0 GROUP BY user_id) b ON e.user_id = b.user_id""")
def box_check(t, spark):
    """Coordinates checked against, or filled from, the box of a code."""
    e = t("events").select("event_id", "user_id", F.when(F.col("value") >= 2, F.col("value")).alias("lat"), F.when(F.col("value") >= 2, F.col("value")).alias("lon"))
    boxes = t("events").where("user_id % 2 = 0").groupBy(F.col("user_id").alias("key")).agg(F.lit(5.0).alias("lat_min"), F.lit(15.0).alias("lat_max"), F.lit(5.0).alias("lon_min"), F.lit(15.0).alias("lon_max"))
    return lookup.fill_from_box(e, boxes, F.col("user_id"), "lat", "lon").select("event_id", "note")


_TERMS = """r AS (SELECT conv_id || ':' || turn AS id, text, conv_id, length(text) AS size FROM conversations),
    ws AS (SELECT id, conv_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM r),
    t AS (SELECT id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM ws),
    tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
    v AS (SELECT term, ln((1 + (SELECT count(*) FROM r)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
    x AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term)), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM x GROUP BY id), n AS (SELECT id, term, w / l AS w FROM x JOIN l USING (id))"""


@query(f"""WITH {_TERMS}, p AS (SELECT id, row_number() OVER (ORDER BY size DESC, id) AS place FROM r), q AS (SELECT id AS qid FROM r WHERE conv_id % 50 = 0),
    qw AS (SELECT DISTINCT id AS qid, unnest(w) AS word FROM ws WHERE conv_id % 50 = 0), dw AS (SELECT DISTINCT id, unnest(w) AS word FROM ws),
    f AS (SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM (SELECT DISTINCT qid, id FROM qw JOIN dw USING (word) WHERE length(word) > 2) JOIN p USING (id)) WHERE rank <= 15),
    few AS (SELECT qid FROM q LEFT JOIN f USING (qid) GROUP BY qid HAVING count(id) < 5),
    c AS (SELECT * FROM f UNION ALL SELECT qid, id, 15 + place FROM few, p WHERE place <= 10 AND (qid, id) NOT IN (SELECT (qid, id) FROM f)),
    s AS (SELECT c.qid, c.id, c.rank AS o, coalesce(round(sum(a.w * b.w), 6), 0.0) AS score FROM c LEFT JOIN n a ON a.id = c.id LEFT JOIN n b ON b.id = c.qid AND b.term = a.term GROUP BY ALL),
    y AS (SELECT *, max(score) OVER (PARTITION BY qid) > 0 AS any_score FROM s)
    SELECT qid, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN any_score THEN 0 ELSE o END, id) AS rank FROM y WHERE NOT any_score OR score > 0) WHERE rank <= 5""")
def recalled_turns(t, spark):
    """The five turns of all conversations nearest to each turn of every fiftieth one, in two stages, longer turns being candidates first."""
    rows = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", "conv_id")
    index = two_stage.indexed(rows, "id", "text", [-F.length("text")])
    return two_stage.recalled(index, rows.where("conv_id % 50 = 0").select(F.col("id").alias("qid"), "text"), "qid", "text", 5)


def _common(a: str, b: str) -> str:
    """The length of the longest common subsequence of two texts, folded over the characters of a and of b, in SQL."""
    return f"""list_last(list_reduce(list_prepend([0 FOR j IN range(0, len({b}) + 1)], [[ascii(y)] FOR y IN string_split({a}, '')]), lambda above, x:
      list_reduce(list_prepend([0], [[CAST(j AS INT)] FOR j IN range(1, len({b}) + 1)]),
                  lambda own, k: list_append(own, CASE WHEN ascii({b}[k[1]]) = x[1] THEN above[k[1]] + 1 ELSE greatest(above[k[1] + 1], own[k[1]]) END))))"""


def _alike(asked: str, known: str, least: float) -> str:
    """The best known name n of each asked q, with the score, in SQL."""
    return f"""(SELECT q, arg_min(n, (-score, n)) AS n, max(score) AS score FROM (SELECT q, n, 2.0 * {_common('q', 'n')} / (len(q) + len(n)) AS score FROM ({asked}), ({known})) WHERE score >= {least} - 1e-12 GROUP BY q)"""


_GARBLED = "CASE WHEN {k} % 4 = 0 THEN substr({n}, 1, 2) || substr({n}, 4) WHEN {k} % 4 = 1 THEN {n} || 's' WHEN {k} % 4 = 2 THEN substr({n}, 2, 1) || substr({n}, 1, 1) || substr({n}, 3) ELSE upper(substr({n}, 1, 3)) || substr({n}, 4) END"
_ASKED = f"SELECT DISTINCT {_GARBLED.format(k='p_partkey', n='p_name')} AS q FROM part"


@query(f"SELECT q, n, round(score, 6) AS score FROM {_alike(_ASKED, 'SELECT DISTINCT p_name AS n FROM part', 0.8)}")
def names_alike(t, spark):
    """The most similar known name of each damaged one, by what both have in the same order."""
    asked = t("part").select(F.expr(_GARBLED.format(k="p_partkey", n="p_name")).alias("q"))
    return fuzzy.most_similar(asked, t("part"), "q", "p_name", 0.8).withColumn("score", F.round("score", 6))


_PLACES = f"SELECT DISTINCT {_GARBLED.format(k='s_suppkey', n='n_name')} AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"""SELECT q AS place, n AS found, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS names FROM {_alike(_PLACES, 'SELECT n_name AS n FROM nation', 0.7)} JOIN nation ON n_name = n JOIN supplier ON s_nationkey = n_nationkey GROUP BY q, n""")
def names_at_similar_place(t, spark):
    """The names found at the place most like each one asked for, in order."""
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edges = graph.upsert_edges(j.select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.lit("FOUND_AT").alias("rel"), F.col("n_name").alias("tgt")))
    nodes = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("label"))
    asked = fuzzy.most_similar(j.select(F.expr(_GARBLED.format(k="s_suppkey", n="n_name")).alias("q")), t("nation"), "q", "n_name", 0.7)
    return asked.join(graph.neighbours(edges, nodes, "FOUND_AT", "supplier"), F.col("n") == F.col("tgt")).select(F.col("q").alias("place"), F.col("n").alias("found"), F.array_join("labels", ",").alias("names"))


@query(f"""WITH m AS (SELECT DISTINCT l_suppkey AS g, p_name AS n FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT a.n, b.n AS other, count(*) AS weight FROM m a JOIN m b ON a.g = b.g AND a.n <> b.n GROUP BY ALL)
    SELECT q AS asked, a.n AS found, other, weight FROM {_alike(_ASKED, 'SELECT DISTINCT p_name AS n FROM part', 0.8)} a JOIN w ON a.n = w.n WHERE weight >= 2""")
def co_occurring_with_similar(t, spark):
    """O2: what occurs with the name most like each one asked for, from a least weight."""
    members = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name")
    pairs = graph.co_occurrence(members, "l_suppkey", "p_name")
    both = pairs.select(F.col("a").alias("found"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("found"), F.col("a").alias("other"), "weight")).where("weight >= 2")
    asked = fuzzy.most_similar(t("part").select(F.expr(_GARBLED.format(k="p_partkey", n="p_name")).alias("q")), t("part"), "q", "p_name", 0.8)
    return asked.join(both, F.col("n") == F.col("found")).select(F.col("q").alias("asked"), "found", "other", "weight")


@query()
def name_sounds(t, spark):
    """how the name of each part and of its maker may sound, as two codes (tested against a table of names)."""
    return t("part").select("p_partkey", F.array_join(phonetic.sounds(F.col("p_name")), ",").alias("name_codes"), F.array_join(phonetic.sounds(F.col("p_brand")), ",").alias("brand_codes"))


_ASKED_PLACE = "CASE s_suppkey % 5 WHEN 1 THEN n_name WHEN 2 THEN '(' || s_suppkey || ') ' || lower(n_name) || '!' WHEN 3 THEN r_name || ' coast' WHEN 4 THEN 'zz' || s_suppkey END"


@query(f"""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_nationkey + 0.5 WHEN 1 THEN s_nationkey WHEN 2 THEN s_nationkey WHEN 3 THEN n_regionkey + 50.0 END AS lat,
    CASE s_suppkey % 5 WHEN 0 THEN -10.25 WHEN 1 THEN n_regionkey WHEN 2 THEN n_regionkey WHEN 3 THEN 1.0 END AS lon,
    CASE s_suppkey % 5 WHEN 0 THEN 'given' WHEN 1 THEN 'nations_exact_100' WHEN 2 THEN 'nations_canonical_95' WHEN 3 THEN 'gazetteer' END AS coordinate_source FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def geocode_cascade(t, spark):
    """2.12, J7: coordinates by what a record has, then named places, then a gazetteer's alternate names, each asked for the rest only."""
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    given = F.col("s_suppkey") % 5 == 0
    rows = j.select("s_suppkey", F.expr(_ASKED_PLACE).alias("place"), F.when(given, F.concat("s_nationkey", F.lit("°30'N"))).alias("lat"), F.when(given, F.lit("10°15'W")).alias("lon"))
    places = t("nation").withColumn("la", F.col("n_nationkey").cast("double")).withColumn("lo", F.col("n_regionkey").cast("double"))
    g = t("region")
    gazetteer = g.select(F.lower("r_name").alias("name"), F.lit("").alias("ascii"), F.concat(F.lit("other,the "), F.upper("r_name"), F.lit(" Coast road")).alias("alternates"), (F.col("r_regionkey") + 50.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit("P").alias("feature"), F.lit("5").alias("population"))
    tools = [geocode.by_names(places, "n_name", "n_nationkey", "la", "lo", "nations", 0.95), geocode.by_gazetteer(gazetteer)]
    return geocode.geocoded(rows, "place", "lat", "lon", tools).select("s_suppkey", "lat", "lon", "coordinate_source")
