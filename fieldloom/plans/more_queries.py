"""Queries on relations, chunks, morphology, places and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geo, values
from fieldloom.operators import articles, chunks, lookup, memory, morphology, relations
from fieldloom.plans.registry import query
from fieldloom.sources.tables import dealt


@query("""SELECT o_orderkey, 'Name ' || o_custkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'FOUND_AT' WHEN 1 THEN 'INHABITS' ELSE 'EATS' END AS relation, o_orderpriority AS object, least(1.0, c) AS confidence
    FROM (SELECT *, (o_custkey % 17) / 10.0 AS c FROM orders) WHERE c >= 0.5 AND o_orderkey % 5 < 3
    UNION ALL SELECT o_orderkey, o_orderstatus, 'FEEDS_ON', 'x {y}', 1.0 FROM orders WHERE o_orderkey % 5 = 1""")
def relation_triples(t, spark):
    """triples out of plain, fenced, truncated and empty replies: clamped, unsure and blank ones left out."""
    kind, verb = F.col("o_orderkey") % 5, F.element_at(F.array(*[F.lit(x) for x in (" found_at ", "PREVIOUSLY INHABITS", "eats")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    item = F.to_json(F.struct(F.concat(F.lit(" Name "), F.col("o_custkey")).alias("subject"), verb.alias("relation"), F.col("o_orderpriority").alias("object"), (F.col("o_custkey") % 17 / 10.0).cast("string").alias("confidence")))
    more = F.to_json(F.struct(F.col("o_orderstatus").alias("subject"), F.lit("feeds_on").alias("relation"), F.lit("x {y}").alias("object"), F.lit("sure").alias("confidence")))
    blank = F.lit(', {"subject": " ", "relation": "INHABITS", "object": "reef"}]')
    reply = (
        F.when(kind == 0, F.concat(F.lit("["), item, blank)).when(kind == 1, F.concat(F.lit('<think>[{"subject": "no"}]</think>\n```json\n['), item, F.lit(", "), more, F.lit("]\n```"))).when(kind == 2, F.concat(F.lit("Here: [ "), item, F.lit(" ] done")))
        .when(kind == 3, F.concat(F.lit("["), item, F.lit(", {"))).otherwise("[]")
    )
    return relations.relation_rows(t("orders").withColumn("reply", reply), "reply", ("o_orderkey",)).select("o_orderkey", "subject", "relation", "object", "confidence")


@query("SELECT c_custkey, 2 AS n, c_name || ',' || c_mktsegment AS names, least(4000, 500 * (c_custkey % 10)) AS chars FROM customer WHERE c_custkey % 10 > 0")
def relation_inputs(t, spark):
    """what the reader of relations gets: names once each, texts capped, nothing for blank ones."""
    known = F.array(F.concat(F.lit(" "), F.col("c_name")), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"))
    c = t("customer").select("c_custkey", relations.asked(F.repeat(F.lit("a" * 499 + "b"), (F.col("c_custkey") % 10).cast("int")), known).alias("a")).where("a is not null")
    return c.select("c_custkey", F.size("a.names").alias("n"), F.array_join("a.names", ",").alias("names"), F.length("a.text").alias("chars"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 1 AND o.user_id = e.user_id AND o.event_type = e.event_type) GROUP BY ALL")
def kept_relations(t, spark):
    """Rows whose keys are stored already are skipped, of new ones alike the first is kept."""
    e = t("events").select("user_id", "event_type", "event_id")
    return relations.skip_existing(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ("user_id", "event_type"), "event_id")


@query("""WITH r AS (SELECT user_id, event_id, value / 100 AS score, props FROM events WHERE value / 100 >= 0.25),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, substr(props, 1, 120) ORDER BY score DESC, event_id) AS k FROM r)
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS INT) AS rank FROM f WHERE k = 1 QUALIFY rank <= 6""")
def ranked_chunks(t, spark):
    """The best six texts of each key, of equal beginnings one, above a least score."""
    e = t("events").select("user_id", "event_id", (F.col("value") / 100).alias("score"), "props")
    return chunks.ranked(e, "user_id", "score", "props", "event_id").select("user_id", "event_id", "rank")


@query("""SELECT source, doc_id, hits FROM (SELECT source, doc_id, CAST(contains(low, 'the') AS INT) + CAST(contains(low, 'ung') AS INT) + CAST(contains(low, 'que') AS INT) + CAST(contains(low, 'ción') AS INT) AS hits FROM (SELECT *, lower(coalesce(text, '')) AS low FROM documents))
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) <= 4""")
def keyword_texts(t, spark):
    """Of each key the four texts with most of the keywords."""
    return chunks.by_keywords(t("documents"), "source", "doc_id", "text", ("the", "ung", "que", "ción")).select("source", "doc_id", "hits")


@query("""WITH n AS (SELECT user_id, event_id, substr(repeat(event_type, 60), 1, CAST(greatest(200, 3000 // count(*) OVER (PARTITION BY user_id)) AS BIGINT)) AS s FROM events),
    b AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
    SELECT user_id, event_id, CAST(length(s) AS INT) AS chars FROM b WHERE before < 3000""")
def quota_texts(t, spark):
    """An equal share of a budget for each text, until it is reached."""
    e = t("events").select("user_id", "event_id", F.repeat("event_type", F.lit(60)).alias("text"))
    return chunks.quotas(e, "user_id", "event_id", "text").select("user_id", "event_id", F.length("text").alias("chars"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def pending_rows(t, spark):
    """Approved rows that are not processed yet."""
    done = t("lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return memory.pending(t("orders"), done, "o_orderkey", "o_orderstatus", "F").select("o_orderkey")


@query("SELECT event_type, count(*) AS n_records, (SELECT count(DISTINCT user_id) FROM events) AS n_names, (SELECT count(DISTINCT props) FROM events) AS n_places FROM events WHERE event_id % 3 = 0 GROUP BY event_type")
def session_rollup(t, spark):
    """Records of each session, names and places of the whole bank."""
    e = t("events")
    return memory.session_rollup(e.where("event_id % 3 = 0"), e, "event_type", "user_id", "props")


@query("SELECT l_suppkey, round(avg(l_quantity), 6) AS lat, round(avg(l_tax), 6) AS lon, count(*) AS n FROM lineitem WHERE l_quantity <> 7 GROUP BY l_suppkey")
def map_centroids(t, spark):
    """The mean position of each key, of rows that have both coordinates."""
    p = t("lineitem").select("l_suppkey", F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("lat"), F.col("l_tax").alias("lon"))
    return memory.centroid(p, "l_suppkey", "lat", "lon").select("l_suppkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query("SELECT coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, l_linestatus) AS name, count(*) AS n, min(l_orderkey) AS first FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def grouped_names(t, spark):
    """Approved rows by the first name that is filled."""
    rows = t("lineitem").withColumn("valid", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(" ")).withColumn("status", F.when(F.col("l_quantity") > 25, "approved").otherwise("open"))
    return memory.grouped_by_name(rows, ("valid", "l_linestatus"), "status", "approved", "l_orderkey")


@query("""WITH p AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || ', ' || n_name || '; Reef' WHEN 1 THEN s_name || ' Island, Gulf of ' || n_name WHEN 2 THEN s_name || ' (' || n_name || ', reef)' ELSE s_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    l AS (SELECT s_suppkey, trim(place) AS place, regexp_split_to_array(place, '[;,]\\s*') AS parts, regexp_matches(place, '[()]') AS brackets FROM p),
    h AS (SELECT *, len(list_filter(parts, lambda x: len(list_filter(WORDS, lambda w: contains(lower(x), w))) > 0)) AS hits FROM l)
    SELECT s_suppkey, CASE WHEN brackets OR len(parts) <= 1 OR hits >= len(parts) // 2 THEN 1 ELSE len(parts) END AS n, CASE WHEN brackets OR len(parts) <= 1 OR hits >= len(parts) // 2 THEN place ELSE parts[1] END AS first FROM h""".replace("WORDS", "[" + ", ".join(f"'{w}'" for w in geo.WIDER_PLACES) + "]"))
def separate_places(t, spark):
    """lists of places told from one place with its wider ones."""
    k, j = F.col("s_suppkey") % 4, t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.when(k == 0, F.concat_ws("", "s_name", F.lit(", "), "n_name", F.lit("; Reef"))).when(k == 1, F.concat_ws("", "s_name", F.lit(" Island, Gulf of "), "n_name")).when(k == 2, F.concat_ws("", "s_name", F.lit(" ("), "n_name", F.lit(", reef)"))).otherwise(F.col("s_name"))
    found = j.select("s_suppkey", geo.separate_places(place).alias("p"))
    return found.select("s_suppkey", F.size("p").alias("n"), F.col("p")[0].alias("first"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN props || ' more' ELSE props END AS body, event_id % 4 IN (0, 3) AS sure FROM events")
def confidence_tags(t, spark):
    """Replies without their tag, and whether they are sure."""
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat("props", F.lit("\n[CONFIDENCE: high] x"))).when(k == 1, F.concat(F.lit("<think>[CONFIDENCE: HIGH]</think> "), "props", F.lit(" [confidence:  LOW]"))).when(k == 2, F.concat("props", F.lit(" [CONFIDENCE: MEDIUM]"))).otherwise(F.concat(F.lit(" "), "props", F.lit(" more")))
    body, sure = values.without_confidence(reply)
    return t("events").select("event_id", body.alias("body"), sure.alias("sure"))


@query("""WITH q AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'Port ' || n_name || ' North' ELSE substr(n_name, 2) END AS q FROM nation),
    o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE substr(n_name, 1, length(n_name) - 1) END AS office FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT q, arg_min(s_suppkey, CASE WHEN lower(office) = trim(lower(q)) THEN 0 ELSE 1000000 END + s_suppkey) AS s_suppkey FROM q LEFT JOIN o ON lower(office) = trim(lower(q)) OR contains(lower(office), trim(lower(q))) OR contains(trim(lower(q)), lower(office)) GROUP BY q""")
def office_lookup(t, spark):
    """Offices whose name equals a query, else the first that it is within or that is within it."""
    k = F.col("n_nationkey") % 3
    q = t("nation").select(F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("Port "), "n_name", F.lit(" North"))).otherwise(F.expr("substr(n_name, 2)")).alias("q"))
    o = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.expr("substr(n_name, 1, length(n_name) - 1)")).alias("office"))
    return lookup.office_match(q, o, "q", "office", "s_suppkey").select("q", "s_suppkey")


@query("SELECT upper(n_name) AS n_name, min(s_acctbal) - 0.1 AS lat_min, max(s_acctbal) + 0.1 AS lat_max, min(s_suppkey / 10) - 0.1 AS lon_min, max(s_suppkey / 10) + 0.1 AS lon_max FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def district_boxes(t, spark):
    """The box of each district, with its margin."""
    p = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.col("s_acctbal").alias("lat"), (F.col("s_suppkey") / 10).alias("lon"))
    return lookup.boxes_of(p, ["n_name"], "lat", "lon", 0.1)


@query("SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS code, arg_max(c_acctbal, c_custkey) - 0.15 AS lat_min, arg_max(c_acctbal, c_custkey) + 0.15 AS lat_max, max(c_custkey) - 0.15 AS lon_min, max(c_custkey) + 0.15 AS lon_max FROM customer GROUP BY c_nationkey")
def code_boxes(t, spark):
    """A box around the last row of each code."""
    p = t("customer").select(F.col("c_nationkey").alias("code"), F.col("c_custkey").alias("seq"), F.col("c_acctbal").alias("lat"), F.col("c_custkey").cast("double").alias("lon"))
    return lookup.code_boxes(p, "code", "seq", "lat", "lon")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'Ring' WHEN contains(lower(p_name), 'anvil') THEN 'ANVIL' WHEN contains(lower(p_name), 'widget') THEN 'widget' END AS named FROM part")
def named_states(t, spark):
    """The first known name that a text contains."""
    return t("part").select("p_partkey", lookup.named_in(F.col("p_name"), ("Ring", "ANVIL", "widget")).alias("named"))


@query("""WITH s AS (SELECT n_regionkey AS doc, n_nationkey AS seq, upper('N' || n_nationkey) AS id, n_name AS place FROM nation),
    r AS (SELECT n_nationkey, n_regionkey AS doc, CASE n_nationkey % 3 WHEN 0 THEN 'station n' || n_nationkey WHEN 1 THEN '' ELSE 'N' END AS p FROM nation)
    SELECT n_nationkey, arg_min(s.place, s.seq) AS station_place FROM r LEFT JOIN s ON r.doc = s.doc AND trim(p) <> '' AND (contains(upper(p), id) OR contains(id, upper(p))) GROUP BY n_nationkey""")
def station_places(t, spark):
    """Station ids in the places of records, resolved against the stations of their document."""
    n, k = t("nation"), F.col("n_nationkey") % 3
    s = n.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("seq"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("place"))
    r = n.select("n_nationkey", F.col("n_regionkey").alias("doc"), F.when(k == 0, F.concat(F.lit("station n"), "n_nationkey")).when(k == 1, "").otherwise("N").alias("p"))
    return lookup.resolved_stations(r, "p", s, "doc").select("n_nationkey", "station_place")


@query("SELECT p_partkey, 'Smith, 1900' AS authority, 'sp. nov.' AS status, 'holotype' AS type_status, 'ZSI/AB/' || p_partkey AS voucher, 'Rao Patel' AS collector, p_size AS least, p_size + 5 AS most FROM part")
def morphology_fields(t, spark):
    """Fields of a description by pattern, from what stands around a name."""
    text = F.concat(F.lit("x" + "." * 600), "p_name", F.lit(" sp. nov. Smith, 1900. Length "), F.col("p_size"), F.lit("-"), F.col("p_size") + 5, F.lit(" mm. Holotype: ZSI/AB/"), "p_partkey", F.lit(", coll. by Rao Patel, in mud. " + "." * 600 + " 3 mm"))
    rows = dealt(t("part").select("p_partkey", "p_name", "p_size"), "p_partkey", rows=5000).select("p_partkey", F.upper("p_name").alias("name"), text.alias("text"))
    f = morphology.with_fields(rows, "text", "name", "f").select("p_partkey", "f.authority", "f.status", "f.type_status", F.col("f.vouchers")[0].alias("voucher"), "f.collector", F.col("f.size_mm").alias("size"))
    return f.select("p_partkey", "authority", "status", "type_status", "voucher", "collector", F.col("size")[0].cast("int").alias("least"), F.col("size")[1].cast("int").alias("most"))


@query("""SELECT p_brand, p_partkey, promise FROM (SELECT p_brand, p_partkey, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS promise FROM part)
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY promise DESC, p_partkey) <= 10""")
def promising_names(t, spark):
    """The ten names of each document whose surroundings promise most."""
    s = F.col("p_size")
    context = F.concat_ws(" ", F.when(s % 2 == 0, "type locality: the reef of the long bay."), F.when(s % 3 == 0, "Paratype"), F.when(s % 5 == 0, "first record"), F.when(s % 7 == 0, "4 mm"))
    return morphology.first_names(t("part"), "p_brand", "p_name", context, "p_partkey").select("p_brand", "p_partkey", "promise")


@query("SELECT user_id, array_to_string(list(f ORDER BY m), ',') AS names FROM (SELECT user_id, min(event_id) AS m, arg_min(CASE WHEN event_id % 2 = 0 THEN event_type ELSE upper(event_type) END, event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def names_in_order(t, spark):
    """A4: names of a text in order, of those alike but for case the first."""
    name = F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.upper("event_type")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", name.alias("n")))), lambda x: x["n"])
    return t("events").groupBy("user_id").agg(rows.alias("names")).select("user_id", F.array_join(values.distinct_names(F.col("names")), ",").alias("names"))


@query("""WITH x AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents) WHERE token IN ('the', 'and') GROUP BY ALL)
    SELECT d.doc_id, d.source, CAST(sum(tf) AS BIGINT) AS matched FROM x JOIN documents d USING (doc_id) GROUP BY d.doc_id, d.source HAVING count(*) = 2 ORDER BY matched DESC, d.doc_id LIMIT 50""")
def index_hits(t, spark):
    """The fifty rows that hold all words most often, joined with what is known of them."""
    d = t("documents")
    return memory.hits(memory.tokens(d, "doc_id", "text"), d.select("doc_id", "source"), "doc_id", ("the", "And")).select("doc_id", "source", "matched")


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS para, l_linenumber * 100 AS s, l_linenumber * 100 + 50 AS e, l_returnflag || l_linenumber AS text FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
    n AS (SELECT doc, para * 7 % 5 * 100 + 10 AS s, para * 7 % 5 * 100 + 10 + para * 10 AS e, CASE WHEN para % 2 = 0 THEN text ELSE '?' END AS parent, para AS own FROM p)
    SELECT n.doc, n.own, coalesce(CASE WHEN n.own % 2 = 0 THEN n.own END, r.para) AS para FROM n LEFT JOIN p r ON n.doc = r.doc AND n.s >= r.s AND n.e <= r.e""")
def sentence_parents(t, spark):
    """Sentences with the paragraph that begins like their parent, else the one in whose range they lie."""
    k = F.struct("l_partkey", "l_suppkey")
    p = dealt(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("para")).agg(F.min_by("l_returnflag", k).alias("f"))
    p = p.select("doc", "para", (F.col("para") * 100).alias("start"), (F.col("para") * 100 + 50).alias("end"), F.concat("f", "para").alias("text"))
    at = F.col("para") * 7 % 5 * 100 + 10
    s = p.select("doc", at.alias("start"), (at + F.col("para") * 10).alias("end"), F.when(F.col("para") % 2 == 0, F.col("text")).otherwise("?").alias("parent"), F.col("para").alias("own"))
    return chunks.with_parent(s, p, "doc", of=t("lineitem")).select("doc", "own", "para")


@query("""WITH p AS (SELECT user_id AS doc, event_id AS para, event_type AS section, props AS text FROM events WHERE event_id % 3 = 0),
    s AS (SELECT user_id AS doc, event_id - event_id % 3 AS para, event_id AS pos, event_type AS text, value > 5 AS has FROM events),
    w AS (SELECT *, list_filter(list(CASE WHEN has THEN text END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), lambda x: x IS NOT NULL) AS places, row_number() OVER (PARTITION BY doc, para ORDER BY pos) AS n, count(*) OVER (PARTITION BY doc, para) AS of_ FROM s),
    i AS (SELECT doc, section, substr(arg_min(text, para), 1, 400) AS intro FROM p GROUP BY ALL)
    SELECT p.doc, p.para, i.intro, array_to_string(w.places, ',') AS places FROM p JOIN i USING (doc, section) JOIN w ON p.doc = w.doc AND p.para = w.para AND n = of_ // 2 + 1""")
def extraction_batches(t, spark):
    """Paragraphs with their section's beginning and the places named in sentences nearby."""
    e = t("events")
    p = e.where("event_id % 3 = 0").select(F.col("user_id").alias("doc"), F.col("event_id").alias("para"), F.col("event_type").alias("section"), F.col("props").alias("text"))
    s = e.select(F.col("user_id").alias("doc"), (F.col("event_id") - F.col("event_id") % 3).alias("para"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), (F.col("value") > 5).alias("has_place"))
    return chunks.extraction_batches(p, s, "doc").select("doc", "para", "intro", F.array_join("places", ",").alias("places"))


@query()
def sentence_chunks(t, spark):
    """Whole texts packed sentence by sentence."""
    return chunks.sentence_chunks(t("documents"), ("doc_id",), "text", 1800)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.6 END AS priority FROM nation")
def section_priorities(t, spark):
    """Sections that are urgent."""
    return t("nation").select("n_nationkey", chunks.priority(F.when(F.col("n_nationkey") % 2 == 0, "RESULTS").otherwise("METHODS")).alias("priority"))


@query("SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS key, CAST(row_number() OVER (PARTITION BY regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') ORDER BY p_partkey) AS INT) AS version, p_partkey FROM part")
def drafts_committed(t, spark):
    """Drafts under the key that their heading gives, as versions of an article."""
    from fieldloom.functions.names import slug

    drafts = t("part").select(slug(F.col("p_name"), "_", 80, True).alias("key"), "p_partkey")
    return articles.versions(drafts, "key", "p_partkey").select("key", "version", "p_partkey")
