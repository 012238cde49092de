"""Queries on records: scans, filters, deduplication, conflicts, staging and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import values
from fieldloom.operators import dedup, records, scans
from fieldloom.plans.registry import query

EVENT_PRIORITY = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"


@query(f"""SELECT user_id, event_type, event_id, first_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {EVENT_PRIORITY}, length(props) DESC, event_id) AS rn, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seq FROM events) WHERE rn = 1""")
def priority_dedup(t, spark):
    """A1: the best record of each key by priority, evidence and order."""
    e = t("events").select("event_id", "user_id", "event_type", "props")
    return dedup.priority_dedup(e, ["user_id", "event_type"], F.expr(EVENT_PRIORITY), F.col("props"), "event_id").select("user_id", "event_type", "event_id", "first_seq")


@query("SELECT user_id, day, event_id FROM (SELECT user_id, strftime(ts, '%Y-%m') AS day, event_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def year_month_dedup(t, spark):
    """A3: the first record of each name and month."""
    e = t("events").select("user_id", F.date_format("ts", "yyyy-MM").alias("day"), "event_id")
    return dedup.first_of_each(e, ["user_id", "day"], "event_id")


@query("""SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT (o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')
    AND EXISTS (SELECT 1 FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')))""")
def suppress_general(t, spark):
    """Rows at a general level go where the same name has a specific one."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return dedup.suppress_general(o, "o_custkey", F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"))


@query("""SELECT l_partkey, l_suppkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT lower(l_returnflag))), ',') AS flags FROM lineitem
    GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT lower(l_returnflag)) > 1""")
def conflict_detection(t, spark):
    """A5: keys whose rows disagree."""
    return dedup.conflicts(t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey", "l_suppkey"], "l_returnflag").select("l_partkey", "l_suppkey", "n", F.array_join("values", ",").alias("flags"))


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 500")
def latest_rows(t, spark):
    """The latest rows, a report of fixed size."""
    return scans.latest(t("events").select("event_id", "user_id", "event_type", "value"), "event_id", 500)


@query("SELECT event_id, user_id, event_type, value FROM events")
def all_rows_latest_first(t, spark):
    """All rows, the latest first."""
    return scans.latest(t("events").select("event_id", "user_id", "event_type", "value"), "event_id")


@query("SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS reviewer, 'unknown' AS place FROM events WHERE user_id = 7 AND (event_type IS NULL OR event_type <> 'error')")
def live_rows_of_key(t, spark):
    """S3: rows of one key that are not rejected, null kept; columns that are missing come as null or a default."""
    columns = {"event_id": "long", "event_type": "string", "reviewer": "string", "place": "string"}
    return scans.of_key(scans.live(t("events"), "event_type", "error"), "user_id", 7, columns, {"place": "unknown"})


@query("SELECT event_id, event_type, 'unknown' AS place FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 200")
def capped_rows_of_key(t, spark):
    """The same, the first two hundred."""
    return scans.of_key(t("events"), "event_type", "click", {"event_id": "long", "event_type": "string", "place": "string"}, {"place": "unknown"}, "event_id", 200)


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events WHERE value > 5 GROUP BY user_id")
def first_row_lookup(t, spark):
    """The first row of each key that fulfils a condition."""
    return scans.first_rows(t("events").select("user_id", "event_type", "event_id", "value"), "user_id", F.col("value") > 5, "event_id").select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT coalesce(r_name, '') AS r_name, coalesce(n_name, '') AS n_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey")
def distinct_hierarchy(t, spark):
    """Distinct paths of a hierarchy, blanks for nulls."""
    h = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return scans.hierarchy(h, ("r_name", "n_name", "c_mktsegment"))


@query("""SELECT event_id FROM events WHERE (CASE WHEN value < 5 THEN NULL ELSE value END IS NULL) AND event_type <> 'error'""")
def missing_value_scan(t, spark):
    """Rows without a coordinate that are not rejected; by a bare comparison, null status drops out."""
    e = t("events").select("event_id", "event_type", "props", F.when(F.col("value") >= 5, F.col("value")).alias("lat"), F.lit(1.0).alias("lon"))
    return scans.live(e.where("lat is null"), "event_type", "error", keep_null=False).select("event_id")


@query("""SELECT event_id, keeps FROM (SELECT event_id, value, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' THEN 'rejected' ELSE 'open' END AS status, event_id % 5 > 0 AS placed FROM events), (VALUES (TRUE), (FALSE)) AS v(keeps)
    WHERE value < 5 AND placed AND (status <> 'rejected' OR (keeps AND status IS NULL))""")
def rows_to_geocode(t, spark):
    """Live rows with a place but without a coordinate, with and without those of null status."""
    e = t("events").select(
        "event_id", F.when(F.col("value") >= 5, F.col("value")).alias("lat"), F.lit(1.0).alias("lon"), F.when(F.col("event_id") % 5 > 0, "Bay").otherwise(" ").alias("place"),
        F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_type") == "error", "rejected").otherwise("open")).alias("status"),
    )
    both = [scans.without_place(e, "lat", "lon", "place", "status", keep).select("event_id", F.lit(keep).alias("keeps")) for keep in (True, False)]
    return both[0].union(both[1])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 < 2")
def primary_rows(t, spark):
    """Rows of the primary type, whatever its case."""
    k = F.col("o_orderkey") % 3
    return scans.primary_only(t("orders").withColumn("kind", F.when(k == 0, "Primary").when(k == 1, " PRIMARY ").otherwise("secondary")), "kind").select("o_orderkey")


@query("SELECT user_id, event_type, count(*) AS times FROM events GROUP BY ALL ORDER BY times DESC, event_type, user_id LIMIT 10")
def most_confirmed(t, spark):
    """The ten facts confirmed most often."""
    atoms = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("times"))
    return scans.most_confirmed(atoms.withColumn("key", F.concat_ws("|", "event_type", F.lpad(F.col("user_id").cast("string"), 12, "0"))), "times", "key").drop("key")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_user_id, CAST(round_even(1000.0 * count(*) FILTER (event_id % 4 > 0) / count(*), 0) AS BIGINT) AS tenths FROM events GROUP BY event_type")
def coverage_statistics(t, spark):
    """Counts, distinct counts and the share of rows in which a column is filled (in tenths of a percent)."""
    e = t("events").withColumn("place", F.when(F.col("event_id") % 4 > 0, "Bay").otherwise(" "))
    return scans.statistics(e, "event_type", ("user_id",), ("place",)).select("event_type", "n", "n_user_id", F.bround(F.col("pct_place") * 10).cast("long").alias("tenths"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus || l_linenumber AS n FROM lineitem), p AS (SELECT y.n AS other, count(*) AS weight FROM m x JOIN m y USING (l_suppkey) WHERE x.n = 'AF1' AND y.n <> 'AF1' GROUP BY ALL)
    SELECT other, weight FROM p WHERE weight >= 2""")
def co_occurring(t, spark):
    """O2: what occurs with a name, from a least weight."""
    from fieldloom.operators import graph

    m = t("lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("n")).distinct()
    return scans.co_occurring(graph.co_occurrence(m, "l_suppkey", "n"), "AF1", 2)


@query("""SELECT c_custkey, n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('ASIA', 'EUROPE') AND c_mktsegment IN ('BUILDING')""")
def hierarchical_filter(t, spark):
    """A cascade of selections, from the top of a hierarchy down; empty selections are ignored."""
    chosen = {"r_name": ["ASIA", "EUROPE"], "n_name": [], "c_mktsegment": ["BUILDING"]}
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return scans.chosen(df, chosen).select("c_custkey", "n_name", "r_name", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_type) = 'economy' AND coalesce(p_size, 0) >= 10 ORDER BY p_name, p_partkey LIMIT 5000")
def filtered_rows(t, spark):
    """Filters with null as zero, whatever the case, in order, as many as one view shows."""
    return t("part").where((F.lower("p_type") == "economy") & (F.coalesce("p_size", F.lit(0)) >= 10)).orderBy("p_name", "p_partkey").limit(5000).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)RED|ring$') OR regexp_matches(p_brand, '(?i)brand#1$')")
def contains_filter(t, spark):
    """A pattern in either of two columns, whatever the case; null is no match."""
    p = t("part").select("p_partkey", "p_name", "p_brand")
    return scans.containing(p, ("p_name",), "RED|ring$").union(scans.containing(p, ("p_brand",), "brand#1$")).select("p_partkey").distinct()


@query("""SELECT s_suppkey, concat_ws(' > ', nullif(r_name, ''), nullif(n_name, '')) AS path, substr(s_name, 1, 10) AS head, CAST(round(s_acctbal) AS BIGINT) AS score
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def verification_view(t, spark):
    """A display projection over left lookups: filled levels joined, texts cut, scores rounded."""
    df = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return df.select("s_suppkey", F.concat_ws(" > ", values.filled(F.col("r_name")), values.filled(F.col("n_name"))).alias("path"), F.substring("s_name", 1, 10).alias("head"), F.round("s_acctbal").cast("long").alias("score"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'Primary' WHEN event_type = 'view' THEN 'Secondary' ELSE 'Uncertain' END AS kind,
    CASE WHEN user_id % 11 = 0 THEN 0.0 WHEN user_id % 7 = 0 THEN 0.5 ELSE 0.9 END AS confidence,
    concat_ws(',', CASE WHEN user_id % 11 = 0 THEN 'no_name' END, CASE WHEN user_id % 7 = 0 THEN 'no_place' END, CASE WHEN value > 90 THEN 'latitude_range' END, CASE WHEN value * 2 > 180 THEN 'longitude_range' END) AS flags FROM events""")
def record_validation(t, spark):
    """Types coerced, confidence lowered and flags set by rules."""
    e = t("events")
    name, place = F.when(F.col("user_id") % 11 != 0, "x"), F.when(F.col("user_id") % 7 != 0, "y")
    score, flags = records.validated(name, place, F.lit(0.9), F.lit(False), F.col("value"), F.col("value") * 2)
    kind = records.record_type(F.when(F.col("event_type") == "click", "primary").when(F.col("event_type") == "view", "SECONDARY").otherwise(F.col("event_type")))
    return e.select("event_id", kind.alias("kind"), score.alias("confidence"), F.concat_ws(",", flags).alias("flags"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 'raised' ELSE o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_custkey % 50 <> 0""")
def overlay_update_delete(t, spark):
    """Updates and deletes by key, as the next version of the table."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    patch = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("P").alias("o_orderstatus"), F.lit("raised").alias("o_orderpriority"))
    return records.overlay(o, patch, "o_orderkey", o.where("o_custkey % 50 = 0")).drop("o_custkey")


@query("""SELECT o_orderkey, name, place, 'pending' AS status, 0.0 AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(name), lower(place) ORDER BY o_orderkey) AS rn FROM (SELECT o_orderkey, 'Customer ' || o_custkey AS name, o_orderpriority AS place FROM orders WHERE o_orderkey % 3 <> 0) b
    WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 3 = 0 AND s.o_orderstatus <> 'F' AND lower('Customer ' || s.o_custkey) = lower(b.name) AND lower(s.o_orderpriority) = lower(b.place))) WHERE rn = 1""")
def review_staging(t, spark):
    """Rows staged for review unless an open row with the same name and place exists, the first of equals."""
    o = t("orders").select("o_orderkey", F.concat(F.lit("Customer "), F.col("o_custkey")).alias("name"), F.col("o_orderpriority").alias("place"), "o_orderstatus")
    staged = o.where("o_orderkey % 3 = 0").withColumn("status", F.when(F.col("o_orderstatus") == "F", "committed").otherwise("pending"))
    new = records.stage(o.where("o_orderkey % 3 <> 0").drop("o_orderstatus"), staged, "name", "place", "o_orderkey", F.lit(None).cast("double"))
    return new.select("o_orderkey", "name", "place", "status", "confidence")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'committed' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ALL")
def review_commit_counts(t, spark):
    """Verified rows are committed; rows counted by status."""
    staged = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "verified").otherwise(F.col("o_orderstatus")).alias("status"))
    return records.commit(staged)[1].groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, content_hash FROM (SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 16) AS content_hash FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 4 = 0 AND substr(sha1(coalesce(s.text, '')), 1, 16) = d.content_hash)")
def unseen_documents(t, spark):
    """ST1, S13, K19: documents whose content hash has not been processed."""
    d = t("documents").select("doc_id", "text")
    seen = d.where("doc_id % 4 = 0").select(F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 16).alias("content_hash"))
    return records.new_by_hash(d, seen, "text").select("doc_id", "content_hash")


@query("SELECT event_id, value FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE event_type = 'purchase' OR n <= 60")
def gated_rows(t, spark):
    """Rows without a mark are skipped only where their group is large."""
    return scans.gated(t("events"), "user_id", F.col("event_type") == "purchase", 60).select("event_id", "value")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'from supplier' ELSE c_mktsegment END AS segment FROM customer""")
def fill_blanks(t, spark):
    """Blank values filled from another table by key."""
    c = t("customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("segment"))
    return values.fill_blanks(c, c.select("c_custkey", F.lit("from supplier").alias("segment")), "c_custkey", ("segment",))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (value > 20) AS high FROM events GROUP BY event_type""")
def dashboard_counts(t, spark):
    """Counts, distinct counts, null counts and conditional counts."""
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.col("value") > 20).alias("high"))


@query("""SELECT stage, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (event_id % 5) * 1000000000 + event_id) AS stage FROM events GROUP BY user_id) GROUP BY stage""")
def last_stage_counts(t, spark):
    """The last stage that each key has reached, counted."""
    return scans.last_stages(t("events").withColumnRenamed("event_type", "stage"), "user_id", "stage", (F.col("event_id") % 5) * 1000000000 + F.col("event_id"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_operations(t, spark):
    """2.8: union, intersection and difference of names."""
    o = t("orders")
    keys = lambda cond: o.where(cond).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").intersect(keys("o_orderstatus = 'F'")).intersect(keys("o_orderstatus = 'O'")).subtract(keys("o_orderpriority = '1-URGENT'"))
