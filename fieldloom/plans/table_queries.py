"""Queries on bar tables, sections, study context, unique items of articles, approval and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.operators import articles, bar_tables
from fieldloom.operators import review_rules as rules
from fieldloom.plans.registry import query
from fieldloom.sources import files
from fieldloom.sources.tables import shared_dir


@query("""WITH f AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY ALL),
    g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey DESC) <= 50)
    SELECT l_suppkey, count(*) AS n, array_to_string(list(l_partkey ORDER BY s, l_partkey), ',') AS parts FROM g GROUP BY l_suppkey""")
def unique_points(t, spark):
    """Points (and provenance) unique by a key of their own, in the order first seen, the last 50."""
    rows = t("lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = articles.unique_items(rows, "l_suppkey", "seq", F.col("l_partkey"), ["l_partkey"], most=50)
    return found.select("l_suppkey", F.size("items").cast("long").alias("n"), F.array_join(F.col("items.l_partkey").cast("array<string>"), ",").alias("parts"))


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_id % 7 > 0 THEN lower(event_type) END AS number FROM events),
    k AS (SELECT user_id, min(event_id) AS event_id FROM v WHERE number IS NOT NULL GROUP BY user_id, number UNION ALL SELECT user_id, event_id FROM v WHERE number IS NULL)
    SELECT user_id, array_to_string(list(event_id ORDER BY event_id), ',') AS kept FROM k GROUP BY user_id""")
def unique_vouchers(t, spark):
    """Vouchers unique by number, whatever the case, those without a number all kept."""
    number = F.when(F.col("event_id") % 7 > 0, F.lower("event_type")).otherwise(" ")
    found = articles.unique_items(t("events"), "user_id", "event_id", number, ["event_id"], keep_blank=True)
    return found.select("user_id", F.array_join(F.col("items.event_id").cast("array<string>"), ",").alias("kept"))


@query("""SELECT p_partkey, coalesce(p_size % 3 > 0 AND ((p_partkey % 4 < 2 AND p_size >= 25) OR p_partkey % 5 = 0), false) AS approved FROM part""")
def approved_matches(t, spark):
    """Matches that need no review: accepted with a high score, or known to another authority."""
    k = F.col("p_partkey")
    match = F.when(F.col("p_size") % 3 == 1, "EXACT").when(F.col("p_size") % 3 == 2, "FUZZY")
    other = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, " ")
    return t("part").select("p_partkey", rules.auto_approved(F.when(k % 4 < 2, "ACCEPTED").otherwise("SYNONYM"), F.col("p_size"), match, other, 25).alias("approved"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS atom_id, c_mktsegment AS phylum, c_name AS valid_name, CAST(NULL AS VARCHAR) AS last_seen, 28 AS n_columns FROM customer")
def memory_export(t, spark):
    """K3: rows under the 28 columns of the export, written in order and read again."""
    rows = t("customer").select(F.col("c_custkey").alias("atom_id"), F.col("c_mktsegment").alias("phylum"), F.col("c_name").alias("valid_name"), "c_acctbal")
    path = f"{shared_dir(spark)}/fieldloom/export-{uuid.uuid4().hex}"
    files.write_export(rows, path)
    back = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in files.EXPORT_COLUMNS))
    return back.select("atom_id", "phylum", "valid_name", "last_seen", F.lit(len(back.columns)).alias("n_columns"))


_LINE = "concat('| ', l_partkey, ' | ', l_linenumber, ' | Nereis pelagica |')"


def _order_tables(t):
    """One text for each order, with a table of its lines under a heading, and its last line as a chunk."""
    own = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr(_LINE).alias("line")))).alias("l"))
    head = F.concat(F.lit("## Order "), F.col("l_orderkey"), F.lit("\n\n| part | line | name |\n|---|:---:|---|\n"))
    return own.select("l_orderkey", F.concat(head, F.array_join("l.line", "\n"), F.lit("\n\nend")).alias("text"), F.element_at("l.line", -1).alias("chunk"), F.size("l").alias("n"))


_SQL_LINES = """SELECT l_orderkey, count(*) AS n, max(struct_pack(k := l_linenumber, v := line)).v AS last, sum(length(line) + 1) - 1 AS chars
    FROM (SELECT *, '| ' || l_partkey || ' | ' || l_linenumber || ' | Nereis pelagica |' AS line FROM lineitem) GROUP BY l_orderkey"""


@query(f"""SELECT l_orderkey, CASE WHEN n >= 3 THEN '[TABLE HEADER — ''Order ' || l_orderkey || ''']' || chr(10) || '| part | line | name |' || chr(10) || '|---|---|---|' || chr(10) || chr(10) || last ELSE last END AS chunk FROM ({_SQL_LINES})""")
def table_headers(t, spark):
    """Chunks cut out of a table get its header back."""
    texts = _order_tables(t)
    tables = texts.select("l_orderkey", bar_tables.tables_of(F.col("text")).alias("tables"))
    return bar_tables.with_headers(texts.select("l_orderkey", "chunk"), "l_orderkey", "chunk", tables)


@query(f"""SELECT l_orderkey, '[TABLE CHUNK — ' || (n + 2) || ' rows detected]' || chr(10) || 'Source: s' || chr(10) || 'Column headers: | part | line | name |' || chr(10) || 'one record a row' AS before, true AS binomial
    FROM ({_SQL_LINES}) WHERE 4 + 4 * n + 4 > 0.07 * (40 + chars + length('## Order ' || l_orderkey) + 2 + 5 + 1)""")
def table_prefixes(t, spark):
    """Texts that are mostly a table, with what the reader is told of them."""
    texts = _order_tables(t).withColumn("d", bar_tables.described(F.col("text"))).where("d.dense")
    told = bar_tables.prefixed(F.col("text"), F.lit("s"), "one record a row")
    return texts.select("l_orderkey", F.substring_index(told, "\n\n", 1).alias("before"), F.col("d.binomial").alias("binomial"))


@query()
def section_chunks(t, spark):
    """Whole texts cut at headings of both styles, each section with the end of the one before."""
    return bar_tables.section_chunks(t("documents"), ("doc_id",), "text")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, 'Bay' || chr(CAST(97 + o_custkey % 26 AS INT)) || ' Reef' AS place FROM orders)
    SELECT o_orderkey, 'METHODS' AS role, '' AS context FROM o UNION ALL
    SELECT o_orderkey, 'RESULTS', '[STUDY CONTEXT from Methods section]' || chr(10) || 'Localities: ' || place || chr(10) || 'Collection period: ' || y || '-' || (y + 1) || chr(10) || 'Depth range: at a depth of ' || o_custkey || ' m' FROM o""")
def study_context(t, spark):
    """Places, dates and depths of the methods go with the results."""
    place, year = F.concat(F.lit("Bay"), F.char(97 + F.col("o_custkey") % 26), F.lit(" Reef")), F.year("o_orderdate")
    methods = F.concat(F.lit("taken off "), place, F.lit(" in "), year, F.lit("-"), year + 1, F.lit(", at a depth of "), F.col("o_custkey"), F.lit(" m, see Table 1"))
    row = lambda n, heading, role, body: F.struct(F.lit(n).alias("section"), F.lit(heading).alias("heading"), F.lit(role).alias("role"), body.alias("body"))
    sections = t("orders").select("o_orderkey", F.explode(F.array(row(1, "Methods", "METHODS", methods), row(2, "Results", "RESULTS", F.lit("found")))).alias("s")).select("o_orderkey", "s.*")
    return rules.with_study_context(sections, "o_orderkey").select("o_orderkey", "role", "context")
