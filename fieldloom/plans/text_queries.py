"""Queries on texts: splitting, chunking, names, coordinates, damaged JSON, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geo, names, repair, values
from fieldloom.operators import dedup, records, text
from fieldloom.plans.registry import query
from fieldloom.sources import files
from fieldloom.streaming import state

_GUARD = "(^|[^A-Za-z])(" + "|".join(a.replace(".", "[.]") for a in text.ABBREVIATIONS) + r"|[A-Z])\.\x01"
_ONCE = rf"regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '{_GUARD}', '\1\2. ', 'g')"
_SENT = rf"string_split(regexp_replace({_ONCE}, '{_GUARD}', '\1\2. ', 'g'), chr(1))"


@query(rf"SELECT doc_id, pos - 1 AS pos, s AS sentence FROM (SELECT doc_id, {_SENT} AS l FROM documents), unnest(l) WITH ORDINALITY AS u(s, pos)")
def sentence_split(t, spark):
    """Sentences in order, not cut after abbreviations and initials."""
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


@query(rf"""SELECT doc_id, 0 AS level, count(*) AS n, sum(length(substr(text, 1, 2000))) AS chars FROM documents GROUP BY doc_id
    UNION ALL SELECT doc_id, 1, count(*), sum(length(p)) FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p FROM documents) WHERE length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 20 GROUP BY doc_id
    UNION ALL SELECT doc_id, 2, count(*), sum(length(s)) FROM (SELECT doc_id, unnest({_SENT}) AS s FROM documents) WHERE length(s) > 10 GROUP BY doc_id""")
def three_levels(t, spark):
    """A document as sections, paragraphs and sentences."""
    return text.levels(t("documents"), "doc_id", "text").groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, o AS \"offset\", substr(text, CAST(o + 1 AS INT), 600) AS chunk FROM documents, unnest(range(0, CAST(length(text) AS BIGINT), 500)) AS u(o)")
def fixed_windows(t, spark):
    """Windows of fixed size and overlap."""
    return text.fixed_windows(t("documents").select("doc_id", "text"), "text", 600, 100).select("doc_id", F.col("offset").cast("long").alias("offset"), "chunk")


@query(r"""WITH l AS (SELECT page_id, n, line, regexp_extract(line, '^#{1,4}\s+(.*)$', 1) AS h FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '<h([1-4])[^>]*>', chr(10) || '## ', 'g'), '<(/h[1-4]|p)[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages), unnest(ls) WITH ORDINALITY AS u(line, n)),
    s AS (SELECT *, CAST(count(nullif(h, '')) OVER (PARTITION BY page_id ORDER BY n) AS INT) AS section FROM l)
    SELECT page_id, section, max(nullif(h, '')) AS heading, count(*) FILTER (h = '') AS lines FROM s GROUP BY page_id, section""")
def heading_sections(t, spark):
    """Sections by headings, here of pages whose heading tags became hashes."""
    html = F.regexp_replace(F.regexp_replace("html", "<h([1-4])[^>]*>", "\n## "), "<(/h[1-4]|p)[^>]*>", "\n")
    out = text.sections(t("pages").select("page_id", html.alias("md")), "page_id", "md")
    return out.select("page_id", "section", "heading", F.col("lines").cast("long").alias("lines"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 0 THEN round((length(text) - length(replace(text, '|', ''))) * 10000.0 / length(text)) ELSE 0 END AS bars,
    len(list_filter(string_split(text, chr(10)), lambda s: length(s) - length(replace(s, '|', '')) >= 2)) AS rows, len(list_filter(string_split(text, chr(10)), lambda s: length(s) - length(replace(s, '|', '')) >= 2)) >= 3 AS has_table FROM documents""")
def table_stats(t, spark):
    """The tables in a text: density of bars, rows, whether there is one."""
    out = text.table_stats(t("documents").select("doc_id", "text"), "text")
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return out.select("doc_id", F.when(F.length("text") > 0, F.round(bars * 10000.0 / F.length("text"))).otherwise(0.0).alias("bars"), "rows", "has_table")


@query()
def packed_chunks(t, spark):
    """Paragraphs packed greedily with overlap, tables uncut."""
    return text.packed(t("documents"), ("doc_id",), "text", most=1500, overlap=100)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(head), 'abstract|summary') THEN 'ABSTRACT' WHEN regexp_matches(lower(head), 'method|material|study area|sampling') THEN 'METHODS' WHEN regexp_matches(lower(head), 'result|finding') THEN 'RESULTS'
    WHEN regexp_matches(lower(head), 'discussion') THEN 'DISCUSSION' WHEN regexp_matches(lower(head), 'taxonom|systematic|checklist') THEN 'TAXONOMY' WHEN regexp_matches(lower(head), 'reference|bibliograph|literature cited') THEN 'REFERENCES' ELSE 'OTHER' END AS role
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Materials and ' || source WHEN 1 THEN 'Main findings' WHEN 2 THEN 'Systematic list' ELSE source END AS head FROM documents)""")
def section_roles(t, spark):
    """The role of a section by its heading, the first that fits."""
    d = t("documents")
    head = F.when(d["doc_id"] % 4 == 0, F.concat(F.lit("Materials and "), d["source"])).when(d["doc_id"] % 4 == 1, "Main findings").when(d["doc_id"] % 4 == 2, "Systematic list").otherwise(d["source"])
    return d.select("doc_id", text.role(head).alias("role"))


@query(r"""SELECT doc_id, round(least(1.0, CASE WHEN contains(low, 'the and') THEN 0.5 ELSE 0 END + CASE WHEN contains(low, 'the') THEN 0.3 ELSE 0 END + CASE WHEN contains(low, 't. and') THEN 0.15 ELSE 0 END + CASE WHEN contains(low, 'and') THEN 0.05 ELSE 0 END) * 100) AS score FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def chunk_relevance(t, spark):
    """How much a text is about a name."""
    return t("documents").select("doc_id", F.round(text.relevance(F.col("text"), F.lit("the and"), F.lit("the"), F.lit("and")) * 100).alias("score"))


@query("""SELECT source, doc_id, length(substr(text, 1, CAST(5000 - b AS INT))) AS chars FROM (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 5000""")
def budgeted_texts(t, spark):
    """Texts of each key while a budget of characters lasts."""
    return text.budgeted(t("documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 5000).select("source", "doc_id", F.length("text").cast("long").alias("chars"))


@query("""SELECT event_id, array_to_string(list_filter(list(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), lambda x: x IS NOT NULL), ',') AS near FROM events""")
def nearby_units(t, spark):
    """Flagged units up to five before and after."""
    e = t("events").withColumn("flag", F.col("event_type") == "click").withColumn("txt", F.col("event_id").cast("string"))
    return text.nearby(e, "user_id", "event_id", "flag", "txt").select("event_id", F.array_join("near", ",").alias("near"))


@query(r"""SELECT doc_id, max(CAST(x AS INT)) AS stated FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{1,6})', 1)) AS x FROM documents) WHERE CAST(x AS INT) > 1 AND CAST(x AS INT) < 5000 GROUP BY doc_id""")
def stated_count(t, spark):
    """The largest number stated, within bounds."""
    return t("documents").select("doc_id", dedup.stated_count(F.col("text"), "([0-9]{1,6})").alias("stated")).where("stated IS NOT NULL")


@query(r"""SELECT p_partkey, lower(p_name) AS canon, regexp_replace(lower(p_name || ' (x) ' || p_brand), '[^a-z0-9]', '_', 'g') AS slug, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug_short,
    substr(sha1(lower(p_name) || '|' || p_brand), 1, 16) AS node_id, len(string_split(p_name, ' ')) AS words FROM part""")
def name_forms(t, spark):
    """canonical names, slugs, ids and word counts of names with authors and open nomenclature."""
    p = t("part")
    full = F.concat(F.lit("  "), F.col("p_name"), F.lit(" cf. (Genus) Linnaeus, 1758 "))
    return p.select(
        "p_partkey", names.canon_name(full).alias("canon"), names.slug(F.concat(F.col("p_name"), F.lit(" (x) "), F.col("p_brand"))).alias("slug"), names.slug(F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand")), "-", 120, True).alias("slug_short"),
        names.short_hash(F.lower("p_name"), F.col("p_brand")).alias("node_id"), names.cardinality(F.concat(F.col("p_name"), F.lit(" sp."))).alias("words"),
    )


@query("SELECT c_custkey, lower(c_name) || ' near district 5' AS place FROM customer")
def place_forms(t, spark):
    """F2, F8: canonical places."""
    return t("customer").select("c_custkey", names.canon_place(F.concat(F.col("c_name"), F.lit(",  Near dist. 5;"))).alias("place"))


@query("SELECT s_suppkey, s_suppkey % 6 IN (0, 1, 2, 3) AS dropped FROM supplier")
def placeholder_names(t, spark):
    """Placeholders, remains of markup, short names and stages of life are no names."""
    n = F.element_at(F.array(*[F.lit(x) for x in ("__candidate_1_2", "[{a", "abc", "Larvae", "Supplier", "Elysia obtusa")]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return t("supplier").select("s_suppkey", (names.is_placeholder(n) | names.is_life_stage(n)).alias("dropped"))


@query("""WITH k AS (SELECT list(DISTINCT substr(lower(n_name), i, 3)) AS known FROM nation, unnest(range(1, CAST(length(n_name) - 1 AS BIGINT))) AS u(i)),
    o AS (SELECT p_partkey, list_distinct([substr(lower(p_name), i, 3) FOR i IN range(1, CAST(length(p_name) - 1 AS BIGINT))]) AS own FROM part)
    SELECT p_partkey, CAST(len(own) AS INT) AS n, CASE WHEN len(own) > 0 THEN len(list_intersect(own, known)) / len(own) ELSE 0.0 END AS score FROM o, k""")
def trigram_scores(t, spark):
    """the share of a whole name's trigrams that occur in known names."""
    known = t("nation").agg(F.array_distinct(F.flatten(F.collect_list(names.trigrams(F.col("n_name"))))).alias("known"))
    own = F.col("p_name")
    return t("part").crossJoin(F.broadcast(known)).select("p_partkey", F.size(names.trigrams(own)).alias("n"), names.trigram_score(own, F.col("known")).alias("score"))


@query("SELECT doc_id, len(list_distinct([substr(lower(text), i, 3) FOR i IN range(1, CAST(length(text) - 1 AS BIGINT))])) AS n FROM documents")
def trigram_counts_whole(t, spark):
    """the distinct trigrams of a whole text."""
    return t("documents").select("doc_id", F.size(names.trigrams(F.col("text"))).alias("n"))


@query(r"SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]{4,}'))  IS NOT NULL AS any_, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]{4,}'))) AS n FROM documents")
def binomials(t, spark):
    """Two-part names by pattern, each once."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [a-z]{4,}"), F.lit(0)))
    return t("documents").select("doc_id", found.isNotNull().alias("any_"), F.size(found).alias("n"))


@query("""SELECT p_partkey, CAST(round(1000 * least(1.0, CASE WHEN p_size > 25 THEN 0.4 ELSE 0 END + least(0.3, 0.3 * p_size / 50.0) + CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 0.15 ELSE 0.08 END ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 0.05 ELSE 0 END) / 10) AS INT) AS score FROM part""")
def match_confidence(t, spark):
    """The confidence of a match from several authorities (in hundredths)."""
    s = F.col("p_size")
    return t("part").select("p_partkey", F.round(names.match_confidence(s > 25, s / 50.0, s % 2 == 0, s % 3 == 0, s % 5 == 0, s % 7 == 0) * 100).cast("int").alias("score"))


@query("SELECT n_nationkey, n_name AS family, r_name AS kingdom FROM nation JOIN region ON n_regionkey = r_regionkey")
def classification_paths(t, spark):
    """two parallel lists as a map of ranks, of equal ranks the last."""
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = names.rank_map(F.concat_ws("|", F.lit("old"), "r_name", "n_name"), F.lit("Kingdom|kingdom|Family"))
    return j.select("n_nationkey", m["family"].alias("family"), m["kingdom"].alias("kingdom"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'FOUND_AT' WHEN 1 THEN 'FOUND_AT' WHEN 2 THEN 'INHABITS' ELSE 'EATS_WITH' END AS relation FROM orders")
def relation_names(t, spark):
    """relation names repaired by containment; unknown ones stay."""
    r = F.element_at(F.array(*[F.lit(x) for x in ("  found_at  ", "IS FOUND_AT HERE", "PREVIOUSLY INHABITS", "eats_with")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t("orders").select("o_orderkey", names.relation_type(r, ("FOUND_AT", "INHABITS")).alias("relation"))


@query("SELECT event_id, event_id % 5 <> 4 AS parsed, CASE WHEN event_id % 5 <> 4 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_repair(t, spark):
    """objects of one key out of fenced, wrapped, truncated and commented replies."""
    kind, p = F.col("event_id") % 5, F.col("props")
    reply = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("<think>{\"k\": 0}</think>```json\n["), p, F.lit("]\n```"))).when(kind == 2, F.concat(F.lit('{"items": ['), p, F.lit(", {\"k\": 1"))).when(kind == 3, F.concat(F.lit("Here it is: "), p, F.lit(" and more"))).otherwise("nothing {k: }")
    one = F.try_element_at(repair.records(reply, "k long", 1), F.lit(1))
    return t("events").select("event_id", one.isNotNull().alias("parsed"), one["k"].alias("k"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN user_id END AS who, event_type AS kind,
    CASE WHEN event_id % 6 = 2 THEN 2 ELSE 1 END AS n FROM events""")
def nested_replies(t, spark):
    """objects six levels deep out of replies that are sound, fenced, in a list within comments, cut off at several places, or have
    commas before closing brackets and strings with brackets in them."""
    inner = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "a": {"b": [{"c": {"d": '), F.col("props"))
    who = F.concat(F.lit(', "note": "a } ] \\" {", "who": '), F.col("user_id"))
    sound = F.concat(inner, F.lit("}}]}"), who, F.lit("}"))
    swapped = F.concat(F.lit('{"a": {"b": [{"c": {"d": '), F.col("props"), F.lit("}}]}, "), F.lit('"kind": "'), F.col("event_type"))
    ways = [
        sound, F.concat(F.lit("<think>{no}</think>```json\n["), sound, F.lit("]\n```")), F.concat(F.lit("Found [none] but ["), sound, F.lit(", "), sound, F.lit(", 7,] and so on")),
        inner, F.concat(swapped, F.lit('", "kin')), F.concat(inner, F.lit(",},},],},"), F.substring(who, 2, 1000), F.lit(",}")),
    ]
    reply = F.element_at(F.array(*ways), (F.col("event_id") % 6 + 1).cast("int"))
    found = t("events").select("event_id", repair.objects(reply, 2).alias("found"))
    one = F.try_element_at("found", F.lit(1))
    get = lambda path: F.get_json_object(one, path)
    return found.select("event_id", get("$.a.b[0].c.d.k").cast("long").alias("k"), get("$.who").cast("long").alias("who"), get("$.kind").alias("kind"), F.size("found").alias("n"))


@query("SELECT event_id, CAST(round((degrees + minutes / 60.0) * 1000) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS lat FROM (SELECT event_id, event_id % 90 AS degrees, event_id % 60 AS minutes FROM events)")
def degrees_parse(t, spark):
    """degrees and minutes, some with damaged marks, as numbers (in thousandths)."""
    d, m, h = F.col("event_id") % 90, F.col("event_id") % 60, F.when(F.col("event_id") % 2 == 0, "S").otherwise("N")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat_ws("", d, F.lit("°"), m, F.lit("'"), h)).when(F.col("event_id") % 3 == 1, F.concat_ws("", d, F.lit(" deg "), m, F.lit("′ "), h)).otherwise(F.concat_ws("", d, F.lit("º "), m, F.lit("`"), h))
    return t("events").select("event_id", F.round(F.abs(geo.parse_degrees(raw, True)) * 1000).cast("long").alias("a"), h.alias("h")).select("event_id", (F.col("a") * F.when(F.col("h") == "S", -1).otherwise(1)).alias("lat"))


@query("SELECT event_id, 2 AS n, CAST(round(value * 1000) AS BIGINT) AS first FROM events WHERE value < 90")
def coordinate_pairs(t, spark):
    """pairs of decimal coordinates in a text, within range."""
    v = F.format_string("%.3f", F.col("value"))
    c = F.concat(F.lit("at "), v, F.lit(", 45.1234 and 200.000, 1.000; 12.3456; -"), v, F.lit("."))
    e = t("events").where("value < 90").select("event_id", geo.coordinate_pairs(c).alias("p"))
    return e.select("event_id", F.size("p").alias("n"), F.round(F.col("p")[0]["lat"] * 1000).cast("long").alias("first"))


@query("SELECT p_partkey, (contains(lower(p_name || ' ' || p_type), 'deep') OR contains(lower(p_name || ' ' || p_type), 'sea') OR p_size % 2 = 0) AS marine FROM part")
def marine_context(t, spark):
    """words that say a place is at sea, also within others."""
    return t("part").select("p_partkey", geo.at_sea(F.col("p_name"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "Coral Reefs").otherwise("land")).alias("marine"))


@query("SELECT c_custkey, x AS place FROM customer, unnest([c_name, 'Harbour', 'Long Beach', 'inner']) AS u(x)")
def place_split(t, spark):
    """a compound place as one row for each part."""
    c = F.concat(F.col("c_name"), F.lit(" and Harbour; Long Beach (inner) & abc"))
    return t("customer").select("c_custkey", F.explode(geo.split_places(c)).alias("place"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN s_name ELSE s_name || chr(10) || chr(10) || 'new' END AS body FROM supplier")
def section_merge(t, spark):
    """New text set, kept out or appended."""
    old = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name"))
    new = F.when(F.col("s_suppkey") % 3 == 1, F.substring("s_name", 1, 5)).otherwise("new")
    return t("supplier").select("s_suppkey", records.merge_text(old, new).alias("body"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A full citation of the document' ELSE 'An own citation that is long enough' END AS citation FROM orders")
def citation_stamp(t, spark):
    """Poor citations give way to the document's."""
    c = F.when(F.col("o_orderkey") % 4 == 0, "file.pdf").when(F.col("o_orderkey") % 4 == 2, " ").otherwise("An own citation that is long enough")
    return t("orders").select("o_orderkey", records.stamp_citation(c, F.lit("Title"), F.lit("A full citation of the document")).alias("citation"))


@query("SELECT s_suppkey, CAST(round(s_acctbal, 0) AS BIGINT) AS v, s_name AS name FROM supplier")
def record_normalise(t, spark):
    """Aliases coalesced, blanks as missing, texts cut, rows without a name left out."""
    s = t("supplier").select("s_suppkey", F.round("s_acctbal").cast("long").alias("v"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(F.col("s_name")).alias("validName"), F.concat(F.col("s_name"), F.lit("  ")).alias("recordedName"))
    return records.normalise(s, {"name": ["validName", "recordedName", "Recorded Name"]}, {"name": 300}, "name")


@query("SELECT n_nationkey AS code, CAST(n_nationkey AS DOUBLE) + 0.5 AS latitude, n_name AS place FROM nation WHERE n_nationkey % 2 = 0")
def gazetteer_scan(t, spark):
    """A gazetteer of tab-separated lines with a mark of byte order, numbers coerced, columns found by their names."""
    lines = t("nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") + 0.5).cast("string")).otherwise("n/a"), "n_name").alias("value"))
    return files.parse_lines(lines, ["Postal_Code", "LATITUDE", "place_name"], {"code": ("pin", "postal"), "latitude": ("lat",), "place": ("place",)}, {"code": "long", "latitude": "double", "place": "string"}).where("latitude IS NOT NULL")


@query("SELECT user_id, CAST((rn - 1) // 8 AS INT) AS flush, count(*) AS n, min(event_id) AS first FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY ALL")
def count_buffer(t, spark):
    """ST2: rows of a key flushed in groups of eight."""
    return state.flushed_by_count(t("events"), "user_id", "event_id", 8).groupBy("user_id", "flush").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query()
def size_buffer(t, spark):
    """ST2: rows of a key flushed at so many characters or rows."""
    return state.flushed_by_size(t("documents"), "source", "doc_id", "text", 12_000, 8)


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-01' + INTERVAL 90 DAY")
def dirty_and_fresh(t, spark):
    """ST3, ST4: keys to be done again, and cached rows that are still young."""
    return state.fresh(t("events"), "ts", F.lit("2024-03-31").cast("timestamp_ntz"), 90).where("event_type = 'signup'").select("user_id").distinct()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(t, spark):
    """Counts by hour and type; the same expression runs on a stream with a watermark."""
    return state.windowed_counts(t("events"), "ts", "1 hour", "event_type").withColumnRenamed("start", "hour")


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z0-9_])-\n([A-Za-z0-9_])', '\\1\\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS clean FROM documents")
def scanned_text(t, spark):
    """Scanned text cleaned: hyphens at line ends joined, empty lines collapsed."""
    return t("documents").select("doc_id", files.clean_scan(F.col("text"), trim_lines=False).alias("clean"))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def export_columns(t, spark):
    """K2, K3, K4: a fixed set of columns in order, written as CSV and read again."""
    return files.round_trip_csv(t("part"), ["p_partkey", "p_name", "p_brand", "p_type"], ["p_type", "p_brand", "p_partkey"])


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 0")
def values_helpers(t, spark):
    """The first filled value and rounding of halves to even."""
    o = t("orders").select("o_orderkey", values.first_filled(F.lit(" "), F.col("o_orderstatus")).alias("s"))
    return o.where("s <> ''").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(r"""WITH g AS (SELECT doc_id, regexp_extract_all(text, '(?:^|[^\p{L}])([A-Z][a-z]{2,}) [a-z]{4,}', 1) AS genera, list_distinct(regexp_extract_all(text, '(?:^|[^\p{L}.])([A-Z]\. ?[a-z]{3,})', 1)) AS short FROM (SELECT doc_id, replace(text, ', ', ' B. ') AS text FROM documents)),
    s AS (SELECT doc_id, genera, unnest(short) AS given FROM g)
    SELECT doc_id, given, list_filter(genera, lambda x: substr(x, 1, 1) = substr(given, 1, 1))[1] || ' ' || regexp_replace(given, '^[A-Z]\. ?', '') AS name FROM s""")
def abbreviated_names(t, spark):
    """Names with an abbreviated genus, expanded by the first full name with its letter."""
    from fieldloom.operators import scans

    d = t("documents").select("doc_id", F.explode(scans.abbreviated(F.replace("text", F.lit(", "), F.lit(" B. ")))).alias("a"))
    return d.select("doc_id", "a.given", "a.name")
