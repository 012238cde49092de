"""Queries on verification, replies and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import calls
from fieldloom.operators import verify
from fieldloom.plans.registry import query


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' WHEN p_partkey % 3 = 0 THEN 'B' END AS family, CAST(CASE WHEN p_partkey % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 15 ELSE 0 END AS INT) AS score, CASE WHEN p_partkey % 2 = 0 THEN 'verified' ELSE 'unverified' END AS status FROM part""")
def verification_cascade(t, spark):
    """2.12, J5, J6, F20: fields and confidence from several authorities, earlier ones first."""
    p = t("part").select("p_partkey", F.concat(F.lit("Name"), F.col("p_partkey"), F.lit(" species")).alias("name"))
    table = lambda n, family, score: p.where(F.col("p_partkey") % n == 0).select(F.lower("name").alias("key"), F.lit(family).alias("family"), F.lit(score).alias("score"))
    out = verify.verified(p, "name", {"first": table(2, "A", 2 / 3), "second": table(3, "B", 1.0)}, ["family"])
    return out.select("p_partkey", "family", F.round(F.col("confidence") * 100).cast("int").alias("score"), "status")


@query("""SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Accepted ' || n_name ELSE n_name END AS accepted, 'Chordata' AS phylum FROM nation""")
def nested_reply(t, spark):
    """nested replies to name, accepted name and ranks."""
    accepted = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(', "accepted": {"name": {"scientificName": "Accepted '), F.col("n_name"), F.lit('"}}'))).otherwise("")
    reply = F.concat(F.lit('{"usage": {"name": {"scientificName": "'), F.col("n_name"), F.lit('"}, "status": "SYNONYM"'), accepted, F.lit('}, "classification": [{"rank": "PHYLUM", "name": "Chordata"}]}'))
    r = verify.parsed_reply(reply)
    return t("nation").select("n_nationkey", r["name"].alias("name"), r["accepted"].alias("accepted"), r["ranks"]["phylum"].alias("phylum"))


@query("SELECT page_id, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS page_id_, nullif(regexp_extract(url, '/([0-9]+)[?]', 1), '') AS path_id FROM pages")
def link_ids(t, spark):
    """ids out of links."""
    ids = verify.link_ids(F.col("url"), {"page": "page=([0-9]+)", "path": "/([0-9]+)[?]"})
    return t("pages").select("page_id", *ids).toDF("page_id", "page_id_", "path_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN CAST(100 AS INT) ELSE 97 END AS score FROM supplier")
def known_names_boost(t, spark):
    """Scores of known names raised, to one at most."""
    s = t("supplier").select("s_suppkey", F.col("s_name").alias("name"), F.lit(0.97).alias("score"))
    return verify.boosted(s, "name", "score", s.where("s_suppkey % 2 = 0").select("name")).select("s_suppkey", F.round(F.col("score") * 100).cast("int").alias("score"))


@query("""SELECT user_id, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id DESC) AS context FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id""")
def context_texts(t, spark):
    """The newest facts of each key as one text."""
    return verify.context_lines(t("events"), "user_id", [F.desc("event_id")], F.concat_ws(" ", "event_type", "event_id"), 5)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'machine' ELSE 'none' END AS label FROM customer")
def injected_call(t, spark):
    """2.13, F34c: an injected function of texts, and the label its reply contains."""
    reply = calls.as_column(lambda s: f"It may be {s.lower()}.", "")(F.col("c_mktsegment"))
    return t("customer").select("c_custkey", calls.label_in(reply, ("building", "machine"), "none").alias("label"))
