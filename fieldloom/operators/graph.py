"""A property graph as two tables: nodes (node_id, label, kind) and weighted edges (src, rel, tgt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import cut, dealt


def upsert_nodes(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each node_id and kind: the first label stays, the last properties win."""
    return rows.groupBy("node_id", "kind").agg(F.min_by("label", seq).alias("label"), F.max_by("props", seq).alias("props"), F.count("*").alias("times"))


def upsert_edges(rows: DataFrame, initial: float = 1.0) -> DataFrame:
    """One row for each edge: its weight is the initial one and one more for each repeat."""
    return rows.groupBy("src", "rel", "tgt").agg((F.count("*") - 1 + F.lit(initial)).alias("weight"))


def co_occurrence(members: DataFrame, group: str, item: str, most: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of distinct items in the same group, with the number of groups; groups over `most` items are left out if given.

    Both directions have the same weight, so half of the ordered pairs is made and counted before the shuffle. With `of`, a table of
    about as many rows as members, groups are dealt by its size, so that a task makes the pairs of a bounded number of rows (of one group
    at least).
    """
    own = members.select(group, item)
    own = (dealt(own, group, of=of) if of is not None else own).distinct()
    if most:
        own = own.join(own.groupBy(group).count().where(F.col("count") <= most).select(group), group, "left_semi")
    a, b = own.select(group, F.col(item).alias("a")), own.select(group, F.col(item).alias("b"))
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """The number of edges, in and out, of each node."""
    return edges.select(F.col("src").alias("node_id")).union(edges.select("tgt")).groupBy("node_id").agg(F.count("*").alias("degree"))


def density(edges: DataFrame, n_nodes: int) -> DataFrame:
    """2m / (n (n - 1)) of the simple undirected graph; loops count in m."""
    pairs = edges.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    return pairs.agg((2 * F.count("*") / F.lit(float(max(1, n_nodes * (n_nodes - 1))))).alias("density"))


def top_by_degree(edges: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """The k nodes of most edges, ties by node_id, among those of a table of node_id if given: a report of bounded size."""
    found = degrees(edges)
    return (found if among is None else found.join(among.select("node_id").distinct(), "node_id", "left_semi")).orderBy(F.desc("degree"), "node_id").limit(k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    n = nodes.select("node_id")
    return edges.join(n, edges["src"] == n["node_id"], "left_semi").join(n, edges["tgt"] == n["node_id"], "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame, rel: str, kind: str) -> DataFrame:
    """For each target of a relation, the distinct labels of the sources of a kind, in order."""
    sources = nodes.where(F.col("kind") == kind).select(F.col("node_id").alias("src"), "label")
    return edges.where(F.col("rel") == rel).join(sources, "src").groupBy("tgt").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def repoint(edges: DataFrame, moves: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Edges after nodes moved (old_id -> new_id): both ends follow, and edges that now coincide add their weights. With `of`, a table of
    about as many rows as there are edges, they are dealt by its size, so that a task adds up a bounded number."""
    a = moves.select(F.col("old_id").alias("src"), F.col("new_id").alias("__src"))
    b = moves.select(F.col("old_id").alias("tgt"), F.col("new_id").alias("__tgt"))
    moved = edges.join(a, "src", "left").join(b, "tgt", "left").select(F.coalesce("__src", "src").alias("src"), "rel", F.coalesce("__tgt", "tgt").alias("tgt"), "weight")
    if of is not None:
        moved = dealt(moved, "src", "tgt", of=of)
    return moved.groupBy("src", "rel", "tgt").agg(F.sum("weight").alias("weight"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities: each node takes the label of most weight among its neighbours, the smallest of equals, a fixed number of times.

    The weighted modularity search of small graphs does not scale; this does, and its result does not depend on row order.
    """
    both = edges.select(F.col("src").alias("u"), F.col("tgt").alias("v"), "weight").union(edges.select("tgt", "src", "weight")).where("u <> v")
    labels = both.select(F.col("u").alias("node_id")).distinct().withColumn("label", F.col("node_id"))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("node_id").alias("v"), "label"), "v").groupBy("u", "label").agg(F.sum("weight").alias("w"))
        labels = around.groupBy("u").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select(F.col("u").alias("node_id"), F.col("best.label").alias("label"))
        labels = cut(labels, "labels")
    return labels


def bounding_boxes(df: DataFrame, key: str, x: str, y: str, seq: str, zero_is_missing: bool = False) -> DataFrame:
    """The range of two coordinates and the count of each key; with zero_is_missing zeros do not extend the range."""
    pick = lambda c: F.when(F.col(c) != 0, F.col(c)) if zero_is_missing else F.col(c)
    return df.groupBy(key).agg(F.min(pick(x)).alias("min_x"), F.max(pick(x)).alias("max_x"), F.min(pick(y)).alias("min_y"), F.max(pick(y)).alias("max_y"), F.count("*").alias("n"), F.min(seq).alias("first_seq"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file, in the order of column `part`, for spark.write.text: head, nodes, edges, tail."""
    text = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    fixed = lambda part, line: spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(line).alias("line"))
    n = nodes.select(F.lit(1), text("node_id"), F.concat(F.lit('<node id="'), text("node_id"), F.lit('"><data key="label">'), text("label"), F.lit("</data></node>")))
    e = edges.select(F.lit(2), F.concat_ws("|", text("src"), text("rel"), text("tgt")), F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("tgt"), F.lit('"><data key="rel">'), text("rel"), F.lit("</data></edge>")))
    return fixed(0, '<graphml><graph edgedefault="directed">').union(n).union(e).union(fixed(3, "</graph></graphml>"))
