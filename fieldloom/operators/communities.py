"""Communities of a weighted graph by modularity: neighbours merge in pairs, level after level, then single nodes move where they gain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import cut


def _undirected(edges: DataFrame) -> DataFrame:
    """u, v, w in both directions of the simple undirected graph: weights of parallel edges add up; a loop counts twice at its node."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    ends = edges.where("src is not null and tgt is not null").select(F.least("src", "tgt").alias("u"), F.greatest("src", "tgt").alias("v"), w.alias("w")).where("w > 0")
    one = ends.groupBy("u", "v").agg(F.sum("w").alias("w"))
    return one.where("u <> v").unionByName(one.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).unionByName(one.where("u = v").withColumn("w", 2 * F.col("w")))


def _quality(graph: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of labels (node, community): inner weight over all, less the squared share of each community's degrees."""
    a = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    each = graph.join(a, "u").join(b, "v").groupBy("cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("degree"))
    found = each.agg(F.sum(F.col("inner") / total - (F.col("degree") / total) ** 2)).first()[0]
    return float(found or 0.0)


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """The modularity of communities (node_id, community) of edges (src, tgt, weight)."""
    graph = _undirected(edges)
    total = graph.agg(F.sum("w")).first()[0]
    return _quality(graph, communities.select(F.col("node_id").alias("node"), "community"), total) if total else 0.0


def _merged(graph: DataFrame, total: float, share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Merges communities until none gains: the last graph, and node and community of the first one's nodes.

    In each round every node picks the neighbour with which merging gains most (ties to the smaller pair), and two that picked each other
    become one, if their gain is at least that share of the best. Pairs share no node, so their gains add up and modularity never
    falls. As many pairs merge at once, graphs shrink by a share in each round.
    """
    member = graph.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(most):
        degrees = graph.groupBy("u").agg(F.sum("w").alias("d"))
        gain = F.round(F.col("w") - F.col("d") * F.col("dv") / total, 9)
        tried = graph.where("u <> v").join(degrees, "u").join(degrees.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
        picks = tried.withColumn("gain", gain).where("gain > 1e-9").groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("p"))
        pairs = cut(picks.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.*"), "pairs")
        best = pairs.agg(F.min("g")).first()[0]
        if best is None:
            break
        to = pairs.where(F.col("g") <= share * best).select("a", "b")
        name = lambda c, to=to: to.select(F.col("b").alias(c), F.col("a").alias(f"to_{c}"))
        graph = graph.join(name("u"), "u", "left").join(name("v"), "v", "left")
        graph = cut(graph.groupBy(F.coalesce("to_u", "u").alias("u"), F.coalesce("to_v", "v").alias("v")).agg(F.sum("w").alias("w")), "graph")
        member = cut(member.join(name("community"), "community", "left").select("node", F.coalesce("to_community", "community").alias("community")), "members")
    return graph, member


def _moved(graph: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, turn: int, parts: int) -> DataFrame:
    """labels after the nodes of this turn's part have gone where modularity gains most, if it gains at all; ties to the smaller community.

    A part is told by a hash of node and turn: what moves at once may spoil each other's gain, so the fewer, the safer.
    """
    own = labels.select(F.col("node").alias("u"), F.col("community").alias("cu"))
    other = labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    to = graph.where("u <> v").join(other, "v").groupBy("u", "cv").agg(F.sum("w").alias("w"))
    sums = labels.join(degrees, "node").groupBy("community").agg(F.sum("degree").alias("s"))
    stay = to.join(own, "u").where("cv = cu").select("u", F.col("w").alias("w_own"))
    tried = to.join(own, "u").where("cv <> cu").where(F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(parts)) == 0)
    tried = tried.join(stay, "u", "left").join(degrees.select(F.col("node").alias("u"), "degree"), "u")
    tried = tried.join(sums.select(F.col("community").alias("cv"), F.col("s").alias("s_new")), "cv").join(sums.select(F.col("community").alias("cu"), F.col("s").alias("s_own")), "cu")
    gain = F.col("w") - F.coalesce("w_own", F.lit(0.0)) - F.col("degree") * (F.col("s_new") - F.col("s_own") + F.col("degree")) / total
    tried = tried.withColumn("gain", F.round(gain, 9)).where("gain > 1e-9")
    best = tried.groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("g"), "cv")).alias("b")).select(F.col("u").alias("node"), F.col("b.cv").alias("new"))
    return labels.join(best, "node", "left").select("node", F.coalesce("new", "community").alias("community"), F.col("new").isNotNull().alias("changed"))


def communities(edges: DataFrame, share: float = 0.0, rounds: int = 60, turns: int = 8, passes: int = 2) -> DataFrame:
    """node_id and community (the smallest node_id in it) of each node of edges (src, tgt, weight).

    Communities first merge in pairs (see _merged; share 1 merges only the pairs that gain most, as a plain greedy search does, in as many
    rounds as there are merges; 0 all pairs that picked each other). Then up to `turns` times a part of all nodes moves, a turn that lowers
    modularity being undone and the next part half as large; what was moved merges on, at most `passes` times. Modularity never falls,
    rounds are bounded, and the same edges always give the same result. Edges with a null end or without a positive weight are left
    out, as are nodes that have no other edge; an empty graph gives none.
    """
    first = cut(_undirected(edges), "graph")
    total = first.agg(F.sum("w")).first()[0]
    if not total:
        return first.select(F.col("u").alias("node_id"), F.col("u").alias("community"))
    degrees = cut(first.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("degree")), "degrees")
    labels = _merged(first, total, share, rounds)[1]
    at = _quality(first, labels, total)
    for step in range(passes):
        begun, parts, still = at, 2, 0
        for turn in range(turns):
            tried = cut(_moved(first, degrees, labels, total, turn + step * turns, parts), "labels")
            if tried.where("changed").limit(1).count() == 0:
                still += 1
                if still >= parts:
                    break
                continue
            now = _quality(first, tried, total)
            if now <= at:
                parts = min(16, 2 * parts)
                continue
            at, labels, still = now, tried.select("node", "community"), 0
        if at - begun < 1e-9:
            break
        a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        coarse = cut(first.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "graph")
        merged = _merged(coarse, total, share, rounds)[1].select(F.col("node").alias("community"), F.col("community").alias("into"))
        labels = cut(labels.join(merged, "community").select("node", F.col("into").alias("community")), "labels")
        at = _quality(first, labels, total)
    name = labels.groupBy("community").agg(F.min("node").alias("name"))
    return labels.join(name, "community").select(F.col("node").alias("node_id"), F.col("name").alias("community"))
