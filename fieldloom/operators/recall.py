"""Two-stage recall: a bounded number of candidates from an index of words, then exact ranking by cosine over words and pairs of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.tables import cut

#: Terms of the vocabulary.
MOST_TERMS = 10_000


def words(text: Column) -> Column:
    """Words of two or more letters or digits (a-z, 0-9) in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: words, and neighbouring words as one term with a space between."""
    w = words(F.col(text))
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return df.select(key, F.explode(F.concat(w, pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


@dataclass
class Index:
    """What recall reads: key, word and the row's place in the order of preference (postings), key, term and weight (weights, of length one
    for each key), and term and idf (terms, the vocabulary); the order itself as key and place."""

    key: str
    postings: DataFrame
    weights: DataFrame
    terms: DataFrame
    order: DataFrame


def indexed(df: DataFrame, key: str, text: str, prefer: Sequence[Column], most_terms: int = MOST_TERMS) -> Index:
    """Builds the index of a table of one row for each key.

    prefer orders rows, best first; ties go to the smaller key. The vocabulary are the most_terms terms of the highest number of occurrences,
    ties by term; weights are (1 + ln tf) * idf with idf = ln((1 + n) / (1 + df)) + 1 over all rows, of length one. Null texts have no
    words. A row's place in the order is its rank among all rows as a sortable struct, so nothing is numbered in one task.
    """
    rows = df.select(key, F.col(text).alias("__text"), F.struct(*prefer, F.col(key)).alias("__place"))
    tf = cut(_terms(rows, key, "__text"), "terms")
    n = rows.agg(F.count("*").alias("n"))
    top = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(most_terms)
    terms = cut(top.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")  # n is one row
    raw = tf.join(F.broadcast(terms), "term").select(key, "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))  # bounded by most_terms
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    weights = raw.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))
    posted = rows.select(key, "__place", F.explode(F.array_distinct(words(F.col("__text")))).alias("word"))
    return Index(key, posted, cut(weights, "weights"), terms, rows.select(key, "__place"))


def recalled(index: Index, queries: DataFrame, qid: str, text: str, k: int = 10, least_word: int = 3) -> DataFrame:
    """The k best rows for each query (one row for each qid): qid, rank, key and score, the cosine rounded to six digits.

    Candidates are the 3 k most preferred rows that hold one of the query's words of least_word letters or more; where they are fewer than
    k, the 2 k most preferred of all rows as well. Those whose cosine with the query is over 0 come, best first, ties by key; a query that
    has none gets its candidates in their order, with score 0. Of each word only its 3 k most preferred rows can be candidates, so the
    rest of the postings is cut before anything is shuffled by query, and weights are read for candidates alone.
    """
    key = index.key
    asked = queries.select(qid, F.explode(F.array_distinct(words(F.col(text)))).alias("word")).where(F.length("word") >= least_word)
    some = index.postings.join(asked.select("word").distinct(), "word", "left_semi")
    held = some.withColumn("__rn", F.row_number().over(Window.partitionBy("word").orderBy("__place"))).where(F.col("__rn") <= 3 * k).drop("__rn")
    met = asked.join(held, "word").select(qid, key, "__place").distinct()
    first = met.withColumn("__rn", F.row_number().over(Window.partitionBy(qid).orderBy("__place"))).where(F.col("__rn") <= 3 * k)
    first = first.select(qid, key, F.col("__rn").alias("order"))
    few = queries.select(qid).distinct().join(first.groupBy(qid).agg(F.count("*").alias("n")), qid, "left").where(F.coalesce("n", F.lit(0)) < k).select(qid)
    best = index.order.orderBy("__place").limit(2 * k)
    best = best.withColumn("order", 3 * k + F.row_number().over(Window.orderBy("__place"))).select(key, "order")  # 2 k rows
    fill = few.crossJoin(F.broadcast(best)).join(first.select(qid, key), [qid, key], "left_anti")
    candidates = first.unionByName(fill.select(qid, key, "order"))

    own = _terms(queries.select(qid, F.col(text).alias("__text")), qid, "__text").join(F.broadcast(index.terms), "term").select(qid, "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    length = own.groupBy(qid).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    own = own.join(length, qid).select(qid, "term", (F.col("w") / F.col("length")).alias("qw"))
    read = index.weights.join(candidates.select(key).distinct(), key, "left_semi")
    dots = candidates.join(read, key).join(own, [qid, "term"]).groupBy(qid, key).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
    scored = candidates.join(dots, [qid, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    some_score = F.max("score").over(Window.partitionBy(qid)) > 0
    scored = scored.withColumn("__any", some_score).where(~F.col("__any") | (F.col("score") > 0))
    ranked = Window.partitionBy(qid).orderBy(F.desc("score"), F.when(F.col("__any"), F.lit(0)).otherwise(F.col("order")), key)
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(qid, "rank", key, "score")
