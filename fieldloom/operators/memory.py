"""Merge-counted facts and their recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.names import short_hash
from fieldloom.functions.similarity import ratio
from fieldloom.sources.tables import cut, dealt


def merge(rows: DataFrame, key: Sequence[str], fields: Sequence[str], seq: str = "seq") -> DataFrame:
    """One atom for each key, addressed by its content: all fields of the first row, and how often it was confirmed."""
    first = F.min_by(F.struct(*fields), F.col(seq))
    atoms = rows.groupBy(*key).agg(first.alias("f"), F.count("*").alias("times_confirmed"), F.min(seq).alias("first_seq"))
    return atoms.select(short_hash(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("atom_id"), *key, *[F.col(f"f.{c}").alias(c) for c in fields], "times_confirmed", "first_seq")


def disagreements(rows: DataFrame, atoms: DataFrame, key: Sequence[str], field: str, seq: str = "seq") -> DataFrame:
    """Rows whose value of a field is not blank and differs from the stored one, which is not blank either."""
    stored = atoms.select(*key, F.col(field).cast("string").alias("stored"), "first_seq")
    joined = rows.join(stored, list(key)).withColumn("given", F.col(field).cast("string"))
    return joined.where((F.col(seq) > F.col("first_seq")) & (F.col("given") != "") & (F.col("stored") != "") & (F.col("given") != F.col("stored"))).select(*key, seq, "stored", "given")


def checklist(df: DataFrame, key: str, place: str, score: str, columns: Sequence[str], least: float) -> DataFrame:
    """For each name: rows, distinct places, the best score, and the other columns of the row that has it (ties by these columns)."""
    best = F.max_by(F.struct(*columns), F.struct(F.col(score), *columns))
    out = df.where(F.col(score) >= least).groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(place).alias("n_places"), F.max(score).alias("best"), best.alias("b"))
    return out.select(key, "n", "n_places", "best", *[F.col(f"b.{c}").alias(c) for c in columns])


def tokens(df: DataFrame, doc: str, text: str, longer_than: int = 2) -> DataFrame:
    """doc, token, tf: letters and digits in lower case, over two characters."""
    words = df.select(doc, F.explode(F.split(F.lower(F.col(text)), "[^a-z0-9]+")).alias("token")).where(F.length("token") > longer_than)
    return words.groupBy(doc, "token").agg(F.count("*").alias("tf"))


def whole_index(df: DataFrame, doc: str, text: str) -> DataFrame:
    """tokens of all rows, for what reads the whole index: texts are dealt out by doc, as they are shorter than their counted words."""
    return tokens(dealt(df.select(doc, text), doc, rows=2000), doc, text)


def tfidf(index: DataFrame, doc: str) -> DataFrame:
    """doc, token, weight: sublinear term frequency times smoothed inverse document frequency, each document of length one."""
    n = index.agg(F.countDistinct(doc).alias("n"))
    df_ = index.groupBy("token").agg(F.count("*").alias("df"))
    raw = index.join(df_, "token").join(F.broadcast(n)).withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).select(doc, "token", "weight")


def recall(index: DataFrame, query: DataFrame, doc: str, qid: str, k: int) -> DataFrame:
    """The k documents nearest to each query (qid, token, weight) by cosine, ties by doc: a join on tokens, top k by window."""
    scored = index.join(query.withColumnRenamed("weight", "qw"), "token").groupBy(qid, doc).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
    w = Window.partitionBy(qid).orderBy(F.desc("score"), doc)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored(index: DataFrame, query: DataFrame, doc: str, qid: str, common: int = 1000, few: int = 100_000, rows: int = 500_000) -> DataFrame:
    """qid, doc and score (cosine on tfidf(index)) of each document that shares a token with a query. Weights meet the queries' tokens at
    once: the whole index only gives each document's length, by partial sums, and no window passes over it.

    The index is written once, as several passes read it. Tokens that one document in `common` has are broadcast with their
    weight (a document has few of them, so they are at most its mean number of tokens times `common`), only the rest of the index is
    dealt out by token. Up to `few` query tokens are broadcast, too: then the rows of the index that have one are dealt out by document,
    so many tasks that each stands for about `rows` rows of the index, and pairs are made, summed and divided by lengths there: no pair is moved.
    """
    index, query = cut(index, "index"), cut(query.select(qid, "token", F.col("weight").alias("qw")), "query")
    n = index.agg(F.countDistinct(doc).alias("n"))
    df_ = index.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), (F.col("df") * common >= F.col("n")).alias("often"))
    often = F.broadcast(df_.where("often").select("token", "idf"))
    rest = index.join(often, "token", "left_anti").join(df_.where(~F.col("often")).select("token", "idf"), "token")
    w = (1 + F.ln("tf")) * F.col("idf")
    length = index.join(often, "token").select(doc, w.alias("w")).unionByName(rest.select(doc, w.alias("w"))).groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    idf = df_.select("token", "idf")
    if query.count() <= few:
        words = cut(query.select("token").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
        found = index.where(F.col(doc).isNotNull()).join(F.broadcast(words), "token").select(doc, "word", "tf")
        asked = F.broadcast(query.join(words, "token").join(idf, "token").select("word", qid, "qw", "idf"))
        pairs = dealt(found, doc, of=index, rows=rows).join(asked, "word")
        length = dealt(length, doc, of=index, rows=rows).hint("shuffle_hash")
    else:
        pairs = index.join(query.join(idf, "token"), "token")
    pairs = pairs.groupBy(qid, doc).agg(F.sum(w * F.col("qw")).alias("dot"))
    return pairs.join(length, doc).select(qid, doc, F.round(F.col("dot") / F.col("length"), 6).alias("score")).where("score > 0")


def recalled(index: DataFrame, query: DataFrame, doc: str, qid: str, k: int) -> DataFrame:
    """What recall gives on tfidf(index), by scored."""
    w = Window.partitionBy(qid).orderBy(F.desc("score"), doc)
    return scored(index, query, doc, qid).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits(index: DataFrame, nodes: DataFrame, doc: str, words: Sequence[str], k: int = 50) -> DataFrame:
    """nodes (with the column doc) whose text holds all words, with matched, the sum of their frequencies; the k with most, ties by
    doc. The index is cut to the words before anything meets the nodes."""
    some = index.where(F.col("token").isin(*[w.lower() for w in words])).groupBy(doc).agg(F.count("*").alias("n"), F.sum("tf").alias("matched"))
    top = some.where(F.col("n") == len({w.lower() for w in words})).orderBy(F.desc("matched"), doc).limit(k).select(doc, "matched")
    return nodes.join(top, doc)


def session_rollup(batch: DataFrame, bank: DataFrame, session: str, name: str, place: str) -> DataFrame:
    """session, n_records of the batch, and n_names and n_places of the whole bank."""
    own = batch.groupBy(session).agg(F.count("*").alias("n_records"))
    return own.join(F.broadcast(bank.agg(F.countDistinct(name).alias("n_names"), F.countDistinct(place).alias("n_places"))))


def centroid(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """The mean of the coordinates of each key, of rows that have both."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(key).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon), F.count("*").alias("n"))


def grouped_by_name(df: DataFrame, names: Sequence[str], status: str, approved: str, value: str) -> DataFrame:
    """name (the first filled of the columns) and n and first of its approved rows; rows without a name are left out."""
    name = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names])
    rows = df.where(F.col(status) == approved).withColumn("__name", name).where("__name is not null")
    return rows.groupBy(F.col("__name").alias("name")).agg(F.count("*").alias("n"), F.min(value).alias("first"))


def pending(df: DataFrame, processed: DataFrame, key: str, status: str, approved: str = "approved") -> DataFrame:
    """Approved rows that are not processed yet; a null key counts as not processed."""
    return df.where(F.col(status) == approved).join(processed.select(key).distinct(), key, "left_anti")


def search(df: DataFrame, column: str, wanted: str, least: float = 0.7, most: int | None = 50) -> DataFrame:
    """Rows that contain the wanted text, whatever the case, the first `most` by name (None: all); where there are none, the most similar one
    by ratio, if that is over least, with its similarity. Null names are never found."""
    low = F.lower(F.col(column))
    others = [c for c in df.columns if c != column]
    hit = df.where(F.contains(low, F.lit(wanted.lower()))).withColumn("similarity", F.lit(1.0))
    if most is not None:
        hit = hit.orderBy(column, *others).limit(most)
    none = hit.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("__none"))
    near = df.join(F.broadcast(none)).drop("__none").withColumn("similarity", F.bround(ratio(low, F.lit(wanted.lower())), 4))
    return hit.unionByName(near.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), column, *others).limit(1))
