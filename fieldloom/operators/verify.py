"""Names verified against several authorities whose replies come as tables or JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.names import canon_name, match_confidence
from fieldloom.functions.values import filled

#: Where the ids of other authorities stand in links to them.
LINK_IDS = {"marine": r"id=([0-9]+)", "federal": r"search_value=([0-9]+)", "facility": r"/species/([0-9]+)"}
REPLY = "struct<usage:struct<name:struct<scientificName:string,authorship:string>,status:string,accepted:struct<name:struct<scientificName:string>>>,classification:array<struct<rank:string,name:string>>>"


def link_ids(url: Column, patterns: Mapping[str, str] = LINK_IDS) -> list[Column]:
    """For each authority the id in a link, null if there is none."""
    return [F.nullif(F.regexp_extract(url, p, 1), F.lit("")).alias(f"{name}_id") for name, p in patterns.items()]


def parsed_reply(reply: Column) -> Column:
    """name, accepted (itself if it is accepted), status and ranks of a nested reply; null where it is not JSON. Of equal ranks the last
    counts, one without a rank none."""
    r = F.from_json(reply, REPLY)
    pairs = F.filter(F.coalesce(r["classification"], F.array().cast("array<struct<rank:string,name:string>>")), lambda c: c["rank"].isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda c: F.lower(c["rank"])))
    ranks = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda c: F.lower(c["rank"]) == k), -1)["name"]))
    name = r["usage"]["name"]["scientificName"]
    return F.when(r["usage"].isNotNull(), F.struct(name.alias("name"), F.coalesce(r["usage"]["accepted"]["name"]["scientificName"], name).alias("accepted"), F.lower(r["usage"]["status"]).alias("status"), ranks.alias("ranks")))


def verified(df: DataFrame, name: str, authorities: Mapping[str, DataFrame], fields: Sequence[str], accept: float = 0.6, first: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """df with fields filled from up to four authorities in order (tables keyed by canonical name, column key, with fields and
    score), confidence from all of them, and status: verified from `accept` on.

    Each is a left equi-join on the canonical name; earlier authorities win, later ones fill what is blank. `first` names, for a field,
    authorities whose values come in this order before df's own value and before the others. Of rows of an authority
    with the same key that of the highest score counts, then that of the smallest fields.
    """
    out = df.withColumn("__key", canon_name(F.col(name)))
    found = []
    for k, table in enumerate(authorities.values()):
        best = F.struct((-F.col("score")).alias("less"), *fields, "score")
        one = table.groupBy("key").agg(F.min(best).alias("b")).select("key", "b.*").select(F.col("key").alias("__key"), *[F.col(f).alias(f"__{k}_{f}") for f in fields], F.col("score").alias(f"__{k}_score"))
        out = out.join(one, "__key", "left")
        found.append(k)
    for f in fields:
        own = [filled(F.col(f))] if f in df.columns else []
        ahead = [list(authorities).index(a) for a in (first or {}).get(f, ())]
        out = out.withColumn(f, F.coalesce(*[filled(F.col(f"__{k}_{f}")) for k in ahead], *own, *[filled(F.col(f"__{k}_{f}")) for k in found]))
    has = [F.col(f"__{k}_score").isNotNull() for k in found] + [F.lit(False)] * (4 - len(found))
    score = F.col("__0_score") if found else F.lit(None).cast("double")
    exact = F.coalesce(F.col("__1_score") >= 1, F.lit(False)) if len(found) > 1 else F.lit(False)
    out = out.withColumn("confidence", match_confidence(has[0], score, has[1], exact, has[2], has[3]))
    return out.withColumn("status", F.when(F.col("confidence") >= accept, "verified").otherwise("unverified")).select(*df.columns, *[f for f in fields if f not in df.columns], "confidence", "status")


def boosted(df: DataFrame, name: str, score: str, known: DataFrame, by: float = 0.05) -> DataFrame:
    """df with scores raised for known names, to 1 at most; nothing is left out."""
    hit = known.select(canon_name(F.col("name")).alias("__key")).distinct().withColumn("__known", F.lit(True))
    out = df.withColumn("__key", canon_name(F.col(name))).join(hit, "__key", "left")
    return out.withColumn(score, F.when(F.coalesce("__known", F.lit(False)), F.least(F.lit(1.0), F.col(score) + by)).otherwise(F.col(score))).drop("__key", "__known")


def context_lines(df: DataFrame, key: str, order: Sequence[Column], line: Column, most: int) -> DataFrame:
    """key and context: the first lines of each key in order, a fixed number, as one text."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    top = df.withColumn("__line", line).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n").alias("context"))
