"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import ann, byte_bpe, chat, decontamination, mixing, periodicity, pii, quality, repair, secrets, simhash, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("secrets"), k).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("secrets"), secrets.BASE), 256).alias("base_sha256"), pii.listed(F.col("secrets")).alias("spans"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, keep=("doc_id",))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), model="piece_bpe_32k.model", limit=4096)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("pii"), k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("pii"), pii.BASE), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    found = chat.read_back(chat.format_conversations(rows))
    learnt = F.array_join("learnt", "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), chat.turns_digest(F.col("turns")).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule and repaired: its faults, the cheapest edits and a digest of the repaired turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repaired(repair.damaged(rows), everyone=rows.select("conv_id").distinct())
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them made periodic by rule, and digests of all runs and of the collapsed text."""
    docs = periodicity.made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodicity.find_runs(docs, least=24, times=3)
    top = periodicity.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(F.lit(1000) * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the ranks of a public tokenizer and decoded again."""
    model = "byte_bpe_multi_50k.tiktoken"
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii": op8_pii,
    "op9_chat_format": op9_chat_format,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}


def _found(kind: str, pattern: str) -> str:
    """Rows r, v, a, b, of the matches of a pattern in t(r, text): value, start and end in code points."""
    return f"""(SELECT r, '{kind}' AS kind, v, a, a + len(v) AS b, text FROM (
        SELECT r, text, vs[i] AS v, CAST(list_sum([len(x) FOR x IN gs[1:i]]) + coalesce(list_sum([len(x) FOR x IN vs[1:i - 1]]), 0) AS BIGINT) AS a
        FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS vs, string_split_regex(text, '{pattern}') AS gs FROM t), unnest(range(1, len(vs) + 1)) AS u(i)))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) ELSE CAST(reverse({_DIGITS})[i] AS INT) * 2 - CASE WHEN CAST(reverse({_DIGITS})[i] AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, len({_DIGITS}) + 1)]) % 10 = 0"
_IBAN = "CAST(list_aggregate([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END FOR c IN string_split(substr(v, 5) || substr(v, 1, 4), '')], 'string_agg', '') AS VARCHAR)"
_MOD97 = f"list_reduce(list_prepend(0, [CAST(d AS BIGINT) FOR d IN string_split({_IBAN}, '')]), lambda x, y: (x * 10 + y) % 97) = 1"

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_nearest_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
    """,
    "op3_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(source, '') || CASE WHEN source IS NULL THEN 'n' ELSE 's' END AS key,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
        s AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
        w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight, 3 * source_size AS cap,
                     sum(source_size) OVER () AS total FROM s),
        c AS (SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS stops
              FROM w WINDOW b AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (SELECT key, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE)
                     ELSE CAST((total - coalesce(sum(cap) FILTER (stops) OVER (), 0)) * weight AS DOUBLE) / sum(weight) FILTER (NOT stops) OVER () END AS target FROM c),
        o AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY key ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN g USING (key))
        SELECT doc_id, size, source_size, target,
               CAST(size * CASE WHEN source_size = 0 THEN 0 ELSE greatest(0, least(3, ceil((target - start - size / 2) / source_size))) END AS BIGINT) AS taken FROM o
    """,
    "op7_benchmark_decontamination": f"""
        WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS s
               FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        dw AS (SELECT r, l.n, k, array_to_string(w[k:k + l.n - 1], ' ') AS s
               FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - l.n + 2)) AS t(k)),
        m AS (SELECT r, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
        t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
    "op8_pii": rf"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        f AS (
            SELECT r, kind, a, b, 0 AS k FROM {_found('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')}
            UNION ALL SELECT r, kind, a, b, 1 FROM {_found('ip', r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')} WHERE regexp_full_match(v, '{_BYTE}(\.{_BYTE})(\.{_BYTE})(\.{_BYTE})')
            UNION ALL SELECT r, kind, a, b, 2 FROM {_found('card', '[0-9](?:[ -]?[0-9])+')} WHERE len({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}
            UNION ALL SELECT r, kind, a, b, 3 FROM {_found('phone', r'\+[0-9][ ().0-9-]+[0-9]')} WHERE len({_DIGITS}) BETWEEN 10 AND 15
            UNION ALL SELECT r, kind, a, b, 4 FROM {_found('iban', '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}')} WHERE {_MOD97}
            UNION ALL SELECT r, kind, a, b, 5 FROM {_found('ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}')} WHERE regexp_matches(lower(substr(text, greatest(1, a - 39), least(40, a))), 'ssn|social security')
        ),
        g AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
                     string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY r)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN g USING (r)
    """,
    "op9_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
                       SELECT conv_id, turn, role, text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                     coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                     sum(13 + len(role) + len(text) + len(regexp_replace(role, '[^\\<|]', '', 'g')) + len(regexp_replace(text, '[^\\<]', '', 'g'))) AS formatted_chars
              FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
    """,
}
