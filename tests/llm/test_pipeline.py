"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from fieldloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in "documents embeddings pages benchmark labels conversations".split():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        expected = c.execute(ORACLE_SQL[name]).df()
        columns = sorted(expected.columns)
        assert sorted(got.columns) == columns
        rows = lambda f: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in f[columns].itertuples(index=False, name=None))
        assert rows(got) == rows(expected)


def test_stages_take_effect(spark):
    from test_operators import plain_components, plain_contamination, shingle_set

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.columns
    (_, classify), (_, dedupe), (_, clean), (_, mask), (_, mix) = corpus_pipeline.STAGES

    good = classify(spark, docs, DATA)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns
    assert all(d in kept for d, q in labels.items() if q == 1 and d in before)
    assert sum(d not in kept for d, q in labels.items() if q == 0 and d in before) >= 0.9 * sum(q == 0 and d in before for d, q in labels.items())

    one = dedupe(spark, good, DATA)
    ids = sorted(kept)
    sets = [shingle_set(before[d]["text"]) for d in ids]
    root = plain_components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert one.columns == columns
    assert sorted(r["doc_id"] for r in one.collect()) == [ids[i] for i, x in enumerate(root) if x == i]

    left = clean(spark, one, DATA)
    rows = one.collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = plain_contamination([r["text"] for r in rows], items)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r, (n, h, _) in zip(rows, plain, strict=True) if not (h and 20 * h >= n))

    masked = mask(spark, left, DATA)
    assert masked.columns == columns
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"])
        assert not re.search(r"[a-z]+\.[0-9]+@mail", r["text"])

    mixed = mix(spark, masked, DATA).collect()
    assert len(mixed) == masked.count()


def test_stages_with_other_columns_and_nulls(spark):
    """Columns named like those used inside, nulls in every column, repeated rows and empty texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    more = docs.withColumn("__text", docs["lang"]).withColumn("__id", docs["n_chars"]).withColumn("bits", docs["lang"]).withColumn("fp", docs["n_chars"]).withColumn("pii", docs["lang"]).withColumn("component_id", docs["doc_id"])
    nulls = spark.createDataFrame([tuple([None] * len(more.columns)), (None, "", *[None] * (len(more.columns) - 2)), (10**9, None, *[None] * (len(more.columns) - 2))], more.schema)
    rows = more.union(more).union(nulls)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, DATA)
        if name != "mix":
            assert out.columns == rows.columns, name
        n = out.count()
        assert n == rows.count() if name in ("mix", "personal data") else 0 < n <= rows.count(), name
        assert stage(spark, rows.limit(0), DATA).count() == 0


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
