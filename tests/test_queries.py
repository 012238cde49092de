"""Every registered query of the library's own runs, and equals its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fieldloom.plans import graph_queries, more_queries, record_queries, rule_queries, table_queries, text_queries, verify_queries  # noqa: F401
from fieldloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def plain(v):
    """Numbers alike whatever their type, everything missing as a dash."""
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return "-"
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(v)
    try:
        return f"{float(v):.6g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        columns = sorted(got.columns)
        assert rows(got, columns) == rows(expected, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.queries())
