"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import catalog

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    rows = catalog.QUERIES[name](spark, sf_dir).toArrow()
    if name not in catalog.ORACLES:
        assert rows.num_rows > 0
        return
    expected = con.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(rows.column_names) == sorted(expected.column_names)
    con.register("got", rows)
    con.register("expected", expected)
    columns = ", ".join(f'"{c}"' for c in expected.column_names)
    for a, b in (("got", "expected"), ("expected", "got")):
        assert con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_entry_module():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and sorted(df.columns) == ["bm25_rank", "chunk_id", "dense_rank", "query_id", "rank", "score"]
