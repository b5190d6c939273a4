"""Every corpus query: against SQL, on odd rows, on empty tables."""

import duckdb
import pytest

from quillspark.llm.queries import ORACLES, QUERIES

TABLES = {"op9_embedding_near_dedup": "embeddings", "op10_url_filter": "pages"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, weird, name):
    rows = QUERIES[name](spark, weird).collect()
    assert len(rows) == spark.read.parquet(f"{weird}/{TABLES.get(name, 'documents')}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{weird}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        got = sorted((tuple(r[n] for n in names) for r in rows), key=repr)
        assert got == sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.count() == 0 and df.columns
