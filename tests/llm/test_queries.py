import duckdb
import pytest

from factweave.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "conversations", "embeddings", "benchmark", "labels", "pages")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, folder, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = QUERIES[name](spark, folder)
    rows = base.execute(ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, rows.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_with_a_stable_schema(spark, folder, name):
    frame = QUERIES[name](spark, folder)
    assert len(frame.columns) == len(set(frame.columns)) and frame.count() >= 0
