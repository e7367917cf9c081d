"""Registered queries against their SQL on the smallest tables, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, same, table

FAST = [n for n in entry.oracle_sql() if n.startswith(("flt_", "jon_", "agg_0", "set_", "win_0", "win_1", "scl_0", "ref_", "qry_", "ctr_01", "ctr_02", "ext_", "src_", "snk_", "prj_1", "obs_1", "mkt_0", "str_01"))]
FAST = [n for n in FAST if not n.startswith(("agg_06", "agg_05"))]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    mine, cols = table([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    theirs, ocols = table(cur.fetchall(), [d[0] for d in cur.description])
    assert cols == ocols and len(mine) == len(theirs)
    assert same(mine, theirs)[1]


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "organisation_number"


@pytest.mark.parametrize("name", ["win_08_event_dedupe", "idr_05_choose_candidate", "win_10_dedupe_articles"])
def test_picks_are_cut_before_the_shuffle(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan
