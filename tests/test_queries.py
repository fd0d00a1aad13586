import os

import duckdb
import pytest

from quern import source_queries as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def tidy(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(map(tidy, r)) for r in got.select(*sorted(got.columns)).collect())))
    if name in queries.SQL:
        con.execute(queries.SQL[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == sorted(got.columns)
        at = [names.index(c) for c in sorted(names)]
        assert rows == sorted(map(repr, (tuple(tidy(r[i]) for i in at) for r in con.fetchall())))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_source_is_collected_whole(spark):
    def plan(name):
        return queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "collect_list" not in plan("claim_ids")
    assert plan("recall_and_overlap").count("WindowGroupLimit") >= 4  # for both orders, before and after the shuffle
