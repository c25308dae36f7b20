"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from nodeloom import registry as nq

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(nq.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = nq.QUERIES[name](spark, SF)
    want = duck.execute(nq.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in got.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(tuple(cell(r[i]) for i in order) for r in want.fetchall())


def test_budget_is_greedy(spark):
    from nodeloom.operators.search import running_budget, within_budget

    items = spark.createDataFrame([("g", "a", 0.9, 5), ("g", "b", 0.8, 6), ("g", "c", 0.7, 4), ("g", "d", 0.6, 2)], "grp string, id string, score double, tokens long")
    assert [r.id for r in within_budget(items, 10, "grp").orderBy("position").collect()] == ["a", "c"]
    assert [r.id for r in running_budget(items, 10, "grp").orderBy("before").collect()] == ["a", "b"]
