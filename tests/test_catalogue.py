"""Every query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

from screenlab import plans

SF = os.environ.get("SCREENLAB_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    ours = plans.QUERIES[name](spark, SF)
    theirs = duck.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(columns, theirs.fetchall())


#: Long searches and tunings, held to plain loops in test_modules and test_kernels: one run here.
LONG = {"module_search", "module_null_controls", "module_random_controls", "ndcg_tuning", "ndcg_tuned_metrics"}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_ones_run(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - LONG))
def test_runs(spark, name):
    first, second = (plans.QUERIES[name](spark, SF) for _ in range(2))
    assert sorted(map(repr, first.collect())) == sorted(map(repr, second.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
