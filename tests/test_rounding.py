"""Values at a half: what the order of summation leaves in the last bit shows in no result, and rounding is the SQL's."""

import math

from screenlab.plans.evaluation import _steady
from screenlab.plans.register import as_sql


def test_the_last_bit_does_not_decide(spark):
    rows = spark.createDataFrame([(0.038522499999999994,), (0.0385225,)], "x double")
    assert [r[0] for r in rows.select(_steady("x")).collect()] == [0.038523, 0.038523]


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [k / 10**5 + 5e-6 for k in range(-2000, 2000)] + [0.19374999999999998, 1.00005, math.pi]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in rows.coalesce(1).select(as_sql("x", 5)).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 5) FROM (SELECT unnest(?::DOUBLE[]) AS x, unnest(range(len(?::DOUBLE[]))) AS i) ORDER BY i", [values, values]).fetchall()]
    assert got == want
