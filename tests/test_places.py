"""Places are a permutation whatever the order in which parts arrive."""

import random

from pyspark.sql import functions as F

from screenlab.operators import ranking, resample


def test_bounds_of_ranges_are_made_once(spark):
    """Approximate quantiles follow the order of arrival: two evaluations in one plan may differ, and places then repeat."""
    rows = spark.range(30000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.xxhash64("id").cast("double").alias("v")).repartition(24)
    for made in (ranking.placed(rows, ["g"], "v", "k", least=64), ranking.counted_values(rows, ["g"], "v")):
        assert "percentile_approx" not in made._jdf.queryExecution().optimizedPlan().toString()
    places = ranking.placed(rows, ["g"], "v", "k", least=64).groupBy("g").agg(F.count_distinct("place").alias("n"), F.max("place").alias("m")).collect()
    assert [(r["n"], r["m"]) for r in places] == [(15000, 15000)] * 2


def test_bounds_have_the_last_bit_of_the_sql(spark):
    """Bounds that stand at a half are rounded by their last bit."""
    import duckdb

    draw = random.Random(3)
    rows = [(g, draw.choice([1, 2, 3, 8, 16]) * draw.randint(-60, 60) / draw.choice([1, 3, 7, 16])) for g in range(60) for _ in range(100)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, stat DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute("SELECT g, quantile_cont(stat, 0.025), quantile_cont(stat, 0.5), quantile_cont(stat, 0.975) FROM t GROUP BY g ORDER BY g").fetchall()
    made = resample.fused_interval(spark.createDataFrame(rows, "g int, stat double").repartition(5), ["g"])
    assert [tuple(r) for r in made.orderBy("g").collect()] == want
