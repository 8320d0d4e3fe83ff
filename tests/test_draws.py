"""Draws whose slots are many times the rows: no slot goes to the driver, and the rows are dealt before they are multiplied."""

import pytest
from pyspark.sql import functions as F

from screenlab.operators import modules, resample


def ran(df):
    """The plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture()
def rows(spark):
    return spark.range(400).select("id", (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 7).cast("double").alias("v"))


def test_slots_are_not_broadcast(rows):
    made = resample.drawn(rows, ["g"], "id", 50, "s")
    assert "ShuffledHashJoin" in ran(made.groupBy("g", "draw").agg(F.sum("v").alias("s")))
    assert made.count() == 400 * 50
    assert made.select("draw", "g", "slot").distinct().count() == 400 * 50


def test_repeated_rows_are_many_by_spark_s_estimate(rows):
    """Sizes decide which side is broadcast: fifty copies of a row are not the size of one."""
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    made = resample.repeated(rows, "id", F.col("id").cast("int"), 0, 50)
    assert made.schema["draw"].dataType.typeName() == "integer" and made.count() == 400 * 50
    assert size(made) >= 50 * size(rows)
    assert made.rdd.getNumPartitions() == 4


def test_shuffles_are_bijections_of_each_draw(rows):
    made = modules.shuffled(rows, "id", "g", ["v"], 10, "s")
    assert made.count() == 400 * 11
    sums = {(r["draw"], r["g"]): r["s"] for r in made.groupBy("draw", "g").agg(F.sum("v").alias("s")).collect()}
    assert all(sums[d, g] == sums[0, g] for d, g in sums)


def test_sums_of_draws_are_those_of_drawn_rows(spark):
    """Packed places give what the drawn rows add up to: several blocks, a missing value, NaN, a group without values and one that is NULL."""
    df = spark.createDataFrame([(i, None if i % 50 == 49 else ("a", "b", "c")[i % 3], None if i % 11 == 0 or i % 3 == 2 else float("nan") if i == 7 else i * 0.25) for i in range(600)], "id int, g string, v double")
    sums, mean = resample.mean_sums("v")
    made = resample.drawn_sums(df, ["g"], "id", sums, 30, "s", block=64)
    assert "__at" not in ran(made).split("ShuffledHashJoin")[0] or "ShuffledHashJoin" not in ran(made)
    got = {(r["g"], r["draw"]): r["m"] for r in made.groupBy("g", "draw").agg(mean.alias("m")).collect()}
    want = {(r["g"], r["draw"]): r["m"] for r in resample.drawn(df, ["g"], "id", 30, "s").groupBy("g", "draw").agg(F.avg("v").alias("m")).collect()}
    assert got.keys() == want.keys() and len(got) == 90
    same = lambda a, b: a is None and b is None or a is not None and b is not None and (a != a and b != b or abs(a - b) < 1e-9)
    assert all(same(got[k], want[k]) for k in want)
    assert any(v is not None and v != v for v in got.values()) and all(got["c", d] is None for d in range(30))


def test_slots_are_packed_before_they_are_shuffled(spark, rows):
    text = ran(resample.bootstrap_strata(rows, "g", "id", "v", 50, "s"))
    assert "ShuffledHashJoin" not in text and "MapInArrow" in text
