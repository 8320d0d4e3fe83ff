"""Kernels of a query set: sums over columns or blocks are taken inside tasks, no pair is shuffled to be added up."""

import random

from pyspark.sql import functions as F

from screenlab.operators import linalg
from screenlab.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_table_kernel_is_the_join_s(spark):
    draw = random.Random(3)
    rows = [(i, f"c{c}", None if draw.random() < 0.2 else float(draw.randrange(-9, 9))) for i in range(600) for c in draw.sample(range(90), 2)] + [(5, "c1", 2.0), (7, None, 1.0), (700, "alone", 1.0), (701, "void", None), (705, "void", 1.0)]
    df = spark.createDataFrame(rows, "r int, c string, v double")
    made = linalg.gram_by_features(df, "r", "c", "v", F.col("r") % 5 == 0)
    a, b = df.filter("r % 5 = 0").toDF("id_a", "c", "x"), df.toDF("id_b", "c", "y")
    want = a.join(b, "c").groupBy("id_a", "id_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in want.collect()}
    assert {tuple(r) for r in linalg._gram_of_lists(df.filter("r % 5 = 0"), df, "r", "c", "v", 64, 7).collect()} == {tuple(r) for r in want.collect()}
    assert "hashpartitioning(id_a" not in plan(made)


def test_blocks_are_added_inside_tasks(spark):
    assert "hashpartitioning(id_a" not in plan(QUERIES["block_sum"](spark, "/root/testdata/sf0.001"))
