"""Balanced folds of more components than one task should deal one by one."""

import random

from pyspark.sql import functions as F

from screenlab.operators import split


def test_all_components_go_to_the_lightest_fold(spark):
    draw = random.Random(7)
    size = {c: draw.choice([1, 1, 2, 3, 5, 8, 40]) for c in range(4600)}
    size[11], size[17] = 500, 2000
    rows = spark.createDataFrame(list(size.items()), "g long, n int").select("g", F.col("g").cast("string").alias("c"), F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    got = {r["g"]: r["fold"] for r in split.balanced_folds(rows, "g", "c", 5).collect()}
    load, want = [0] * 5, {}
    for c in sorted(size, key=lambda c: (-size[c], c)):
        want[c] = min(range(5), key=lambda f: (load[f], f))
        load[want[c]] += size[c]
    assert got == want
