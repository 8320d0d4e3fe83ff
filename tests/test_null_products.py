"""Products of shuffled rows without a row of a draw, against the rows themselves."""

import numpy as np
from pyspark.sql import functions as F

from screenlab.operators import modules
from screenlab.plans import searches


def test_products_of_shuffled_rows_need_no_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, None if i % 7 == 0 else "ab"[i % 2], [float(rng.normal())], rng.integers(0, 9, 4).astype(float).tolist(), None if i % 41 == 0 else float(rng.normal())) for i in range(700)]
    frame = spark.createDataFrame(rows, "id int, fold int, context string, c array<double>, x array<double>, y double").repartition(3)
    drawn = modules.shuffled(frame, "id", "context", ["x"], 3, "null").withColumn("v", F.concat("c", "x"))
    want = {(r["draw"], r["fold"]): r for r in modules.fold_products(drawn, "fold", "v", "y", 1, 1.0).collect()}
    assert len(want) == 12
    for most, block in ((1 << 21, 1 << 15), (1 << 21, 64), (50, 64)):  # the last one cuts contexts into parts
        made = modules.shuffled_products(frame, "id", "context", "fold", "c", "x", "y", 3, "null", 1, 1.0, most, block)
        got = {(r["draw"], r["fold"]): r for r in made.collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r["columns"] == 5 and np.allclose(r["train"], want[k]["train"], atol=1e-8) and np.allclose(r["held"], want[k]["held"], atol=1e-8) and abs(r["total"] - want[k]["total"]) < 1e-8


def test_no_row_of_a_draw_is_shuffled(spark, monkeypatch):
    """The query never makes the rows of its draws."""

    def refuse(*_):
        raise AssertionError("rows of draws were made")

    monkeypatch.setattr(modules, "shuffled", refuse)
    assert searches._setting(spark, "/root/testdata/sf0.001", 2)[3].select("draw").distinct().count() == 3
