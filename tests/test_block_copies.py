"""How often rows and queries travel when blocks meet."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from screenlab.operators import linalg


def test_a_row_travels_once(spark):
    v = np.random.default_rng(2).normal(size=(300, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "k long, v array<float>").repartition(3)
    made = linalg.gram(df.filter("k % 7 = 0"), df, "k", "v", 32)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # queries alone are copied
    assert "array<double>" not in plan  # floats stay floats on the way
    got = {(r["id_a"], r["id_b"]): r["dot"] for r in made.collect()}
    assert len(got) == 43 * 300 and all(abs(x - v[i].astype(float) @ v[j].astype(float)) < 1e-12 for (i, j), x in got.items())


def test_columns_without_rows_and_queries_alone(spark):
    """Few rows leave columns empty, and each query is still seen alone once."""
    df = spark.createDataFrame([(i, [1.0 * i, 2.0]) for i in range(40)], "id long, v array<double>").repartition(5)
    ids = lambda a, b: pa.RecordBatch.from_arrays([a.field("id").take(pa.array(np.repeat(np.arange(len(a)), len(b)))), b.field("id").take(pa.array(np.tile(np.arange(len(b)), len(a))))], names=["a", "b"])
    alone = lambda a: pa.RecordBatch.from_arrays([a.field("id"), pa.nulls(len(a), pa.int64())], names=["a", "b"])
    for packed in (1, 16):
        made = linalg._block_products(df, df.filter("id < 3"), "id", 7, ids, "a long, b long", alone, packed)
        want = [(i, j) for i in range(40) for j in (0, 1, 2, None)]
        assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
