"""Pairs by blocks: dealt among many tasks however few bytes there are, and paths over a shared neighbour are no rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from screenlab.operators import graph, linalg
from screenlab.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_small_tables_are_dealt(spark):
    made = QUERIES["permuted_kernel_all"](spark, SMALL)
    assert "Cartesian" not in plan(made) and "NestedLoop" not in plan(made)
    tasks = made.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < 0.3 * sum(r["count"] for r in tasks)


def test_products_are_rounded_as_sql_rounds():
    x = np.array([0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, 0.0])
    assert linalg._rounded(x, 0).tolist() == [1, -1, 2, 3, -3, 0, 0, 0]


def test_moves_over_shared_neighbours(spark):
    """More than 64 neighbours in common, hubs that all have, blocks of more than 256: the plain loops' bridges, and no rows of paths."""
    draw = random.Random(5)
    genes = [f"s{i}" for i in range(300)]
    pairs = [(g, f"b{k:03d}") for g in genes for k in draw.sample(range(150), 40)] + [("s1", "s2"), ("s3", "x1"), ("x1", "s4")]
    edges = graph.canonical_edges(spark.createDataFrame(pairs, "x string, y string"), "x", "y")
    own = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, v long")
    states = [([f"s{i}"], [f"s{i}"]) for i in range(0, 300, 20)] + [(["s1", "s3"], ["s1", "s3", "b007"])]
    made = graph.transitions(spark.createDataFrame(states, "chosen array<string>, nodes array<string>"), edges, own, "gene", "v", 6, 1)
    assert "__mid" not in plan(made) and "Join" not in plan(made).split("MapInArrow")[0]
    near = graph.neighbours(pairs)
    want = {(tuple(n), "STOP", None) for _, n in states}
    for chosen, nodes in states:
        for g in set(genes) - set(chosen):
            if g in nodes or near[g] & set(nodes):
                want.add((tuple(nodes), g, None))
            elif between := {b for n in nodes for b in near[n] & near[g]}:
                want.add((tuple(nodes), g, min(between)))
    got = [(tuple(r["nodes"]), r["action"], r["bridge"]) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
