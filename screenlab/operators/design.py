"""Blinded plate layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key


def plate_layout(spark: SparkSession, plates: int, conditions: int, replicates: int, seed: str) -> DataFrame:
    """plate, well, condition, replicate, blind: conditions dealt to a plate's inner wells in hash order.

    A plate has 8 rows and 12 columns, of which the outer ones stay empty: 60 wells.
    """
    wells = spark.range(60).select((F.floor(F.col("id") / 10) + 1).cast("int").alias("r"), (F.col("id") % 10 + 2).cast("int").alias("c"))
    wells = wells.select(F.concat(F.substring(F.lit("ABCDEFGH"), F.col("r") + 1, F.lit(1)), F.lpad(F.col("c").cast("string"), 2, "0")).alias("well"))
    grid = spark.range(plates).select((F.col("id") + 1).alias("plate")).crossJoin(wells)
    key = lambda *c: hash_key(F.lit(seed), *c)
    places = grid.withColumn("__n", F.row_number().over(Window.partitionBy("plate").orderBy(key(F.col("plate"), F.col("well")), "well")))
    jobs = spark.range(conditions * replicates).select((F.col("id") + 1).alias("__n"), (F.col("id") % conditions + 1).alias("condition"), (F.floor(F.col("id") / conditions) + 1).cast("long").alias("replicate"))
    return places.join(F.broadcast(jobs), "__n").select("plate", "well", "condition", "replicate", F.substring(key(F.col("plate"), F.col("condition")), 1, 8).alias("blind"))


def invariants(layout: DataFrame) -> DataFrame:
    """Of each plate: assay wells, conditions, least and most wells a condition, and whether all lie inside the rim."""
    each = layout.groupBy("plate", "condition").agg(F.count("*").alias("__k"), F.bool_and(F.substring("well", 1, 1).between("B", "G") & F.substring("well", 2, 2).cast("int").between(2, 11)).alias("__in"))
    return each.groupBy("plate").agg(F.sum("__k").alias("n_wells"), F.count("*").alias("n_conditions"), F.min("__k").alias("least"), F.max("__k").alias("most"), F.bool_and("__in").alias("inner_only"))
