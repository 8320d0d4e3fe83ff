"""Tables of a data folder, and the views that play the parts of screening data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(x: Column) -> Column:
    """Sum of values with two decimals, exact in any order."""
    return F.sum(x.cast("decimal(12,2)")).cast("double")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, lineage (region) and cluster (nation) of each supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # fixed tables of 25 and 5 rows
    return rows.select(F.col("s_suppkey").alias("row_id"), F.col("r_name").alias("lineage"), F.col("n_name").alias("cluster"))


def screen_cells(spark: SparkSession, sf_dir: str, measure: str = "l_discount") -> DataFrame:
    """row_id (supplier), col_id (brand and type), value: the quantity-weighted mean of a measure of its lines."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_suppkey").alias("row_id"), F.concat_ws("/", "p_brand", "p_type").alias("col_id"), F.col("l_quantity").alias("q"), F.col(measure).alias("m"))
    weighted = F.sum(F.col("q").cast("decimal(12,2)") * F.col("m").cast("decimal(12,2)")).cast("double")
    return rows.groupBy("row_id", "col_id").agg((weighted / exact_sum(F.col("q"))).alias("value"))


def labelled_cells(spark: SparkSession, sf_dir: str, measure: str = "l_discount") -> DataFrame:
    """Cells with the lineage and cluster of their row."""
    return screen_cells(spark, sf_dir, measure).join(suppliers(spark, sf_dir), "row_id").select("row_id", "col_id", "lineage", "cluster", "value")


def held_out_predictions(cells: DataFrame) -> DataFrame:
    """Cells with ``truth`` (value less the mean of the column in other lineages) and ``predicted``.

    The prediction is the column's mean over other lineages less the grand mean of these. Sums are taken by
    lineage and column first, so what cells meet has a row a lineage and column, and no task holds a column's cells.
    """
    from pyspark.sql import Window

    column = Window.partitionBy("col_id")  # a row a lineage
    sums = cells.groupBy("lineage", "col_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    others = sums.select("lineage", "col_id", F.round(F.try_divide(F.sum("s").over(column) - F.col("s"), F.sum("n").over(column) - F.col("n")), 12).alias("mu"))
    grand = others.groupBy("lineage").agg(F.avg("mu").alias("grand"))
    rows = cells.join(others, ["lineage", "col_id"]).join(grand, "lineage")
    return rows.select("row_id", "lineage", "cluster", "col_id", F.round(F.col("value") - F.col("mu"), 9).alias("truth"), F.round(F.col("mu") - F.col("grand"), 9).alias("predicted"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell (user), feature (event type), count, and the cell's label: its smallest ``k`` modulo 3."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("count"), F.min("k").alias("k"))
    label = F.concat(F.lit("g"), (F.min("k").over(Window.partitionBy("user_id")) % 3).cast("string"))
    return n.select(F.col("user_id").alias("cell"), F.col("event_type").alias("feature"), "count", label.alias("label"))
