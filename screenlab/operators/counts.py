"""Grouped counts of sparse tables (absent is zero), profiles and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_counts(df: DataFrame, groups: list[str], feature: str, count: str) -> DataFrame:
    """Sum and number of positive cells of each feature in each group."""
    return df.groupBy(*groups, feature).agg(F.sum(count).alias("count"), F.count_if(F.col(count) > 0).alias("detected"))


def cpm(sums: DataFrame, groups: list[str], count: str = "count") -> Column:
    """Counts per million of the group's total."""
    return F.try_divide(1e6 * F.col(count), F.sum(count).over(Window.partitionBy(*groups)))


def overlapping(df: DataFrame, label: Column, special: str) -> DataFrame:
    """One row for each group that a row belongs to: all, its label, and non_``special`` unless that is its label."""
    member = F.filter(F.array(F.lit("all"), label, F.when(label != special, F.lit(f"non_{special}"))), lambda g: g.isNotNull())
    return df.withColumn("group", F.explode(member))


def quality(df: DataFrame, cell: str, feature: str, count: str, marked: Column) -> DataFrame:
    """Total, features detected and share of marked features of each cell."""
    total = F.sum(count)
    return df.groupBy(cell).agg(total.alias("total"), F.count_if(F.col(count) > 0).alias("detected"), F.try_divide(F.sum(F.when(marked, F.col(count)).otherwise(0)).cast("double"), total.cast("double")).alias("marked_share"))


def mixtures(profiles: DataFrame, keys: list[str], a: str, b: str, fractions: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """log2(x + 1) of (1 - f) a + f b for each fraction."""
    rows = profiles.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    return rows.select(*keys, "fraction", F.log2((1 - F.col("fraction")) * F.col(a) + F.col("fraction") * F.col(b) + 1).alias("profile"))


def presence_or_zero(rows: DataFrame, features: DataFrame, measured: DataFrame, cells: DataFrame, keys: list[str], feature: str, value: str) -> DataFrame:
    """Value of every pair of a row and a feature: 0 where it is measured but absent, NULL where the feature is not measured.

    ``measured`` lists what was measured, by feature or by row and feature.
    """
    have = measured.distinct().withColumn("__m", F.lit(True))
    every = rows.crossJoin(features)  # two small dimensions
    out = every.join(have, [c for c in have.columns if c != "__m"], "left").join(cells, keys, "left")
    return out.select(*keys, F.coalesce("__m", F.lit(False)).alias("present"), F.when(F.col("__m"), F.coalesce(F.col(value), F.lit(0).cast(dict(cells.dtypes)[value]))).alias(value))


def log_ratio(a: Column, b: Column) -> Column:
    """log2((a + 1) / (b + 1)); NULL where one is not measured."""
    return F.log2((a + 1) / (b + 1))


def rolled_up(df: DataFrame, sample: str, donor: str, keys: list[str], count: str) -> DataFrame:
    """Sums by donor with the samples that went into them."""
    return df.groupBy(donor, *keys).agg(F.sum(count).alias(count), F.array_join(F.array_sort(F.collect_set(F.col(sample).cast("string"))), ";").alias("samples"))


def donor_summary(df: DataFrame, keys: list[str], donor: str, value: str) -> DataFrame:
    """Donors counted alike: their number, and median, least and most of their values."""
    per = df.groupBy(*keys, donor).agg(F.avg(value).alias("__v"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_donors"), F.median("__v").alias("median"), F.min("__v").alias("least"), F.max("__v").alias("most"))
