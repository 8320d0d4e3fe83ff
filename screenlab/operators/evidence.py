"""Rules over evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import percentile_ranks


def first_match(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; NULL conditions do not."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit(otherwise))


def assembled(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """Evidence tables joined to the frozen list, which keeps its rows."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, base)


def exclusive(df: DataFrame, category: str, place: str) -> DataFrame:
    """Categories that occur in one place only."""
    return df.groupBy(category).agg(F.count_distinct(place).alias("n"), F.min(place).alias(place), F.count("*").alias("n_rows")).filter("n = 1").drop("n")


def exposure(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """Highest and median value over places, where the highest is, its share of the sum, and its percentile rank among keys."""
    rows = df.groupBy(key).agg(F.max(value).alias("highest"), F.median(value).alias("median"), F.min_by(place, F.struct(-F.col(value), F.col(place))).alias("place"), F.try_divide(F.max(value), F.sum(value)).alias("share"), F.count_if(F.col(value) >= 1).alias("n_places"))
    return percentile_ranks(rows, [], "highest", "percentile")


def orientation(df: DataFrame, by: list[str], score: str, binary: str) -> DataFrame:
    """How often a binary call agrees with the sign of a score."""
    agrees = (F.col(score) < 0) == (F.col(binary) == 1)
    return df.groupBy(*by).agg(F.count(agrees).alias("n"), F.count_if(agrees).alias("n_agree"))


def audit(left: DataFrame, right: DataFrame, keys: list[str]) -> dict[str, int]:
    """Rows of either side without a partner."""
    return {"left_only": left.join(right, keys, "left_anti").count(), "right_only": right.join(left, keys, "left_anti").count()}


def nearest_rank(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
