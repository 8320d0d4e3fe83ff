"""Joins that check themselves, exclusions, sets and shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides must have unique keys where ``validate`` says ``one``."""
    sides = dict(zip((left, right), validate.split("_to_"))) if left is not right else {left: "one" if "one" in validate else "many"}
    for side, kind in sides.items():
        if kind == "one" and not duplicate_keys(side, keys).isEmpty():
            raise ValueError(f"{validate}: the keys {keys} are not unique")
    return left.join(right, keys, how)


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side, and whether it stands ``left_only``, ``right_only`` or in ``both``."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "outer").select(*keys, side.alias("side"))


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reasons``: every rule that excludes a row, in order, joined by ``;``; ``included`` if none does."""
    failed = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("reasons", F.array_join(failed, ";")).withColumn("included", F.size(failed) == 0)


def presence(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of keys with a flag for each source, and ``in_all``."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(key), F.lit(name).alias("__s")) for name, df in sources.items()])
    flags = [F.coalesce(F.bool_or(F.col("__s") == name), F.lit(False)).alias(f"in_{name}") for name in sources]
    return rows.groupBy(key).agg(*flags, (F.count_distinct("__s") == len(sources)).alias("in_all"))


def intersection(sources: list[DataFrame], key: str) -> DataFrame:
    """Keys that every source has."""
    return reduce(DataFrame.intersect, [df.select(key) for df in sources])


def pivoted(df: DataFrame, keys: list[str], by: str, values: list, what: Column) -> DataFrame:
    """Long to wide over a fixed list of values."""
    return df.groupBy(*keys).pivot(by, values).agg(what)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(keys, columns, name, value)


def grid(rows: DataFrame, columns: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of two small dimensions with its cell, where there is one. ``columns`` must be small."""
    return rows.crossJoin(columns).join(cells, keys, "left")


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of some column names that the frame has, whatever the case."""
    have = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in have:
            return have[name.lower()]
    raise KeyError(f"none of {names} is a column")


def exactly_one(df: DataFrame) -> DataFrame:
    """The frame, if it has one row."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError("no row" if n == 0 else "more than one row")
    return df


def resolved_aliases(pairs: DataFrame, alias: str = "alias", target: str = "approved") -> DataFrame:
    """Each alias with its only target; an alias of several is ``ambiguous`` and has none."""
    n = F.count_distinct(target)
    return pairs.groupBy(alias).agg(F.when(n == 1, F.min(target)).alias(target), (n > 1).alias("ambiguous"), n.alias("n_targets"))


def first_per_entity(df: DataFrame, entity: str, order: list[Column]) -> DataFrame:
    """The first row of each entity, and how many others there were."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity)
    return df.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("n_excluded", F.count("*").over(w) - 1).filter("__n = 1").drop("__n")


def transposed(cells: DataFrame, row: str = "row_id", column: str = "col_id", value: str = "value") -> DataFrame:
    """A long matrix with rows and columns exchanged: names alone, no data moves."""
    return cells.select(F.col(column).alias(row), F.col(row).alias(column), value)
