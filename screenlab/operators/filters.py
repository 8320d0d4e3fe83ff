"""Filters by coverage, counts and quality, ranks under masks, and agreement of key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covered(df: DataFrame, entity: str, column: str, value: str, least: float = 0.9) -> DataFrame:
    """Columns observed in at least a share of all entities: column, n and share. A missing cell is NULL or absent."""
    total = df.agg(F.count_distinct(entity).alias("__all"))
    seen = df.groupBy(column).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(entity))).alias("n"))
    rows = seen.join(F.broadcast(total)).withColumn("share", F.try_divide(F.col("n"), F.col("__all")))  # one row
    return rows.filter(F.col("share") >= least).select(column, "n", "share")


def count_window(df: DataFrame, key: str, entity: str, low: int, share: float, total: DataFrame, excluded: DataFrame) -> DataFrame:
    """Keys that at least ``low`` entities have, and at most a share of the entities of ``total``, less the excluded keys."""
    n = total.agg(F.floor(F.count_distinct(entity) * share).alias("__most"))
    counts = df.groupBy(key).agg(F.count_distinct(entity).alias("n")).filter(F.col("n") >= low)
    return counts.join(F.broadcast(n), F.col("n") <= F.col("__most")).join(excluded.select(key).distinct(), key, "left_anti").select(key, "n")  # one row


def passing(cells: DataFrame, least_detected: int, most_marked: float, *flags: Column) -> DataFrame:
    """Cells with enough features, few marked counts and every further flag; a missing share does not pass."""
    rule = (F.col("detected") >= least_detected) & F.coalesce(F.col("marked_share") <= most_marked, F.lit(False))
    for flag in flags:
        rule = rule & F.coalesce(flag, F.lit(False))
    return cells.filter(rule)


def masked_ranks(df: DataFrame, by: list[str], value: str, key: str, mask: Column) -> DataFrame:
    """Place of each value among the group's rows inside the mask; NULL outside it. A missing value inside is an error."""
    bad = F.col(value).isNull() | F.isnan(value)
    inside = df.filter(F.coalesce(mask, F.lit(False))).withColumn(value, F.when(bad, F.raise_error(F.lit("a value inside the mask is missing"))).otherwise(F.col(value)))
    ranked = inside.select(*by, key, F.row_number().over(Window.partitionBy(*by).orderBy(value, key)).alias("rank"))
    return df.join(ranked, [*by, key], "left")


def set_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of both, of one side alone, and whether the sets are equal or the first lies in the second."""
    sides = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    each = sides.groupBy(key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    counts = each.agg(F.count_if((F.col("__a") == 1) & (F.col("__b") == 1)).alias("both"), F.count_if(F.col("__b") == 0).alias("left_only"), F.count_if(F.col("__a") == 0).alias("right_only"))
    return counts.select("*", ((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("equal"), (F.col("left_only") == 0).alias("subset"))


def counts_text(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value stands, packed in order of the values: ``a=3;b=1``. For values of few kinds."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("v"), "__n")))
    return n.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["v"], p["__n"].cast("string"))), ";").alias("counts"))


def mask_groups(df: DataFrame, entity: str, column: str, value: str) -> DataFrame:
    """column, mask, n: the columns that the same entities have observed share a mask, the digest of these entities' ids.

    The ids are folded by the leading byte of their digests into sums, so no task lists a column's entities.
    """
    d = F.sha2(F.col(entity).cast("string"), 256)
    seen = df.filter(F.col(value).isNotNull()).select(column, entity).distinct()
    word = F.conv(F.substring(d, 3, 12), 16, 10).cast("decimal(38,0)")
    parts = seen.groupBy(column, F.substring(d, 1, 1).alias("__b")).agg(F.count("*").alias("__k"), F.sum(word).alias("__s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", F.concat_ws(":", "__b", F.col("__k").cast("string"), F.col("__s").cast("string")).alias("t")))), lambda x: x["t"]), ",")
    return parts.groupBy(column).agg(F.sha2(text, 256).alias("mask"), F.sum("__k").alias("n"))


def two_way_identity(forward: DataFrame, backward: DataFrame, source: str, target: str) -> DataFrame:
    """Each source with its only target from mappings in both directions; several targets are a conflict and give none."""
    both = forward.select(source, target).unionByName(backward.select(source, target)).filter(F.col(target).isNotNull())
    n = F.count_distinct(target)
    return both.groupBy(source).agg(F.when(n == 1, F.min(target)).alias(target), n.alias("n_targets"), (n > 1).alias("conflict"))


def paired_states(df: DataFrame, keys: list[str], state: str, first: str, second: str, value: str) -> DataFrame:
    """Rows of two states of the same keys side by side: ``first`` and ``second`` and their difference; pairs with both only."""
    a = df.filter(F.col(state) == first).select(*keys, F.col(value).alias("first"))
    b = df.filter(F.col(state) == second).select(*keys, F.col(value).alias("second"))
    return a.join(b, keys).select(*keys, "first", "second", (F.col("first") - F.col("second")).alias("difference"))


def ordered_union(*lists: Column) -> Column:
    """Lists joined, each member where it first stands."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array()) for x in lists]))


def full_overlap(a: Column, b: Column, k: int) -> Column:
    """Share of ``k`` in common; NULL where a list has fewer than ``k``."""
    return F.when((F.size(a) >= k) & (F.size(b) >= k), F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k))) / F.lit(float(k)))


def finite_json(**columns: Column) -> Column:
    """A JSON object of columns; NaN and infinite numbers become null, and null fields stay in it."""
    kept = {n: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c) for n, c in columns.items()}
    return F.to_json(F.struct(*[c.alias(n) for n, c in kept.items()]), {"ignoreNullFields": "false"})
