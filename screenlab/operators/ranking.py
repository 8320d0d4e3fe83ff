"""Ranks, top-k lists and their agreement. Lower is stronger; ties go to the smaller key."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.publish import staged


def average_rank(by: list[str], value: str, base: int = 0) -> Column:
    """Mean rank of tied values, from ``base``; the ties are counted as peers, so one sort serves both."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) - 1 + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0 + base


def percentile_rank(by: list[str], value: str) -> Column:
    """Mean rank from 1 over the group's size."""
    return average_rank(by, value, 1) / F.count("*").over(Window.partitionBy(*by))


def tertile(rank: Column) -> Column:
    """low up to a third, high above two thirds."""
    return F.when(rank <= 1 / 3, "low").when(rank > 2 / 3, "high").otherwise("middle")


def ordinal_rank(by: list[str], value: str, key: str) -> Column:
    """Places from 1."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, key))


def top_k(df: DataFrame, by: list[str], value: str, key: str, k: int) -> DataFrame:
    """The ``k`` smallest of each group with their ranks."""
    return df.filter(F.col(value).isNotNull()).withColumn("rank", ordinal_rank(by, value, key)).filter(F.col("rank") <= k)


def boundary_gap(df: DataFrame, by: list[str], value: str, key: str, k: int, near: float) -> DataFrame:
    """Gap between places k and k + 1, how many values lie within ``near`` of place k, and whether the two are tied."""
    at = lambda place: F.max(F.when(F.col("__r") == place, F.col(value)))
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__r", ordinal_rank(by, value, key))
    edge = ranked.groupBy(*by).agg(at(k).alias("__k"), at(k + 1).alias("__next"))
    rows = ranked.join(edge, by)
    return rows.groupBy(*by).agg(F.max(F.col("__next") - F.col("__k")).alias("gap"), F.count_if(F.abs(F.col(value) - F.col("__k")) <= near).alias("near"), F.bool_or(F.col("__next") == F.col("__k")).alias("tied"))


def top_lists(df: DataFrame, by: list[str], value: str, key: str, k: int) -> DataFrame:
    """The top-k keys of each group as one array, in order."""
    rows = top_k(df, by, value, key, k)
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("top"))


def mean_pairwise_jaccard(lists: DataFrame, group: str, entity: str, items: str = "top", block: int = 256) -> DataFrame:
    """Mean Jaccard index over all pairs of entities in a group, for lists of any length; no pair leaves a task.

    Lists with the same items count once, with their number. Those that differ are dealt into blocks of about ``block``;
    two blocks meet in one task, which adds up the indices of their pairs from the lists of each item that both
    hold. Two empty lists are a pair without an index; a group of one list has no row.
    """
    rows = lists.filter(F.col(group).isNotNull()).select(F.col(group).alias("__g"), F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("__items"))
    groups = rows.groupBy("__g").agg(F.count("*").alias("__n"), F.count_if(F.size("__items") == 0).alias("__none"))
    unlike = rows.filter(F.size("__items") > 0).groupBy("__g", "__items").agg(F.count("*").alias("c"))
    counts = unlike.groupBy("__g").agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    unlike = unlike.join(counts, "__g").withColumn("__own", F.pmod(F.xxhash64("__items"), F.col("__blocks")).cast("int"))
    met = unlike.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    met = met.select("__g", F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), "__own", "__items", "c")

    def added(table: pa.Table) -> pa.Table:
        own, i, j = table.column("__own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        n, lists = table.column("c").to_numpy().astype(float), table.column("__items").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        owner, item = np.repeat(np.arange(len(own)), sizes), lists.flatten().dictionary_encode().indices.to_numpy()
        place = np.where(own == i, np.cumsum(own == i), np.cumsum(own == j)) - 1
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        shared = np.zeros((len(a), len(b)))
        order = np.argsort(item, kind="stable")
        for who in np.split(owner[order], np.flatnonzero(np.diff(item[order])) + 1):
            x, y = who[own[who] == i], who[own[who] == j]
            if len(x) and len(y):
                shared[np.ix_(place[x], place[y])] += 1
        index = shared / (sizes[a][:, None] + sizes[b][None, :] - shared)
        total = n[a] @ index @ n[b]
        if i == j:  # every pair stood twice, every list beside itself once: copies of one list have the index 1
            total = (total - n[a].sum()) / 2
        return pa.table({"__g": table.column("__g")[:1], "s": [float(total)]})

    sums = met.groupBy("__g", "i", "j").applyInArrow(added, T.StructType([met.schema["__g"], T.StructField("s", T.DoubleType())]))
    sums = sums.groupBy("__g").agg(F.sum("s").alias("__s"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    mean = F.try_divide(F.coalesce("__s", F.lit(0.0)), pairs("__n") - pairs("__none"))
    return groups.filter("__n > 1").join(sums, "__g", "left").select(F.col("__g").alias(group), pairs("__n").cast("long").alias("n_pairs"), mean.alias("jaccard"))


def top_n(df: DataFrame, frequency: str, key: str, n: int, positive: bool = False) -> DataFrame:
    """The ``n`` most frequent keys; zeros pad the list unless only positive ones count."""
    rows = df.filter(F.col(frequency) > 0) if positive else df
    return rows.orderBy(F.desc(frequency), key).limit(n)


def _ranged(df: DataFrame, by: list[str], value: str, buckets: int, least: int = 1) -> DataFrame:
    """``__b``, the range of each row's value inside its group, and ``size`` of the group.

    Approximate quantiles cut a group into ranges of about equal size; equal values share a range. Only every so
    many-th quantile is a bound if ranges would hold fewer than ``least`` rows, so many small groups make few ranges.
    Bounds are staged: approximate quantiles follow the order in which parts arrive, and rows and the counts before them
    must see the same ones.
    """
    side = 32
    n = side * max(1, buckets // side)
    q = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(10 * n))
    groups = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    cuts = df.groupBy(*groups).agg(F.coalesce(q, F.array().cast("array<double>")).alias("__q"), F.count("*").alias("size"))
    if least > 1:
        every = F.ceil(F.lit(least * n) / F.col("size"))
        cuts = cuts.withColumn("__q", F.filter("__q", lambda _, i: (i + 1) % every == 0))
    cuts = staged(cuts, "ranges")
    below = lambda x: F.size(F.filter(x, lambda c: c < F.col(value)))
    # every 32nd bound first, then the bounds between two of those
    coarse = below(F.transform(F.sequence(F.lit(1), F.lit(max(1, n // side - 1))), lambda i: F.get("__q", i * side - 1)))
    rows = df.join(cuts, _same(by)).drop(*[f"__g{i}" for i in range(len(by))]).withColumn("__c", coarse)
    return rows.withColumn("__b", F.col("__c") * side + below(F.slice("__q", F.col("__c") * side + 1, F.lit(side - 1)))).drop("__q", "__c")


def _same(by: list[str]) -> Column:
    """Whether a row's group is that of the columns ``__g0``, ``__g1`` ...; NULL is a group."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], F.lit(True))


def _after_ranges(rows: DataFrame, by: list[str], counted: Column) -> DataFrame:
    """``__before``: what ``counted`` gives for all ranges of the group below the row's own."""
    names = [f"__g{i}" for i in range(len(by))]
    counts = rows.groupBy(*[F.col(c).alias(g) for c, g in zip(by, names)], F.col("__b").alias("__at")).agg(counted.alias("__m"))
    before = Window.partitionBy(*names).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    return rows.join(counts, _same(by) & (F.col("__b") == F.col("__at"))).drop(*names, "__at")


def placed(df: DataFrame, by: list[str], value: str, key: str | list[str], buckets: int = 1024, least: int = 1 << 14) -> DataFrame:
    """``place`` (from 1, by ``value`` and ``key``) and ``size`` of each row in its group, for groups of any share of all rows.

    Rows are numbered inside a range of values, after the exact counts of the ranges before it. Without
    ``by`` the whole table is one group. ``value`` is a number; missing ones come first. A group has a range for
    ``least`` rows, ``buckets`` at most: the counts, which may be broadcast, are few beside the rows, however many groups there are.
    """
    rows = _after_ranges(_ranged(df, by, value, buckets, least), by, F.count("*"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(value, *([key] if isinstance(key, str) else key)))
    return rows.withColumn("place", F.col("__before") + inside).drop("__b", "__before")


def counted_values(df: DataFrame, by: list[str], value: str, counted: Column | None = None, buckets: int = 1024) -> DataFrame:
    """``df`` with how many rows of its group have a smaller value, the same one, and any: ``n_below``, ``n_same``, ``n_all``.

    Rows are counted by value first, so a value that many share costs no more than others, and sums run
    inside ranges of values, so no group is one task's work. ``counted`` counts all rows unless given.
    """
    names = [f"__g{i}" for i in range(len(by))]
    values = df.groupBy(*by, value).agg((F.count("*") if counted is None else counted).alias("n_same"))
    rows = _after_ranges(_ranged(values, by, value, buckets).drop("size"), by, F.sum("n_same"))
    earlier = Window.partitionBy(*by, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_below", F.col("__before") + F.coalesce(F.sum("n_same").over(earlier), F.lit(0)))
    all_ = values.groupBy(*[F.col(c).alias(g) for c, g in zip(by, names)]).agg(F.sum("n_same").alias("n_all"))
    rows = rows.join(all_, _same(by)).select(*[F.col(c).alias(g) for c, g in zip(by, names)], F.col(value).alias("__v"), "n_below", "n_same", "n_all")
    return df.join(rows, _same(by) & F.col(value).eqNullSafe(F.col("__v"))).drop(*names, "__v")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str, base: int = 0) -> DataFrame:
    """``df`` with the mean rank of tied values from ``base``, as ``average_rank`` gives it, for groups of any share of all rows."""
    rank = F.col("n_below") + (F.col("n_same") - 1) / 2.0 + base
    return counted_values(df, by, value).withColumn(name, rank).drop("n_below", "n_same", "n_all")


def percentile_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the mean rank from 1 over the group's size."""
    rank = (F.col("n_below") + (F.col("n_same") - 1) / 2.0 + 1) / F.col("n_all")
    return counted_values(df, by, value).withColumn(name, rank).drop("n_below", "n_same", "n_all")


def eligible_places(df: DataFrame, eligible: Column, value: str, key: str) -> DataFrame:
    """``place`` among all eligible rows; NULL for the others, which stay."""
    found = placed(df.filter(F.coalesce(eligible, F.lit(False))).select(key, value), [], value, key).select(key, "place")
    return df.join(found, key, "left")


def category_places(df: DataFrame, category: str, order: list[str], *then: Column | str) -> DataFrame:
    """``place`` by the order of categories, then by further keys, the last of which tells all rows apart; for lists of candidates."""
    at = reduce(lambda made, x: made.when(F.col(category) == x[1], x[0]), enumerate(order[1:], 1), F.when(F.col(category) == order[0], 0)).otherwise(len(order))
    return df.withColumn("place", F.row_number().over(Window.orderBy(at, *then)).cast("long"))


def top_contributions(rows: DataFrame, weights: DataFrame, column: str, target: str, k: int) -> DataFrame:
    """The ``k`` columns of largest mean absolute contribution (value times weight) to each target, with the signed mean."""
    part = F.col("value") * F.col("weight")
    sums = rows.join(weights, column).groupBy(target, column).agg(F.avg(F.abs(part)).alias("size"), F.avg(part).alias("signed"))
    place = F.row_number().over(Window.partitionBy(target).orderBy(F.desc(F.round("size", 12)), column))
    return sums.withColumn("place", place).filter(F.col("place") <= k)


def places_missing_last(df: DataFrame, value: str, key: str) -> DataFrame:
    """``place`` from the highest value down, missing ones last, ties by ``key``; for lists of candidates."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(value), key)).cast("long"))
