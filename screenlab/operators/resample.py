"""Resampling by hashed indices: every draw depends on seed, group, draw and slot alone, in any engine and order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_key, hash_place
from .ranking import placed

#: Quantiles reported.
BOUNDS = (0.025, 0.5, 0.975)


def numbered(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """``__pos`` from 0 by ``key`` and ``__size`` of each row inside its group, for groups of any share of all rows.

    ``key`` is a number or text; text is dealt into ranges by the first bytes after what all keys of its group begin with.
    """
    own = {c: f"__own_{c}" for c in ("place", "size") if c in df.columns}
    name = lambda c: own.get(c, c)
    rows, value = df.withColumnsRenamed(own), name(key)
    if isinstance(df.schema[key].dataType, T.StringType):
        ends = rows.groupBy(*[F.col(name(c)).alias(f"__k{i}") for i, c in enumerate(groups)]).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
        both = F.least(F.char_length("__low"), F.char_length("__high"))
        shared = F.when(F.col("__low") == F.col("__high"), both).otherwise(F.size(F.filter(F.sequence(F.lit(0), both), lambda i: (i > 0) & (F.substring("__low", F.lit(1), i) == F.substring("__high", F.lit(1), i)))))
        ends = ends.select(*[f"__k{i}" for i in range(len(groups))], F.octet_length(F.substring("__low", F.lit(1), F.coalesce(shared, F.lit(0)))).alias("__past"))
        same = reduce(Column.__and__, [F.col(name(c)).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(groups)], F.lit(True))
        start = F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), F.coalesce("__past", F.lit(0)) + 1, F.lit(6))), 12, "0")
        rows = rows.join(ends, same) if groups else rows.join(F.broadcast(ends))  # one row
        rows, value = rows.withColumn("__first", F.conv(start, 16, 10).cast("long")).drop("__past", *[f"__k{i}" for i in range(len(groups))]), "__first"
    rows = placed(rows, [name(c) for c in groups], value, name(key)).drop("__first")
    rows = rows.withColumns({"__pos": (F.col("place") - 1).cast("int"), "__size": F.col("size")}).drop("place", "size")
    return rows.withColumnsRenamed({v: k for k, v in own.items()})


def drawn(df: DataFrame, groups: list[str], key: str, draws: int, seed: str) -> DataFrame:
    """Every draw of every group: as many rows, with replacement; columns draw and slot are added.

    Each row stands for one slot of its group, so slots cost no extra join; only indices are joined back. The rows are
    the side that tasks look up, so the slots of all draws are not sorted.
    """
    rows = numbered(df, groups, key)
    slots = repeated(rows.select(*groups, F.col("__pos").alias("slot"), "__size"), "slot", F.col("id").cast("int"), 0, draws)
    name = F.concat_ws("/", *[F.col(g).cast("string") for g in groups]) if groups else F.lit("")
    slots = slots.withColumn("__pos", (hash_place(F.lit(seed), name, F.col("draw"), F.col("slot")) % F.col("__size")).cast("int")).drop("__size")
    return slots.join(rows.drop("__size").hint("shuffle_hash"), [*groups, "__pos"]).drop("__pos")


def repeated(df: DataFrame, key: str, draw: Column, first: int, end: int) -> DataFrame:
    """Every row once for each number ``id`` from ``first`` up to, not including, ``end``, as column draw.

    Rows are dealt by ``key`` among as many tasks as a shuffle has before they are multiplied, however few bytes they
    hold. They meet the numbers by a join, since Spark takes exploded rows to be no larger than what they come
    from and would broadcast all of them.
    """
    spark = df.sparkSession
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return dealt.crossJoin(F.broadcast(spark.range(first, end).select(draw.alias("draw"))))  # a row a draw


def drawn_sums(df: DataFrame, groups: list[str], key: str, sums: dict[str, Column], draws: int, seed: str, block: int = 1 << 13) -> DataFrame:
    """Sums over every draw of every group, as ``drawn`` draws: groups, draw and parts of each sum, to be added; NULL where nothing is there.

    Places that are drawn travel packed, four bytes each, to the block of rows they are in, which counts how often a draw takes
    each row. A group that is NULL has no draws.
    """
    rows = df.select(*groups, key, *[c.cast("double").alias(f"__s{i}") for i, c in enumerate(sums.values())])
    rows = numbered(rows.dropna(subset=groups) if groups else rows, groups, key)
    slots = repeated(rows.select(*groups, F.col("__pos").alias("slot"), "__size"), "slot", F.col("id").cast("int"), 0, draws)
    name = F.concat_ws("/", *[F.col(g).cast("string") for g in groups]) if groups else F.lit("")
    place = hash_place(F.lit(seed), name, F.col("draw"), F.col("slot")) % F.col("__size")
    slots = slots.select(*groups, "draw", place.alias("__pos")).select(*groups, F.floor(F.col("__pos") / block).cast("int").alias("__b"), (F.col("draw") * block + F.col("__pos") % block).cast("int").alias("__at"))
    keys, names, many = [*groups, "__b"], list(sums), 1 << 20
    kinds = [T.StructField(c, slots.schema[c].dataType) for c in keys]

    def packed(batches):
        held, n = [], 0

        def made():
            found = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("__at", "list")])
            yield from found.select([*keys, "__at_list"]).rename_columns([*keys, "__at"]).to_batches(max_chunksize=64)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= many:
                yield from made()
                held, n = [], 0
        if n:
            yield from made()

    def added(taken: pa.Table, own: pa.Table) -> pa.Table:
        at = np.concatenate([np.asarray(x.flatten()) for x in taken.column("__at").chunks]) if taken.num_rows else np.zeros(0, int)
        times = np.bincount(at, minlength=draws * block).reshape(draws, block).astype(float)[:, np.asarray(own.column("__p"))]
        out = {c: own.column(c).take(pa.array(np.zeros(draws, int))) for c in groups} | {"draw": pa.array(np.arange(draws), pa.int32())}
        for i, c in enumerate(names):
            v = own.column(f"__s{i}")
            there, x = np.asarray(v.is_valid()), v.to_numpy().astype(float)
            odd = ~np.isfinite(x)  # missing ones, and what must not be multiplied by 0
            s, odd = times @ np.where(odd, 0.0, x), odd & there
            for k in np.flatnonzero(odd):
                s[times[:, k] > 0] += x[k]
            out[c] = pa.array(s, mask=times @ there == 0)
        return pa.table(out)

    schema = T.StructType([*kinds[:-1], T.StructField("draw", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in sums]])
    places = slots.mapInArrow(packed, T.StructType([*kinds, T.StructField("__at", T.ArrayType(T.IntegerType()))]))
    values = rows.select(*groups, F.floor(F.col("__pos") / block).cast("int").alias("__b"), (F.col("__pos") % block).alias("__p"), *[f"__s{i}" for i in range(len(sums))])
    return places.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInArrow(added, schema)


def mean_sums(value: str) -> tuple[dict[str, Column], Column]:
    """The sums of a mean, and the mean of these."""
    v = F.col(value).cast("double")
    return {"__v": v, "__n": F.when(v.isNotNull(), 1.0)}, F.sum("__v") / F.sum("__n")


def _means(df: DataFrame, groups: list[str], key: str, value: str, draws: int, seed: str) -> DataFrame:
    """groups, draw, m: the mean of each draw of each group."""
    sums, mean = mean_sums(value)
    return drawn_sums(df, groups, key, sums, draws, seed).groupBy(*groups, "draw").agg(mean.alias("m"))


def interval(per_draw: DataFrame, groups: list[str], value: str = "stat") -> DataFrame:
    """Percentile bounds of a statistic over draws."""
    q = F.percentile(F.col(value), F.array(*[F.lit(b) for b in BOUNDS]))
    return per_draw.groupBy(*groups).agg(q.alias("q")).select(*groups, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("ci_low", "boot_median", "ci_high"))])


def fused_interval(per_draw: DataFrame, groups: list[str], value: str = "stat") -> DataFrame:
    """``interval`` to the last bit as DuckDB's quantile_cont makes it, which fuses a product with the sum; at a half the last bit decides how a bound is rounded."""
    v, last = F.col("__v"), F.size("__v") - 1
    fused = lambda a, b, c: F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")

    def bound(b: float) -> Column:
        at = last * F.lit(b)
        low, high, d = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int")), at - F.floor(at)
        return F.when(d == 0, low).otherwise(fused(low, 1 - d, high * d))

    rows = per_draw.groupBy(*groups).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("__v"))  # a value a draw
    return rows.select(*groups, *[bound(b).alias(n) for b, n in zip(BOUNDS, ("ci_low", "boot_median", "ci_high"))])


def bootstrap(df: DataFrame, groups: list[str], key: str, stat: Column, draws: int, seed: str, sums: dict[str, Column] | None = None, bounds: Callable[[DataFrame, list[str]], DataFrame] = interval) -> DataFrame:
    """Interval of ``stat`` (an aggregate) by resampling rows in each group, with the point estimate and n.

    With ``sums`` the statistic is made of sums of these columns, by name, and no drawn row is shuffled.
    """
    source = df if sums is None else df.select(*groups, *[c.alias(n) for n, c in sums.items()])
    points = source.groupBy(*groups).agg(F.count("*").alias("n"), stat.alias("estimate"))
    rows = drawn(df, groups, key, draws, seed) if sums is None else drawn_sums(df, groups, key, sums, draws, seed)
    found = bounds(rows.groupBy(*groups, "draw").agg(stat.alias("stat")), groups)
    return points.join(found, groups) if groups else points.crossJoin(found)


def bootstrap_difference(df: DataFrame, groups: list[str], key: str, value: str, arm: str, draws: int, seed: str) -> DataFrame:
    """Interval of the mean where ``arm`` holds less the mean elsewhere, each arm resampled by itself."""
    per = _means(df, [*groups, arm], key, value, draws, seed)
    both = per.groupBy(*groups, "draw").agg((F.max(F.when(F.col(arm), F.col("m"))) - F.max(F.when(~F.col(arm), F.col("m")))).alias("stat"))
    return interval(both, groups)


def bootstrap_strata(df: DataFrame, stratum: str, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """Interval of the mean of stratum means, strata fixed and rows resampled inside each."""
    per = _means(df, [stratum], key, value, draws, seed)
    return interval(per.groupBy("draw").agg(F.avg("m").alias("stat")), [])


def bootstrap_hierarchical(df: DataFrame, stratum: str, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """As ``bootstrap_strata``, with the strata resampled too."""
    inner = _means(df, [stratum], key, value, draws, seed)
    outer = drawn(df.select(stratum).distinct(), [], stratum, draws, f"{seed}/strata").select("draw", "slot", stratum)
    return interval(outer.join(inner, [stratum, "draw"]).groupBy("draw").agg(F.avg("m").alias("stat")), [])


def cluster_bootstrap(df: DataFrame, stratum: str, cluster: str, draws: int, seed: str) -> DataFrame:
    """All rows of each drawn cluster, as often as it is drawn."""
    clusters = drawn(df.select(stratum, cluster).distinct(), [stratum], cluster, draws, seed).select(stratum, cluster, "draw", "slot")
    return clusters.join(df, [stratum, cluster])


def _by_lot(df: DataFrame, by: list[str], lot: Column, key: str) -> DataFrame:
    """``place`` in the order of a hash inside groups of any share of all rows; the hash has 48 bits in ranges, and ties go by ``key``."""
    rows = df.withColumn("__lot", lot).withColumn("__first", F.conv(F.substring("__lot", 1, 12), 16, 10).cast("double"))
    return placed(rows, by, "__first", ["__lot", key]).drop("__lot", "__first")


def block_permutation(df: DataFrame, stratum: str, block: str, seed: str) -> DataFrame:
    """A donor for each block among the blocks of its stratum and size: a bijection in hash order, for strata of any share of all blocks."""
    sizes = df.groupBy(stratum, block).agg(F.count("*").alias("__n"))
    a = numbered(sizes, [stratum, "__n"], block).select(stratum, block, "__n", (F.col("__pos") + 1).alias("place"))
    b = _by_lot(sizes, [stratum, "__n"], hash_key(F.lit(seed), F.col(block)), block)
    donors = b.select(F.col(stratum).alias("__s"), F.col("__n").alias("__m"), F.col("place").alias("__p"), F.col(block).alias("donor"))
    met = a.join(donors, a[stratum].eqNullSafe(F.col("__s")) & (F.col("__n") == F.col("__m")) & (F.col("place") == F.col("__p")))
    return met.select(stratum, block, F.col("__n").alias("size"), "donor", (F.col(block) != F.col("donor")).alias("moved"))


def bootstrap_pooled(df: DataFrame, stratum: str, key: str, stat: Column, draws: int, seed: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Interval of ``stat`` over all rows, resampled inside strata of fixed size; ``sums`` as in ``bootstrap``."""
    rows = drawn(df, [stratum], key, draws, seed) if sums is None else drawn_sums(df, [stratum], key, sums, draws, seed)
    return interval(rows.groupBy("draw").agg(stat.alias("stat")), [])


def shuffled_values(df: DataFrame, context: str, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """Null controls: in each draw every row has the value of the row that a hash puts in its place inside the context, of whatever size that is."""
    rows = numbered(df, [context], key).withColumn("__p", F.col("__pos") + 1).drop("__pos", "__size")
    lots = repeated(df.select(F.col(context).alias("__ctx"), F.col(key).alias("__k"), F.col(value).alias("__v")), "__k", F.col("id"), 0, draws)
    lot = hash_key(F.concat(F.lit(seed), F.col("draw").cast("string")), F.col("__k"))
    lots = _by_lot(lots, ["draw", "__ctx"], lot, "__k").select("draw", "__ctx", "__v", "place")
    met = lots.join(rows.drop(value).hint("shuffle_hash"), rows[context].eqNullSafe(F.col("__ctx")) & (F.col("__p") == F.col("place")))
    return met.drop("__p", "__ctx", "place").withColumnRenamed("__v", value)
