"""Deterministic splits that keep groups together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_key
from ..sources.publish import staged
from .ranking import placed


def hash_split(df: DataFrame, entity: str, context: str, seed: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """train, validation and test inside each context, in the order of a hash; sizes are rounded half to even, at least 1 while rows last."""
    n, place = F.col("size"), F.col("place")
    first = F.greatest(F.bround(n * train), F.lit(1))
    second = F.greatest(F.bround(n * validation), F.lit(1))
    split = F.when(place <= first, "train").when(place <= first + second, "validation").otherwise("test")
    return _dealt(df, entity, context, seed).withColumn("split", split).select(*df.columns, "split")


def _dealt(df: DataFrame, entity: str, context: str, seed: str) -> DataFrame:
    """``place`` and ``size`` of each row in hash order inside its context, of whatever size that is."""
    lot = hash_key(F.lit(seed), F.col(entity))
    rows = df.withColumn("__lot", lot).withColumn("__first", F.conv(F.substring("__lot", 1, 12), 16, 10).cast("double"))  # 48 bits are exact in a double
    return placed(rows, [context], "__first", ["__lot", entity])


def group_holdout(df: DataFrame, entity: str, group: str, cluster: str, least: int = 1) -> DataFrame:
    """held, entity, role: every group of ``least`` or more is held out once; others train unless their cluster has a held-out member."""
    keys = df.select(entity, group, cluster).distinct()
    held = keys.groupBy(group).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(F.col(group).alias("held"))
    clusters = keys.select(F.col(group).alias("held"), F.col(cluster).alias("__c")).distinct()
    rows = keys.join(F.broadcast(held))  # one row for each group
    rows = rows.join(clusters, (rows["held"] == clusters["held"]) & (rows[cluster] == clusters["__c"]), "left").drop(clusters["held"])
    role = F.when(F.col(group) == F.col("held"), "test").when(F.col("__c").isNotNull(), "purged").otherwise("train")
    return rows.select("held", entity, role.alias("role"))


def leaks(splits: DataFrame, entities: DataFrame, entity: str, cluster: str) -> DataFrame:
    """Clusters that stand on both sides of a split; none should."""
    rows = splits.filter("role IN ('train', 'test')").join(entities.select(entity, cluster).distinct(), entity)
    return rows.groupBy("held", cluster).agg(F.count_distinct("role").alias("n")).filter("n > 1")


def round_robin(df: DataFrame, entity: str, stratum: str, folds: int, seed: str) -> DataFrame:
    """``fold`` of each row: dealt out in hash order inside its stratum."""
    return _dealt(df, entity, stratum, seed).withColumn("fold", (F.col("place") - 1) % folds).select(*df.columns, "fold")


def linked_groups(df: DataFrame, group: str, cluster: str) -> DataFrame:
    """group, component: the smallest group that each group reaches through shared clusters, by joins until nothing changes.

    Each round takes the smallest label of a group's clusters, then the label of that label, so chains halve. Rows without a
    cluster link nothing; rows without a group are left out.
    """
    links = staged(df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(cluster).alias("c")).distinct(), "links")
    labels = staged(links.groupBy("g").agg(F.min("g").alias("l")), "labels")
    while True:
        by_cluster = links.filter("c IS NOT NULL").join(labels, "g").groupBy("c").agg(F.min("l").alias("m"))
        near = links.join(by_cluster, "c").groupBy("g").agg(F.min("m").alias("m"))
        low = labels.join(near, "g", "left").select("g", "l", F.least("l", "m").alias("m"))
        up = low.select(F.col("g").alias("m"), F.col("m").alias("u"))
        after = staged(low.join(up, "m").select("g", "l", F.least("m", "u").alias("n")), "labels")
        if after.filter("n <> l").isEmpty():
            return after.select(F.col("g").alias(group), F.col("n").alias("component"))
        labels = after.select("g", F.col("n").alias("l"))


def _turns(load: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where ``m`` components of one size ``n`` leave off that go to the lightest fold one after the other, from ``load``; all by row.

    Fold i takes its j-th one at weight load_i + j * n, so they go in the order of (weight, fold): whole turns by weight div n, then
    some folds of the next one by the rest. Gives the whole turns of each fold, the order of the rest, who of it is in the next turn, and how many of these are through.
    """
    whole, rest = load // n[:, None], load % n[:, None]
    sums = np.cumsum(np.sort(whole, axis=1), axis=1)
    level = ((m[:, None] + sums) // np.arange(1, load.shape[1] + 1)).min(axis=1)[:, None]
    turns = np.maximum(level - whole, 0)
    order = np.argsort(rest, axis=1, kind="stable")
    return turns, order, np.take_along_axis(whole <= level, order, axis=1), m - turns.sum(axis=1)


def balanced_folds(df: DataFrame, group: str, cluster: str, folds: int, greedy: int | None = None) -> DataFrame:
    """group, component, fold: groups that share a cluster stay together, components go to the lightest fold, the largest first.

    Size is the number of rows; ties go to the smaller component and the lower fold. What equal components do is known from their number
    (``_turns``), so one task follows the loads over the different sizes alone, and each component finds its fold by its place among those of its
    size. Only if ``greedy`` is given are components after the first ``greedy`` dealt by turns there and back in order of size.
    """
    named = staged(linked_groups(df, group, cluster), "components")
    sizes = df.join(named, group).groupBy("component").agg(F.count("*").alias("n"))
    ranked = placed(sizes.withColumn("__v", -F.col("n").cast("double")), [], "__v", "component").select("component", "n", "place")
    head = ranked if greedy is None else ranked.filter(F.col("place") <= greedy)
    runs = head.groupBy("n").agg(F.count("*").alias("k"), F.min("place").alias("first"))

    def follow(batches):
        load = np.zeros((1, folds), np.int64)
        for batch in batches:
            n, k, out = batch.column("n").to_numpy(), batch.column("k").to_numpy(), []
            for i in range(len(n)):
                out.append(load[0])
                turns, order, next_, left = _turns(load, n[i : i + 1], k[i : i + 1])
                more = np.zeros_like(load)
                np.put_along_axis(more, order, (next_ & (np.cumsum(next_, axis=1) <= left[:, None])).astype(np.int64), axis=1)
                load = load + n[i] * (turns + more)
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("first"), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], names=["__n", "__first", "__load"])

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                load = batch.column("__load").flatten().to_numpy().reshape(batch.num_rows, -1)
                _, order, next_, left = _turns(load, batch.column("n").to_numpy(), batch.column("m").to_numpy())
                at = np.argmax(next_ & (np.cumsum(next_, axis=1) == left[:, None] + 1), axis=1)
                fold = np.take_along_axis(order, at[:, None], axis=1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(fold, pa.int32())], names=["component", "fold"])

    # a row for each size that components have
    loads = runs.repartition(1).sortWithinPartitions(F.desc("n")).mapInArrow(follow, "__n long, __first long, __load array<long>")
    own = head.join(loads, head["n"] == loads["__n"]).select("component", "n", (F.col("place") - F.col("__first")).cast("long").alias("m"), "__load")
    dealt = own.mapInArrow(deal, f"component {dict(sizes.dtypes)['component']}, fold int")
    if greedy is not None:
        turn = F.pmod(F.col("place") - 1, F.lit(2 * folds))
        rest = ranked.filter(F.col("place") > greedy).select("component", F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold"))
        dealt = dealt.unionByName(rest)
    return named.join(dealt, "component").select(group, "component", "fold")


def replayed(frozen: DataFrame, rows: DataFrame, entity: str) -> DataFrame:
    """Rows under the split that was stored; entities of the split without a row stay, with NULLs."""
    return frozen.join(rows, entity, "left")
