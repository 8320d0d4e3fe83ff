"""The dual side: kernels summed over blocks of features, for tables with far more columns than rows.

A bucket of columns holds about ``bucket_cells`` cells of all entities. It is scaled on each fold's training
rows and multiplied with itself there; tiles of the products are summed over buckets by Spark. So no task holds
features squared: one of a fold holds entities squared, of which there may be ``MOST`` (``ridge_by_shape`` takes the
primal side where there are more entities than columns). Fits take one decomposition a fold and mask of targets:
targets that are observed for the same entities share it, and a gap changes the fits of its own targets alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.publish import staged
from . import linalg
from .metrics import choose_highest, ranking_metrics

#: Entities of one kernel at most: entities squared times 8 bytes are held by a task (0.5 GB).
MOST = 8192
_TILE = 256


@dataclass
class Folds:
    """Entities in order, and for each fold its name (outer, inner) and which entities train and are held out."""

    ids: list
    names: list[tuple]
    train: np.ndarray
    held: np.ndarray


def members(rows: DataFrame, entity: str, *columns: str) -> list[tuple]:
    """Entities with further columns, sorted; refused beyond ``MOST``."""
    found = sorted(tuple(r) for r in rows.select(entity, *columns).distinct().filter(F.col(entity).isNotNull()).limit(MOST + 1).collect())
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} entities: a kernel over them does not fit a task; use the primal side")
    if len({r[0] for r in found}) < len(found):
        raise ValueError("an entity has two groups or clusters")
    return found


def group_folds(rows: DataFrame, entity: str, group: str) -> Folds:
    """Each group held out once, all others train; entities without a group do neither."""
    found = members(rows, entity, group)
    groups = np.array([r[1] for r in found], object)
    names = sorted({g for g in groups if g is not None})
    held = np.array([[g == name for g in groups] for name in names], bool).reshape(len(names), len(found))
    known = np.array([g is not None for g in groups], bool)
    return Folds([r[0] for r in found], [(n, None) for n in names], ~held & known, held)


def nested_folds(rows: DataFrame, entity: str, group: str, cluster: str, inner: int) -> Folds:
    """Outer folds by group, less entities whose cluster has a held-out member, and inside each linked inner folds.

    Groups that share a cluster are one component and go together, the largest first to the lightest fold.
    Inner folds are named by number; an outer fold with fewer than two components has none.
    """
    found = members(rows, entity, group, cluster)
    names, train, held = [], [], []
    for outer in sorted({r[1] for r in found if r[1] is not None}):
        out = np.array([r[1] == outer for r in found])
        shared = {r[2] for r in found if r[1] == outer and r[2] is not None}
        rest = np.array([r[1] not in (None, outer) and r[2] not in shared for r in found])
        names.append((outer, None))
        train.append(rest)
        held.append(out)
        fold = _linked([(r[1], r[2]) for r, on in zip(found, rest) if on], inner)
        for k in sorted(set(fold.values())) if len(set(fold.values())) > 1 else ():
            here = rest & np.array([fold.get(r[1]) == k for r in found])
            names.append((outer, k))
            train.append(rest & ~here)
            held.append(here)
    shape = (len(names), len(found))
    return Folds([r[0] for r in found], names, np.array(train, bool).reshape(shape), np.array(held, bool).reshape(shape))


def _linked(pairs: list[tuple], folds: int) -> dict:
    """Fold of each group, from the (group, cluster) pairs of at most ``MOST`` entities."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, c in pairs:
        a = root(("g", g))
        if c is not None:
            b = root(("c", c))
            parent[max(a, b, key=str)] = min(a, b, key=str)
    size: dict = {}
    least: dict = {}
    for g, _ in pairs:
        r = root(("g", g))
        size[r] = size.get(r, 0) + 1
        least[r] = min(least.get(r, g), g)
    load, fold = [0] * min(folds, len(size)), {}
    for r in sorted(size, key=lambda r: (-size[r], least[r])):
        fold[r] = min(range(len(load)), key=lambda k: (load[k], k))
        load[fold[r]] += size[r]
    return {g: fold[root(("g", g))] for g, _ in pairs}


def _scaled(x: np.ndarray, train: np.ndarray, least: float) -> np.ndarray:
    """Columns on the scale of the training rows, missing values at their mean; those without spread there go."""
    rows = x[train]
    n = (~np.isnan(rows)).sum(axis=0)
    mean = np.where(n > 0, np.nansum(rows, axis=0) / np.maximum(n, 1), 0.0)
    z = np.where(np.isnan(x), 0.0, x - mean)
    sd = np.sqrt((z[train] ** 2).mean(axis=0)) if train.any() else np.zeros(x.shape[1])
    keep = sd > least
    return z[:, keep] / sd[keep]


def fold_kernels(cells: DataFrame, folds: Folds, entity: str, column: str, value: str, bucket_cells: int = 1 << 20, least: float = 1e-8, dense_cells: int = 1 << 20) -> DataFrame:
    """fold, i, j, used, values: tiles (rows i, columns j, i <= j) of each fold's kernel over all entities, and the columns used.

    A bucket's columns are spread over all entities ``dense_cells`` at a time, so columns with few cells take no more memory.

    Cells that are missing or NULL are at the column's training mean; a cell that stands twice is an error, a cell
    of an unknown entity or without a column is left out.
    """
    spark, n = cells.sparkSession, len(folds.ids)
    where = T.StructType([T.StructField("__id", cells.schema[entity].dataType), T.StructField("__e", T.IntegerType())])
    places = spark.createDataFrame([(x, k) for k, x in enumerate(folds.ids)], where)  # at most MOST rows
    rows = cells.filter(F.col(column).isNotNull()).join(F.broadcast(places), cells[entity] == F.col("__id")).select("__e", F.xxhash64(column).alias("__h"), F.col(column).cast("string").alias("__c"), F.col(value).cast("double").alias("__v"))
    buckets = max(1, math.ceil(rows.count() / bucket_cells))
    rows = rows.withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int")).select("__b", "__e", "__c", "__v")
    train = folds.train

    def products(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(parts)
        names = table.column("__c").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        e, c = table.column("__e").to_numpy(), names.indices.to_numpy()
        if len(np.unique(e.astype(np.int64) * len(names.dictionary) + c)) < len(e):
            raise ValueError("a cell of an entity and a column stands twice")
        v = table.column("__v").to_numpy(zero_copy_only=False)
        order = np.argsort(c, kind="stable")
        e, c, v = e[order], c[order], v[order]
        cuts = [*range(0, len(names.dictionary), max(1, dense_cells // max(n, 1))), len(names.dictionary)]

        def scaled(fold: int, low: int, high: int) -> np.ndarray:
            """Columns from ``low`` up to ``high``: all entities are there, so few columns at a time, however few cells these have."""
            start, end = np.searchsorted(c, (low, high))
            x = np.full((n, high - low), np.nan)
            x[e[start:end], c[start:end] - low] = v[start:end]
            return _scaled(x, train[fold], least)

        for fold in range(len(train)):
            whole = scaled(fold, 0, cuts[-1]) if len(cuts) <= 2 else None
            for i in range(0, n, _TILE):
                sums, used = np.zeros((min(_TILE, n - i), n - i)), 0
                for low, high in zip(cuts, cuts[1:]):
                    z = scaled(fold, low, high) if whole is None else whole
                    sums += z[i : i + _TILE] @ z[i:].T
                    used += z.shape[1]
                for j in range(i, n, _TILE):
                    yield (fold, i // _TILE, j // _TILE), used, sums[:, j - i : j - i + _TILE].ravel()

    def tiles(made: Iterator[tuple], bucket: int) -> Iterator[pa.RecordBatch]:
        for (fold, i, j), used, values in made:
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([bucket], pa.int32()), pa.array([used], pa.int64()), pa.array([values], pa.list_(pa.float64()))], names=["fold", "i", "j", "bucket", "used", "values"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = first = None
        added: dict[tuple, list] = {}  # a task's sums over all its buckets, where kernels are small

        def made() -> Iterator[pa.RecordBatch]:
            if len(train) * n * n > dense_cells * 4:
                yield from tiles(products(held), now)
                return
            for at, used, values in products(held):
                own = added.setdefault(at, [0, np.zeros(len(values))])
                own[0] += used
                own[1] += values

        for batch in batches:
            b = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if now is not None and b[start] != now:
                    yield from made()
                    held = []
                now = int(b[start])
                first = now if first is None else first
                held.append(batch.slice(start, end - start))
        if held:
            yield from made()
        yield from tiles(((at, *own) for at, own in added.items()), first)

    def total(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        values = group.column("values").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({**{c: group.column(c)[:1] for c in ("fold", "i", "j")}, "used": pa.array([sum(group.column("used").to_pylist())], pa.int64()), "values": pa.array([values], pa.list_(pa.float64()))})

    parts = rows.repartition("__b").sortWithinPartitions("__b").mapInArrow(run, "fold int, i int, j int, bucket int, used long, values array<double>")
    return parts.groupBy("fold", "i", "j").applyInArrow(total, "fold int, i int, j int, used long, values array<double>")


def _assembled(tiles: pa.Table, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for i, j, values in zip(tiles.column("i").to_pylist(), tiles.column("j").to_pylist(), tiles.column("values")):
        rows, columns = slice(i * _TILE, (i + 1) * _TILE), slice(j * _TILE, (j + 1) * _TILE)
        out[rows, columns] = np.asarray(values.values).reshape(out[rows, columns].shape)
        out[columns, rows] = out[rows, columns].T
    return out


def _centred(k: np.ndarray, rows: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel of rows, and of held rows against them, about the mean of rows."""
    own, far = k[np.ix_(rows, rows)], k[np.ix_(held, rows)]
    mean = own.mean(axis=0)
    return own - mean - mean[:, None] + mean.mean(), far - mean - far.mean(axis=1, keepdims=True) + mean.mean()


#: What is tuned: options of each method, the simplest first.
OPTIONS: dict[str, list[tuple]] = {
    "knn": [(20,), (10,), (5,)],
    "ridge": [(10_000.0,), (1_000.0,), (100.0,), (10.0,)],
    "components": [(r, a) for r in (2, 8, 32) for a in (1_000.0, 10.0)],
}


def knn(k: np.ndarray, train: np.ndarray, held: np.ndarray, y: np.ndarray, options: list[tuple]) -> list[np.ndarray]:
    """Mean of the nearest training rows by cosine (ties: the earlier entity); missing targets are skipped."""
    size = np.sqrt(np.maximum(np.diag(k), 0))
    norm = np.outer(size[held], size[train])
    cos = np.round(np.divide(k[np.ix_(held, train)], norm, out=np.full(norm.shape, -2.0), where=norm > 0), 9)
    order = np.argsort(-cos, axis=1, kind="stable")
    out = []
    for (near,) in options:
        values = y[train[order[:, :near]]]
        n = (~np.isnan(values)).sum(axis=1)
        out.append(np.where(n > 0, np.nansum(values, axis=1) / np.maximum(n, 1), np.nan))
    return out


def kernel_ridge(k: np.ndarray, train: np.ndarray, held: np.ndarray, y: np.ndarray, options: list[tuple]) -> list[np.ndarray]:
    """Ridge with an intercept on the rows that have the target, for targets of one mask."""
    rows = train[~np.isnan(y[train, 0])]
    if len(rows) < 2:
        return [np.full((len(held), y.shape[1]), np.nan) for _ in options]
    own, far = _centred(k, rows, held)
    values, vectors = np.linalg.eigh(own)
    mean = y[rows].mean(axis=0)
    turned, far = vectors.T @ (y[rows] - mean), far @ vectors
    return [(far / (np.maximum(values, 0) + alpha)) @ turned + mean for (alpha,) in options]


def component_ridge(k: np.ndarray, train: np.ndarray, held: np.ndarray, y: np.ndarray, options: list[tuple]) -> list[np.ndarray]:
    """Ridge on the leading components of all training rows, fitted on the rows that have the target."""
    none = [np.full((len(held), y.shape[1]), np.nan) for _ in options]
    seen = ~np.isnan(y[train, 0])
    if seen.sum() < 2:
        return none
    own, far = _centred(k, train, held)
    values, vectors = np.linalg.eigh(own)
    values, vectors = values[::-1], vectors[:, ::-1]
    full = int((values > 1e-8).sum())
    if not full:
        return none
    x, hx = vectors[:, :full] * np.sqrt(values[:full]), far @ vectors[:, :full] / np.sqrt(values[:full])
    mean, out = y[train[seen]].mean(axis=0), []
    for rank, alpha in options:
        r = int(min(rank, full, seen.sum() - 1))
        design = x[seen, :r]
        off = design.mean(axis=0)
        beta = np.linalg.solve((design - off).T @ (design - off) + alpha * np.eye(r), (design - off).T @ (y[train[seen]] - mean))
        out.append((hx[:, :r] - off) @ beta + mean)
    return out


METHODS: dict[str, Callable] = {"knn": knn, "ridge": kernel_ridge, "components": component_ridge}


def dual_predictions(kernels: DataFrame, targets: DataFrame, folds: Folds, entity: str, target: str, value: str, options: dict[str, list[tuple]], block_cells: int = 1 << 19) -> DataFrame:
    """fold, method, option, entity, target, truth, predicted: every option for every held-out entity, less the target's training mean.

    One decomposition a fold and mask: targets of one mask meet in a task, or in as many as their cells call for.
    A target with fewer than two training values has no row; a NULL target has no truth, and is no row of a fit.
    """
    spark, n = targets.sparkSession, len(folds.ids)
    where = T.StructType([T.StructField("__id", targets.schema[entity].dataType), T.StructField("__e", T.IntegerType())])
    places = spark.createDataFrame([(x, k) for k, x in enumerate(folds.ids)], where)  # at most MOST rows
    known = targets.filter(F.col(target).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(F.broadcast(places), targets[entity] == F.col("__id"))
    # a target's values are entities at most
    packed = known.groupBy(F.col(target).alias("target")).agg(F.array_sort(F.collect_list(F.struct("__e", F.col(value).cast("double").alias("v")))).alias("y"))
    packed = packed.withColumn("mask", F.md5(F.array_join(F.transform("y", lambda x: x["__e"].cast("string")), ",")))
    counts = packed.groupBy("mask").agg(F.count("*").alias("m"))
    blocks = max(1, math.ceil(packed.count() * n / block_cells))
    spread = F.ceil(F.col("m") * n / block_cells)
    packed = packed.join(counts, "mask").select("target", "y", F.pmod(F.xxhash64("mask", F.pmod(F.xxhash64("target"), spread)), F.lit(blocks)).cast("int").alias("block"))
    packed = staged(packed, "targets")
    each = F.explode(F.sequence(F.lit(0), F.lit(len(folds.names) - 1)))
    right = packed.withColumn("fold", each)
    left = kernels.join(F.broadcast(packed.select(F.col("block").alias("of")).distinct()))  # block numbers: a fold's tiles go to each block of targets
    train, held = folds.train, folds.held
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("method", T.StringType()), T.StructField("option", T.IntegerType()), T.StructField("entity", targets.schema[entity].dataType), T.StructField("target", targets.schema[target].dataType), T.StructField("truth", T.DoubleType()), T.StructField("predicted", T.DoubleType())])
    ids = folds.ids

    def fit(tiles: pa.Table, own: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not tiles.num_rows or not own.num_rows:
            return arrow.empty_table()
        fold = tiles.column("fold")[0].as_py()
        k, tr, he = _assembled(tiles, n), np.flatnonzero(train[fold]), np.flatnonzero(held[fold])
        own = own.sort_by("target")
        y = np.full((n, own.num_rows), np.nan)
        lists = own.column("y").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        cells = lists.flatten()
        y[np.asarray(cells.field("__e")), np.repeat(np.arange(own.num_rows), np.asarray(lists.value_lengths()))] = np.asarray(cells.field("v"))
        seen = ~np.isnan(y[tr])
        _, groups = np.unique(np.packbits(seen.T, axis=1), axis=0, return_inverse=True)
        names, made = own.column("target").combine_chunks(), []
        for group in np.unique(groups):
            at = np.flatnonzero(groups == group)
            if seen[:, at[0]].sum() < 2 or not len(he):
                continue
            mean = np.nanmean(y[np.ix_(tr, at)], axis=0)
            truth = y[np.ix_(he, at)] - mean
            who = pa.array([ids[i] for i in he], arrow.field("entity").type).take(pa.array(np.repeat(np.arange(len(he)), len(at))))
            what = names.take(pa.array(np.tile(at, len(he))))
            for method, choices in options.items():
                for option, raw in enumerate(METHODS[method](k, tr, he, y[:, at], choices)):
                    size = raw.size
                    columns = [pa.array(np.full(size, fold), pa.int32()), pa.repeat(method, size), pa.array(np.full(size, option), pa.int32()), who, what, pa.array(truth.ravel(), from_pandas=True), pa.array(np.round((raw - mean).ravel(), 9), from_pandas=True)]
                    made.append(pa.table(columns, schema=arrow))
        return pa.concat_tables(made) if made else arrow.empty_table()

    return left.groupBy("fold", "of").cogroup(right.groupBy("fold", "block")).applyInArrow(fit, schema)


def tuned_by_ndcg(predictions: DataFrame, folds: Folds, groups: DataFrame, entity: str, group: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """What inner folds score each option, and what each method's best option gives on its outer group.

    The first table: outer, method, option, score (NDCG at ``k`` by entity, averaged inside groups, then over
    groups alike) and selected (the highest score, the simpler option on ties). The second: outer, method, option
    and the ranking metrics of each entity of the outer group.
    """
    spark = predictions.sparkSession
    names = spark.createDataFrame([(f, o, i is None) for f, (o, i) in enumerate(folds.names)], T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("outer", groups.schema[group].dataType), T.StructField("final", T.BooleanType())]))
    by = ["fold", "method", "option", "entity"]
    scored = ranking_metrics(predictions, by, "target", "truth", "predicted", k)
    scored = staged(scored.join(F.broadcast(names), "fold"), "ndcg")  # folds: a row each
    lineage = groups.select(F.col(entity).alias("entity"), F.col(group).alias("__g")).distinct()
    inner = scored.filter("NOT final").join(lineage, "entity").groupBy("outer", "method", "option", "__g").agg(F.avg("ndcg").alias("s"))
    scores = inner.groupBy("outer", "method", "option").agg(F.round(F.avg("s"), 9).alias("score"))
    chosen = choose_highest(scores.filter("score IS NOT NULL"), ["outer", "method"], "option", "score", "option").select("outer", "method", F.col("option").alias("__o"))
    report = scores.join(chosen, ["outer", "method"], "left").select("outer", "method", "option", "score", F.coalesce(F.col("option") == F.col("__o"), F.lit(False)).alias("selected"))
    final = scored.filter("final").join(chosen.withColumnRenamed("__o", "option"), ["outer", "method", "option"]).drop("fold", "final")
    return report, final


def ridge_by_shape(cells: DataFrame, targets: DataFrame, groups: DataFrame, entity: str, group: str, column: str, value: str, target: str, truth: str, alpha: float = 1.0) -> DataFrame:
    """held, entity, target, predicted (less the training mean): kernel ridge by the side that is smaller.

    With no more columns than entities and no missing cell, products of columns are summed by group (no limit on
    entities); otherwise kernels of entities are. Both give the same numbers.
    """
    shape = cells.agg(F.count_distinct(column).alias("p"), F.count_distinct(entity).alias("n"), F.count(value).alias("cells")).first()
    if shape["p"] <= shape["n"] and shape["cells"] == shape["p"] * shape["n"]:
        return _primal(cells, targets, groups, entity, group, column, value, target, truth, alpha)
    folds = group_folds(groups, entity, group)
    kernels = staged(fold_kernels(cells, folds, entity, column, value), "kernels")
    names = cells.sparkSession.createDataFrame([(f, o) for f, (o, _) in enumerate(folds.names)], T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("held", groups.schema[group].dataType)]))
    made = dual_predictions(kernels, targets, folds, entity, target, truth, {"ridge": [(alpha,)]})
    return made.join(F.broadcast(names), "fold").select("held", F.col("entity").alias(entity), "target", "predicted")


def _primal(cells: DataFrame, targets: DataFrame, groups: DataFrame, entity: str, group: str, column: str, value: str, target: str, truth: str, alpha: float) -> DataFrame:
    vectors = cells.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(column, F.col(value).cast("double").alias("__v")))), lambda x: x["__v"]).alias("__x"))
    names = [r[0] for r in targets.select(target).distinct().filter(F.col(target).isNotNull()).orderBy(target).collect()]  # columns of targets
    wide = targets.groupBy(entity).pivot(target, names).agg(F.first(truth)) if names else targets.select(entity).distinct()
    wide = wide.toDF(entity, *[f"__y{i}" for i in range(len(names))])
    rows = vectors.join(groups.select(entity, F.col(group).alias("held")).filter("held IS NOT NULL"), entity).join(wide, entity, "left")
    columns = [f"__y{i}" for i in range(len(names))]
    rows = staged(rows, "primal")
    states = linalg.others(linalg.moments(rows, "held", "__x", columns, True), "held")
    models = linalg.fitted(states, "held", len(names), "kernel_ridge", alpha=alpha)
    means = states.filter("part >= 0").select("held", "part", F.try_element_at("mean", F.lit(-1)).alias("m"), "n")
    made = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(t).alias("target"), linalg._predicted("__x", i).alias("p")) for i, t in enumerate(names)])
    found = rows.join(F.broadcast(models), "held").select("held", entity, F.explode(made).alias("q")).select("held", entity, "q.*")
    return found.join(means.filter("n >= 2"), ["held", "part"]).select("held", entity, "target", F.round(F.col("p") - F.col("m"), 9).alias("predicted"))


def kernel_pairs(kernels: DataFrame, folds: Folds) -> DataFrame:
    """fold, id_a, id_b (a not after b), dot: the entries of tiles, for kernels of few entities."""
    spark = kernels.sparkSession
    last = len(folds.ids) - 1
    cell = kernels.select("fold", "i", "j", F.posexplode("values").alias("at", "dot"))
    width = F.least(F.lit(_TILE), F.lit(last + 1) - F.col("j") * _TILE)
    a, b = F.col("i") * _TILE + F.floor(F.col("at") / width), F.col("j") * _TILE + F.col("at") % width
    placed = cell.select("fold", a.cast("int").alias("a"), b.cast("int").alias("b"), "dot").filter("a <= b")
    names = spark.createDataFrame(list(enumerate(folds.ids)), "k int, id string")  # at most MOST rows
    both = placed.join(F.broadcast(names.toDF("a", "id_a")), "a").join(F.broadcast(names.toDF("b", "id_b")), "b")
    return both.select("fold", "id_a", "id_b", "dot")


def annotation_cells(rows: DataFrame, entity: str, category: str, train: str, flags: list[str], neutral: float = 0.0) -> DataFrame:
    """entity, block, column, value: indicators of the training rows' categories, and flags.

    A row whose category is NULL or not among the training ones has 0 in all indicators, and a flag that is
    NULL is ``neutral``, so rows from elsewhere need neither. A task holds a row and its categories, ``MOST`` at most.
    """
    names = sorted(r[0] for r in rows.filter(F.col(train) & F.col(category).isNotNull()).select(category).distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} categories among training rows")
    cell = lambda block, name, value: F.struct(F.lit(block).alias("block"), F.lit(str(name)).alias("column"), value.cast("double").alias("value"))
    hot = [cell("category", x, F.coalesce(F.col(category) == F.lit(x), F.lit(False)).cast("int")) for x in names]
    own = [cell("flag", f, F.coalesce(F.col(f).cast("double"), F.lit(neutral))) for f in flags]
    return rows.select(entity, F.explode(F.array(*hot, *own)).alias("__c")).select(entity, "__c.*")


def row_mean_cells(cells: DataFrame, entity: str, value: str, block: str) -> DataFrame:
    """A block of one column: the mean of what is observed of each entity."""
    return cells.groupBy(entity).agg(F.avg(value).alias("value")).select(entity, F.lit(block).alias("block"), F.lit("mean").alias("column"), "value")


def external_kernels(cells: DataFrame, rows: DataFrame, entity: str, train: str, bucket_cells: int = 1 << 20) -> DataFrame:
    """block, id_a, id_b, dot, used: kernels between entities from elsewhere (or training ones) and training entities, by block.

    ``cells`` has entity, block, column and value, ``rows`` the entities and whether they train. Columns are scaled on training
    rows alone, and those without spread there go; a missing cell is at the training mean. Training pairs stand
    once, with ``id_a`` not after ``id_b``; pairs of an entity with itself are its squared norm, also from elsewhere.
    """
    known = members(rows, entity, train)
    own = np.array([[bool(r[1]) for r in known]], bool).reshape(1, len(known))
    folds = Folds([r[0] for r in known], [("all", None)], own, ~own)
    trains = rows.sparkSession.createDataFrame([(r[0], bool(r[1])) for r in known], f"id {dict(rows.dtypes)[entity]}, t boolean")  # at most MOST rows
    made = None
    for block in sorted(r[0] for r in cells.select("block").distinct().collect()):  # a few modalities
        tiles = staged(fold_kernels(cells.filter(F.col("block") == block), folds, entity, "column", "value", bucket_cells), "external")
        pairs = kernel_pairs(tiles, folds).join(F.broadcast(trains.toDF("id_a", "__ta")), "id_a").join(F.broadcast(trains.toDF("id_b", "__tb")), "id_b")
        pairs = pairs.filter(F.col("__ta") | F.col("__tb") | (F.col("id_a") == F.col("id_b")))
        turned = F.col("__ta") & ~F.col("__tb")  # the one from elsewhere first
        pairs = pairs.select(F.lit(block).alias("block"), F.when(turned, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"), F.when(turned, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"), "dot")
        pairs = pairs.join(F.broadcast(tiles.agg(F.max("used").alias("used"))))  # one row
        made = pairs if made is None else made.unionByName(pairs)
    return made
