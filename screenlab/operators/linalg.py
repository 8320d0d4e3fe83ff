"""Dense algebra: sums of products in SQL, and small solvers inside grouped functions.

Only what needs an eigendecomposition or an iteration runs in numpy, on one fold's matrix at a time; a
fold's matrix is bounded by its feature and target counts, as normal equations are summed first: partitions
return counts, means and centred products (``moments``), and no task sees more rows than its partition has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.publish import staged


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaler(train: DataFrame, by: list[str], column: str, value: str, least: float = 1e-8) -> DataFrame:
    """Mean, population SD and ``kept`` (SD above ``least``) of each column, missing values skipped."""
    return train.groupBy(*by, column).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).withColumn("kept", F.coalesce(F.col("sd") > least, F.lit(False)))


def standardised(df: DataFrame, fitted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values on the scale of the training rows; missing values become 0, the training mean; dropped columns go."""
    return df.join(fitted.filter("kept"), keys).withColumn(value, F.coalesce((F.col(value) - F.col("mean")) / F.col("sd"), F.lit(0.0))).drop("mean", "sd", "kept")


def held_out_scalers(df: DataFrame, entity: str, group: str, column: str, value: str) -> DataFrame:
    """The scaler of each hold-out group, fitted on all other groups, from one pass of (n, mean, variance) by group.

    Sums are taken about the column's mean over all groups, so a column far from zero loses no digits.
    """
    states = df.groupBy(group, column).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    all_ = Window.partitionBy(column)  # a row a group
    states = states.withColumn("at", F.try_divide(F.sum(F.col("n") * F.col("m")).over(all_), F.sum("n").over(all_)))
    off = F.col("m") - F.col("at")
    states = states.withColumns({"s": F.col("n") * off, "q": F.col("n") * (F.col("v") + off * off)})
    less = {x: F.sum(x).over(all_) - F.col(x) for x in ("n", "s", "q")}
    rows = states.select(F.col(group).alias("held"), column, "at", *[e.alias(x) for x, e in less.items()])
    off = F.try_divide(F.col("s"), F.col("n"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("n")) - off * off, F.lit(0.0)))
    return rows.select("held", column, (F.col("at") + off).alias("mean"), sd.alias("sd"), (sd > 1e-8).alias("kept"))


def _blocks(df: DataFrame, block: int, *columns: Column | str) -> DataFrame:
    """__rows: structs of the columns, at most ``block`` a row, put together inside partitions."""
    source = df.select(F.struct(*columns).alias("__r"))

    def cut(batches):
        for batch in batches:
            column = batch.column(0)
            for start in range(0, len(column), block):
                part = column.slice(start, block)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]))], names=["__rows"])

    return source.mapInArrow(cut, T.StructType([T.StructField("__rows", T.ArrayType(source.schema[0].dataType))]))


def _block_products(queries: DataFrame, rows: DataFrame, key: str, block: int, products: Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch], schema: str | T.StructType, alone: Callable[[pa.StructArray], pa.RecordBatch] | None = None, packed: int = 1) -> DataFrame:
    """What ``products`` makes of every block of queries (a stated set) beside every block of rows; ``alone`` gets each query once.

    Rows are dealt by ``key`` into columns, a task each and many beside tasks, however few bytes they hold: the work is by
    pairs. A row is shuffled once, a query once for each column, ``packed`` of them together. A task holds the rows of its column and streams the queries.
    """
    spark = queries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = n if n >= 64 else 4 * n
    a = _blocks(queries, packed, *queries.columns) if packed > 1 else queries.select(F.array(F.struct(*queries.columns)).alias("__rows"))
    a = a.select(F.col("__rows").alias("__a"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("__j"))
    b = rows.select(F.struct(*rows.columns).alias("__b"), F.pmod(F.xxhash64(key), F.lit(across)).cast("int").alias("__j"))
    met = a.unionByName(b, allowMissingColumns=True).select("__j", "__a", "__b", F.col("__b").isNotNull().alias("__row"))
    met = met.repartitionById(across, "__j").sortWithinPartitions("__j", F.desc("__row"))
    cut = lambda x: [x.slice(k, block) for k in range(0, len(x), block)]

    def run(batches):
        now, held, own = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            j, row = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 3))
            starts = np.flatnonzero(np.r_[True, (np.diff(j) != 0) | (row[1:] != row[:-1])])
            for start, end in zip(starts, [*starts[1:], len(j)]):
                if j[start] != now:
                    now, held, own = j[start], [], []
                if row[start]:
                    held.append(batch.column(2).slice(start, end - start))
                    continue
                if held:
                    own, held = cut(pa.concat_arrays(held)), []
                for x in cut(batch.column(1).slice(start, end - start).flatten()):
                    if alone is not None and now == 0:
                        yield alone(x)
                    yield from (products(x, y) for y in own)

    return met.mapInArrow(run, schema)


def _reals(df: DataFrame, vector: str) -> Column:
    """A vector as it travels: floats stay floats, which are doubles of the same value in the task."""
    return F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")


def _matrix(rows: pa.Array, name: str = "v") -> np.ndarray:
    return rows.field(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds a double: scaled, to the nearest whole number, a half away from 0, and back."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return np.where(np.abs(y - whole) == 0.5, whole + np.sign(y), np.rint(y)) / 10.0**digits


def gram(queries: DataFrame, rows: DataFrame, entity: str, vector: str, block: int = 256, digits: int | None = None) -> DataFrame:
    """id_a, id_b, dot of a stated query set against all rows; rows go by blocks, so no row meets another alone.

    With ``digits`` the products are rounded in the tasks, as SQL does.
    """
    cells = lambda df: df.select(F.col(entity).alias("id"), _reals(df, vector).alias("v"))
    kinds = [dict(df.dtypes)[entity] for df in (queries, rows)]

    def products(a, b):
        made = _matrix(a) @ _matrix(b).T
        x, y = (k.ravel() for k in np.indices(made.shape))
        dots = made.ravel() if digits is None else _rounded(made.ravel(), digits)
        return pa.RecordBatch.from_arrays([a.field("id").take(pa.array(x)), b.field("id").take(pa.array(y)), pa.array(dots)], names=["id_a", "id_b", "dot"])

    return _block_products(cells(queries), cells(rows), "id", block, products, f"id_a {kinds[0]}, id_b {kinds[1]}, dot double", packed=16)


def gram_by_features(df: DataFrame, entity: str, column: str, value: str, queries: Column | None = None) -> DataFrame:
    """The kernel of a long table: products summed over shared columns.

    Without ``queries`` each pair of entities once; with it, the entities for which it holds against all: their cells go
    by blocks of entities, so no product is shuffled to be added.
    """
    if queries is not None:
        return _gram_of_lists(df.filter(queries), df, entity, column, value)
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, F.col(f"a.{column}") == F.col(f"b.{column}")).filter(F.col(f"a.{entity}") <= F.col(f"b.{entity}"))
    return pairs.groupBy(F.col(f"a.{entity}").alias("id_a"), F.col(f"b.{entity}").alias("id_b")).agg(F.sum(F.col(f"a.{value}") * F.col(f"b.{value}")).alias("dot"))


def _gram_of_lists(queries: DataFrame, rows: DataFrame, entity: str, column: str, value: str, block: int = 256, wide: int = 4096) -> DataFrame:
    """id_a, id_b, dot of entities that share a column; NULL if no shared column has both values. Columns go ``wide`` at a time."""
    kind = dict(rows.dtypes)[entity]

    def cells(df):
        lists = df.filter(F.col(column).isNotNull() & F.col(entity).isNotNull()).groupBy(entity).agg(F.collect_list(F.struct(F.col(column).alias("c"), F.col(value).cast("double").alias("v"))).alias("l"))
        return lists.select(F.col(entity).alias("id"), "l")

    def dense(cells, sizes, at, low, high):
        """Values, how many of them are there, and how many cells, of the columns from ``low`` up to ``high``."""
        who, v = np.repeat(np.arange(len(sizes)), sizes), cells.field("v")
        here = (at >= low) & (at < high)
        there = np.asarray(v.is_valid())
        out = np.zeros((3, len(sizes), high - low))
        for k, part in enumerate((np.asarray(v.fill_null(0.0)), there, np.ones(len(v)))):
            np.add.at(out[k], (who[here], at[here] - low), part[here])
        return out

    def products(*sides):
        lists = [s.field("l") for s in sides]
        flat, sizes = [x.flatten() for x in lists], [np.asarray(x.value_lengths()) for x in lists]
        names = pa.concat_arrays([x.field("c") for x in flat]).dictionary_encode()
        at = np.asarray(names.indices)
        at, n = (at[: len(flat[0])], at[len(flat[0]) :]), len(names.dictionary)
        made = np.zeros((3, len(sides[0]), len(sides[1])))
        for low in range(0, n, wide):
            x, y = (dense(f, s, p, low, min(low + wide, n)) for f, s, p in zip(flat, sizes, at))
            made += x @ y.transpose(0, 2, 1)
        a, b = np.nonzero(made[2] > 0)
        dots = pa.array(made[0][a, b], mask=made[1][a, b] == 0)
        return pa.RecordBatch.from_arrays([sides[0].field("id").take(pa.array(a)), sides[1].field("id").take(pa.array(b)), dots], names=["id_a", "id_b", "dot"])

    return _block_products(cells(queries), cells(rows), "id", block, products, f"id_a {kind}, id_b {kind}, dot double")


def knn_mean(queries: DataFrame, rows: DataFrame, entity: str, vector: str, target: str, k: int, block: int = 256) -> DataFrame:
    """Mean target of the ``k`` most similar other rows by cosine; ties go to the smaller id, missing targets are skipped.

    A query's ``k`` nearest of each block of rows leave the block; a vector of zeros is similar to none.
    """
    cells = lambda df, *more: df.select(F.col(entity).alias("id"), _reals(df, vector).alias("v"), *more)
    kinds = [dict(queries.dtypes)[entity], dict(rows.dtypes)[entity], dict(rows.dtypes)[target]]

    def nearest(a, b):
        x, y = _matrix(a), _matrix(b)
        size = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
        cos = np.round(np.divide(x @ y.T, size, out=np.full(size.shape, -2.0), where=size > 0), 9)
        ids = [c.field("id").to_numpy(zero_copy_only=False) for c in (a, b)]
        place = np.unique(ids[1], return_inverse=True)[1]
        order = np.lexsort((np.broadcast_to(place, cos.shape), -cos), axis=-1)[:, : k + 1]
        p, q = np.repeat(np.arange(len(a)), order.shape[1]), order.ravel()
        apart = ids[0][p] != ids[1][q]
        p, q = p[apart], q[apart]
        return pa.RecordBatch.from_arrays([a.field("id").take(pa.array(p)), b.field("id").take(pa.array(q)), b.field("t").take(pa.array(q)), pa.array(cos[p, q])], names=["id_a", "id_b", "t", "cos"])

    pairs = _block_products(cells(queries), cells(rows, F.col(target).alias("t")), "id", block, nearest, f"id_a {kinds[0]}, id_b {kinds[1]}, t {kinds[2]}, cos double", packed=16)
    near = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("cos"), "id_b"))).filter(F.col("rank") <= k)
    return near.groupBy("id_a").agg(F.avg("t").alias("prediction"), F.count("t").alias("n"))


def ridge_line(df: DataFrame, by: list[str], x: str, y: str, alpha: float) -> DataFrame:
    """Slope and intercept of one-feature ridge, centred so that the intercept is not shrunk."""
    return line_moments(df, by, x, y).select(*by, "n", *_line(F.lit(alpha)))


def line_moments(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, the two means and the sums of squares and products about them, over rows where both are there."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(a)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), (n * F.var_pop(a)).alias("sxx"), (n * F.covar_pop(a, b)).alias("sxy"), (n * F.var_pop(b)).alias("syy"))


def _line(alpha: Column) -> tuple[Column, Column]:
    slope = F.col("sxy") / (F.col("sxx") + alpha)
    return slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept")


def line_errors(df: DataFrame, by: list[str], fold: str, x: str, y: str, alphas: list[float]) -> DataFrame:
    """Squared error of each group and alpha, every fold's line over the rows of all other folds.

    Rows are read once, into moments by group and fold; errors follow from those of the fold that is scored.
    """
    moments = line_moments(df, [*by, fold], x, y)
    fits = moments.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas]))).select(*by, F.col(fold).alias("__fitted"), "alpha", *_line(F.col("alpha")))
    met = moments.join(fits, by).filter(F.col(fold) != F.col("__fitted"))
    off = F.col("my") - F.col("slope") * F.col("mx") - F.col("intercept")
    sse = F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx") + F.col("n") * off * off
    return met.groupBy(*by, "alpha").agg(F.sum(sse).alias("sse"))


def attribution(loadings: DataFrame, betas: DataFrame) -> DataFrame:
    """Weight of each column for each target: loadings times coefficients summed over components."""
    return loadings.join(betas, "pc").groupBy("col_id", "target").agg(F.sum(F.col("loading") * F.col("beta")).alias("weight"))


def predict(rows: DataFrame, fitted: DataFrame, loadings: DataFrame, betas: DataFrame, targets: DataFrame) -> DataFrame:
    """Predictions of a stored component model for a long table: scale, weigh, add the target's bias."""
    scaled = standardised(rows, fitted, ["col_id"], "value")
    scores = scaled.join(attribution(loadings, betas), "col_id").groupBy("row_id", "target").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    return scores.join(targets, "target").select("row_id", "target", (F.col("score") + F.col("bias")).alias("prediction"))


def masked_ridge(x: np.ndarray, y: np.ndarray, alphas: list[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """Kernel ridge for targets with gaps: those of one mask share a decomposition of the centred kernel.

    Returns for each alpha the weights (columns by targets) and intercepts; a target with fewer than two
    observed rows has NaN.
    """
    out = {a: (np.full((x.shape[1], y.shape[1]), np.nan), np.full(y.shape[1], np.nan)) for a in alphas}
    seen = ~np.isnan(y)
    for mask in np.unique(seen, axis=1).T:
        if mask.sum() < 2:
            continue
        which = np.flatnonzero((seen == mask[:, None]).all(axis=0))
        xm, ym = x[mask], y[np.ix_(mask, which)]
        cx, cy = xm - xm.mean(axis=0), ym - ym.mean(axis=0)
        values, vectors = np.linalg.eigh(cx @ cx.T)
        turned = vectors.T @ cy
        for a in alphas:
            w = cx.T @ (vectors @ (turned / (np.maximum(values, 0) + a)[:, None]))
            out[a][0][:, which], out[a][1][which] = w, ym.mean(axis=0) - xm.mean(axis=0) @ w
    return out


def component_ridge(x: np.ndarray, y: np.ndarray, rank: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge on the leading principal components (at most rows less one); weights and intercepts."""
    cx, cy = x - x.mean(axis=0), y - y.mean(axis=0)
    u, s, vt = np.linalg.svd(cx, full_matrices=False)
    r = min(rank, len(x) - 1, int((s > 1e-10).sum()))
    w = vt[:r].T @ ((s[:r] / (s[:r] ** 2 + alpha))[:, None] * (u[:, :r].T @ cy))
    return w, y.mean(axis=0) - x.mean(axis=0) @ w


def reduced_rank(x: np.ndarray, y: np.ndarray, rank: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge for all targets, projected onto the leading directions of the fitted values."""
    cx, cy = x - x.mean(axis=0), y - y.mean(axis=0)
    w = np.linalg.solve(cx.T @ cx + alpha * np.eye(x.shape[1]), cx.T @ cy)
    _, _, vt = np.linalg.svd(cx @ w, full_matrices=False)
    w = w @ vt[:rank].T @ vt[:rank]
    return w, y.mean(axis=0) - x.mean(axis=0) @ w


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, mix: float = 0.5, rounds: int = 5000, close: float = 1e-9) -> tuple[np.ndarray, float, float]:
    """Coordinate descent on centred data; weights, intercept and the largest violation of the optimality conditions."""
    n, cx, cy = len(y), x - x.mean(axis=0), y - y.mean()
    sq, w, left = (cx**2).sum(axis=0) / n, np.zeros(x.shape[1]), cy.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(sq > 0):
            rho = cx[:, j] @ left / n + sq[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * mix, 0) / (sq[j] + alpha * (1 - mix))
            if new != w[j]:
                left += cx[:, j] * (w[j] - new)
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < close:
            break
    slope = cx.T @ left / n - alpha * (1 - mix) * w
    off = np.where(w != 0, np.abs(slope - alpha * mix * np.sign(w)), np.maximum(np.abs(slope) - alpha * mix, 0))
    return w, float(y.mean() - x.mean(axis=0) @ w), float(off.max(initial=0.0))


SOLVERS = {
    "kernel_ridge": lambda x, y: masked_ridge(x, y, [1.0])[1.0],
    "component_ridge": lambda x, y: component_ridge(x, y, 16, 1.0),
    "reduced_rank": lambda x, y: reduced_rank(x, y, 2, 1.0),
    "elastic_net": lambda x, y: tuple(np.stack(v, -1) for v in list(zip(*(elastic_net(x, y[:, t], 0.01)[:2] for t in range(y.shape[1]))))),
}


def ridge_moments(a: np.ndarray, b: np.ndarray, n: float, alpha: float = 1.0) -> np.ndarray:
    """Ridge weights from centred products: features by features, features by targets."""
    return np.linalg.solve(a + alpha * np.eye(len(a)), b)


def component_moments(a: np.ndarray, b: np.ndarray, n: float, rank: int = 16, alpha: float = 1.0) -> np.ndarray:
    """``component_ridge`` from centred products."""
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1], vectors[:, ::-1]
    least = max(1e-20, len(a) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0))
    r = int(min(rank, n - 1, (values > least).sum()))
    return vectors[:, :r] @ ((vectors[:, :r].T @ b) / (values[:r] + alpha)[:, None])


def reduced_moments(a: np.ndarray, b: np.ndarray, n: float, rank: int = 2, alpha: float = 1.0) -> np.ndarray:
    """``reduced_rank`` from centred products."""
    w = ridge_moments(a, b, n, alpha)
    lead = np.linalg.eigh(w.T @ a @ w)[1][:, ::-1][:, :rank]
    return w @ lead @ lead.T


def elastic_moments(a: np.ndarray, b: np.ndarray, n: float, alpha: float = 0.01, mix: float = 0.5, rounds: int = 5000, close: float = 1e-9) -> np.ndarray:
    """``elastic_net`` of every target from centred products: the same steps, with the slopes kept instead of what is left of y."""
    out = np.zeros(b.shape)
    a, sq = a / n, np.diag(a) / n
    for t in range(b.shape[1]):
        w, slope = out[:, t], b[:, t] / n
        for _ in range(rounds):
            moved = 0.0
            for j in np.flatnonzero(sq > 0):
                rho = slope[j] + sq[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha * mix, 0) / (sq[j] + alpha * (1 - mix))
                if new != w[j]:
                    slope = slope + a[:, j] * (w[j] - new)
                    moved, w[j] = max(moved, abs(new - w[j])), new
            if moved < close:
                break
    return out


#: The solvers above on summed products.
MOMENT_SOLVERS = {"kernel_ridge": ridge_moments, "ridge": ridge_moments, "component_ridge": component_moments, "reduced_rank": reduced_moments, "elastic_net": elastic_moments}
_STATE = tuple[float, np.ndarray, np.ndarray]


def _state(z: np.ndarray, w: np.ndarray) -> _STATE:
    """Weight, mean and centred products of rows."""
    n = w.sum()
    mean = w @ z / n
    c = z - mean
    return float(n), mean, (c * w[:, None]).T @ c


def _merged(a: _STATE | None, b: _STATE | None) -> _STATE | None:
    """The state of both sets of rows; means are moved, so nothing cancels."""
    if a is None or b is None:
        return b if a is None else a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _states(table: pa.Table, order: list[tuple[str, str]]) -> list[_STATE]:
    """The states of a table's rows."""
    table = table.sort_by(order)
    vectors = [[np.asarray(v.values, float) for v in table.column(c)] for c in ("mean", "cross")]
    return [(n, m, c.reshape(len(m), len(m))) for n, m, c in zip(table.column("n").to_pylist(), *vectors)]


def target_masks(rows: DataFrame, targets: list[str]) -> list[list[int]]:
    """Numbers of the targets in groups that the same rows lack, told by how many these are and two sums of their hashes."""
    if not targets:
        return []
    gone = lambda t: F.col(t).isNull() | F.isnan(F.col(t).cast("double"))
    own = [F.xxhash64(F.lit(seed), *[c for c, kind in rows.dtypes if "map" not in kind]).cast("decimal(38,0)") for seed in (1, 2)]
    sums = [F.concat_ws(":", F.count_if(gone(t)), *[F.coalesce(F.sum(F.when(gone(t), h)), F.lit(0)).cast("string") for h in own]).alias(f"m{i}") for i, t in enumerate(targets)]
    found = rows.agg(*sums).first()
    groups: dict[str, list[int]] = {}
    for i, mask in enumerate(found):
        groups.setdefault(mask, []).append(i)
    return list(groups.values())


def moments(rows: DataFrame, key: str, vector: str, targets: list[str], masked: bool | list[list[int]] = False, weight: str | None = None) -> DataFrame:
    """key, part, n, mean, cross: weight, means and centred products of vector and targets by key, summed over partitions.

    Part -1 is of all rows that have all targets: the vector followed by the targets. ``masked``: the vector
    alone there, of all rows, and a part t for the rows that have target t: the vector followed by that target; with
    groups of targets (``target_masks``) a part for each group and the rows that have all of it, so a gap changes no
    other group. A vector that is NULL, holds a NULL or has another length is an error.
    """
    groups = masked if isinstance(masked, list) else [[t] for t in range(len(targets))] if masked else []
    masked = bool(masked) or isinstance(masked, list)
    source = rows.select(F.col(key).alias("__k"), F.col(vector).cast("array<double>").alias("__v"), *[F.col(t).cast("double").alias(f"__t{i}") for i, t in enumerate(targets)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    schema = f"{key} {dict(rows.dtypes)[key]}, part int, n double, mean array<double>, cross array<double>"

    def table(states: dict, kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in states], kind), pa.array([p for _, p in states], pa.int32()), pa.array([s[0] for s in states.values()], pa.float64()), *(pa.array([s[i].ravel() for s in states.values()], pa.list_(pa.float64())) for i in (1, 2))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([TaskContext.get().partitionId()] * len(states), pa.int32())], names=[key, "part", "n", "mean", "cross", "piece"])

    def summed(batches):
        states: dict = {}
        kind, width = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            keys = batch.column(0).dictionary_encode("encode")
            place, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            if batch.column(1).null_count or len(set(sizes.tolist()) | width) > 1:
                raise ValueError("a vector is NULL or has another length than the others")
            width |= {int(sizes[0])}
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if np.isnan(x).any():
                raise ValueError("a vector holds a missing value")
            y = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(targets))], axis=1) if targets else np.zeros((batch.num_rows, 0))
            w = batch.column(2 + len(targets)).to_numpy()
            for k, name in enumerate(names):
                here = np.flatnonzero(place == k)
                whole = here if masked else here[~np.isnan(y[here]).any(axis=1)]
                parts = {-1: (whole, x[whole] if masked else np.hstack([x[whole], y[whole]]))} if len(whole) else {}
                for part, group in enumerate(groups):
                    seen = here[~np.isnan(y[np.ix_(here, group)]).any(axis=1)]
                    if len(seen):
                        parts[part] = (seen, np.hstack([x[seen], y[np.ix_(seen, group)]]))
                for part, (at, z) in parts.items():
                    states[name, part] = _merged(states.get((name, part)), _state(z, w[at]))
            if len(states) > 256:
                yield table(states, kind)
                states = {}
        if states:
            yield table(states, kind)

    return added_states(source.mapInArrow(summed, schema + ", piece int"), key)


def added_states(pieces: DataFrame, key: str) -> DataFrame:
    """The states of ``moments`` from those of pieces of the rows, told apart by a column piece."""

    def one(group: pa.Table) -> pa.Table:
        n, mean, cross = reduce(_merged, _states(group, [("piece", "ascending"), ("n", "ascending")]))
        return pa.table({key: group.column(key)[:1], "part": group.column("part")[:1], "n": [n], "mean": [mean], "cross": [cross.ravel()]})

    return pieces.groupBy(key, "part").applyInArrow(one, pieces.drop("piece").schema)


def others(states: DataFrame, key: str) -> DataFrame:
    """The states of all other keys' rows for each key: what comes before it and what comes after, so nothing is subtracted.

    One task a part holds a state a key: keys times features squared, whatever the number of rows.
    """

    def rest(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        states = _states(group, [(key, "ascending")])
        after: list[_STATE | None] = [None]
        for s in states[:0:-1]:
            after.append(_merged(s, after[-1]))
        before, out = None, []
        for s, late in zip(states, after[::-1]):
            out.append(_merged(before, late) or (0.0, np.full(len(s[1]), np.nan), np.zeros(s[2].shape)))
            before = _merged(before, s)
        return pa.table({key: group.column(key), "part": group.column("part"), "n": [o[0] for o in out], "mean": [o[1] for o in out], "cross": [o[2].ravel() for o in out]})

    return states.groupBy("part").applyInArrow(rest, states.schema)


def fitted(states: DataFrame, key: str, n_targets: int, method: str, scaled: bool = True, **options: float) -> DataFrame:
    """key, mean, bias, weights (an array a target): a target's prediction is its bias plus the weights times what exceeds the mean.

    ``scaled``: features are standardised on the training rows first, and those without spread go. A target
    that a key's rows lack, or that fewer than two have, gets NaN where parts by target are given.
    """
    solve = MOMENT_SOLVERS[method]

    def fit(group: pa.Table) -> pa.Table:
        parts = dict(zip(group.sort_by("part").column("part").to_pylist(), _states(group, [("part", "ascending")])))
        n, mean, cross = parts[-1]
        masked = method == "kernel_ridge"
        p = len(mean) if masked else len(mean) - n_targets
        mean, sd = mean[:p], np.sqrt(np.maximum(np.diag(cross)[:p] / max(n, 1), 0)) if scaled else np.ones(p)
        on = np.flatnonzero(sd > 1e-8) if n else np.arange(0)
        sd, weights, bias = sd[on], np.zeros((n_targets, p)), np.full(n_targets, np.nan)
        for part, (m, centre, c) in parts.items():
            if m < 1 or part >= 0 and m < 2 or masked and part < 0:
                continue
            at = [part] if masked else list(range(n_targets))
            w = solve(c[np.ix_(on, on)] / np.outer(sd, sd), c[on, p:] / sd[:, None], m, **options)
            weights[np.ix_(at, on)] = (w / sd[:, None]).T
            bias[at] = centre[p:] - (centre[on] - mean[on]) / sd @ w
        mean = np.where(np.isnan(mean), 0, mean)
        return pa.table({key: group.column(key)[:1], "mean": [mean], "bias": [bias], "weights": pa.array([[w for w in weights]], pa.list_(pa.list_(pa.float64())))})

    return states.groupBy(key).applyInArrow(fit, f"{key} {dict(states.dtypes)[key]}, mean array<double>, bias array<double>, weights array<array<double>>")


def _predicted(vector: str, target: int) -> Column:
    """The prediction of one target by the model beside the row."""
    over = F.zip_with(F.col(vector), F.col("mean"), lambda x, m: x.cast("double") - m)
    return F.get("bias", F.lit(target)) + dot(over, F.get("weights", F.lit(target)))


def cross_fitted(rows: DataFrame, entity: str, group: str, vector: str, targets: list[str], method: str) -> DataFrame:
    """held, entity, target, prediction: each group predicted by a model of all others.

    Features are standardised on training rows. Products are summed by group once; a fold solves a system
    of features by features on the sums of the other groups, and rows meet their group's weights alone.
    """
    source = rows.select(entity, F.col(group).alias("held"), F.col(vector).alias("__v"), *[F.col(t).alias(f"__y{i}") for i, t in enumerate(targets)])
    names = [f"__y{i}" for i in range(len(targets))]
    models = fitted(others(moments(source, "held", "__v", names, method == "kernel_ridge"), "held"), "held", len(targets), method)
    found = source.join(F.broadcast(models), "held")  # a fold's weights: features by targets
    made = F.array(*[F.struct(F.lit(t).alias("target"), _predicted("__v", i).alias("prediction")) for i, t in enumerate(targets)])
    return found.select("held", entity, F.explode(made).alias("__p")).select("held", entity, "__p.target", "__p.prediction")


def summed_gram(queries: DataFrame, rows: DataFrame, entity: str, vectors: list[str], digits: int | None = None) -> DataFrame:
    """``block_sum`` of the named columns of vectors: products of vectors put end to end, so the blocks' pairs are not shuffled to be added."""
    joined = lambda df: df.select(entity, F.concat(*[_reals(df, v) for v in vectors]).alias("__v"))
    return gram(joined(queries), joined(rows), entity, "__v", digits=digits)


def block_sum(grams: dict[str, DataFrame], chosen: list[str]) -> DataFrame:
    """The kernel of a configuration: the sum of its named blocks."""
    rows = reduce(DataFrame.unionByName, [grams[name].select("id_a", "id_b", "dot") for name in chosen])
    return rows.groupBy("id_a", "id_b").agg(F.sum("dot").alias("dot"))


def permuted_kernel(gram: DataFrame, donors: DataFrame) -> DataFrame:
    """A kernel as if each row had its donor's values: ids looked up twice, the products stay. ``gram`` holds both orders of a pair."""
    a = donors.select(F.col("row_id").alias("new_a"), F.col("donor").alias("id_a"))
    b = donors.select(F.col("row_id").alias("new_b"), F.col("donor").alias("id_b"))
    return gram.join(a, "id_a").join(b, "id_b").select(F.col("new_a").alias("id_a"), F.col("new_b").alias("id_b"), "dot")


def permuted_block(queries: DataFrame, rows: DataFrame, donors: DataFrame, entity: str, vector: str, digits: int | None = None) -> DataFrame:
    """``permuted_kernel`` of a stated query set against all rows: each row takes its donor's vector, and blocks meet."""
    given = rows.select(F.col(entity).alias("donor"), F.col(vector).alias("__v")).join(donors, "donor").select(F.col("row_id").alias(entity), F.col("__v").alias(vector))
    given = staged(given, "given")
    return gram(given.join(queries.select(entity), entity, "left_semi"), given, entity, vector, digits=digits)


def one_hot(df: DataFrame, entity: str, category: str, train: Column) -> DataFrame:
    """Long indicator features of the categories that training rows have; other categories have none."""
    names = df.filter(train).select(F.col(category).alias("__c")).distinct()
    return df.join(names, F.col(category) == F.col("__c")).select(entity, F.concat(F.lit(f"{category}="), F.col("__c").cast("string")).alias("feature"), F.lit(1.0).alias("value"))


def configurations(blocks: tuple[str, ...]) -> dict[str, list[str]]:
    """Blocks of each kernel configuration: background (none), full, each block dropped, each block alone."""
    return {"background": [], "full": list(blocks)} | {f"drop_{b}": [x for x in blocks if x != b] for b in blocks} | {f"only_{b}": [b] for b in blocks}


def with_interactions(df: DataFrame, features: list[str], contexts: list[str], train: Column) -> DataFrame:
    """Features less their mean over training rows, and the product of each with every context centred likewise."""
    means = df.filter(train).agg(*[F.avg(c).alias(f"__{c}") for c in (*features, *contexts)])
    rows = df.join(F.broadcast(means))  # one row
    centred = {c: F.col(c) - F.col(f"__{c}") for c in (*features, *contexts)}
    products = {f"{f}_{c}": centred[f] * centred[c] for f in features for c in contexts}
    return rows.withColumns({f: centred[f] for f in features} | products).drop(*means.columns)


def certificate(slopes: DataFrame, alpha: float) -> DataFrame:
    """Largest violation of the lasso conditions by target, from weights and correlations (weight, slope) of each column."""
    w, s = F.col("weight"), F.col("slope")
    off = F.when(w != 0, F.abs(s - alpha * F.signum(w))).otherwise(F.greatest(F.abs(s) - alpha, F.lit(0.0)))
    return slopes.groupBy("target").agg(F.max(off).alias("violation"), F.count_if(w != 0).alias("n_active"))


def residualised(x: np.ndarray, y: np.ndarray, nuisance: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sides less their ridge fit on nuisance columns: a fit of the rest on the rest is the joint fit's part."""
    z = nuisance - nuisance.mean(axis=0)
    solve = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T)
    return (x - x.mean(axis=0)) - z @ (solve @ (x - x.mean(axis=0))), (y - y.mean(axis=0)) - z @ (solve @ (y - y.mean(axis=0)))


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the angles between two column spaces, largest first; blind to sign and rotation."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), 0, 1)


def refit_stability(rows: DataFrame, stratum: str, cluster: str, entity: str, vector: str, target: str, held: Column, draws: int, seed: str, k: int = 10) -> DataFrame:
    """How often each held-out row is among the k lowest predictions of models refitted on cluster bootstraps.

    A draw's products are sums of rows weighted by how often their cluster is drawn.
    """
    from .resample import drawn

    train = rows.filter(~held).select(stratum, cluster, F.col(vector).alias("__v"), F.col(target).alias("__y"))
    times = drawn(train.select(stratum, cluster).distinct(), [stratum], cluster, draws, seed).groupBy(stratum, cluster, "draw").agg(F.count("*").alias("__n"))
    models = fitted(moments(train.join(times, [stratum, cluster]), "draw", "__v", ["__y"], weight="__n"), "draw", 1, "component_ridge", scaled=False)
    test = rows.filter(held).select(entity, F.col(vector).alias("__v")).join(F.broadcast(models))  # one row of weights a draw
    scored = test.select("draw", entity, F.round(_predicted("__v", 0), 9).alias("__s"))
    picked = scored.withColumn("__r", F.row_number().over(Window.partitionBy("draw").orderBy("__s", entity))).filter(F.col("__r") <= k)
    return picked.groupBy(entity).agg((F.count("*") / draws).alias("frequency"))
