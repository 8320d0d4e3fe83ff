"""Kernels over blocks of columns, and what is tuned on them, against numpy on whole matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.operators import kernels, linalg


def sample(spark, n=60, p=300, t=14, seed=4, gaps=True):
    rng = np.random.default_rng(seed)
    lead = rng.normal(size=(n, 4))
    x = lead @ rng.normal(size=(4, p)) + rng.normal(size=(n, p))
    x[:, 7] = 1.5  # no spread
    y = lead @ rng.normal(size=(4, t)) + 0.5 * rng.normal(size=(n, t))
    if gaps:
        x[rng.random(x.shape) < 0.02] = np.nan
        y[rng.random(y.shape) < 0.03] = np.nan
        y[5:9, 3] = np.nan
        y[:, 6] = np.nan  # nobody has it
        y[1:, 9] = np.nan  # one row has it
    lineage = np.array([f"g{i % 4}" for i in range(n)])
    cluster = np.array([f"c{i // 2}" if i < 8 else f"p{i}" for i in range(n)])  # some clusters join two lineages
    cells = spark.createDataFrame([(f"e{i:03d}", f"f{j:05d}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(n) for j in range(p) if not (np.isnan(x[i, j]) and j % 2)], "id string, f string, v double")
    targets = spark.createDataFrame([(f"e{i:03d}", f"t{j:02d}", None if np.isnan(y[i, j]) else float(y[i, j])) for i in range(n) for j in range(t)], "id string, t string, y double")
    groups = spark.createDataFrame([(f"e{i:03d}", str(lineage[i]), str(cluster[i])) for i in range(n)], "id string, g string, c string")
    return x, y, lineage, cluster, cells, targets, groups


def scaled(x, train):
    mean = np.nanmean(x[train], axis=0)
    z = np.where(np.isnan(x), 0, x - mean)
    sd = np.sqrt((z[train] ** 2).mean(axis=0))
    return z[:, sd > 1e-8] / sd[sd > 1e-8]


def test_fold_kernels_equal_whole_matrices(spark):
    x, _, lineage, _, cells, _, groups = sample(spark)
    folds = kernels.group_folds(groups, "id", "g")
    assert folds.names == [("g0", None), ("g1", None), ("g2", None), ("g3", None)]
    odd = cells.unionByName(spark.createDataFrame([("unknown", "f00001", 1.0), ("e000", None, 2.0)], cells.schema))
    for size in (1 << 20, 700):  # one bucket, and many
        made = kernels.fold_kernels(odd, folds, "id", "f", "v", size).toArrow()
        for k in range(4):
            z = scaled(x, lineage != f"g{k}")
            part = made.filter(np.array([v == k for v in made.column("fold").to_pylist()]))
            assert np.allclose(kernels._assembled(part, 60), z @ z.T) and set(part.column("used").to_pylist()) == {299}
    with pytest.raises(Exception, match="stands twice"):
        kernels.fold_kernels(cells.unionByName(cells.limit(1)), folds, "id", "f", "v").count()


def masked_fit(z, y, train, held, fit):
    """Predictions of each target by a fit on the training rows that have it."""
    out = np.full((held.sum(), y.shape[1]), np.nan)
    for t in range(y.shape[1]):
        rows = train & ~np.isnan(y[:, t])
        if rows.sum() >= 2:
            out[:, t] = fit(z, rows, y[rows, t], z[held], train)
    return out


def ridge_fit(alpha):
    def fit(z, rows, y, new, train):
        a, m = z[rows] - z[rows].mean(axis=0), z[rows].mean(axis=0)
        w = a.T @ np.linalg.solve(a @ a.T + alpha * np.eye(len(a)), y - y.mean())
        return (new - m) @ w + y.mean()

    return fit


def component_fit(rank, alpha):
    def fit(z, rows, y, new, train):
        m = z[train].mean(axis=0)
        v = np.linalg.svd(z[train] - m, full_matrices=False)[2]
        r = min(rank, len(v), rows.sum() - 1, train.sum() - 1)
        s, sn = (z[rows] - m) @ v[:r].T, (new - m) @ v[:r].T
        o = s.mean(axis=0)
        b = np.linalg.solve((s - o).T @ (s - o) + alpha * np.eye(r), (s - o).T @ (y - y.mean()))
        return (sn - o) @ b + y.mean()

    return fit


def knn_fit(k):
    def fit(z, rows, y, new, train):
        full = np.full(len(z), np.nan)
        full[rows] = y
        norm = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
        at = np.flatnonzero(train)
        order = np.argsort(-np.round(norm(new) @ norm(z[at]).T, 9), axis=1, kind="stable")[:, :k]
        return np.array([np.nanmean(full[at[o]]) if (~np.isnan(full[at[o]])).any() else np.nan for o in order])

    return fit


FITS = {"knn": lambda o: knn_fit(*o), "ridge": lambda o: ridge_fit(*o), "components": lambda o: component_fit(*o)}
OPTIONS = {"knn": [(20,), (5,)], "ridge": [(1000.0,), (10.0,)], "components": [(2, 10.0), (8, 10.0)]}


def everything(x, y, folds, ids):
    out = {}
    for f in range(len(folds.names)):
        train, held = folds.train[f], folds.held[f]
        z = scaled(x, train)
        mean = np.array([np.nanmean(c) if (~np.isnan(c)).any() else np.nan for c in y[train].T])
        for method, options in OPTIONS.items():
            for o, option in enumerate(options):
                raw = masked_fit(z, y, train, held, FITS[method](option))
                for a, i in enumerate(np.flatnonzero(held)):
                    for t in range(y.shape[1]):
                        if (~np.isnan(y[train, t])).sum() >= 2:
                            out[f, method, o, ids[i], f"t{t:02d}"] = (y[i, t] - mean[t], raw[a, t] - mean[t])
    return out


def test_dual_predictions_and_tuning_equal_plain_loops(spark):
    """All options in all inner folds, with gaps in features and targets; the choice by lineage-equal NDCG."""
    x, y, lineage, cluster, cells, targets, groups = sample(spark)
    folds = kernels.nested_folds(groups, "id", "g", "c", 3)
    ids = [f"e{i:03d}" for i in range(60)]
    for (outer, inner), train, held in zip(folds.names, folds.train, folds.held):
        assert not (train & held).any() and not set(cluster[train]) & set(cluster[held]) and not set(lineage[train]) & set(lineage[held])
        assert inner is not None or set(lineage[held]) == {outer}
    made = kernels.dual_predictions(kernels.fold_kernels(cells, folds, "id", "f", "v", 5000).cache(), targets, folds, "id", "t", "y", OPTIONS, 200).cache()
    got = {(r["fold"], r["method"], r["option"], r["entity"], r["target"]): (r["truth"], r["predicted"]) for r in made.collect()}
    want = everything(x, y, folds, ids)
    assert set(got) == set(want) and not {k for k in got if k[4] in ("t06", "t09")}
    same = lambda a, b: (a is None and np.isnan(b)) or (a is not None and abs(a - b) < 1e-6)
    assert all(same(got[k][0], want[k][0]) and same(got[k][1], want[k][1]) for k in want)

    def ndcg(pairs, k=5):
        pairs = [(t, p, name) for name, (t, p) in pairs if not np.isnan(t) and not np.isnan(p)]
        if len(pairs) < k:
            return None
        gain = lambda rows: sum(max(-t, 0) / math.log2(r + 2) for r, (t, _, _) in enumerate(rows[:k]))
        ideal = gain(sorted(pairs, key=lambda r: (r[0], r[2])))
        return gain(sorted(pairs, key=lambda r: (round(r[1], 9), r[2]))) / ideal if ideal > 0 else None

    report, final = kernels.tuned_by_ndcg(made, folds, groups, "id", "g", 5)
    scores = {(r["outer"], r["method"], r["option"]): (r["score"], r["selected"]) for r in report.collect()}
    for outer in sorted(set(lineage)):
        for method, options in OPTIONS.items():
            mine = []
            for o in range(len(options)):
                by_lineage: dict = {}
                for f, name in enumerate(folds.names):
                    if name[0] == outer and name[1] is not None:
                        for i in np.flatnonzero(folds.held[f]):
                            s = ndcg([(f"t{t:02d}", want[f, method, o, ids[i], f"t{t:02d}"]) for t in range(14) if (f, method, o, ids[i], f"t{t:02d}") in want])
                            if s is not None:
                                by_lineage.setdefault(lineage[i], []).append(s)
                mine.append(round(float(np.mean([np.mean(v) for v in by_lineage.values()])), 9))
                assert abs(scores[outer, method, o][0] - mine[-1]) < 1e-6
            best = max(range(len(options)), key=lambda o: (mine[o], -o))
            assert [scores[outer, method, o][1] for o in range(len(options))] == [o == best for o in range(len(options))]
            assert {r["option"] for r in final.filter((F.col("outer") == outer) & (F.col("method") == method)).collect()} <= {best}
    assert final.count() == 60 * 3


def test_gap_changes_its_own_fits_alone(spark):
    """A target set to NULL for one entity changes no prediction of another target."""
    _, _, _, _, cells, targets, groups = sample(spark, gaps=False, t=6)
    folds = kernels.group_folds(groups, "id", "g")
    tiles = kernels.fold_kernels(cells, folds, "id", "f", "v").cache()
    fit = lambda rows: {(r["fold"], r["entity"], r["target"]): r["predicted"] for r in kernels.dual_predictions(tiles, rows, folds, "id", "t", "y", {"ridge": [(1.0,)]}).collect()}
    before, after = fit(targets), fit(targets.withColumn("y", F.when((F.col("t") != "t02") | (F.col("id") != "e010"), F.col("y"))))
    changed = {k for k in before if abs(before[k] - after[k]) > 1e-9}
    assert changed and {k[2] for k in changed} == {"t02"} and len(before) == len(after) == 360


def test_sides_agree(spark):
    """With fewer columns than entities products of columns are summed, else kernels; both equal a plain fit."""
    for p in (20, 130):
        x, y, lineage, _, cells, targets, groups = sample(spark, p=p, t=5, gaps=False)
        y[3, 2] = np.nan
        targets = targets.withColumn("y", F.when((F.col("t") != "t02") | (F.col("id") != "e003"), F.col("y")))
        got = {(r["id"], r["target"]): r["predicted"] for r in kernels.ridge_by_shape(cells, targets, groups, "id", "g", "f", "v", "t", "y", 3.0).collect()}
        assert len(got) == 300
        for k in range(4):
            train, held = lineage != f"g{k}", lineage == f"g{k}"
            raw = masked_fit(scaled(x, train), y, train, held, ridge_fit(3.0)) - np.nanmean(y[train], axis=0)
            for a, i in enumerate(np.flatnonzero(held)):
                assert all(abs(got[f"e{i:03d}", f"t{t:02d}"] - raw[a, t]) < 1e-6 for t in range(5))


def test_many_columns(spark):
    """500 rows of 20,000 columns: no task holds columns squared, and the kernel equals numpy's."""
    n, p = 500, 20_000
    rows = spark.range(n * p, numPartitions=16).select((F.col("id") % n).alias("e"), F.floor(F.col("id") / n).alias("c"))
    cells = rows.select("e", "c", (F.pmod(F.xxhash64("e", "c"), F.lit(1000)) / 1000.0).alias("v"))
    groups = spark.range(n).select(F.col("id").alias("e"), (F.col("id") % 2).alias("g"))
    folds = kernels.group_folds(groups, "e", "g")
    made = kernels.fold_kernels(cells, folds, "e", "c", "v", 1 << 20).toArrow()
    wide = np.array(cells.orderBy("e", "c").select("v").toArrow().column(0).to_numpy()).reshape(n, p)
    z = scaled(wide, np.arange(n) % 2 != 0)
    k = kernels._assembled(made.filter(np.array([v == 0 for v in made.column("fold").to_pylist()])), n)
    assert np.allclose(k, z @ z.T, rtol=1e-9, atol=1e-6)


def test_odd_tables(spark):
    _, _, _, _, cells, targets, groups = sample(spark, t=4, gaps=False)
    folds = kernels.group_folds(groups, "id", "g")
    assert kernels.fold_kernels(cells.limit(0), folds, "id", "f", "v").count() == 0
    tiles = kernels.fold_kernels(cells, folds, "id", "f", "v")
    assert kernels.dual_predictions(tiles, targets.limit(0), folds, "id", "t", "y", OPTIONS).count() == 0
    with pytest.raises(ValueError, match="two groups"):
        kernels.group_folds(groups.unionByName(groups.limit(1).withColumn("g", F.lit("other"))), "id", "g")
    with pytest.raises(ValueError, match="entities"):
        kernels.members(spark.range(kernels.MOST + 1), "id")


def test_vectors_and_gaps_in_moments(spark):
    """Missing targets have a rule, broken vectors an error."""
    rows = [(i, i % 3, [float(i), float(i * i % 7)], float(i) if i != 4 else None, float(-i)) for i in range(12)]
    frame = spark.createDataFrame(rows, "id int, g int, v array<double>, a double, b double")
    whole = {r["g"]: r for r in linalg.moments(frame, "g", "v", ["a", "b"]).collect()}
    assert [whole[k]["n"] for k in range(3)] == [4.0, 3.0, 4.0] and not any(np.isnan(r["mean"]).any() or np.isnan(r["cross"]).any() for r in whole.values())
    groups = linalg.target_masks(frame, ["a", "b"])
    assert groups == [[0], [1]]
    parts = {(r["g"], r["part"]): r["n"] for r in linalg.moments(frame, "g", "v", ["a", "b"], groups).collect()}
    assert parts[1, -1] == 4 and parts[1, 0] == 3 and parts[1, 1] == 4
    for bad in ("CAST(NULL AS array<double>)", "array(1.0D)", "array(1.0D, CAST(NULL AS double))"):
        with pytest.raises(Exception, match="vector"):
            linalg.moments(frame.withColumn("v", F.when(F.col("id") == 5, F.expr(bad)).otherwise(F.col("v"))), "g", "v", ["b"]).count()


def test_columns_with_few_cells_are_spread_few_at_a_time(spark):
    """A bucket of one cell a column: no more dense cells at a time than asked for, one row of sums a task and tile, the same kernel."""
    rng = np.random.default_rng(8)
    rows = [(f"e{i % 30:02d}", c, float(rng.normal())) for c in range(400) for i in range(c, c + (1 if c % 2 else 12))]
    cells = spark.createDataFrame(rows, "id string, f int, v double")
    groups = spark.createDataFrame([(f"e{i:02d}", f"g{i % 3}") for i in range(30)], "id string, g string")
    folds = kernels.group_folds(groups, "id", "g")
    big, small = (kernels.fold_kernels(cells, folds, "id", "f", "v", size, 1e-8, dense) for size, dense in ((1 << 20, 1 << 20), (300, 30 * 16)))
    pick = lambda made: {(r["fold"], r["i"], r["j"]): (r["used"], np.array(r["values"])) for r in made.collect()}
    a, b = pick(big), pick(small)
    assert a.keys() == b.keys() and len(a) == 3
    assert all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], atol=1e-9) for k in a)
