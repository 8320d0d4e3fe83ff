"""Grids, nested tuning, stored models and certified paths against numpy on whole matrices."""

import numpy as np
from pyspark.sql import functions as F

from screenlab.operators import estimators, linalg, ranking


def made(spark, n=240, p=6, groups=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + rng.normal(size=p)
    x[:, 4] = 2.5  # no spread
    y = np.stack([x[:, 0] * 2 - x[:, 1] + rng.normal(size=n), rng.normal(size=n)], axis=1)
    g = np.arange(n) % groups
    rows = [(int(i), int(g[i]), [float(v) for v in x[i]], float(y[i, 0]), float(y[i, 1])) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, label int, v array<double>, t1 double, t2 double").repartition(5)
    return x, y, g, frame, linalg.moments(frame, "label", "v", ["t1", "t2"])


def plain(x, y, weights):
    """Scaled and centred training matrices, and a function from weights on scaled features to predictions."""
    sd = x.std(axis=0)
    on = sd > 1e-8
    z, c = (x[:, on] - x[:, on].mean(axis=0)) / sd[on], y - y.mean(axis=0)
    w = weights(z, c)
    return lambda new: y.mean(axis=0) + (new[:, on] - x[:, on].mean(axis=0)) / sd[on] @ w


def ridge(alpha):
    return lambda z, c: np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ c)


def components(rank, alpha):
    def weights(z, c):
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        r = min(rank, len(z) - 1, len(s))
        return vt[:r].T @ ((s[:r] / (s[:r] ** 2 + alpha))[:, None] * (u[:, :r].T @ c))

    return weights


def test_nested_tuning_equals_whole_matrices(spark):
    x, y, g, frame, _ = made(spark)
    groups = linalg.target_masks(frame, ["t1", "t2"])
    assert groups == [[0, 1]]
    errors = estimators.nested_errors(linalg.moments(frame, "label", "v", ["t1", "t2"], groups), "label", groups, ["mean", "ridge", "components"]).cache()
    got = {(r["outer"], r["inner"], r["method"], r["option"], r["target"]): r["sse"] for r in errors.collect()}
    options = {"ridge": [ridge(a) for _, a in estimators.GRIDS["ridge"]], "components": [components(int(r), a) for r, a in estimators.GRIDS["components"]], "mean": [lambda z, c: np.zeros((z.shape[1], 2))]}
    want = {}
    for outer in range(4):
        for inner in (None, *[k for k in range(4) if k != outer]):
            train = (g != outer) & (g != (-1 if inner is None else inner))
            held = g == (outer if inner is None else inner)
            for method, grid in options.items():
                for k, weights in enumerate(grid):
                    off = ((plain(x[train], y[train], weights)(x[held]) - y[held]) ** 2).sum(axis=0)
                    want |= {(outer, inner, method, k, t): off[t] for t in range(2)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)
    for r in estimators.tuned(errors).collect():
        scores = [np.mean([sum(want[r["outer"], i, r["method"], k, t] for t in range(2)) / (2 * 60) for i in range(4) if i != r["outer"]]) for k in range(len(options[r["method"]]))]
        assert r["option"] == int(np.argmin(np.round(scores, 9))) and r["n"] == 120
    assert estimators.scan_options(errors).count() == 4 * (1 + 4 + 6)


def test_stored_model(spark):
    x, y, g, frame, states = made(spark)
    model = estimators.component_model(linalg.others(states, "label"), "label", 2, 3, 1.0).cache()
    got = {(r["id"], r["target"]): r["prediction"] for r in estimators.predicted(model, frame, "id", "label", "v").collect()}
    near = {r["id"]: r for r in estimators.domain(model, frame, "id", "label", "v").collect()}
    for k in range(4):
        train = g != k
        of = plain(x[train], y[train], components(3, 1.0))
        for i in np.flatnonzero(g == k)[:20]:
            assert np.allclose([got[i, 0], got[i, 1]], of(x[i : i + 1])[0])
            on = x[train].std(axis=0) > 1e-8
            z = (x[i, on] - x[train][:, on].mean(axis=0)) / x[train][:, on].std(axis=0)
            zt = (x[train][:, on] - x[train][:, on].mean(axis=0)) / x[train][:, on].std(axis=0)
            v = np.linalg.svd(zt, full_matrices=False)[2][:3]
            assert abs(near[i]["residual"] - np.sqrt(((z - z @ v.T @ v) ** 2).mean())) < 1e-6 and near[i]["n"] == on.sum()
    cosines = estimators.subspaces(model, "label", 0).collect()
    assert len(cosines) == 9 and all(0 <= r["cosine"] <= 1 + 1e-9 for r in cosines)


def test_paths_are_certified():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12))
    y = x[:, 0] - 2 * x[:, 5] + rng.normal(size=300)
    c, d = x - x.mean(axis=0), y - y.mean()
    path = estimators.net_path(c.T @ c, c.T @ d, 300.0, [0.5, 0.1, 0.02])
    assert [p[0] for p in path] == [0.5, 0.1, 0.02]
    for alpha, w, _, off, gap in path:
        assert off < 1e-8 and gap < 1e-12 and np.allclose(w, linalg.elastic_net(x, y, alpha)[0], atol=1e-7)
    assert estimators.net_certificate(c.T @ c / 300, c.T @ d / 300, path[0][1] + 0.1, 0.5, 0.5)[0] > 0.01


def test_places_of_hot_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(0, 40, 900))] + [(900 + i, "hot", 7.0) for i in range(300)] + [(1300, "b", None), (1301, None, 1.0)]
    frame = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r["id"]: (r["place"], r["size"]) for r in ranking.placed(frame, ["g"], "v", "id", 64).collect()}
    for name in ("hot", "b", None):
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    assert {r["place"] for r in ranking.placed(frame, [], "v", "id", 64).select(F.col("place")).collect()} == set(range(1, len(rows) + 1))


def test_paired_refits_equal_whole_matrices(spark):
    """Six refits on repeated rows, and parts that add up."""
    x, y, g, frame, _ = made(spark)
    rng = np.random.default_rng(5)
    train = np.flatnonzero(g != 0)
    times = {d: np.bincount(rng.choice(len(train), len(train)), minlength=len(train)) for d in range(3)}
    rows = [(int(train[i]), d, int(k)) for d, n in times.items() for i, k in enumerate(n) if k]
    own = frame.filter("label <> 0")
    base = linalg.moments(own.withColumn("draw", F.lit(-1)), "draw", "v", ["t1", "t2"])
    draws = linalg.moments(own.join(spark.createDataFrame(rows, "id long, draw int, w int"), "id"), "draw", "v", ["t1", "t2"], weight="w")
    refits = estimators.paired_refits(base, draws, "draw", 2, 3, 2.0).cache()
    got = {(r["draw"], r["control"], r["target"]): (np.array(r["weights"]), r["bias"]) for r in refits.collect()}

    def scores(xs, scale, vectors=None):
        on = scale.std(axis=0) > 1e-8
        z = lambda m: (m[:, on] - xs.mean(axis=0)[on]) / scale.std(axis=0)[on]
        v = np.linalg.svd(z(xs), full_matrices=False)[2][:3].T if vectors is None else vectors
        return z, v

    def fit(xs, ys, scale, vectors, new):
        z, v = scores(xs, scale, vectors)
        d = z(xs) @ v
        beta = np.linalg.solve(d.T @ d + 2.0 * np.eye(3), d.T @ (ys - ys.mean(axis=0)))
        return z(new) @ v @ beta + ys.mean(axis=0)

    bx, by, new = x[train], y[train], x[g == 0]
    v0 = scores(bx, bx)[1]
    for d, n in times.items():
        xs, ys = np.repeat(bx, n, axis=0), np.repeat(by, n, axis=0)
        m0, m1 = by.mean(axis=0), ys.mean(axis=0)
        full, base_fit = fit(xs, ys, xs, None, new), fit(bx, by, bx, None, new)
        want = {"base": base_fit - m0, "full_local": full - m1, "full_common": full - m0, "reference_only": base_fit - m1, "fixed_geometry": fit(xs, ys, bx, v0, new) - m0, "fixed_scaler": fit(xs, ys, bx, None, new) - m0, "scaler_only": fit(xs, ys, xs, v0, new) - m0}
        for control, values in want.items():
            for t in range(2):
                w, b = got[d, control, t]
                assert np.allclose(new @ w + b, values[:, t], atol=1e-8), control
    parts = estimators.refit_decomposition(refits, frame.filter("label = 0"), "draw", "id", "v")
    found = parts.collect()
    assert len(found) == 3 * 60 * 2 and all(abs(r["coefficients"] + r["components"] + r["scaling"] + r["reference"] - r["total"]) < 1e-9 for r in found)
    table = estimators.cross_products(parts, ["target"], ["coefficients", "components", "scaling", "reference"]).collect()
    assert len(table) == 20 and all(r["miss"] < 1e-9 for r in table)


def test_tampered_weights_are_caught(spark):
    """Certificates come from the data's products, so what the solver wrote about itself cannot hide a wrong weight."""
    _, _, _, _, states = made(spark)
    train = linalg.others(states, "label").cache()
    fits = estimators.net_fits(train, "label", 2, [0.2, 0.02]).cache()
    honest = estimators.net_recertified(train, fits, "label", 2, 0.5).collect()
    assert len(honest) == 16 and all(r["violation"] < 1e-8 and r["moved"] < 1e-7 for r in honest)
    wrong = fits.withColumn("weight", F.when((F.col("label") == 1) & (F.col("target") == 0) & (F.col("column") == 0), F.col("weight") + 0.1).otherwise(F.col("weight")))
    for r in estimators.net_recertified(train, wrong, "label", 2, 0.5).collect():
        caught = r["label"] == 1 and r["target"] == 0
        assert (r["violation"] > 0.01) == caught and r["refined"] < 1e-8 and (abs(r["moved"] - 0.1) < 1e-6) == caught
