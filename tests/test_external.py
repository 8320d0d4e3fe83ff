"""Evidence by split, stored models and kernels on rows from elsewhere, summaries over groups, against plain loops."""

import random
from statistics import mean, median

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.operators import cohorts, kernels, metrics, transfer

CELLS = "p string, g string, tumour boolean, v double"


def evidence_rows(seed=3):
    rng = random.Random(seed)
    split = {f"p{i}": rng.choice(["train", "train", "validation", "test", None]) for i in range(40)}
    rows = [(p, f"g{j}", arm, round(rng.random() * 9, 3)) for p in split for j in range(4) for arm in (True, False) if rng.random() < 0.7]
    return split, [r for r in rows if not (r[1] == "g3" and not r[2] and split[r[0]] == "train")]  # g3 has no reference


def test_split_evidence_reads_open_splits_alone(spark):
    split, rows = evidence_rows()
    splits = spark.createDataFrame([(p, s) for p, s in split.items() if s], "p string, split string")

    def run(rows):
        out = cohorts.split_evidence(spark.createDataFrame(rows, CELLS), splits, "p", "g", "v", "tumour", 30, "s")
        return {(r["split"], r["g"]): r for r in out.collect()}

    made, want = run([*rows, ("p0", "g9", True, None)]), {}
    value = {(p, g, arm): v for p, g, arm, v in rows}
    for g in ("g0", "g1", "g2"):
        reference = mean(v for (p, h, arm), v in value.items() if h == g and not arm and split[p] == "train")
        for s in ("train", "validation"):
            cases = [v for (p, h, arm), v in value.items() if h == g and arm and split[p] == s]
            pairs = [v - value[p, g, False] for (p, h, arm), v in value.items() if h == g and arm and split[p] == s and (p, g, False) in value]
            want[s, g] = (len(cases), median(v - reference for v in cases), mean(v > reference for v in cases), len(pairs), median(pairs))
    assert set(made) == set(want)
    for k, (n, mid, above, n_pairs, paired) in want.items():
        r = made[k]
        assert (r["n"], r["n_pairs"]) == (n, n_pairs) and np.allclose([r["median"], r["above"], r["paired_median"]], [mid, above, paired])
        assert r["ci_low"] <= r["boot_median"] <= r["ci_high"]
    # what is locked, or outside, changes nothing; nor do the normals of another split move the reference
    locked = [(p, g, arm, v + 100 if split[p] in ("test", None) else v) for p, g, arm, v in rows]
    assert run(locked) == made
    moved = run([(p, g, arm, v + 100 if split[p] == "validation" and not arm else v) for p, g, arm, v in rows])
    assert all(moved[k]["median"] == made[k]["median"] and moved[k]["above"] == made[k]["above"] for k in made)
    with pytest.raises(Exception, match="two values of one arm"):
        run([*rows, next(r for r in rows if split[r[0]] == "train" and r[1] != "g3")])
    assert run([r for r in rows if split[r[0]] == "test"]) == {}


def test_split_audit(spark):
    split, rows = evidence_rows()
    splits = spark.createDataFrame([(p, s) for p, s in split.items() if s], "p string, split string")
    out = {r["split"]: r for r in cohorts.split_audit(spark.createDataFrame(rows, CELLS), splits, "p", "tumour").collect()}
    for s in ("train", "validation", "test", "none"):
        have = lambda arm: {r[0] for r in rows if r[2] == arm and (split[r[0]] or "none") == s}
        assert (out[s]["n_case"], out[s]["n_normal"], out[s]["n_pairs"]) == (len(have(True)), len(have(False)), len(have(True) & have(False)))
        assert out[s]["used"] == (s in ("train", "validation"))


def test_frozen_model_on_aligned_scenarios(spark):
    rng = np.random.default_rng(5)
    columns, targets, donors = [f"c{j}" for j in range(6)], [f"t{j}" for j in range(3)], [f"d{i}" for i in range(7)]
    weight, centre, bias = rng.normal(size=(6, 3)), rng.random(6) + 1, rng.normal(size=3)
    model = spark.createDataFrame([(c, t, float(centre[i]), float(centre[i] - 0.5), float(centre[i] + 0.5), float(weight[i, j]), float(bias[j])) for i, c in enumerate(columns) for j, t in enumerate(targets) if (i, j) != (5, 2)], "c string, target string, mean double, low double, high double, weight double, bias double")
    x = {s: rng.normal(size=(7, 6)) + k for k, s in enumerate(("pure", "mixed"))}
    for s in x:
        x[s][2, 1] = np.nan
    rows = [(s, d, c, None if np.isnan(x[s][i, j]) else float(x[s][i, j])) for s in x for i, d in enumerate(donors) for j, c in enumerate(columns)] + [("pure", "d0", "unknown", 1.0)]
    means = model.select("c", "mean").distinct()
    moved = transfer.aligned(spark.createDataFrame(rows, "s string, d string, c string, v double"), "s", "c", "v", means)
    out = {(r["s"], r["d"], r["target"]): r for r in transfer.frozen_scores(moved, model, ["s", "d"], "c", "v").collect()}
    assert len(out) == 2 * 7 * 3
    for s, values in x.items():
        z = np.maximum(values + centre - np.nanmean(values, axis=0), 0)
        for i, d in enumerate(donors):
            for j, t in enumerate(targets):
                at = [k for k in range(6) if (k, j) != (5, 2)]
                here = [k for k in at if not np.isnan(z[i, k])]
                r = out[s, d, t]
                assert np.isclose(r["score"], bias[j] + sum((z[i, k] - centre[k]) * weight[k, j] for k in here))
                assert r["n_used"] == len(here) and np.isclose(r["missing"], 1 - len(here) / len(at)) and np.isclose(r["outside"], np.mean([abs(z[i, k] - centre[k]) > 0.5 for k in here]))
    assert transfer.frozen_scores(moved.limit(0), model, ["s", "d"], "c", "v").count() == 0


def test_external_kernels_equal_numpy(spark):
    rng = np.random.default_rng(2)
    n, far, p = 30, 6, 80
    x = rng.normal(size=(n + far, p))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 3] = 2.0  # no spread
    ids, train = [f"e{i:02d}" for i in range(n + far)][::-1], np.arange(n + far) < n
    category, flag = [f"l{i % 3}" if i < n else None for i in range(n + far)], [float(i % 4 == 0) if i < n else None for i in range(n + far)]
    rows = spark.createDataFrame([(ids[i], bool(train[i]), category[i], flag[i]) for i in range(n + far)], "id string, t boolean, l string, f double")
    parts = spark.createDataFrame([(ids[i], "x", f"c{j}", float(x[i, j])) for i in range(n + far) for j in range(p) if not np.isnan(x[i, j])], "id string, block string, column string, value double")
    cells = kernels.annotation_cells(rows, "id", "l", "t", ["f"]).unionByName(kernels.row_mean_cells(parts, "id", "value", "m")).unionByName(parts)
    blocks = {"category": np.array([[float(c == f"l{k}") for k in range(3)] for c in category]), "flag": np.array([[f or 0.0] for f in flag]), "m": np.nanmean(x, axis=1)[:, None], "x": x}
    for size in (1 << 20, 300):  # one bucket, and many
        out = {(r["block"], r["id_a"], r["id_b"]): r for r in kernels.external_kernels(cells, rows, "id", "t", size).collect()}
        for block, v in blocks.items():
            z = np.where(np.isnan(v), 0, v - np.nanmean(v[train], axis=0))
            sd = np.sqrt((z[train] ** 2).mean(axis=0))
            k = (z[:, sd > 1e-8] / sd[sd > 1e-8]) @ (z[:, sd > 1e-8] / sd[sd > 1e-8]).T
            for i in range(n + far):
                for j in range(n):
                    key = (block, ids[i], ids[j]) if i >= n else (block, *sorted((ids[i], ids[j])))
                    assert np.isclose(out[key]["dot"], k[i, j]) and out[key]["used"] == int((sd > 1e-8).sum())
                assert np.isclose(out[block, ids[i], ids[i]]["dot"], k[i, i])
        assert len(out) == 4 * (n * (n + 1) // 2 + far * n + far)


def test_group_summary(spark):
    rng = random.Random(1)
    rows = [("a", f"g{i}", v) for i in range(9) for v in [rng.random() - 0.4] * (1 + 5 * (i == 0))] + [("a", "g9", None), ("b", "g0", 2.0)]
    out = {r["m"]: r for r in metrics.group_summary(spark.createDataFrame(rows, "m string, g string, v double"), ["m"], "g", "v", 50, "s").collect()}
    each = [next(v for m, g, v in rows if m == "a" and g == f"g{i}") for i in range(9)]
    assert out["a"]["n"] == 9 and np.allclose([out["a"]["mean"], out["a"]["median"], out["a"]["positive"]], [mean(each), median(each), mean(v > 0 for v in each)])
    assert out["a"]["ci_low"] <= out["a"]["mean"] <= out["a"]["ci_high"]
    assert (out["b"]["n"], out["b"]["mean"], out["b"]["ci_low"], out["b"]["ci_high"]) == (1, 2.0, 2.0, 2.0)


def test_gains_by_scope_equal_loops(spark):
    rng = random.Random(6)
    rows = [(f"e{i:02d}", f"t{j}", m, a, rng.gauss(0, 1), rng.gauss(0, 0.3)) for i in range(24) for j in range(5) for m in ("base", "full") for a in (1, 10)]
    truth = {(e, t): y for e, t, _, _, y, _ in rows}  # one truth an entity and target
    rows = [(e, t, m, a, truth[e, t], p) for e, t, m, a, _, p in rows]
    scopes = [("all", f"e{i:02d}", f"s{i % 3}") for i in range(24)] + [("some", f"e{i:02d}", f"s{i % 3}") for i in range(0, 24, 2)] + [("all", "e99", "s0")]
    frame = spark.createDataFrame([*rows, ("e00", "t9", "base", 1, None, 0.0), ("e00", "t9", "full", 1, 1.0, None)], "e string, t string, m string, a int, truth double, predicted double")
    within = spark.createDataFrame([*scopes, scopes[0]], "scope string, e string, s string")  # an entity that stands twice counts once
    out = {(r["scope"], r["m"], r["a"]): r for r in metrics.scope_gains(frame, within, "e", "a", "m", "base", "s", 40, "x").collect()}
    each = {(r["scope"], r["m"], r["a"], r["t"]): r for r in metrics.target_gains(frame, within, "e", "a", "m", "base", "t").collect()}

    def r2(scope, m, a, target=None):
        own = {e for s, e, _ in scopes if s == scope}
        use = [(y, p) for e, t, mm, aa, y, p in rows if e in own and mm == m and aa == a and target in (None, t)]
        return 1 - sum((y - p) ** 2 for y, p in use) / sum(y * y for y, _ in use)

    assert len(out) == 8 and len(each) == 40
    for (scope, m, a), r in out.items():
        assert r["n"] == (24 if scope == "all" else 12)
        assert np.allclose([r["r2"], r["delta_r2"]], [r2(scope, m, a), r2(scope, m, a) - r2(scope, "base", a)])
        assert r["ci_low"] <= r["boot_median"] <= r["ci_high"] and (m == "full" or r["ci_low"] == r["ci_high"] == 0)
    for (scope, m, a, t), r in each.items():
        assert np.allclose([r["r2"], r["delta_r2"]], [r2(scope, m, a, t), r2(scope, m, a, t) - r2(scope, "base", a, t)])
    assert metrics.scope_gains(frame.limit(0), within, "e", "a", "m", "base", "s", 5, "x").count() == 0
