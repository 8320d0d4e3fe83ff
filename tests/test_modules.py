"""Searches with set rewards, partialling out and null controls, against plain loops over whole matrices."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from screenlab.operators import linalg, modules

GENES = [f"g{i}" for i in range(9)]
#: A sparse graph: a path with a branch, and one node apart.
EDGES = [("g0", "g1"), ("g1", "g2"), ("g2", "g3"), ("g3", "g4"), ("g1", "g5"), ("g5", "g6"), ("g6", "g7")]


def data(n=160, seed=1):
    """Nuisance, two columns a gene, a target that two genes explain together and neither alone."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n, 2))
    x = rng.normal(size=(n, 18)) + 0.4 * c[:, :1]
    shared = rng.normal(size=n)
    x[:, 6] += 3 * shared  # g3
    x[:, 14] -= 3 * shared  # g7
    y = (x[:, 6] + x[:, 14]) + 1.2 * x[:, 2] + 0.9 * x[:, 0] + c[:, 0] * 2 + 0.8 * rng.normal(size=n)
    return c, x, y, np.arange(n) % 4, np.arange(n) % 3


def plain_reward(c, x, y, fold, alpha):
    """Gain of a set over nuisance alone by joint fits on each fold's training rows."""
    memo = {}

    def of(members):
        members = tuple(sorted(members))
        if members not in memo:
            gain = total = 0.0
            for k in range(4):
                t, h = fold != k, fold == k
                scale = lambda m: ((m[t] - m[t].mean(0)) / m[t].std(0), (m[h] - m[t].mean(0)) / m[t].std(0))  # noqa: B023, E731
                (ct, ch), (xt, xh), (yt, yh) = scale(c), scale(x), scale(y)
                at = [GENES.index(m) * 2 + j for m in members for j in range(2)]
                errors = []
                for zt, zh in ((ct, ch), (np.hstack([ct, xt[:, at]]), np.hstack([ch, xh[:, at]]))):
                    w = np.linalg.solve(zt.T @ zt + alpha * np.eye(zt.shape[1]), zt.T @ yt)
                    errors.append(((yh - zh @ w) ** 2).sum())
                gain += errors[0] - errors[1]
                total += (yh**2).sum()
            memo[members] = round(gain / total, 12)
        return memo[members]

    return of


def children(state, genes, budget):
    chosen, nodes = state
    near = {g: {b for a, b in [*EDGES, *[(y, x) for x, y in EDGES]] if a == g} for g in GENES}
    for g in genes:
        if g in chosen:
            continue
        if not nodes or g in nodes or near[g] & nodes:
            grown = nodes | {g}
        else:
            via = sorted(b for b in near[g] if near[b] & nodes)
            if not via:
                continue
            grown = nodes | {g, via[0]}
        if len(grown) <= budget:
            yield tuple(sorted((*chosen, g))), frozenset(grown)


def plain_searches(reward, budget, penalty, width, order):
    worth = lambda s: round(reward(s[0]) - penalty * len(s[1]), 12) if s[0] else 0.0
    out = {}
    state = ((), frozenset())
    while kids := list(children(state, GENES, budget)):
        top = max(kids, key=lambda s: (worth(s), s[0], sorted(s[1])))
        if worth(top) <= worth(state):
            break
        state = top
    out["greedy"] = state
    beam, best = [((), frozenset())], ((), frozenset())
    for _ in range(budget):
        kids = {k for s in beam for k in children(s, GENES, budget)}
        if not kids:
            break
        beam = sorted(kids, key=lambda s: (-worth(s), s[0], sorted(s[1])))[:width]
        best = beam[0] if worth(beam[0]) > worth(best) else best
    out["beam"] = best
    for name, genes in (("fixed", order), ("static", sorted(GENES, key=lambda g: (-reward((g,)), g)))):
        state = best = ((), frozenset())
        for _ in range(budget):
            kids = list(children(state, genes, budget))
            if not kids:
                break
            state = kids[0]
            best = state if worth(state) > worth(best) else best
        out[name] = best
    return {m: (list(s[0]), sorted(s[1]), worth(s)) for m, s in out.items() if s[0]}, worth


def frames(spark, c, x, y, fold, context):
    rows = [(i, int(fold[i]), int(context[i]), [float(v) for v in (*c[i], *x[i])], float(y[i])) for i in range(len(y))]
    frame = spark.createDataFrame(rows, "id int, fold int, context int, v array<double>, y double").repartition(3)
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    order = ["g4", "g8", "g2", "g7", "g0", "g1", "g3", "g5", "g6"]
    return frame, edges, spark.createDataFrame([(g, order.index(g)) for g in GENES], "gene string, place int"), order


def test_searches_equal_plain_loops(spark):
    c, x, y, fold, context = data()
    frame, edges, genes, order = frames(spark, c, x, y, fold, context)
    products = modules.fold_products(frame.withColumn("draw", F.lit(0)), "fold", "v", "y", 2, 1.0).cache()
    reward = plain_reward(c, x, y, fold, 1.0)
    sets = [list(s) for k in (1, 2, 3) for s in combinations(GENES, k)]
    got = modules.set_rewards(spark.createDataFrame([(0, s) for s in sets], "draw int, members array<string>"), products, GENES, 2, 1.0).collect()
    assert len(got) == len(sets) and all(abs(r["reward"] - reward(r["members"])) < 1e-9 for r in got)
    want, worth = plain_searches(reward, 6, 0.002, 6, order)
    found, memo = modules.search(edges, genes, products, GENES, 2, 1.0, 6, 0.002, 6, {"fixed": "place", "static": "reward"})
    mine = {r["method"]: (r["chosen"], r["nodes"], r["objective"]) for r in found.collect()}
    assert mine.keys() == want.keys() == {"greedy", "beam", "fixed", "static"}
    assert all(mine[m][:2] == want[m][:2] and abs(mine[m][2] - want[m][2]) < 1e-9 for m in want)
    # the reward is not additive: the beam finds what greedy steps do not, and that is the best of all
    everything, front = set(), {((), frozenset())}
    while front:
        front = {k for s in front for k in children(s, GENES, 6)} - everything
        everything |= front
    assert max(map(worth, everything)) == want["beam"][2] > want["greedy"][2]
    assert memo.count() == memo.select("draw", "members").distinct().count()
    begun = {r["method"]: r["chosen"] for r in modules.search(edges, genes, products, GENES, 2, 1.0, 4, 0.002, 3, {"fixed": "place"}, "g4")[0].collect()}
    assert all("g4" in s for s in begun.values())
    none, _ = modules.search(edges, genes, products, GENES, 2, 1.0, 3, 5.0, 3, {"fixed": "place"})
    assert none.count() == 0


def test_null_controls_repeat_the_whole_search(spark):
    """Each draw equals the plain search on its own shuffled rows; rows are dealt inside contexts, one to one."""
    c, x, y, fold, context = data()
    frame, edges, genes, order = frames(spark, c, x, y, fold, context)
    wide = frame.withColumns({"c": F.slice("v", 1, 2), "x": F.slice("v", 3, 18)}).drop("v")
    drawn = modules.shuffled(wide, "id", "context", ["x"], 3, "null").cache()
    rows = {(r["draw"], r["id"]): r for r in drawn.collect()}
    assert len(rows) == 4 * len(y)
    joined = drawn.withColumn("v", F.concat("c", "x"))
    found, _ = modules.search(edges, genes, modules.fold_products(joined, "fold", "v", "y", 2, 1.0).cache(), GENES, 2, 1.0, 4, 0.002, 3, {"fixed": "place"})
    found = found.cache()
    mine = {(r["draw"], r["method"]): (r["chosen"], r["nodes"]) for r in found.collect()}
    for draw in range(4):
        own = np.array([rows[draw, i]["x"] for i in range(len(y))])
        for k in range(3):
            assert sorted(map(tuple, own[context == k])) == sorted(map(tuple, x[context == k]))
        assert draw == 0 or (own != x).any()
        want, _ = plain_searches(plain_reward(c, own, y, fold, 1.0), 4, 0.002, 3, order)
        assert {m: mine[draw, m] for d, m in mine if d == draw} == {m: s[:2] for m, s in want.items() if m != "static"}
    table = {r["method"]: r for r in modules.null_comparison(found, 3).collect()}
    assert table["beam"]["reward"] > table["beam"]["null_best"] and table["beam"]["n_reached"] == 0


def test_partialling_out_equals_the_joint_fit(spark):
    c, x, y, _, _ = data(seed=6)
    frame = spark.createDataFrame([(0, [float(v) for v in (*c[i], *x[i])], float(y[i])) for i in range(len(y))], "k int, v array<double>, y double")
    got = {r["column"]: r["weight"] for r in modules.partial_fits(linalg.moments(frame, "k", "v", ["y"]), "k", 2, 1, 3.0).collect()}
    z = np.hstack([c, x]) - np.hstack([c, x]).mean(0)
    w = np.linalg.solve(z.T @ z + 3.0 * np.eye(20), z.T @ (y - y.mean()))
    assert all(abs(got[j] - w[2 + j]) < 1e-8 for j in range(18))
