"""Estimators over summed products: grids, stored component models, elastic-net paths with certificates, nested tuning.

Everything here works on the states of ``linalg.moments`` - weight, means and centred products by group -
so a task holds features squared, whatever the number of rows. A fit of all groups but one takes the merged
states of the others (``linalg.others``); errors of a fit on held rows follow from the held group's own state,
so tuning reads the rows once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linalg
from .metrics import choose_lowest


def _unpacked(row: dict) -> linalg._STATE:
    mean = np.asarray(row["mean"], float)
    return float(row["n"]), mean, np.asarray(row["cross"], float).reshape(len(mean), len(mean))


def _scaled(state: linalg._STATE, p: int, constant: str = "drop") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept features, their SDs, and centred products of scaled features with themselves and with targets.

    ``constant``: features without spread are dropped, or kept with SD 1.
    """
    n, _, cross = state
    sd = np.sqrt(np.maximum(np.diag(cross)[:p], 0) / max(n, 1))
    if constant == "keep":
        sd = np.where(sd > 1e-8, sd, 1.0)
    on = np.flatnonzero(sd > 1e-8)
    return on, sd[on], cross[np.ix_(on, on)] / np.outer(sd[on], sd[on]), cross[on, p:] / sd[on][:, None]


def component_grid(a: np.ndarray, b: np.ndarray, n: float, ranks: list[int], alphas: list[float]) -> dict[tuple[int, float], np.ndarray]:
    """Weights of principal-component ridge for every rank (at most rows less one) and alpha, from one decomposition."""
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1], vectors[:, ::-1]
    full = int((values > max(1e-20, len(a) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0))).sum())
    turned = vectors.T @ b
    out = {}
    for rank in ranks:
        r = int(min(rank, n - 1, full))
        for alpha in alphas:
            out[rank, alpha] = vectors[:, :r] @ (turned[:r] / (values[:r] + alpha)[:, None])
    return out


def ridge_grid(a: np.ndarray, b: np.ndarray, alphas: list[float]) -> dict[float, np.ndarray]:
    """Ridge weights for every alpha from one decomposition; primal whatever the shape, as only products are held."""
    values, vectors = np.linalg.eigh(a)
    turned = vectors.T @ b
    return {alpha: vectors @ (turned / (np.maximum(values, 0) + alpha)[:, None]) for alpha in alphas}


def net_certificate(a: np.ndarray, b: np.ndarray, w: np.ndarray, alpha: float, mix: float) -> tuple[float, float]:
    """Largest violation of the optimality conditions, and a bound on how far the objective is above its least.

    ``a`` and ``b`` are products over n. The objective is strongly convex with modulus ``alpha * (1 - mix)``,
    so the squared least subgradient over twice the modulus bounds the gap.
    """
    slope = b - a @ w - alpha * (1 - mix) * w
    off = np.where(w != 0, np.abs(slope - alpha * mix * np.sign(w)), np.maximum(np.abs(slope) - alpha * mix, 0))
    return float(off.max(initial=0.0)), float((off**2).sum() / (2 * alpha * (1 - mix))) if mix < 1 else float("inf")


def net_path(a: np.ndarray, b: np.ndarray, n: float, alphas: list[float], mix: float = 0.5, rounds: int = 20_000, close: float = 1e-10) -> list[tuple[float, np.ndarray, int, float, float]]:
    """Elastic net of one target down a path of alphas, each started from the one before: alpha, weights, rounds, violation, gap bound.

    Coordinate steps run over a working set, first the columns in use; a column that breaks its condition
    joins, and the path goes on only when none does and the certificate is below ``close``, or the rounds end.
    """
    a, b = a / n, b / n
    w, out = np.zeros(len(b)), []
    sq = np.diag(a)
    for alpha in sorted(alphas, reverse=True):
        used, spent = list(np.flatnonzero(w)), 0
        while spent < rounds:
            slope = b - a @ w
            for _ in range(200):
                spent += 1
                moved = 0.0
                for j in used:
                    rho = slope[j] + sq[j] * w[j]
                    new = np.sign(rho) * max(abs(rho) - alpha * mix, 0.0) / (sq[j] + alpha * (1 - mix))
                    if new != w[j]:
                        slope = slope + a[:, j] * (w[j] - new)
                        moved, w[j] = max(moved, abs(new - w[j])), new
                if moved < close / 10:
                    break
            outside = np.flatnonzero((np.abs(b - a @ w) > alpha * mix + close) & (w == 0) & (sq > 0))
            fresh = [int(j) for j in outside if j not in used]
            if not fresh and net_certificate(a, b, w, alpha, mix)[0] <= close:
                break
            if not fresh and moved < close / 10:
                break
            used += fresh
        out.append((alpha, w.copy(), spent, *net_certificate(a, b, w, alpha, mix)))
    return out


#: The estimators that are tuned, with their grids: options in order of simplicity.
GRIDS: dict[str, list[tuple[float, float]]] = {
    "mean": [(0.0, 0.0)],
    "ridge": [(0.0, a) for a in (1000.0, 100.0, 10.0, 1.0)],
    "components": [(r, a) for r in (2.0, 8.0, 32.0) for a in (100.0, 1.0)],
    "reduced_rank": [(r, a) for r in (1.0, 2.0) for a in (100.0, 1.0)],
    "elastic_net": [(m, a) for m in (0.9, 0.5) for a in (0.1, 0.01)],
}


def solutions(method: str, a: np.ndarray, b: np.ndarray, n: float) -> list[np.ndarray]:
    """Weights on scaled features of every option of a method's grid."""
    grid = GRIDS[method]
    if method == "mean":
        return [np.zeros(b.shape)]
    if method == "ridge":
        made = ridge_grid(a, b, [x for _, x in grid])
        return [made[x] for _, x in grid]
    if method == "components":
        made = component_grid(a, b, n, sorted({int(r) for r, _ in grid}), sorted({x for _, x in grid}))
        return [made[int(r), x] for r, x in grid]
    if method == "reduced_rank":
        return [linalg.reduced_moments(a, b, n, int(r), x) for r, x in grid]
    out = []
    for mix, alpha in grid:
        out.append(np.stack([net_path(a, b[:, t], n, sorted({x for m, x in grid if m == mix}), mix, 2_000, 1e-8)[[x for x in sorted({x for m, x in grid if m == mix}, reverse=True)].index(alpha)][1] for t in range(b.shape[1])], axis=1))
    return out


def _errors(fit: linalg._STATE, held: linalg._STATE, p: int, weights: np.ndarray, on: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Summed squared errors by target of a fit on held rows, from the held rows' state alone."""
    n, mean, cross = held
    w = np.zeros((p, weights.shape[1]))
    w[on] = weights / sd[:, None]
    shift = (mean[p:] - fit[1][p:]) - w.T @ (mean[:p] - fit[1][:p])
    spread = np.diag(cross)[p:] - 2 * np.einsum("it,it->t", w, cross[:p, p:]) + np.einsum("it,ij,jt->t", w, cross[:p, :p], w)
    return spread + n * shift**2


def nested_errors(states: DataFrame, key: str, groups: list[list[int]], methods: list[str]) -> DataFrame:
    """outer, inner, method, option, target, n, sse: every option fitted without two groups and measured on one of them.

    ``inner`` is NULL for fits on all groups but the outer one, measured on the outer one. ``states`` are those of
    ``moments`` with groups of targets (``target_masks``): features are scaled on all training rows, and a group of
    targets is fitted and measured on the rows that have it, so a gap in a target changes its own errors alone.
    A pair of groups is one row of work: its fit takes the states of all others, merged along the pairs of an outer group.
    """
    kind = dict(states.dtypes)[key]
    schema = f"outer {kind}, inner {kind}, method string, option int, target int, n double, sse double"
    packed = states.select(F.struct(F.col(key).alias("key"), "part", "n", "mean", "cross").alias("s"))
    every = packed.agg(F.array_sort(F.collect_list("s")).alias("all"))  # a state a group and mask: features squared
    work = states.filter("part = -1").select(F.col(key).alias("outer")).join(F.broadcast(every))

    def fits(batches):
        for batch in batches:
            for outer, everyone in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts: dict[int, dict] = {}
                for g in everyone.as_py():
                    parts.setdefault(g["part"], {})[g["key"]] = _unpacked(g)
                rows: list[tuple] = []
                for inner in [None, *[k for k in parts.get(-1, {}) if k != outer]]:
                    rest = lambda part: reduce(linalg._merged, [s for k, s in parts.get(part, {}).items() if k not in (outer, inner)], None)  # noqa: B023, E731
                    base = rest(-1)
                    if base is None or base[0] < 2:
                        continue
                    p = len(base[1])
                    on, sd, _, _ = _scaled(base, p)
                    for part, targets in enumerate(groups):
                        train, measured = rest(part), parts.get(part, {}).get(outer if inner is None else inner)
                        if train is None or train[0] < 2 or measured is None:
                            continue
                        a, b = train[2][np.ix_(on, on)] / np.outer(sd, sd), train[2][on, p:] / sd[:, None]
                        for method in methods:
                            for option, w in enumerate(solutions(method, a, b, train[0])):
                                sse = _errors(train, measured, p, w, on, sd)
                                rows += [(outer, inner, method, option, t, measured[0], float(sse[k])) for k, t in enumerate(targets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((batch.column(0).type, batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["outer", "inner", "method", "option", "target", "n", "sse"])

    return work.repartition(F.col("outer")).mapInArrow(fits, schema)


def tuned(errors: DataFrame) -> DataFrame:
    """outer, method, option, inner_mse, n, sse: the option with least mean over inner groups of their mean squared error, and its outer error.

    Inner groups count alike; ties go to the simpler option. Every option must have been measured on the same
    inner groups, or the choice is an error.
    """
    inner = errors.filter("inner IS NOT NULL").groupBy("outer", "method", "option", "inner").agg((F.sum("sse") / F.sum("n")).alias("mse"))
    scores = inner.groupBy("outer", "method", "option").agg(F.round(F.avg("mse"), 12).alias("inner_mse"), F.count("*").alias("k"), F.sum(F.xxhash64("inner").cast("decimal(38,0)")).alias("h"))
    same = scores.groupBy("outer", "method").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_distinct("h").alias("sets"))
    whole = F.when((F.col("lo") == F.col("hi")) & (F.col("sets") == 1), F.lit(True)).otherwise(F.raise_error(F.lit("options were measured on different groups")).cast("boolean"))
    chosen = choose_lowest(scores, ["outer", "method"], "option", "inner_mse").join(same.filter(whole), ["outer", "method"])
    final = errors.filter("inner IS NULL").groupBy("outer", "method", "option").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"))
    return chosen.join(final, ["outer", "method", "option"]).select("outer", "method", "option", "inner_mse", "n", "sse")


def scan_options(errors: DataFrame) -> DataFrame:
    """outer, method, option, mse: every option on the outer group, for reports; nothing is chosen by it."""
    return errors.filter("inner IS NULL").groupBy("outer", "method", "option").agg((F.sum("sse") / F.sum("n")).alias("mse"))


def component_model(states: DataFrame, key: str, n_targets: int, rank: int, alpha: float) -> DataFrame:
    """A fitted component model a key, as tables can store it: kind, i, j, value.

    kinds: mean and sd of feature i, loading of feature i on component j, beta of component i for target j,
    bias of target i, component variance i, n.
    """
    schema = f"{key} {dict(states.dtypes)[key]}, kind string, i int, j int, value double"

    def fit(group: pa.Table) -> pa.Table:
        state = linalg._states(group.filter(pa.compute.equal(group.column("part"), -1)), [("part", "ascending")])[0]
        p = len(state[1]) - n_targets
        on, sd, a, b = _scaled(state, p)
        values, vectors = np.linalg.eigh(a)
        values, vectors = values[::-1], vectors[:, ::-1]
        r = int(min(rank, state[0] - 1, (values > 1e-10 * max(values.max(initial=0.0), 1e-300)).sum()))
        # a component's sign is fixed by its largest loading
        lead = vectors[np.abs(vectors[:, :r]).argmax(axis=0), np.arange(r)] if r else np.zeros(0)
        vectors = vectors[:, :r] * np.where(lead < 0, -1.0, 1.0)
        beta = (vectors.T @ b) / (values[:r] + alpha)[:, None]
        rows = [("mean", int(i), 0, state[1][i]) for i in on] + [("sd", int(i), 0, s) for i, s in zip(on, sd)]
        rows += [("loading", int(i), j, vectors[k, j]) for k, i in enumerate(on) for j in range(r)]
        rows += [("beta", j, t, beta[j, t]) for j in range(r) for t in range(n_targets)]
        rows += [("bias", t, 0, state[1][p + t]) for t in range(n_targets)] + [("variance", j, 0, values[j] / state[0]) for j in range(r)] + [("n", 0, 0, state[0])]
        return pa.table({key: pa.array([group.column(key)[0].as_py()] * len(rows), group.column(key).type), **{n: pa.array([x[k] for x in rows], t) for k, (n, t) in enumerate((("kind", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())))}})

    return states.groupBy(key).applyInArrow(fit, schema)


def predicted(model: DataFrame, rows: DataFrame, entity: str, key: str, vector: str) -> DataFrame:
    """key, entity, target, prediction by a stored component model: scale, project, weigh, add the bias; joins and sums alone."""
    of = lambda kind, *names: model.filter(F.col("kind") == kind).select(key, *[F.col(c).alias(n) for c, n in zip(("i", "j", "value"), names) if n])
    scaler = of("mean", "i", None, "mean").join(of("sd", "i", None, "sd"), [key, "i"])
    weights = of("loading", "i", "pc", "loading").join(of("beta", "pc", "target", "beta"), [key, "pc"]).groupBy(key, "i", "target").agg(F.sum(F.col("loading") * F.col("beta")).alias("w"))
    table = scaler.join(weights, [key, "i"]).select(key, "i", "target", (F.col("w") / F.col("sd")).alias("w"), "mean")
    cells = rows.select(entity, key, F.posexplode(vector).alias("i", "x"))
    sums = cells.join(table, [key, "i"]).groupBy(key, entity, "target").agg(F.sum((F.col("x") - F.col("mean")) * F.col("w")).alias("s"))
    return sums.join(of("bias", "target", None, "bias"), [key, "target"]).select(key, entity, "target", (F.col("s") + F.col("bias")).alias("prediction"))


def domain(model: DataFrame, rows: DataFrame, entity: str, key: str, vector: str, wide: float = 3.0) -> DataFrame:
    """key, entity, n, missing, outside, residual: how far rows are from what a stored model was fitted on.

    ``outside`` is the share of features beyond ``wide`` SDs, ``missing`` the share of features without a value,
    ``residual`` the root mean squared part of the scaled row that the components do not carry. As loadings
    are orthonormal, that is the row's squared length less its squared scores.
    """
    of = lambda kind, *names: model.filter(F.col("kind") == kind).select(key, *[F.col(c).alias(n) for c, n in zip(("i", "j", "value"), names) if n])
    scaler = of("mean", "i", None, "mean").join(of("sd", "i", None, "sd"), [key, "i"])
    cells = rows.select(entity, key, F.posexplode(vector).alias("i", "x")).join(scaler, [key, "i"]).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))
    z = F.coalesce("z", F.lit(0.0))
    length = cells.groupBy(key, entity).agg(F.count("*").alias("n"), F.avg(F.col("x").isNull().cast("double")).alias("missing"), F.avg((F.abs(z) > wide).cast("double")).alias("outside"), F.sum(z * z).alias("q"))
    scores = cells.join(of("loading", "i", "pc", "loading"), [key, "i"]).groupBy(key, entity, "pc").agg(F.sum(z * F.col("loading")).alias("s"))
    carried = scores.groupBy(key, entity).agg(F.sum(F.col("s") * F.col("s")).alias("c"))
    return length.join(carried, [key, entity]).select(key, entity, "n", "missing", "outside", F.sqrt(F.greatest(F.col("q") - F.col("c"), F.lit(0.0)) / F.col("n")).alias("residual"))


def net_fits(states: DataFrame, key: str, n_targets: int, alphas: list[float], mix: float = 0.5) -> DataFrame:
    """key, target, alpha, column, weight, slope, rounds, violation, gap: certified elastic-net paths on scaled features.

    ``slope`` is the correlation of the column with what is left of the target, less the quadratic part of
    the penalty, so that a certificate can be worked out again from the table.
    """
    schema = f"{key} {dict(states.dtypes)[key]}, target int, alpha double, column int, weight double, slope double, rounds int, violation double, gap double"

    def fit(group: pa.Table) -> pa.Table:
        state = linalg._states(group.filter(pa.compute.equal(group.column("part"), -1)), [("part", "ascending")])[0]
        n, p = state[0], len(state[1]) - n_targets
        on, _, a, b = _scaled(state, p)
        rows: list[tuple] = []
        for t in range(n_targets):
            for alpha, w, spent, off, gap in net_path(a, b[:, t], n, alphas, mix):
                slope = b[:, t] / n - a @ w / n - alpha * (1 - mix) * w
                rows += [(t, alpha, int(i), float(x), float(s), spent, off, gap) for i, x, s in zip(on, w, slope)]
        names = ("target", "alpha", "column", "weight", "slope", "rounds", "violation", "gap")
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
        return pa.table({key: pa.array([group.column(key)[0].as_py()] * len(rows), group.column(key).type), **{c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(names, kinds))}})

    return states.groupBy(key).applyInArrow(fit, schema)


def net_recertified(states: DataFrame, fits: DataFrame, key: str, n_targets: int, mix: float, close: float = 1e-9, rounds: int = 5_000) -> DataFrame:
    """key, target, alpha, violation, gap, refined, moved: certificates of stored weights worked out from the training data's products.

    What the solver wrote about itself is not read: slopes are X'(y - Xw) of the states. ``refined`` is the
    violation after coordinate steps from the stored weights, ``moved`` the largest change of a weight on the way; columns of the
    data that the table lacks count as weight 0.
    """
    schema = f"{key} {dict(states.dtypes)[key]}, target int, alpha double, violation double, gap double, refined double, moved double"

    def judge(own: pa.Table, stored: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if own.num_rows and stored.num_rows:
            state = linalg._states(own.filter(pa.compute.equal(own.column("part"), -1)), [("part", "ascending")])[0]
            on, _, a, b = _scaled(state, len(state[1]) - n_targets)
            a, b, at = a / state[0], b / state[0], {int(c): k for k, c in enumerate(on)}
            weights: dict[tuple, np.ndarray] = {}
            for t, alpha, c, w in zip(*(stored.column(x).to_pylist() for x in ("target", "alpha", "column", "weight"))):
                weights.setdefault((t, alpha), np.zeros(len(on)))[at[c]] = w
            for (t, alpha), w in sorted(weights.items()):
                off, gap = net_certificate(a, b[:, t], w, alpha, mix)
                new, slope = w.copy(), b[:, t] - a @ w
                for _ in range(rounds):
                    for j in np.flatnonzero(np.diag(a) > 0):
                        rho = slope[j] + a[j, j] * new[j]
                        step = np.sign(rho) * max(abs(rho) - alpha * mix, 0.0) / (a[j, j] + alpha * (1 - mix))
                        if step != new[j]:
                            slope = slope + a[:, j] * (new[j] - step)
                            new[j] = step
                    if net_certificate(a, b[:, t], new, alpha, mix)[0] <= close:
                        break
                rows.append((t, alpha, off, gap, net_certificate(a, b[:, t], new, alpha, mix)[0], float(np.abs(new - w).max(initial=0.0))))
        names = ("target", "alpha", "violation", "gap", "refined", "moved")
        kinds = (pa.int32(), *[pa.float64()] * 5)
        return pa.table({key: pa.array([own.column(key)[0].as_py()] * len(rows) if rows else [], own.schema.field(key).type), **{c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(names, kinds))}})

    return states.groupBy(key).cogroup(fits.groupBy(key)).applyInArrow(judge, schema)


def certified(fits: DataFrame, key: str, mix: float, tolerance: float) -> DataFrame:
    """key, alpha, n_targets, n_active, violation, worst_gap, passed: certificates worked out from stored weights and slopes.

    A column in use must have the slope that its penalty asks for, an idle one no more than that.
    """
    w, s, t = F.col("weight"), F.col("slope"), F.col("alpha") * mix
    off = F.when(w != 0, F.abs(s - t * F.signum(w))).otherwise(F.greatest(F.abs(s) - t, F.lit(0.0)))
    return fits.groupBy(key, "alpha").agg(F.count_distinct("target").alias("n_targets"), F.count_if(w != 0).alias("n_active"), F.max(off).alias("violation"), F.max("gap").alias("worst_gap")).withColumn("passed", F.col("violation") <= tolerance)


def subspaces(models: DataFrame, key: str, reference) -> DataFrame:
    """key, place, cosine: cosines of the principal angles between a model's loadings and the reference key's, largest first.

    Blind to signs and rotations. Both sides are features by components; one task a key.
    """
    loadings = models.filter("kind = 'loading'").select(key, "i", "j", "value")
    ref = loadings.filter(F.col(key) == reference).select(F.lit(True).alias("ref"), "i", "j", "value")
    keys = loadings.filter(F.col(key) != reference).select(key).distinct()
    rows = loadings.filter(F.col(key) != reference).withColumn("ref", F.lit(False)).unionByName(ref.join(keys))  # the reference once a key
    schema = f"{key} {dict(models.dtypes)[key]}, place int, cosine double"

    def angles(group: pa.Table) -> pa.Table:
        sides = []
        features = sorted(set(group.column("i").to_pylist()))
        at = {f: k for k, f in enumerate(features)}
        for side in (True, False):
            part = group.filter(pa.compute.equal(group.column("ref"), side))
            made = np.zeros((len(features), int(max(part.column("j").to_pylist(), default=-1)) + 1))
            made[[at[i] for i in part.column("i").to_pylist()], part.column("j").to_pylist()] = part.column("value").to_numpy()
            sides.append(made)
        cos = linalg.principal_angles(*sides)
        return pa.table({key: pa.array([group.column(key)[0].as_py()] * len(cos), group.column(key).type), "place": pa.array(range(1, len(cos) + 1), pa.int32()), "cosine": cos})

    return rows.groupBy(key).applyInArrow(angles, schema)


def refit_parts(base: DataFrame, refits: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Keys with the change of a value split into ordered parts: each refit less the one before it, and their exact sum.

    ``refits`` go from the base to the full refit; parts are named after them.
    """
    rows, before = base.select(*keys, F.col(value).alias("__0")), "__0"
    parts: list[Column] = []
    for k, (name, df) in enumerate(refits.items(), 1):
        rows = rows.join(df.select(*keys, F.col(value).alias(f"__{k}")), keys)
        parts.append((F.col(f"__{k}") - F.col(before)).alias(name))
        before = f"__{k}"
    return rows.select(*keys, *parts, (F.col(before) - F.col("__0")).alias("total"))


def cross_products(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, a, b, product: mean products of every two parts, and how far the parts' sum misses the total (``miss``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) * F.col(b)).alias("p")) for a in names for b in names if a <= b])).alias("x")
    miss = F.abs(reduce(Column.__add__, [F.col(n) for n in names]) - F.col("total"))
    return parts.select(*by, miss.alias("m"), pairs).groupBy(*by, "x.a", "x.b").agg(F.avg("x.p").alias("product"), F.max("m").alias("miss"))


#: Refits of a draw: what is its own, and what stays as in the base fit.
CONTROLS = ("full_local", "full_common", "reference_only", "fixed_geometry", "fixed_scaler", "scaler_only")


def _components(state: linalg._STATE, p: int, rank: int, alpha: float, scaler: linalg._STATE | None = None, loadings: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Weights on raw features of component ridge on a state, and its kept features and loadings; scaler and loadings may be another fit's."""
    n, _, cross = state
    sd = np.sqrt(np.maximum(np.diag((scaler or state)[2])[:p], 0) / max((scaler or state)[0], 1))
    on = np.flatnonzero(sd > 1e-8) if loadings is None else loadings[0][sd[loadings[0]] > 1e-8]
    a, b = cross[np.ix_(on, on)] / np.outer(sd[on], sd[on]), cross[on, p:] / sd[on][:, None]
    if loadings is None:
        values, vectors = np.linalg.eigh(a)
        values, vectors = values[::-1], vectors[:, ::-1]
        v = vectors[:, : int(min(rank, n - 1, (values > 1e-10 * max(values.max(initial=0.0), 1e-300)).sum()))]
    else:
        v = loadings[1][np.isin(loadings[0], on)]
    w = np.zeros((p, b.shape[1]))
    w[on] = v @ np.linalg.solve(v.T @ a @ v + alpha * np.eye(v.shape[1]), v.T @ b) / sd[on][:, None]
    return w, (on, v)


def refit_controls(base: linalg._STATE, draw: linalg._STATE, p: int, rank: int, alpha: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weights on raw features and intercepts of the base fit and of six refits on a draw, as differences from the targets' base means.

    ``full_local`` is measured from the draw's own target means, ``full_common`` is the same fit from the base means;
    ``reference_only`` is the base fit from the draw's means; the others take scaler and loadings, the scaler, or the loadings from the base.
    """
    w0, loadings = _components(base, p, rank, alpha)
    shift = draw[1][p:] - base[1][p:]
    at = lambda w, mean, more=0.0: (w, more - mean[:p] @ w)
    full = _components(draw, p, rank, alpha)[0]
    return {
        "base": at(w0, base[1]),
        "full_local": at(full, draw[1]),
        "full_common": at(full, draw[1], shift),
        "reference_only": at(w0, base[1], -shift),
        "fixed_geometry": at(_components(draw, p, rank, alpha, base, loadings)[0], draw[1], shift),
        "fixed_scaler": at(_components(draw, p, rank, alpha, base)[0], draw[1], shift),
        "scaler_only": at(_components(draw, p, rank, alpha, None, loadings)[0], draw[1], shift),
    }


def paired_refits(base: DataFrame, draws: DataFrame, key: str, n_targets: int, rank: int, alpha: float) -> DataFrame:
    """key, control, target, bias, weights: the base fit (one state) and all refits of each draw's state."""
    own = _unpacked(base.filter("part = -1").first().asDict())  # features squared
    schema = f"{key} {dict(draws.dtypes)[key]}, control string, target int, bias double, weights array<double>"

    def fit(group: pa.Table) -> pa.Table:
        state = linalg._states(group, [("part", "ascending")])[0]
        made = refit_controls(own, state, len(own[1]) - n_targets, rank, alpha)
        rows = [(c, t, float(b[t]), w[:, t]) for c, (w, b) in made.items() for t in range(n_targets)]
        return pa.table({key: pa.array([group.column(key)[0].as_py()] * len(rows), group.column(key).type), "control": [r[0] for r in rows], "target": pa.array([r[1] for r in rows], pa.int32()), "bias": [r[2] for r in rows], "weights": pa.array([r[3] for r in rows], pa.list_(pa.float64()))})

    return draws.filter("part = -1").groupBy(key).applyInArrow(fit, schema)


def refit_decomposition(refits: DataFrame, rows: DataFrame, key: str, entity: str, vector: str, tolerance: float = 1e-10) -> DataFrame:
    """key, entity, target, coefficients, components, scaling, reference, total: a draw's change of a prediction in four ordered parts.

    From the base fit to a refit of coefficients on fixed geometry, of components on the fixed scaler, of all, and to the draw's own
    reference. The parts add up to the whole change within ``tolerance``, or it is an error. Weights are draws by controls by features: they are broadcast.
    """
    made = rows.select(entity, F.col(vector).cast("array<double>").alias("__v")).join(F.broadcast(refits))
    wide = made.groupBy(key, entity, "target").pivot("control", ["base", *CONTROLS]).agg(F.first(F.col("bias") + linalg.dot(F.col("__v"), F.col("weights"))))
    steps = ["base", "fixed_geometry", "fixed_scaler", "full_common", "full_local"]
    parts = {n: F.col(b) - F.col(a) for n, a, b in zip(("coefficients", "components", "scaling", "reference"), steps, steps[1:])}
    found = wide.withColumns(parts | {"total": F.col("full_local") - F.col("base")})
    miss = F.abs(reduce(Column.__add__, [F.col(n) for n in parts]) - F.col("total"))
    sure = F.when(miss <= tolerance * F.greatest(F.lit(1.0), F.abs("total")), F.col("total")).otherwise(F.raise_error(F.lit("the parts of a refit do not add up")).cast("double"))
    return found.select(key, entity, "target", *parts, sure.alias("total"))


def domain_bounds(cells: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """key, column, low, high, n: the range of each column over the rows of all other keys, from one pass of ranges by key.

    Missing values are no part of a range. A column that no other key has is at NULL.
    """
    own = cells.groupBy(key, column).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__k"))
    every = Window.partitionBy(column)  # a row a key
    before, after = every.orderBy(key).rowsBetween(Window.unboundedPreceding, -1), every.orderBy(key).rowsBetween(1, Window.unboundedFollowing)
    low = F.least(F.min("__lo").over(before), F.min("__lo").over(after))
    high = F.greatest(F.max("__hi").over(before), F.max("__hi").over(after))
    return own.select(key, column, low.alias("low"), high.alias("high"), (F.sum("__k").over(every) - F.col("__k")).alias("n"))


def outside_bounds(cells: DataFrame, bounds: DataFrame, key: str, entity: str, column: str, value: str) -> DataFrame:
    """key, entity, n, missing, outside, excess: the share of columns without a value, of those beyond their range, and the largest distance beyond it in ranges."""
    rows = cells.join(bounds, [key, column])
    v, low, high = F.col(value), F.col("low"), F.col("high")
    off = F.greatest(low - v, v - high, F.lit(0.0)) / F.when(high > low, high - low)
    return rows.groupBy(key, entity).agg(F.count("*").alias("n"), F.avg(v.isNull().cast("double")).alias("missing"), F.coalesce(F.avg(((v < low) | (v > high)).cast("double")), F.lit(0.0)).alias("outside"), F.coalesce(F.max(off), F.lit(0.0)).alias("excess"))
