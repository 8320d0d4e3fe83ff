"""Module search with a reward of whole sets: cross-validated gain of ridge over nuisance columns.

What a set of genes is worth is not the sum of its genes' worths, so sets are scored as sets. A fold's products of
all genes' columns are summed once (``estimators``' states), nuisance columns leave them by a Schur complement, and
a set's score takes its own rows and columns of these products: no set reads the data. All searches of all draws
grow in one plan, a step scores the sets of all its states in one job, and a memo table keyed by draw
and sorted set keeps scores, so no set is scored twice.
"""

from __future__ import annotations

import zlib
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_key
from ..sources.publish import staged
from . import linalg
from .graph import moves
from .ranking import placed
from .resample import numbered, repeated


def partialled(train: linalg._STATE, held: linalg._STATE, q: int, alpha: float, scaled: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Products of training and held-out rows of all columns after the first ``q`` once these nuisance columns are taken out, and the last column's held-out sum of squares before that.

    Columns are scaled on the training rows (one without spread becomes 0), the intercept is not penalised, nuisance
    is with ``alpha``: a penalised fit of the rest on the rest is then the joint fit's part. Held-out products are about the training mean.
    """
    n, mean, cross = train
    sd = np.sqrt(np.maximum(np.diag(cross), 0) / max(n, 1)) if scaled else np.ones(len(mean))
    turn = np.where(sd > 1e-8, 1 / np.where(sd > 1e-8, sd, 1), 0.0)
    g = cross * np.outer(turn, turn)
    off = (held[1] - mean) * turn
    h = held[2] * np.outer(turn, turn) + held[0] * np.outer(off, off)
    b = np.linalg.solve(g[:q, :q] + alpha * np.eye(q), g[:q, q:]) if q else np.zeros((0, len(mean) - q))
    rest = g[q:, q:] - g[q:, :q] @ b
    moved = np.vstack([-b, np.eye(len(mean) - q)])
    return (rest + rest.T) / 2, moved.T @ h @ moved, float(h[-1, -1])


def partial_fits(states: DataFrame, key: str, q: int, n_targets: int, alpha: float) -> DataFrame:
    """key, column, target, weight: ridge on what nuisance columns (the first ``q``) leave, on raw scale."""
    schema = f"{key} {dict(states.dtypes)[key]}, column int, target int, weight double"

    def fit(group: pa.Table) -> pa.Table:
        state = linalg._states(group.filter(pa.compute.equal(group.column("part"), -1)), [("part", "ascending")])[0]
        rest, _, _ = partialled(state, (0.0, state[1], np.zeros(state[2].shape)), q, alpha, scaled=False)
        p = len(rest) - n_targets
        w = np.linalg.solve(rest[:p, :p] + alpha * np.eye(p), rest[:p, p:])
        at = [(i, t) for i in range(p) for t in range(n_targets)]
        return pa.table({key: pa.array([group.column(key)[0].as_py()] * len(at), group.column(key).type), "column": pa.array([i for i, _ in at], pa.int32()), "target": pa.array([t for _, t in at], pa.int32()), "weight": [float(w[i, t]) for i, t in at]})

    return states.groupBy(key).applyInArrow(fit, schema)


def shuffled(rows: DataFrame, entity: str, context: str, values: list[str], draws: int, seed: str) -> DataFrame:
    """``rows`` once a draw: draw 0 as they are, in every other each row has the values of a donor of its context, a bijection in hash order.

    A context may hold any share of the rows: places are counted inside ranges of hashes, not by sorting a context in one task.
    """
    lot = lambda *parts: F.conv(F.substring(hash_key(*parts), 1, 12), 16, 10).cast("double")
    keys = repeated(rows.select(entity, context), entity, F.col("id").cast("int"), 1, draws + 1) if draws else None
    plain = rows.withColumn("draw", F.lit(0))
    if keys is None:
        return plain
    a = placed(keys.withColumn("__lot", lot(F.lit(f"{seed}/rows"), F.col("draw"), F.col(entity))), ["draw", context], "__lot", entity).select("draw", context, entity, "place")
    b = placed(keys.withColumn("__lot", lot(F.lit(f"{seed}/donors"), F.col("draw"), F.col(entity))), ["draw", context], "__lot", entity).select("draw", F.col(context).alias("__c"), F.col(entity).alias("__donor"), "place")
    given = a.join(b, (a["draw"] == b["draw"]) & a[context].eqNullSafe(F.col("__c")) & (a["place"] == b["place"])).select(a["draw"], a[entity], "__donor")
    taken = rows.select(F.col(entity).alias("__donor"), *values)
    return plain.unionByName(rows.drop(*values).join(given, entity).join(taken, "__donor").drop("__donor"))


def fold_products(rows: DataFrame, fold: str, vector: str, target: str, q: int, alpha: float) -> DataFrame:
    """draw, fold, columns, total, train, held: products of each fold without its nuisance columns, from rows with a ``draw``.

    ``vector`` holds ``q`` nuisance columns, then the genes' columns; the last row and column of products is the target's, ``total`` its held-out sum of squares about the training mean.
    """
    keyed = rows.withColumn("__key", F.concat_ws("|", F.lpad(F.col("draw").cast("string"), 9, "0"), F.col(fold).cast("string")))
    return _products(linalg.moments(keyed, "__key", vector, [target]), q, alpha)


def _products(states: DataFrame, q: int, alpha: float) -> DataFrame:
    """``fold_products`` from states by draw and fold."""
    states = states.filter("part = -1").withColumn("draw", F.split("__key", r"\|")[0].cast("int"))

    def apart(group: pa.Table) -> pa.Table:
        group = group.sort_by("__key")
        states, out = linalg._states(group, [("__key", "ascending")]), []
        for k, held in enumerate(states):
            train = reduce(linalg._merged, [s for i, s in enumerate(states) if i != k], None)
            if train is not None and train[0] >= 2:
                out.append((k, *partialled(train, held, q, alpha)))
        kind = pa.list_(pa.float64())
        return pa.table({"draw": pa.array([group.column("draw")[0].as_py()] * len(out), pa.int32()), "fold": pa.array([x[0] for x in out], pa.int32()), "columns": pa.array([len(x[1]) for x in out], pa.int32()), "total": pa.array([x[3] for x in out], pa.float64()), "train": pa.array([x[1].ravel() for x in out], kind), "held": pa.array([x[2].ravel() for x in out], kind)})

    # a draw's folds: columns squared, whatever the number of rows
    return states.groupBy("draw").applyInArrow(apart, "draw int, fold int, columns int, total double, train array<double>, held array<double>")


def _lots(seed: str, side: str, draw: int, keys: list[bytes]) -> np.ndarray:
    """The first 48 bits of ``hash_key`` of seed and side, draw and key."""
    start, out = f"{seed}/{side}|{draw}|".encode(), np.zeros((len(keys), 8), np.uint8)
    out[:, 2:] = np.frombuffer(b"".join([sha256(start + k).digest() for k in keys]), np.uint8).reshape(-1, 32)[:, :6]
    return out.view(">u8")[:, 0].astype(np.int64)


def shuffled_products(rows: DataFrame, entity: str, context: str, fold: str, kept: str, values: str, target: str, draws: int, seed: str, q: int, alpha: float, most: int = 1 << 21, block: int = 1 << 15) -> DataFrame:
    """``fold_products`` of ``shuffled`` rows, with ``kept`` and then ``values`` for a vector; no row of a draw is ever made.

    ``entity`` is a key. Hashes meet packed, a group for each draw and context; what a row keeps goes from there to the
    block its donor is in, which adds up products by draw and fold, so values never travel with a draw. A context of more
    than ``most`` rows is cut by place: hashes are counted in bins first, and a bin on a cut goes to both sides.
    """
    keyed = rows.select("*", F.concat_ws("|", F.lit("000000000"), F.col(fold).cast("string")).alias("__key"), F.concat(kept, values).alias("__v"))
    plain = linalg.moments(keyed, "__key", "__v", [target])
    if not draws:
        return _products(plain, q, alpha)
    tails = sorted(r[0] for r in keyed.select(F.substr("__key", F.lit(10))).distinct().collect())  # a row a fold
    code = (F.array_position(F.array(*[F.lit(t) for t in tails]), F.substr("__key", F.lit(10))) - 1).cast("int")
    own = keyed.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("__e"), F.col(context).alias("__ctx"), code.alias("__fold"), F.concat(F.col(kept).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("__given"), F.col(values).cast("array<double>").alias("__x"))
    own = staged(numbered(own, ["__ctx"], "__e"), "numbered")
    kind = own.schema["__ctx"].dataType
    dealt = own.select(F.col("__e").cast("string").alias("__e"), "__ctx", "__pos", "__fold", "__given")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, many = dealt.repartition(n, "__e"), max(n, draws)
    sizes = {r[0]: r[1] for r in own.filter(f"__pos = 0 AND __size > {most}").select("__ctx", "__size").collect()}  # contexts of more than ``most`` rows
    width, before = {c: -(-m // -(-m // most)) for c, m in sizes.items()}, {}
    bins = {c: 16 * -(-m // width[c]) for c, m in sizes.items()}
    lot, sides = [("high", "<u4"), ("low", "<u2"), ("pos", "<i4")], ("rows", "donors")

    def hashed(batches):
        """Batch, its rows by context, draw, side and hashes."""
        for batch in batches:
            if batch.num_rows:
                codes = batch.column("__ctx").dictionary_encode("encode")
                at = codes.indices.to_numpy()
                groups = [(c, np.flatnonzero(at == k)) for k, c in enumerate(codes.dictionary.to_pylist())]
                keys = [k.encode() for k in batch.column("__e").to_pylist()]
                for draw in range(1, draws + 1):
                    for side in (0, 1):
                        yield batch, groups, draw, side, _lots(seed, sides[side], draw, keys)

    def counted(batches):
        for batch, groups, draw, side, lots in hashed(batches):
            for c, at in groups:
                if c in bins:
                    k, m = np.unique(lots[at] * bins[c] >> 48, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(k), batch.column("__ctx").type), pa.array([draw] * len(k), pa.int32()), pa.array([side] * len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(m)], names=["c", "draw", "side", "bin", "n"])

    if sizes:
        kinds = T.StructType([T.StructField("c", kind), *[T.StructField(x, T.IntegerType()) for x in ("draw", "side", "bin")], T.StructField("n", T.LongType())])
        counts = dealt.join(F.broadcast(own.filter(f"__pos = 0 AND __size > {most}").select(F.col("__ctx").alias("__big"))), F.col("__ctx").eqNullSafe(F.col("__big")), "left_semi").mapInArrow(counted, kinds)
        for r in counts.groupBy("c", "draw", "side", "bin").agg(F.sum("n").alias("n")).toLocalIterator():  # 16 bins for ``most`` rows of a draw
            before.setdefault((r["c"], r["draw"], r["side"]), np.zeros(bins[r["c"]] + 1, np.int64))[r["bin"] + 1] = r["n"]
        before = {k: np.cumsum(x) for k, x in before.items()}

    def packed(batches):
        for batch, groups, draw, side, lots in hashed(batches):
            given = batch.column("__given").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            made = np.zeros(batch.num_rows, lot if side else [*lot, ("fold", "<i2"), ("given", "<f8", given.shape[1:])])
            made["high"], made["low"], made["pos"] = lots >> 16, lots & 0xFFFF, batch.column("__pos").to_numpy()
            if not side:
                made["fold"], made["given"] = batch.column("__fold").to_numpy(), given
            out = []
            for c, at in groups:
                part = np.zeros(len(at), int)
                if c in bins:
                    first = before[c, draw, side]
                    k = lots[at] * bins[c] >> 48
                    low, times = first[k] // width[c], (first[k + 1] - 1) // width[c] - first[k] // width[c] + 1
                    at = np.repeat(at, times)
                    part = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(at))
                out += [(c, int(p), made[at[part == p]].tobytes()) for p in np.unique(part)]
            yield pa.RecordBatch.from_arrays([pa.array([draw] * len(out), pa.int32()), pa.array([c for c, _, _ in out], batch.column("__ctx").type), pa.array([p for _, p, _ in out], pa.int32()), pa.array([side] * len(out), pa.int32()), pa.array([b for _, _, b in out], pa.binary()), pa.array([given.shape[1]] * len(out), pa.int32())], names=["draw", "__ctx", "__part", "side", "packed", "m"])

    def paired(group: pa.Table) -> pa.Table:
        draw, c, part, m = (group.column(x)[0].as_py() for x in ("draw", "__ctx", "__part", "m"))
        met = []
        for side in (0, 1):
            found = group.filter(pa.compute.equal(group.column("side"), side)).column("packed").to_pylist()
            x = np.frombuffer(b"".join(found), lot if side else [*lot, ("fold", "<i2"), ("given", "<f8", (m,))])
            x = x[np.lexsort((x["pos"], x["low"], x["high"]))]
            if c in width:
                first, low = before[c, draw, side], part * width[c]
                start = first[np.searchsorted(first, low, side="right") - 1]
                x = x[low - start : low - start + min(width[c], sizes[c] - low)]
            met.append(x)
        to = met[1]["pos"]
        made = np.zeros(len(to), [("at", "<u2"), ("fold", "<i2"), ("given", "<f8", (m,))])
        made["at"], made["fold"], made["given"] = to % block, met[0]["fold"], met[0]["given"]
        blocks = np.unique(to // block)
        return pa.table([pa.array([c] * len(blocks), group.column("__ctx").type), pa.array(blocks, pa.int32()), pa.array([draw] * len(blocks), pa.int32()), pa.array([made[to // block == b].tobytes() for b in blocks], pa.binary())], names=["__ctx", "__b", "draw", "packed"])

    def summed(sent: pa.Table, values: pa.Table) -> pa.Table:
        values = values.sort_by("__at")
        x = values.column("__x").combine_chunks()
        lengths = set(np.diff(x.offsets.to_numpy()).tolist())
        if x.null_count or len(lengths) > 1:
            raise ValueError("a vector is NULL or has another length than the others")
        x, states = x.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1), {}
        for draw, packed in zip(sent.column("draw").to_pylist(), sent.column("packed")):
            m = values.column("__m")[0].as_py()
            e = np.frombuffer(packed.as_buffer(), [("at", "<u2"), ("fold", "<i2"), ("given", "<f8", (m,))])
            for k in np.unique(e["fold"]):
                own = e[e["fold"] == k]
                own = own[~np.isnan(own["given"][:, -1])]
                z = np.hstack([own["given"][:, :-1], x[own["at"]], own["given"][:, -1:]])
                if np.isnan(z).any():
                    raise ValueError("a vector holds a missing value")
                if len(z):
                    key = f"{draw:09d}{tails[k]}"
                    states[key] = linalg._merged(states.get(key), linalg._state(z, np.ones(len(z))))
        piece = zlib.crc32(repr((values.column("__ctx")[0].as_py(), values.column("__b")[0].as_py())).encode()) >> 1
        lists = pa.list_(pa.float64())
        return pa.table({"__key": pa.array(list(states), pa.string()), "part": pa.array([-1] * len(states), pa.int32()), "n": pa.array([s[0] for s in states.values()], pa.float64()), "mean": pa.array([s[1] for s in states.values()], lists), "cross": pa.array([s[2].ravel() for s in states.values()], lists), "piece": pa.array([piece] * len(states), pa.int32())})

    binary = lambda *x: T.StructType([T.StructField(c, {"__ctx": kind, "packed": T.BinaryType()}.get(c, T.IntegerType())) for c in x])
    hashes = dealt.mapInArrow(packed, binary("draw", "__ctx", "__part", "side", "packed", "m")).repartition(many, "draw", "__ctx", "__part")
    sent = hashes.groupBy("draw", "__ctx", "__part").applyInArrow(paired, binary("__ctx", "__b", "draw", "packed"))
    values = own.select("__ctx", F.floor(F.col("__pos") / block).cast("int").alias("__b"), (F.col("__pos") % block).alias("__at"), "__x", F.size("__given").alias("__m"))
    pieces = sent.groupBy("__ctx", "__b").cogroup(values.groupBy("__ctx", "__b")).applyInArrow(summed, "__key string, part int, n double, mean array<double>, cross array<double>, piece int")
    return _products(plain.unionByName(linalg.added_states(pieces, "__key")), q, alpha)


def set_rewards(sets: DataFrame, products: DataFrame, names: list[str], width: int, alpha: float) -> DataFrame:
    """draw, members, reward: how much of the held-out sum of squares a set's columns explain beyond nuisance, over all folds.

    ``names`` are the genes in the order of their columns, ``width`` columns each; the empty set gives 0.
    """

    def score(own: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("draw", pa.int32()), ("members", pa.list_(pa.string())), ("reward", pa.float64())])
        if not own.num_rows or not asked.num_rows:
            return schema.empty_table()
        own, at = own.sort_by("fold"), {name: k for k, name in enumerate(names)}
        folds = [tuple(np.asarray(own.column(c)[k].values, float).reshape(m, m) for c in ("train", "held")) for k, m in enumerate(own.column("columns").to_pylist())]
        total, out = sum(own.column("total").to_pylist()), []
        for members in asked.column("members").to_pylist():
            columns = np.array([at[m] * width + j for m in sorted(members, key=at.__getitem__) for j in range(width)], int)
            left = 0.0
            for g, h in folds:
                beta = np.linalg.solve(g[np.ix_(columns, columns)] + alpha * np.eye(len(columns)), g[columns, -1])
                left += 2 * beta @ h[columns, -1] - beta @ h[np.ix_(columns, columns)] @ beta
            out.append(round(float(left / max(total, 1e-12)), 12))
        return pa.table([pa.array([own.column("draw")[0].as_py()] * len(out), pa.int32()), asked.column("members").combine_chunks(), pa.array(out, pa.float64())], schema=schema)

    return products.groupBy("draw").cogroup(sets.groupBy("draw")).applyInArrow(score, "draw int, members array<string>, reward double")


def search(edges: DataFrame, genes: DataFrame, products: DataFrame, names: list[str], width: int, alpha: float, budget: int, penalty: float, beam: int, ranked: dict[str, str] | None = None, seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Greedy, beam and fixed-priority searches of every draw, and the memo of all sets that were scored.

    ``genes`` has a column gene and one for each entry of ``ranked`` (method name: column of distinct places, or
    ``reward`` for the order of single genes' rewards). A state is chosen genes and connected nodes: a gene
    joins if it is a node, has an edge to one, or shares a neighbour with one, which then comes along. Its objective is
    the reward of what is chosen less ``penalty`` a node. Greedy takes the best state and stops when that is no gain; the beam keeps the
    ``beam`` first; a ranked search adds the first gene that may join; of a beam's or ranked search's states the first of the highest
    objective is the result. ``seed`` is a gene that all begin with. One row a draw and method: draw, method, chosen, nodes, objective, reward; no
    row if nothing is worth more than the empty state.
    """
    ranked = ranked or {}
    methods = ["greedy", "beam", *ranked]
    draws = products.select("draw").distinct()
    single = staged(draws.crossJoin(F.broadcast(genes.select(F.array("gene").alias("members")))), "sets")  # draws by genes: the first step's sets
    memo = staged(set_rewards(single, products, names, width, alpha), "memo")
    order = memo.select("draw", F.get("members", F.lit(0)).alias("__gene"), "reward")
    by_reward = order.withColumn("__r", F.row_number().over(Window.partitionBy("draw").orderBy(F.desc("reward"), "__gene")).cast("long")).select("draw", "__gene", "__r")
    places = None
    for method, column in ranked.items():
        own = by_reward.withColumnRenamed("__r", "__place") if column == "reward" else draws.join(F.broadcast(genes.select(F.col("gene").alias("__gene"), F.col(column).cast("long").alias("__place"))))  # draws by genes
        own = own.select("draw", "__gene", "__place", F.lit(method).alias("method"))
        places = own if places is None else places.unionByName(own)
    if places is not None:
        places = staged(places, "places")
    worths = genes.select("gene", F.lit(0).alias("worth"))
    state = F.struct("chosen", "nodes", "objective")
    empty = F.struct(F.array().cast("array<string>").alias("chosen"), F.array().cast("array<string>").alias("nodes"), F.lit(0.0).alias("objective"))
    start = draws.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    made = start.join(F.broadcast(genes.filter(F.col("gene") == seed) if seed is not None else genes), how="inner").select("draw", "method", empty.alias("before"), F.col("gene").alias("__gene"), F.array("gene").alias("chosen"), F.array("gene").alias("nodes"))
    best = start.withColumn("best", empty)
    for step in range(budget):
        if places is not None:
            # of a ranked search's moves the first by place is the only one
            row = Window.partitionBy("draw", "method").orderBy("__place")
            first = made.join(places, ["draw", "method", "__gene"]).withColumn("__n", F.row_number().over(row)).filter("__n = 1").drop("__n", "__place")
            made = made.filter(F.col("method").isin("greedy", "beam")).unionByName(first)
        made = staged(made.drop("__gene").distinct(), "moves")
        fresh = made.select("draw", F.col("chosen").alias("members")).distinct().join(memo, ["draw", "members"], "left_anti")
        memo = staged(memo.unionByName(set_rewards(fresh, products, names, width, alpha)), "memo")
        scored = made.join(memo.withColumnRenamed("members", "chosen"), ["draw", "chosen"]).withColumn("objective", F.round(F.col("reward") - penalty * F.size("nodes"), 12))
        by = Window.partitionBy("draw", "method")
        up, down = by.orderBy(F.desc("objective"), "chosen", "nodes"), by.orderBy(F.desc("objective"), F.desc("chosen"), F.desc("nodes"))
        scored = scored.dropDuplicates(["draw", "method", "chosen", "nodes"]) if step else scored
        scored = scored.withColumn("__n", F.when(F.col("method") == "greedy", F.row_number().over(down)).otherwise(F.row_number().over(up)))
        gains = (F.col("method") != "greedy") | (F.col("objective") > F.col("before.objective"))
        live = scored.filter((F.col("__n") <= F.when(F.col("method") == "beam", beam).otherwise(1)) & gains)
        live = staged(live.select("draw", "method", "chosen", "nodes", "objective", "__n"), "live")
        top = live.filter("__n = 1").select("draw", "method", state.alias("top"))
        # a row a draw and method; what it reads is staged
        best = best.join(top, ["draw", "method"], "left").select("draw", "method", F.when(F.col("top.objective") > F.col("best.objective"), F.col("top")).otherwise(F.col("best")).alias("best"))
        if step + 1 == budget or live.isEmpty():
            break
        grown = moves(live.select("draw", "method", "chosen", "nodes", "objective"), edges, worths, "gene", "worth", budget)
        made = grown.select("draw", "method", state.alias("before"), "__gene", F.sort_array(F.array_append("chosen", F.col("__gene"))).alias("chosen"), F.col("__nodes").alias("nodes"))
    found = best.select("draw", "method", "best.*").filter(F.size("chosen") > 0)
    return found.join(memo.withColumnRenamed("members", "chosen"), ["draw", "chosen"]).select("draw", "method", "chosen", "nodes", "objective", "reward"), memo


def null_comparison(found: DataFrame, draws: int) -> DataFrame:
    """method, reward, nodes, n_draws, null_mean, null_best, n_reached: draw 0 beside the searches of ``draws`` shuffled ones.

    A draw whose search found nothing counts with reward 0. Descriptive: how often a null search gets as far, no p-value.
    """
    own = found.filter("draw = 0").select("method", "reward", F.size("nodes").alias("nodes"))
    null = found.filter("draw > 0").select("method", F.col("reward").alias("__null"))
    rows = own.join(null, "method", "left").groupBy("method", "reward", "nodes").agg(F.coalesce(F.sum("__null"), F.lit(0.0)).alias("s"), F.coalesce(F.max("__null"), F.lit(0.0)).alias("m"), F.count_if(F.col("__null") >= F.col("reward")).alias("n_reached"), F.count("__null").alias("k"))
    best = F.when(F.col("k") < draws, F.greatest("m", F.lit(0.0))).otherwise(F.col("m"))
    return rows.select("method", "reward", "nodes", F.lit(draws).alias("n_draws"), (F.col("s") / draws).alias("null_mean"), best.alias("null_best"), "n_reached")
