"""Undirected graphs as edge tables, and budgeted module search."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linalg import _block_products


def canonical_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """src < dst, each edge once, without loops."""
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Number of neighbours of each node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def bridges(edges: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest common neighbour of each pair, and how many there are."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    x, y = both.select(F.col("src").alias(a), F.col("dst").alias("__via")), both.select(F.col("src").alias(b), F.col("dst").alias("__via"))
    return pairs.join(x, a).join(y, [b, "__via"]).groupBy(a, b).agg(F.min("__via").alias("bridge"), F.count_distinct("__via").alias("n_bridges"))


def neighbours(edges: list[tuple[str, str]]) -> dict[str, set[str]]:
    """Adjacency of a small graph."""
    out: dict[str, set[str]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def beam_search(adjacent: dict[str, set[str]], reward: Callable[[frozenset], float], budget: int, width: int = 1, penalty: float = 0.0) -> tuple[list[str], float]:
    """The best connected node set of at most ``budget`` nodes that a beam of ``width`` finds; width 1 is greedy.

    For graphs of candidate nodes, which are small. A set's worth is its reward less ``penalty`` a node; ties
    go to the smaller set in order of names.
    """
    worth: dict[frozenset, float] = {}

    def of(s: frozenset) -> float:
        if s not in worth:
            worth[s] = reward(s) - penalty * len(s)
        return worth[s]

    order = lambda s: (-of(s), sorted(s))
    beam = sorted((frozenset([n]) for n in adjacent), key=order)[:width]
    best = beam[0] if beam else frozenset()
    for _ in range(budget - 1):
        grown = {s | {n} for s in beam for m in s for n in adjacent[m] - s}
        if not grown:
            break
        beam = sorted(grown, key=order)[:width]
        if order(beam[0]) < order(best):
            best = beam[0]
    return sorted(best), of(best) if best else 0.0


def non_additivity(pair_gain: float, one: float, two: float) -> float:
    """What a pair brings beyond its members."""
    return pair_gain - one - two


def random_modules(adjacent: dict[str, set[str]], size: int, n: int, seed: str) -> list[list[str]]:
    """Connected control sets of a size, grown from hashed choices, for graphs of candidate nodes."""
    from hashlib import sha256

    out = []
    names = sorted(adjacent)
    for i in range(n):
        pick = lambda options, step: min(options, key=lambda x: sha256(f"{seed}|{i}|{step}|{x}".encode()).hexdigest())
        chosen = {pick(names, 0)}
        while len(chosen) < size:
            edge = sorted({m for c in chosen for m in adjacent[c]} - chosen)
            if not edge:
                break
            chosen.add(pick(edge, len(chosen)))
        out.append(sorted(chosen))
    return out


def shared_key_edges(df: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Canonical edges between nodes that have a key in common; ``df`` is brought to distinct keys first."""
    have = df.select(node, *keys).distinct()
    return canonical_edges(have.withColumnRenamed(node, "__a").join(have.withColumnRenamed(node, "__b"), keys), "__a", "__b")


def _steps(edges: DataFrame) -> DataFrame:
    """__from, __to of each edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("__from"), F.col("dst").alias("__to")), F.struct(F.col("dst").alias("__from"), F.col("src").alias("__to")))).alias("e")).select("e.*")


def beam_modules(edges: DataFrame, worths: DataFrame, node: str, worth: str, budget: int, width: int, penalty: int) -> DataFrame:
    """members, worth: what ``beam_search`` finds, as joins of states with edges.

    ``worths`` has a whole number for each node. A state is live, or the best of all earlier ones; each step
    keeps the ``width`` first live ones and the best one.
    """
    prices = worths.select(F.col(node).alias("__to"), (F.col(worth) - penalty).cast("long").alias("__gain"))
    moves = _steps(edges).join(prices, "__to")
    order = [F.desc("worth"), "members"]

    def first(states: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("live").orderBy(*order))
        return states.withColumn("__n", place).filter((F.col("__n") <= width) & (F.col("live") | (F.col("__n") == 1))).drop("__n")

    both = lambda members, worth: F.explode(F.array(*[F.struct(F.lit(live).alias("live"), members.alias("members"), worth.alias("worth")) for live in (True, False)]))
    states = first(prices.select(both(F.array("__to"), F.col("__gain")).alias("s")).select("s.*"))
    for _ in range(budget - 1):
        # the best one stays as it is; a live one grows by each neighbour of a member
        reached = states.withColumn("__from", F.explode("members")).join(moves, "__from", "left")
        grows = F.col("live") & F.col("__to").isNotNull() & ~F.array_contains("members", F.col("__to"))
        grown = F.when(grows, F.sort_array(F.concat("members", F.array("__to")))), F.when(grows, F.col("worth") + F.col("__gain"))
        made = reached.select("live", "members", "worth", *[c.alias(n) for c, n in zip(grown, ("__m", "__w"))])
        kept = F.when(~F.col("live"), F.array(F.struct("live", "members", "worth"))).when(F.col("__m").isNotNull(), F.array(*[F.struct(F.lit(live).alias("live"), F.col("__m").alias("members"), F.col("__w").alias("worth")) for live in (True, False)]))
        states = first(made.select(F.explode(kept).alias("s")).select("s.*").distinct())
    return states.filter(~F.col("live")).select("members", "worth")


def random_growth(edges: DataFrame, nodes: DataFrame, node: str, size: int, n: int, seed: str) -> DataFrame:
    """draw, members: what ``random_modules`` grows, as joins of draws with edges."""
    moves = _steps(edges)
    lot = lambda step, x: F.sha2(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.lit(str(step)), x), 256)
    drawn = nodes.select(F.col(node).alias("__to")).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    grown = drawn.groupBy("draw").agg(F.array(F.min_by("__to", lot(0, F.col("__to")))).alias("members"))
    for step in range(1, size):
        reached = grown.withColumn("__from", F.explode("members")).join(moves, "__from", "left")
        open_ = F.when(~F.array_contains("members", F.col("__to")), F.col("__to"))
        chosen = reached.select("draw", "members", open_.alias("__to")).groupBy("draw", "members").agg(F.min_by("__to", F.when(F.col("__to").isNotNull(), lot(step, F.col("__to")))).alias("__to"))
        grown = chosen.select("draw", F.when(F.col("__to").isNull(), F.col("members")).otherwise(F.concat("members", F.array("__to"))).alias("members"))
    return grown.select("draw", F.sort_array("members").alias("members"))


def _joining(columns: list[str], states: pa.StructArray, genes: pa.StructArray) -> pa.RecordBatch:
    """The states' columns, __gene, __bridge and __gain of all genes of one block that may join states of another.

    Neighbours in common are bits, 64 names at a time in the order of names, so the lowest common bit is the first bridge.
    """
    lists = [states.field("__near"), genes.field("__near")]
    flat, who = [x.flatten() for x in lists], [np.repeat(np.arange(len(x)), np.asarray(x.value_lengths())) for x in lists]
    coded = pa.concat_arrays(flat).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary)).astype(np.int64)
    at = np.argsort(order)[np.asarray(coded.indices)]
    at = at[: len(flat[0])], at[len(flat[0]) :]
    both = np.intersect1d(*at)
    best = np.full((len(states), len(genes)), -1)
    for low in range(0, len(both), 64):
        words = []
        for names, owner, size in zip(at, who, best.shape):
            here = (names >= both[low]) & (names <= both[min(low + 64, len(both)) - 1]) & np.isin(names, both[low : low + 64])
            words.append(np.zeros(size, np.uint64))
            np.bitwise_or.at(words[-1], owner[here], np.uint64(1) << (np.searchsorted(both, names[here]) - low).astype(np.uint64))
        rows, other = (np.flatnonzero(w) for w in words)
        common, found = words[0][rows][:, None] & words[1][other], best[np.ix_(rows, other)]
        new = (found < 0) & (common != 0)
        lowest = common[new] & (~common[new] + np.uint64(1))
        found[new] = both[low + np.log2(lowest.astype(float)).astype(int)]
        best[np.ix_(rows, other)] = found
        if (best >= 0).all():
            break
    own = genes.field("__gene").dictionary_encode()

    def marked(lists: pa.ListArray) -> np.ndarray:
        place = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), own.dictionary), -1))
        out = np.zeros((len(lists), len(own.dictionary)), bool)
        out[np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))[place >= 0], place[place >= 0]] = True
        return out[:, np.asarray(own.indices)]

    best[marked(states.field("__near")) | marked(states.field("nodes"))] = -2  # these need no bridge
    best[marked(states.field("chosen"))] = -1
    i, j = np.nonzero(best != -1)
    code = best[i, j]
    bridge = coded.dictionary.take(pa.array(order[code] if len(order) else code, mask=code < 0))
    return pa.RecordBatch.from_arrays([*[states.field(c).take(pa.array(i)) for c in columns], genes.field("__gene").take(pa.array(j)), bridge, genes.field("__gain").take(pa.array(j))], names=[*columns, "__gene", "__bridge", "__gain"])


def moves(states: DataFrame, edges: DataFrame, genes: DataFrame, gene: str, worth: str, budget: int, alone: bool = False) -> DataFrame:
    """As ``extensions``; states that nothing joins have no row, or, with ``alone``, every state has one more row without a gene.

    States meet genes by blocks, each with the set of its neighbours: paths over a neighbour that many have are not rows.
    """
    steps, columns = _steps(edges), states.columns
    near = F.collect_set("__to").alias("__near")  # a state's or gene's neighbours
    from_ = states.withColumn("__from", F.explode("nodes")).join(steps, "__from", "left").groupBy(*columns).agg(near)
    to = genes.select(F.col(gene).alias("__gene"), F.col(worth).cast("long").alias("__gain")).dropna()
    to = to.join(steps, F.col("__gene") == F.col("__from"), "left").groupBy("__gene", "__gain").agg(near)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in states.schema], *[T.StructField(c, to.schema["__gene"].dataType) for c in ("__gene", "__bridge")], T.StructField("__gain", T.LongType())])

    def nothing(own: pa.StructArray) -> pa.RecordBatch:
        none = [pa.nulls(len(own), kind) for kind in (pa.string(), pa.string(), pa.int64())]
        return pa.RecordBatch.from_arrays([*[own.field(c) for c in columns], *none], names=schema.names)

    pair = lambda df: df.withColumn("__key", F.xxhash64("nodes" if "nodes" in df.columns else "__gene"))
    made = _block_products(pair(from_), pair(to), "__key", 256, partial(_joining, columns), schema, nothing if alone else None)
    made = made.withColumn("__nodes", F.sort_array(F.array_union("nodes", F.array_compact(F.array("__gene", "__bridge")))))
    fits = F.size("__nodes") <= budget
    return made.filter(fits | F.col("__gene").isNull()).select(*columns, "__gene", "__bridge", "__gain", "__nodes")


def extensions(states: DataFrame, edges: DataFrame, genes: DataFrame, gene: str, worth: str, budget: int) -> DataFrame:
    """Every state by every gene that may join it: the state's columns and __gene, __bridge, __nodes, __gain.

    A state has nodes (one at least) and chosen genes. A gene joins if it is a node already, has an edge to
    one, or has a neighbour in common with one: then the first such neighbour by name comes along as bridge.
    States of more than ``budget`` nodes are left out. A state that nothing joins has one row without a gene.
    """
    rows = moves(states, edges, genes, gene, worth, budget, alone=True)
    none = rows.groupBy(*states.columns).agg(F.collect_list(F.when(F.col("__gene").isNotNull(), F.struct("__gene", "__bridge", "__gain", "__nodes"))).alias("__made"))
    return none.select(*states.columns, F.explode_outer("__made").alias("m")).select(*states.columns, "m.*")


def transitions(states: DataFrame, edges: DataFrame, genes: DataFrame, gene: str, worth: str, budget: int, penalty: int) -> DataFrame:
    """The state's columns, action, bridge, reached and reward of all moves that a state allows.

    The reward is the gene's worth less ``penalty`` for each new node, so rewards along a way add up to the
    worth of its end; STOP leaves the state and gives nothing.
    """
    made = moves(states, edges, genes, gene, worth, budget)
    reward = F.col("__gain") - penalty * (F.size("__nodes") - F.size("nodes"))
    made = made.select(*states.columns, F.col("__gene").alias("action"), F.col("__bridge").alias("bridge"), F.col("__nodes").alias("reached"), reward.cast("long").alias("reward"))
    stop = states.select("*", F.lit("STOP").alias("action"), F.lit(None).cast("string").alias("bridge"), F.col("nodes").alias("reached"), F.lit(0).cast("long").alias("reward"))
    return made.unionByName(stop)


def ranked_prefix(edges: DataFrame, genes: DataFrame, gene: str, worth: str, place: str, budget: int, penalty: int, seed: str | None = None) -> DataFrame:
    """chosen, nodes and worth of the best prefix of a search by fixed priority; no row if none is worth more than 0.

    Each step adds the gene of the lowest ``place`` (all differ) that may join, whatever it is worth; of the
    states on the way the first of the highest worth is the result. ``seed`` is a gene that comes first.
    """
    by = genes.select(F.col(gene).alias("__gene"), F.col(place).alias("__place"))
    start = genes.filter(F.col(gene) == seed) if seed is not None else genes.orderBy(place).limit(1)
    worthy = F.col(worth).cast("long") - penalty
    states = start.select(F.array(gene).alias("chosen"), F.array(gene).alias("nodes"), worthy.alias("worth"))
    best = lambda: F.struct("chosen", "nodes", "worth")
    states = states.withColumn("best", best())
    for _ in range(budget - 1):
        made = extensions(states, edges, genes, gene, worth, budget).join(by, "__gene", "left")
        # one row a state, and there is one state
        made = made.groupBy(*states.columns).agg(F.min_by(F.struct("__gene", "__nodes", "__gain"), "__place").alias("m"))
        grown = F.col("m").isNotNull()
        worth_now = F.col("worth") + F.col("m.__gain") - penalty * (F.size("m.__nodes") - F.size("nodes"))
        made = made.select(F.when(grown, F.array_append("chosen", F.col("m.__gene"))).otherwise(F.col("chosen")).alias("chosen"), F.when(grown, F.col("m.__nodes")).otherwise(F.col("nodes")).alias("nodes"), F.when(grown, worth_now).otherwise(F.col("worth")).alias("worth"), "best")
        states = made.withColumn("best", F.when(F.col("worth") > F.col("best.worth"), best()).otherwise(F.col("best")))
    return states.select("best.*").filter("worth > 0")
