"""SimHash near duplicates: fingerprints, exact links by tiles, components.

Of some bit blocks, fingerprints at most ``radius`` bits apart agree on all but ``radius``, so the bits of one
such choice of blocks (a band) and its value decide which fingerprints meet; the more fingerprints there are,
the more blocks they are cut into and the more bits a band has, so a value holds about as many of them at
any size. A crowded value is dealt to slices by population count, and slices whose counts differ beyond the radius never meet. Inside a task, slices are cut
into tiles in the order of the count, tile pairs beyond the radius are skipped, and the rest is compared
exactly with exclusive-or and bit counts. A task returns a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, kept, staged

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of lower-cased text; 0 without words.

    Words are cut at ASCII white space, A-Z are lowered, repeats count, fewer words than ``size`` make
    one shingle. A bit is set if more than half of the shingles' XXH64 have it.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        return digest(join(words), SEED)
    ones = np.zeros(64, np.int64)
    last = len(words) - size + 1
    for start in range(0, last, 1 << 14):
        stop = min(last, start + (1 << 14))
        shifted = [words[start + k : stop + k] for k in range(size)]
        hashes = np.fromiter([digest(x, SEED) for x in map(join, zip(*shifted))], np.uint64, stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > last, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """``keep`` and __fp (the fingerprint's 64 bits as a signed long) of every row. Null text has no words."""
    source = docs.select(*[docs[c] for c in kept(keep, ["__fp"])], docs[text].alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__fp", T.LongType())])

    def rows(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(made.view(np.int64))], names=schema.names)

    return source.mapInArrow(rows, schema)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        out = self.parent[x]
        while not np.array_equal(up := self.parent[out], out):
            out = up
        return out

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] and b[i] for all i."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def links(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 512) -> np.ndarray:
    """Pairs of a spanning forest of all links within ``left``, or between ``left`` and ``right``.

    Both hold distinct unsigned fingerprints. Tiles of a pair of slices are skipped if their population
    counts differ beyond ``radius``.
    """
    sides = []
    for values in (left, left if right is None else right):
        count = np.bitwise_count(values)
        order = np.lexsort((values, count))
        sides.append((values[order], count[order].astype(np.int64)))
    (a, count_a), (b, count_b) = sides
    shift = 0 if right is None else len(a)
    forest = Forest(shift + len(b))
    for i in range(0, len(a), tile):
        low, high = count_a[i] - radius, count_a[min(i + tile, len(a)) - 1] + radius
        start, stop = int(np.searchsorted(count_b, low, "left")), int(np.searchsorted(count_b, high, "right"))
        for j in range(max(start, i) if right is None else start, stop, tile):
            near = np.bitwise_count(a[i : i + tile, None] ^ b[None, j : min(j + tile, stop)]) <= radius
            x, y = np.nonzero(near)
            forest.link(x + i, y + j + shift)
    root = forest.roots(np.arange(len(forest.parent)))
    values = a if right is None else np.concatenate([a, b])
    apart = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([values[apart], values[root[apart]]], axis=1)


def bands(n: int, radius: int, group_rows: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Bands as lists of bit ranges (from, to), and how many of a band's leading bits make its value.

    With m blocks there is a band for each choice of m - radius of them: two fingerprints within the radius
    differ in ``radius`` blocks at most and agree on all of some band. The fewest blocks are taken whose bands
    have the bits that give a value about ``group_rows`` of ``n`` fingerprints.
    """
    wanted = max(0, round(math.log2(max(1, n / group_rows))))
    for m in range(radius + 1, 65):
        cuts = [64 * k // m for k in range(m + 1)]
        made = [[(cuts[k], cuts[k + 1]) for k in chosen] for chosen in combinations(range(m), m - radius)]
        if m == 64 or min(sum(b - a for a, b in ranges) for ranges in made) >= wanted:
            return made, min(wanted, min(sum(b - a for a, b in ranges) for ranges in made))
    raise AssertionError


def near_pairs(prints: DataFrame, radius: int = 3, slice_rows: int = 4096, group_rows: int = 1024) -> DataFrame:
    """a, b: links that connect what fingerprints (__fp, distinct) within ``radius`` bits connect.

    Counts by band, value and population count size the slices of values
    beyond ``slice_rows``, so no task compares more than about two slices however common a value is.
    """
    cut, taken = bands(prints.count(), radius, group_rows)

    def value(ranges: list[tuple[int, int]]) -> Column:
        """The leading ``taken`` bits of a band, those of its last range first."""
        made, left = F.lit(0).cast("long"), taken
        for low, high in reversed(ranges):
            n = min(left, high - low)
            if n:
                made = F.shiftleft(made, n).bitwiseOR(F.shiftrightunsigned("__fp", high - n).bitwiseAND(F.lit((1 << n) - 1)))
            left -= n
        return made

    rows = prints.select("__fp", F.bit_count("__fp").alias("pop"), F.explode(F.array(*[F.struct(F.lit(k).alias("band"), value(ranges).alias("value")) for k, ranges in enumerate(cut)])).alias("x")).select("__fp", "pop", "x.band", "x.value")
    key = ["band", "value"]
    counts = rows.groupBy(*key, "pop").agg(F.count("*").alias("n"))
    by_pop = Window.partitionBy(*key).orderBy("pop")  # at most 65 rows a value
    counts = counts.withColumn("before", F.sum("n").over(by_pop) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
    crowded = counts.filter(F.col("all") > slice_rows)
    # slices of a crowded value: a count's rows run over the slices that its places fall in
    spread = crowded.select(*key, "pop", "n", "before", F.floor(F.col("before") / slice_rows).alias("first"), F.floor((F.col("before") + F.col("n") - 1) / slice_rows).alias("last"))
    slices = spread.select(*key, "pop", F.explode(F.sequence("first", "last")).alias("slice")).groupBy(*key, "slice").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    other = slices.select(*key, F.col("slice").alias("with"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = slices.join(other, key).filter((F.col("low2") <= F.col("high") + radius) & (F.col("high2") >= F.col("low") - radius))
    meet = meet.groupBy(*key, "slice").agg(F.collect_list("with").alias("partners"))
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("__fp"), F.col("n"))) / slice_rows)
    single = counts.filter((F.col("all") > 1) & (F.col("all") <= slice_rows)).select(*key, "pop")
    few = rows.join(single, [*key, "pop"], "left_semi").select(*key, F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(False).alias("second"), "__fp")
    many = rows.join(spread, [*key, "pop"]).select(*key, place.alias("slice"), "__fp").join(meet, [*key, "slice"])
    many = many.select(*key, "slice", F.explode("partners").alias("with"), "__fp")
    many = many.select(*key, F.least("slice", "with").alias("one"), F.greatest("slice", "with").alias("two"), (F.col("slice") > F.col("with")).alias("second"), "__fp")

    def compare(group: pa.Table) -> pa.Table:
        values, second = group.column("__fp").to_numpy().view(np.uint64), group.column("second").to_numpy(zero_copy_only=False)
        same = group.column("one")[0] == group.column("two")[0]
        found = links(values, None, radius) if same else links(values[~second], values[second], radius)
        return pa.table({"a": found[:, 0].view(np.int64) if len(found) else pa.array([], pa.int64()), "b": found[:, 1].view(np.int64) if len(found) else pa.array([], pa.int64())})

    return few.unionByName(many).groupBy(*key, "one", "two").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) reaches, by alternating stars.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones;
    every node keeps a path to its component's smallest node. Ends when a round changes nothing.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        old, edges = edges, staged(small, "links")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        before = now


def near_duplicates(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", size: int = 3, radius: int = 3, root: bool = False) -> DataFrame:
    """``keep``, __fp and __component of each row: the smallest ``doc_id`` that links reach.

    Null ids are ignored when the smallest is taken (null only if a whole component has none). Repeated
    rows give repeated results. Texts without words all have fingerprint 0. An empty table gives an
    empty result. ``root``: __root too, the fingerprint that names the component, whatever its ids. Columns in ``keep`` must
    not be named __fp, __component or __root; further columns of the table, whatever their names, are not read.
    """
    columns = list(dict.fromkeys([*keep, doc_id]))
    rows = staged(fingerprints(docs, columns, text, size), "fingerprints")
    prints = staged(rows.groupBy("__fp").agg(F.min(doc_id).alias("__least")), "distinct-fingerprints")
    roots = components(near_pairs(prints.select("__fp"), radius))
    named = prints.join(roots, prints["__fp"] == roots["node"], "left").select("__fp", "__least", F.coalesce("root", "__fp").alias("__root"))
    least = named.groupBy("__root").agg(F.min("__least").alias("__component"))
    named = named.select("__fp", "__root").join(least, "__root").select("__fp", "__component", "__root")
    return rows.join(named, "__fp").select(*[rows[c] for c in keep], rows["__fp"], "__component", *["__root"] * root)


def hex_print(fp: str = "__fp"):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
