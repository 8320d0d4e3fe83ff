"""Ranked lexical search as a threshold-seeded join.

One pass over the texts keeps, for each row, how often it holds each term that any item asks for (the
forward index). A second pass over it keeps each term's best impacts: what the term adds to a score, at most
(top) and in its kth best row (kth). As impacts are never negative, an item's kth best score is at least
the greatest kth impact among its terms: the seed of its threshold. With an item's terms in order of their
top impacts, those whose tops add up to less than the threshold cannot lift a row over it alone (suffix
bounds): only rows with one of the other terms are candidates. Candidates are scored term by term, leave once
what is still to come cannot lift them to the threshold, and what stays has its exact score. Each task raises
thresholds by the best it has found; the best of all tasks meet in two steps.

Items are searched in parts of at most ``most_bytes`` of text, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .store import staged

#: How lengths enter, and the units of weights and of what a term's count makes of them.
BASE, BY_LENGTH, LENGTH, UNIT, COUNT = 50, 50, 20, 1_000_000_000, 1_000
#: What a term is, byte by byte: letters and digits of ASCII, lower-cased, and all that is not ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SALTS = 64


def term_blocks(text: str | None, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a whole text in UTF-8, those of about ``block`` bytes at a time; blocks end between terms."""
    folded, start = (text or "").encode("utf-8", "replace").translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + block)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def term_counts(text: str | None) -> Counter[bytes]:
    """Terms of a text with their numbers."""
    out: Counter[bytes] = Counter()
    for terms in term_blocks(text):
        out.update(terms)
    return out


def weight(rows: int, holding: int) -> int:
    """Of a term that ``holding`` of ``rows`` rows hold."""
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * holding + 1)))


def shares(tf: np.ndarray, n: np.ndarray, rows: int, terms: int) -> np.ndarray:
    """What weights are multiplied by, for terms that stand ``tf`` times in rows of ``n`` terms."""
    length = 100 - BASE + (BY_LENGTH * n * rows) // max(terms, 1)
    return (UNIT * tf) // (COUNT * tf + LENGTH * length)


class Items:
    """Some items: ids, and the numbers of their terms in one vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.terms = [np.array([self.number.setdefault(t, len(self.number)) for t in sorted(term_counts(text))], np.int64) for _, text in items]


def item_shards(items: DataFrame, item_id: str, text: str, most_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in lists of at most ``most_bytes`` of text (one longer item stands alone), fetched part by part."""
    part, size = [], 0
    for row in items.select(items[item_id], items[text]).toLocalIterator():
        more = len((row[1] or "").encode("utf-8", "replace"))
        if part and size + more > most_bytes:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += more
    if part:
        yield part


_HELD: dict[str, object] = {}


def _held(name: str, made):
    """What a worker makes once for all its tasks of one search."""
    if name not in _HELD:
        while len(_HELD) > 3:
            _HELD.pop(next(iter(_HELD)))
        _HELD[name] = made()
    return _HELD[name]


def forward_index(docs: DataFrame, doc_id: str, text: str, sent: Broadcast) -> DataFrame:
    """__id, n (terms with repeats), terms (numbers in the vocabulary, ascending) and tf of each row."""
    rows, name = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__text")), uuid.uuid4().hex
    schema = T.StructType([rows.schema.fields[0], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def count(batches):
        number = _held(name, lambda: sent.value)
        for batch in batches:
            sizes, ends, at, tf = [], [0], [], []
            for value in batch.column(1):
                n, found = 0, Counter()
                for terms in term_blocks(value.as_py()):
                    n += len(terms)
                    found.update(terms)
                places = sorted((number[t], c) for t, c in found.items() if t in number)
                sizes.append(n)
                at.extend(p for p, _ in places)
                tf.extend(c for _, c in places)
                ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (at, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=schema.names)

    return rows.mapInArrow(count, schema)


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths by row, and row, term and tf of each posting."""
    lengths, lists, tf = (batch.column(k) for k in (1, 2, 3))
    counts = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(batch.num_rows), counts)
    return lengths.to_numpy().astype(np.int64), rows, lists.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)


def _blocks(batches, rows: int = 4096, postings: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most ``rows`` rows and about ``postings`` postings."""
    for batch in batches:
        start = 0
        ends = batch.column(2).offsets.to_numpy()
        while start < batch.num_rows:
            end = min(start + rows, batch.num_rows, max(start + 1, int(np.searchsorted(ends, ends[start] + postings, "right")) - 1))
            yield batch.slice(start, end - start)
            start = end


def best_shares(index: DataFrame, rows: int, terms: int, k: int) -> DataFrame:
    """term, df (rows that hold it) and best (its k greatest shares, greatest first), from partial lists of tasks."""

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        df: Counter[int] = Counter()
        for batch in _blocks(batches):
            n, row, term, tf = _postings(batch)
            value = shares(tf, n[row], rows, terms)
            order = np.lexsort((-value, term))
            term, value = term[order], value[order]
            names, starts = np.unique(term, return_index=True)
            for t, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)]):
                df[t] += b - a
                old = held.get(t)
                new = value[a : min(b, a + k)]
                held[t] = new.copy() if old is None else -np.sort(-np.concatenate([old, new]))[:k]
        names = list(held)
        for start in range(0, len(names), 4096):
            part = names[start : start + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([df[t] for t in part], pa.int64()), pa.array([held[t].tolist() for t in part], pa.list_(pa.int64()))], names=["term", "df", "best"])

    merged = lambda frame, *by: frame.groupBy(*by).agg(F.sum("df").alias("df"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, k).alias("best"))
    salted = index.mapInArrow(partial, "term int, df long, best array<long>").withColumn("salt", F.spark_partition_id() % _SALTS)
    return merged(merged(salted, "term", "salt"), "term")


class Search:
    """Bounds of the items' terms, and the search in a block of the forward index."""

    def __init__(self, items: Items, rows: int, terms: int, stats: dict[int, tuple[int, int, int]], k: int):
        self.rows, self.terms, self.k = rows, terms, k
        size = len(items.number)
        self.weights, top, kth = (np.zeros(size, np.int64) for _ in range(3))
        for t, (df, first, last) in stats.items():
            self.weights[t] = w = weight(rows, df)
            top[t], kth[t] = w * first, w * last
        self.orders, self.rests, self.floors = [], [], []
        for own in items.terms:
            own = own[top[own] > 0]
            own = own[np.argsort(-top[own], kind="stable")]
            rest = np.append(np.cumsum(top[own][::-1])[::-1], 0)
            floor = max(1, int(kth[own].max(initial=0)))
            self.orders.append(own)
            self.rests.append(rest)
            self.floors.append(floor)

    def block(self, batch: pa.RecordBatch, floors: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item, rows of the block and their scores, all at least the item's floor."""
        n, row, term, tf = _postings(batch)
        value = shares(tf, n[row], self.rows, self.terms) * self.weights[term]
        order = np.argsort(term, kind="stable")
        row, value = row[order], value[order]
        ends = np.searchsorted(term[order], np.arange(len(self.weights) + 1)).tolist()
        score = np.zeros(batch.num_rows, np.int64)
        for item, (own, rest) in enumerate(zip(self.orders, self.rests)):
            floor = floors[item]
            if not len(own) or rest[0] < floor:
                continue
            score[:] = 0
            needed = int(np.searchsorted(-rest, -floor, "right"))  # terms after these cannot reach the floor by themselves
            for t in own[:needed].tolist():
                score[row[ends[t] : ends[t + 1]]] += value[ends[t] : ends[t + 1]]
            alive = score > 0
            if needed < len(own):
                alive &= score + rest[needed] >= floor
            for j, t in enumerate(own[needed:].tolist(), needed):
                if not alive.any():
                    break
                score[row[ends[t] : ends[t + 1]]] += value[ends[t] : ends[t + 1]]
                alive &= score + rest[j + 1] >= floor
            found = np.flatnonzero(alive & (score >= floor))
            if len(found):
                yield item, found, score[found]


def _first(i) -> tuple:
    """Ids in ascending order, nulls last."""
    return (i is None, i if i is not None else 0)


def _found(index: DataFrame, search: Broadcast, id_type: T.DataType) -> DataFrame:
    """Each task's best rows of each item: item (its number), score, doc_id."""
    name = uuid.uuid4().hex
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("doc_id", id_type)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        here: Search = _held(name, lambda: search.value)
        arrow, floors = to_arrow_schema(schema), list(here.floors)
        best: dict[int, list[tuple[int, object]]] = {}
        for batch in _blocks(batches):
            ids = batch.column(0)
            for item, rows, scores in here.block(batch, floors):
                if len(rows) > here.k:  # those below the kth score of the block go, ties at it stay until ids decide
                    least = np.partition(scores, -here.k)[-here.k]
                    rows, scores = rows[scores >= least], scores[scores >= least]
                held = best.get(item, []) + list(zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist()))
                held.sort(key=lambda x: (-x[0], _first(x[1])))
                best[item] = held[: here.k]
                if len(held) >= here.k:
                    floors[item] = max(floors[item], best[item][-1][0])
        items = [(item, *row) for item, rows in best.items() for row in rows]
        for start in range(0, len(items), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items[start : start + (1 << 14)]), arrow.types)], schema=arrow)

    return index.mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``k`` best rows with a score above 0.

    Equal scores go by ascending id, rows without an id last. Null and empty texts hold no term: such rows
    are in no result and do not count, such items have no result. Repeated rows are ranked each, repeated items
    answered each; an empty table on either side gives an empty result; further columns, whatever their names,
    are not read. Texts are counted whole, block by block.
    """
    spark, id_type = docs.sparkSession, docs.schema[doc_id].dataType
    out_schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    out = None
    for shard in item_shards(items, item_id, item_text, most_bytes):
        part = _shard(docs, doc_id, text, Items(shard), k, id_type, out_schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], out_schema) if out is None else out


def _shard(docs: DataFrame, doc_id: str, text: str, items: Items, k: int, id_type: T.DataType, out_schema: T.StructType) -> DataFrame:
    spark = docs.sparkSession
    index = staged(forward_index(docs, doc_id, text, spark.sparkContext.broadcast(items.number)), "lexical-index")
    rows, terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    impacts = staged(best_shares(index, rows, terms, k).select("term", "df", F.get("best", F.lit(0)).alias("top"), F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0)).alias("kth")), "lexical-impacts")
    stats = {r["term"]: (r["df"], r["top"], r["kth"]) for r in impacts.toLocalIterator()}  # at most as many as the shard has terms
    search = spark.sparkContext.broadcast(Search(items, rows, terms, stats, k))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = lambda frame, *by: frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    salted = _found(index, search, id_type).withColumn("salt", F.spark_partition_id() % _SALTS)
    ranked = best(best(salted, "item", "salt").drop("rank"), "item")
    names = spark.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("item", T.IntegerType()), out_schema["item_id"]]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
