"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the words it holds, each also by its first letters (so inflected words share a weight),
pairs and triples of words in a row, and pairs of words with one or two between them: each once, however often it stands. Rates go
by coordinate, and an L1 penalty leaves most weights at zero, so the model that is broadcast is small.

Learning goes in rounds. The sample is dealt by a hash of the id into shards, each of which one task runs through in
a fixed order from the state of the round before; the driver adds the mean of what they have
changed, 12 bytes for each of 2 ** bits features at most, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import kept, staged

#: Odd multipliers of the hashes.
_BASE, _MIX = 0x9E3779B97F4A7C15, np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
PREFIXES = (4, 5, 6)
_TABLES: dict[str, np.ndarray] = {}


def _is_word() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    if "word" not in _TABLES:
        _TABLES["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _TABLES["word"]


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64."""
    found = _TABLES.get(str(base))
    if found is None or len(found) < size:
        found = np.full(max(size, 1 << 12), base, np.uint64)
        found[0] = 1
        _TABLES[str(base)] = found = np.multiply.accumulate(found)
    return found[:size]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased text in order, and of the beginnings of those that are longer.

    A stretch of characters hashes to a polynomial in its code points, taken from one running sum over the text.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    edge = np.flatnonzero(np.diff(_is_word()[codes], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(codes) + 1)
    of = lambda a, b: (sums[b] - sums[a]) * back[a]
    longer = [starts[ends - starts > n] for n in PREFIXES]
    return of(starts, ends), np.concatenate([(of(a, a + n) + np.uint64(n)) * _MIX[5] for n, a in zip(PREFIXES, longer)])


def text_blocks(text: str | None, block: int = 1 << 20) -> Iterator[str]:
    """A text in blocks of about ``block`` characters that end before white space, or after twice as many without any."""
    text, start = text or "", 0
    while start < len(text):
        end = start + block
        while end < min(len(text), start + 2 * block) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


def feature_blocks(text: str | None, bits: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Features of a whole text, with repeats; the last three words of a block go on into the next, so blocks change no set of features."""
    h = np.zeros(0, np.uint64)
    for part in text_blocks(text, block):
        words, starts = word_hashes(part)
        h = np.concatenate([h[-3:], words])
        made = [h * _MIX[0], starts]
        for gap in (1, 2, 3):
            if len(h) > gap:
                made.append((h[:-gap] ^ (h[gap:] * _MIX[gap])) * _MIX[0])
        if len(h) > 2:
            made.append(((h[:-2] ^ (h[1:-1] * _MIX[1])) * _MIX[4] ^ h[2:]) * _MIX[0])
        out = np.concatenate(made)
        out = (out ^ (out >> np.uint64(29))) * _MIX[1]
        yield (out >> np.uint64(64 - bits)).astype(np.int32)


def features(text: str | None, bits: int) -> np.ndarray:
    """The distinct features of a whole text, ascending."""
    found = np.zeros(0, np.int32)
    for part in feature_blocks(text, bits):
        found = np.unique(np.concatenate([found, part]))
    return found


def packed(found: np.ndarray, bits: int) -> bytes:
    """Ascending features as the count of each value of their upper bits, then their lower 16 bits: two bytes each."""
    counts = np.bincount(found >> 16, minlength=1 << max(0, bits - 16)).astype(np.uint32)
    return counts.tobytes() + (found & 0xFFFF).astype(np.uint16).tobytes()


def unpacked(held: bytes, bits: int) -> np.ndarray:
    """The features of ``packed``."""
    size = 1 << max(0, bits - 16)
    counts = np.frombuffer(held, np.uint32, size)
    return (np.repeat(np.arange(size, dtype=np.int32), counts) << 16) | np.frombuffer(held, np.uint16, offset=4 * size)


class Ftrl:
    """State of FTRL-proximal: z and n by feature, the bias last (it has no penalty)."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = (np.zeros((1 << bits) + 1) for _ in range(2))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        l1[-1] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, found: np.ndarray, label: int) -> None:
        at = np.append(found, 1 << self.bits)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bits: int, rows: int, shards: int, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """shard, place, label and packed features of about ``rows`` labelled rows (all, if fewer), taken by a hash of the id; a shard's rows in order of place.

    Of rows with one id and label, the one whose text has the smallest digest is taken; null labels and ids are not.
    """
    named = labels.select(labels[doc_id].alias("__id"), labels[label].cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)").distinct()
    hashed = lambda seed, column: F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30))
    rate = rows / max(rows, named.count())
    sample = named.filter(hashed("toxicity", F.col("__id")) < rate * (1 << 30))  # about ``rows`` rows of two numbers are broadcast
    found = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__text")).join(F.broadcast(sample), "__id")
    found = found.select("__id", "__label", F.md5(F.encode(F.coalesce("__text", F.lit("")), "utf-8")).alias("__digest"), "__text")
    one = found.groupBy("__id", "__label").agg(F.min_by("__text", "__digest").alias("text"))
    dealt = one.select((hashed("shard", F.col("__id")) % shards).cast("int").alias("shard"), hashed("place", F.col("__id")).alias("place"), F.col("__label").alias("label"), "text")
    # texts are shuffled, which are smaller than their features
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "place", "label")

    def made(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                held = [packed(features(value.as_py(), bits), bits) for value in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(held, pa.binary())], names=["shard", "place", "label", "features"])

    return dealt.mapInArrow(made, "shard int, place long, label int, features binary")


def trained(rows: DataFrame, bits: int, rounds: int, alpha: float, beta: float, l1: float, l2: float) -> Ftrl:
    """The state after some rounds over rows of ``training_rows``.

    Every task learns from the rows of a shard that it reads, starting from the state of the round before; states are averaged by rows.
    """
    spark, model = rows.sparkSession, Ftrl(bits, alpha, beta, l1, l2)
    rows = staged(rows, "toxicity-rows")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches, sent=sent):
            names = ["shard", "rows", "at", "z", "n"]
            now = state = None
            count = 0

            def part():
                at = np.flatnonzero(state.n != sent.value.n).astype(np.int32)
                moved = [(x[at] - y[at]).astype(np.float32) for x, y in ((state.z, sent.value.z), (state.n, sent.value.n))]
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([count], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (at, *moved))], names=names)

            for batch in batches:
                for shard, label, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    if shard != now:
                        if state is not None:
                            yield part()
                        now, state, count = shard, Ftrl(bits, alpha, beta, l1, l2), 0
                        state.z[:], state.n[:] = sent.value.z, sent.value.n
                    state.learn(unpacked(found.as_py(), bits), label)
                    count += 1
            if state is not None:
                yield part()

        parts = rows.mapInArrow(learn, "shard int, rows long, at binary, z binary, n binary")
        total, z, n = 0, np.zeros_like(model.z), np.zeros_like(model.n)
        for part in sorted(parts.collect(), key=lambda r: (r["shard"], r["rows"])):  # a row a shard or a few: what it has changed, 12 bytes a feature
            at = np.frombuffer(part["at"], np.int32)
            z[at] += part["rows"] * np.frombuffer(part["z"], np.float32)
            n[at] += part["rows"] * np.frombuffer(part["n"], np.float32)
            total += part["rows"]
        sent.destroy()
        if not total:
            break
        model.z += z / total
        model.n += n / total
    return model


class Weights:
    """The weights that are not zero, and the bias; None if nothing was learned."""

    def __init__(self, bits: int, at: np.ndarray, values: np.ndarray, bias: float | None):
        self.bits, self.at, self.values, self.bias = bits, at, values, bias

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.values
        return out


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, rows: int = 24_000, shards: int = 4, rounds: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1, **columns: str) -> Weights:
    """Weights learned from at most about ``rows`` labelled rows (a bound on the sample, not on what is scored)."""
    model = trained(training_rows(docs, labels, bits, rows, shards, **columns), bits, rounds, alpha, beta, l1, l2)
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return Weights(bits, at.astype(np.int32), w[at], float(w[-1]) if model.n[-1] else None)


def score_text(text: str | None, weights: Weights, dense: np.ndarray, block: int = 1 << 20) -> float:
    """Probability of label 1 of one whole text."""
    if weights.bias is None:
        return 0.0
    hit = np.zeros(0, np.int32)
    for found in feature_blocks(text, weights.bits, block):
        hit = np.unique(np.concatenate([hit, found[dense[found] != 0]]))
    return float(1 / (1 + np.exp(-np.clip(dense[hit].sum() + weights.bias, -35, 35))))


def score(docs: DataFrame, weights: Weights, keep: list[str], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep``, score (0 to 1, of label 1) and predicted (1 from ``threshold`` on) of each row, from its text alone.

    Null and empty texts, and those without a word, have the score of the bias; without labelled rows every score is 0.
    Repeated rows give repeated results, an empty table an empty one; columns in ``keep`` that are named like a result
    are left out; long texts are read whole, block by block, and stretches of over two million characters without white space in parts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*[docs[c] for c in kept(keep, ["score", "predicted"])], docs[text].alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        dense = sent.value.dense()
        for batch in batches:
            scores = [score_text(value.as_py(), sent.value, dense) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)
