"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import kept, staged

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}").search
#: Odd multipliers of the n-gram hash, one for each place.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def gram_blocks(text: str, orders: tuple[int, ...], bits: int, block: int) -> Iterator[np.ndarray]:
    """Hashed n-grams (with repeats) of lower-cased text between two spaces, those that start in ``block`` characters at a time.

    A block reads on into the next one, so the n-grams do not depend on where blocks end.
    """
    padded = f" {text.lower()} "
    for start in range(0, len(padded), block):
        codes = np.frombuffer(padded[start : start + block + max(orders) - 1].encode("utf-32-le", "replace"), np.uint32)
        out = []
        for n in orders:
            size = min(block, len(padded) - start - n + 1)
            if size > 0:
                mixed = np.full(size, n, np.uint32)
                for k in range(n):
                    mixed = (mixed ^ codes[k : k + size]) * _MIX[k]
                    mixed ^= mixed >> np.uint32(15)
                out.append(mixed >> np.uint32(32 - bits))
        yield np.concatenate(out) if out else np.zeros(0, np.uint32)


def ngrams(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashed n-grams of a whole text."""
    return np.concatenate(list(gram_blocks(text, orders, bits, len(text) + 2)))


def _labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    rows = docs.select(docs[doc_id].alias("__id"), docs[text].alias("__text"), docs[lang].alias("__lang"))
    return rows.filter("__lang IS NOT NULL AND __text IS NOT NULL")


def training_counts(rows: DataFrame, sizes: dict[str, int], orders: tuple[int, ...], bits: int, per_language: int) -> DataFrame:
    """__lang, __feature, __n over a sample of about ``per_language`` rows of each language of ``sizes`` (rows by language).

    The sample takes rows by a hash of their id, each language at the rate that its row count calls for.
    """
    rate = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    place = F.pmod(F.xxhash64(F.lit("language"), "__id"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.filter(place < F.coalesce(rate[F.col("__lang")], F.lit(0.0))).select("__lang", "__text")
    schema = pa.schema([("__lang", pa.string()), ("__feature", pa.int64()), ("__n", pa.int64())])

    def made(totals: dict[str, np.ndarray]):
        for label, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(total[at])], schema=schema)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = totals.setdefault(label, np.zeros(1 << bits, np.int64))
                for grams in gram_blocks(value.as_py(), orders, bits, 1 << 18):
                    total += np.bincount(grams, minlength=1 << bits)
                if len(totals) > 64:
                    yield from made(totals)
                    totals = {}
        yield from made(totals)

    return rows.mapInArrow(count, "__lang string, __feature long, __n long").groupBy("__lang", "__feature").agg(F.sum("__n").alias("__n"))


class Model:
    """Languages in order and the log probability of each feature (row) in each language (column).

    Log probabilities are multiples of 2 ** -18, so sums of them are exact in any order: neither batches
    nor blocks change a score.
    """

    def __init__(self, languages: list[str], logs: np.ndarray, orders: tuple[int, ...], bits: int):
        self.languages, self.orders, self.bits = languages, orders, bits
        self.logs = (np.round(np.asarray(logs, np.float64) * 2**18) / 2**18).astype(np.float32)

    def sums(self, texts: list[str | None], block: int = 1 << 20) -> np.ndarray:
        """Summed log probabilities, texts by languages.

        The batch's n-grams make sparse rows (row starts, feature numbers), scored once about ``block`` are held;
        fewer of them the more languages there are, so what is gathered stays within 32 MB.
        """
        out = np.zeros((len(texts), len(self.languages)))
        most = max(256, min(block, (1 << 23) // max(1, len(self.languages))) // len(self.orders))
        grams, owners, held = [], [], 0

        def flush() -> None:
            if grams:
                starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]])
                np.add.at(out, owners, np.add.reduceat(self.logs[np.concatenate(grams)], starts, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            for part in gram_blocks(text, self.orders, self.bits, most) if text else ():
                if len(part):
                    grams.append(part)
                    owners.append(i)
                    held += len(part)
                if held >= most:
                    flush()
                    grams, owners, held = [], [], 0
        flush()
        return out

    def predict(self, texts: list[str | None], block: int = 1 << 20) -> tuple[list[str], list[float]]:
        """Language and its probability; ``und`` and 0 without a letter. Ties go to the language that sorts first."""
        names, tops, rests = self.best(texts, block)
        return [UNDETERMINED if n is None else n for n in names], [0.0 if n is None else 1 / r for n, r in zip(names, rests)]

    def best(self, texts: list[str | None], block: int = 1 << 20) -> tuple[list[str | None], list[float], list[float]]:
        """The best language (None without a letter), its summed log probability, and the sum of all languages' odds to it."""
        scored = [bool(t and self.languages and _LETTER(t)) for t in texts]
        if not any(scored):
            return [None] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        sums = self.sums([t if s else None for t, s in zip(texts, scored)], block)
        place = sums.argmax(axis=1)
        tops = sums[np.arange(len(texts)), place]
        rests = np.exp(sums - tops[:, None]).sum(axis=1)
        return [self.languages[p] if s else None for p, s in zip(place, scored)], tops.tolist(), rests.tolist()


def models(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, per_language: int = 5_000, smooth: float = 0.5, block_languages: int = 256, **columns: str) -> Iterator[Model]:
    """Models of ``block_languages`` languages each, in order of their names, from rows with text and language.

    Each is fitted on at most about ``per_language`` rows a language. One matrix of 2 ** bits rows and at
    most ``block_languages`` columns of 4 bytes (34 MB) is on the driver at a time, and counts of one language.
    """
    rows = _labelled(docs, **columns)
    names = iter(rows.groupBy("__lang").agg(F.count("*").alias("n")).orderBy("__lang").toLocalIterator())
    while sizes := {r["__lang"]: r["n"] for r in islice(names, block_languages)}:
        counts = training_counts(rows, sizes, orders, bits, per_language)
        each = counts.groupBy("__lang").agg(F.collect_list("__feature").alias("at"), F.collect_list("__n").alias("n"))  # 2 ** bits features at most
        languages = sorted(sizes)
        totals = np.full((1 << bits, len(languages)), smooth)
        for r in each.toLocalIterator():
            totals[r["at"], languages.index(r["__lang"])] += r["n"]
        yield Model(languages, np.log(totals / totals.sum(axis=0)), orders, bits)


def fit(docs: DataFrame, **options) -> Model:
    """One model of all languages; the driver holds 4 * 2 ** bits bytes for each, so prefer ``models`` for very many."""
    parts = list(models(docs, **options))
    if not parts:
        return Model([], np.zeros((1, 0)), options.get("orders", (1, 2, 3)), options.get("bits", 15))
    return Model([x for m in parts for x in m.languages], np.hstack([m.logs for m in parts]), parts[0].orders, parts[0].bits)


def identify(docs: DataFrame, found: Model | Iterable[Model], keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred and score (0 to 1) of each row, from its text alone.

    Null text and text without a letter are ``und`` with score 0, as is every row if no language was
    learned. Repeated rows give repeated results, an empty table an empty one; columns in ``keep`` that are
    named like a result are left out; long texts are scored whole. Models of more blocks of languages go
    over the rows one after the other, each with its matrix broadcast; ties go to the language that sorts first.
    """
    blocks = iter([found] if isinstance(found, Model) else found)
    empty = [F.lit(None).cast("string").alias("__best"), F.lit(0.0).alias("__top"), F.lit(0.0).alias("__rest")]
    rows = docs.select(*[docs[c] for c in kept(keep, ["lang_pred", "score"])], *empty, docs[text].alias("__text"))
    model = next(blocks, None) or Model([], np.zeros((1, 0)), (1,), 1)
    for following in blocks:
        rows = staged(_pass(rows, model, False), "language")
        model = following
    return _pass(rows, model, True)


def _pass(rows: DataFrame, model: Model, last: bool) -> DataFrame:
    """Scores of one block of languages beside the best of the blocks before it."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    fields = rows.schema.fields[:-4]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]) if last else rows.schema

    def score(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                *carried, bests, tops, rests, texts = part.columns
                made = []
                for old, now in zip(zip(*(c.to_pylist() for c in (bests, tops, rests))), zip(*sent.value.best(texts.to_pylist()))):
                    made.append(_better(old, now))
                names, tops, rests = (list(x) for x in zip(*made))
                if last:
                    ends = [pa.array([UNDETERMINED if n is None else n for n in names], pa.string()), pa.array([0.0 if n is None else 1 / r for n, r in zip(names, rests)], pa.float64())]
                else:
                    ends = [pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(rests, pa.float64()), texts]
                yield pa.RecordBatch.from_arrays([*carried, *ends], names=schema.names)

    return rows.mapInArrow(score, schema)


def _better(old: tuple, now: tuple) -> tuple:
    """The better of two bests, the earlier on ties, with the odds of both sides' languages to it."""
    if old[0] is None or now[0] is None:
        return old if now[0] is None else now
    (first, second) = (old, now) if old[1] >= now[1] else (now, old)
    return first[0], first[1], first[2] + second[2] * math.exp(second[1] - first[1])


def is_held_out(doc_id: str = "doc_id"):
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
