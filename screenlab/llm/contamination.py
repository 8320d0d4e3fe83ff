"""Benchmark decontamination with one Aho-Corasick automaton over word sequences.

Text is normalised to lower-case words on its UTF-8 bytes; each word becomes its number in the automaton's
vocabulary (0 if no test item has it), and one pass of the automaton finds every window of every item.
Places are word numbers, mapped back to character offsets of the original text where asked for.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import kept, staged

#: Fixed value: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = regex.compile(WORD.replace("\\x60", "\\x40\\x5B-\\x60", 1)).finditer


def words_of(text: str | None) -> list[bytes]:
    """Words of lower-cased text, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The automaton of all windows of some items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = 13):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for start in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(ids[start : start + size], set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, found in owners.items():
            self.automaton.add_word(window, (len(window), found))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes], block: int = 1 << 16) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None if none is), and by which items."""
        hit, items = None, set()
        if self.empty or not words:
            return hit, items
        get, state = self.number.get, self.automaton.iter(())
        for start in range(0, len(words), block):
            state.set(tuple([get(w, 0) for w in words[start : start + block]]), False)
            for end, (length, found) in state:
                if hit is None:
                    hit = np.zeros(len(words), bool)
                hit[end - length + 1 : end + 1] = True
                items |= found
        return hit, items


def char_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end, in characters of the original text, of each run of hit words."""
    out: list[tuple[int, int]] = []
    run = False
    for match, on in zip(_SPANS(text), hit):
        if on and run:
            out[-1] = (out[-1][0], match.end())
        elif on:
            out.append(match.span())
        run = on
    return out


def item_shards(items: DataFrame, item_id: str, text: str, most_bytes: int):
    """Items in lists of at most ``most_bytes`` of text (one longer item stands alone), fetched part by part."""
    part, size = [], 0
    for row in items.select(items[item_id].cast("string"), items[text]).toLocalIterator():
        more = len((row[1] or "").encode())
        if part and size + more > most_bytes:
            yield part
            part, size = [], 0
        part.append((row[0] or "", row[1]))
        size += more
    yield part


_WINDOWS: dict[str, Windows] = {}


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, spans: bool = False, most_bytes: int = 16 << 20) -> DataFrame:
    """``keep``, n_words, n_hit, __items (ids of items with occurring windows), contaminated, and __spans if asked for.

    What is broadcast is at most ``most_bytes`` of item text at a time: more items are scanned in further
    passes over the rows, whose hits add up. The driver holds two such parts at most. Null text has no words and no hits; items without words have
    no windows; repeated rows give repeated results; without items nothing is contaminated.
    """
    rows = docs.select(*[docs[c] for c in kept(keep, ["n_words", "n_hit", "contaminated"])], F.lit(None).cast("binary").alias("__bits"), F.lit(None).cast("array<string>").alias("__items"), docs[text].alias("__text"))
    shards = item_shards(items, item_id, item_text, most_bytes)
    shard = next(shards)
    for following in shards:
        sent = docs.sparkSession.sparkContext.broadcast(shard)
        rows = staged(_pass(rows, sent, size, False, spans), "hits")
        sent.destroy()
        shard = following
    return _pass(rows, docs.sparkSession.sparkContext.broadcast(shard), size, True, spans)


def _pass(rows: DataFrame, sent: Broadcast, size: int, last: bool, spans: bool) -> DataFrame:
    name = uuid.uuid4().hex
    kept = rows.schema.fields[:-3]
    made = [("n_words", T.LongType(), pa.int64()), ("n_hit", T.LongType(), pa.int64()), ("__items", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("contaminated", T.BooleanType(), pa.bool_())]
    if spans:
        made.append(("__spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t, _ in made)]) if last else rows.schema

    def scan(batches):
        if name not in _WINDOWS:
            _WINDOWS.clear()
            _WINDOWS[name] = Windows(sent.value, size)
        windows = _WINDOWS[name]
        for batch in batches:
            out: list[list] = [[] for _ in made]
            masks = []
            for bits, earlier, value in zip(*(batch.column(batch.num_columns - k) for k in (3, 2, 1))):
                text = value.as_py()
                words = words_of(text)
                hit, items = windows.scan(words)
                if bits.is_valid:
                    old = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(words)).astype(bool)
                    hit, items = old if hit is None else hit | old, items | set(earlier.as_py())
                if not last:
                    masks.append(None if hit is None else np.packbits(hit).tobytes())
                    out[2].append(sorted(items))
                    continue
                n = 0 if hit is None else int(hit.sum())
                values = [len(words), n, sorted(items), n > 0 and 20 * n >= len(words)]
                if spans:
                    values.append([{"start": a, "end": b} for a, b in char_spans(text, hit)] if n else [])
                for column, v in zip(out, values):
                    column.append(v)
            columns = [batch.column(i) for i in range(batch.num_columns - 3)]
            if last:
                columns += [pa.array(v, k) for v, (_, _, k) in zip(out, made)]
            else:
                columns += [pa.array(masks, pa.binary()), pa.array(out[2], pa.list_(pa.string())), batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(scan, schema)
