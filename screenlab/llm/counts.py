"""Token counts and token ids by the tokenizers and sentencepiece libraries, in batches of bounded bytes."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import TAIL, parts, split_tail, windows
from .store import kept


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts (last column) come to about ``most_bytes``; a longer text stands alone."""
    if not batch.num_rows:
        return
    ends = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0), dtype=np.int64).cumsum()
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class LibraryEncoder:
    """Ids of whole texts by the library that a vocabulary file belongs to.

    Byte-level vocabularies are cut at safe spaces; the parts of a batch that are not remembered yet are
    handed to the library together; parts with a special string always go to it. Other vocabularies, and
    those whose special strings hold spaces or closing marks, get each text whole, as their pre-processing
    may look across any cut.
    """

    def __init__(self, path: str, parts_kept: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        self.limit, self.memo, self.marks = parts_kept, _Known(), {}
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: self.model.encode(texts, num_threads=1)
            self.cuts = False
        else:
            import json

            from tokenizers import Tokenizer, pre_tokenizers

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.whole = lambda texts: [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            self.tokenize = self.model.model.tokenize
            with open(path, encoding="utf-8") as f:
                kind = json.load(f)
            pre = kind.get("pre_tokenizer") or {}
            self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer") and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["content"].strip(TAIL) != x["content"] for x in kind["added_tokens"])
            #: special strings that a part of letters may hold: the library alone finds them
            self.special = [x["content"] for x in kind["added_tokens"] if not x["content"] or any(c.isalpha() for c in x["content"])]
            shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            #: characters that byte-level models show bytes as, read off the library with text that holds them
            self.table = {}
            for code in (*range(0x800), 0x800, *range(0x1000, 0xD000, 0x1000), 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
                self.table |= dict(zip(chr(code).encode(), shown.pre_tokenize_str(chr(code))[0][0]))

    def _letters(self, word: str) -> bytes:
        """Ids of a pre-token of letters (a space may stand before it), straight from the library's model."""
        # the characters of bytes that are ASCII letters are these letters
        shown = word.replace(" ", self.table[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _learn(self, missing: set[str], special: list[str]) -> dict[str, bytes]:
        """Ids of parts after a space: letters with or without closing marks by the model, others by the whole library."""
        found, odd, memo = {}, [], self.memo
        for part in missing:
            if special and any(x in part for x in special):
                odd.append(part)
                continue
            if part.isalpha():
                found[part] = self._letters(" " + part)
                continue
            stem, tail = split_tail(part)
            if tail and stem.isalpha():
                ids = dict.get(memo, stem) or found.get(stem)
                if ids is None:
                    ids = found[stem] = self._letters(" " + stem)
                if tail not in self.marks:
                    self.marks[tail] = array("I", [t.id for t in self.tokenize(tail)]).tobytes()
                found[part] = ids + self.marks[tail]
            else:
                odd.append(part)
        if odd:
            found |= {part: array("I", ids).tobytes() for part, ids in zip(odd, self.whole([" " + part for part in odd]))}
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what is remembered of a part are the bytes of its ids, which are joined."""
        if not self.cuts:
            return [np.array(ids, np.uint32) for ids in self.whole(texts)]
        special = [x for x in self.special if any(x in text for text in texts)]
        cut, memo, seen = [parts(text) for text in texts], self.memo, set()
        for words in cut:
            seen.update(words[1:])
        memo.rest = self._learn(seen.difference(memo), special)
        room = self.limit - len(memo)
        if room > 0:
            memo.update(memo.rest if len(memo.rest) <= room else dict(islice(memo.rest.items(), room)))
        plain = {w[0] for w in cut if not w[0].isalpha() or any(x in w[0] for x in special)}
        heads = {part: array("I", ids).tobytes() for part, ids in zip(plain, self.whole(list(plain)))}
        out = []
        for words in cut:
            head = words[0]
            words[0] = heads[head] if head in plain else self._letters(head)
            words[1:] = map(memo.__getitem__, words[1:])
            out.append(np.frombuffer(b"".join(words), np.uint32))
        return out


class _Known(dict):
    """Remembered parts; those of the batch at hand that there is no room for stand in ``rest``."""

    def __missing__(self, part: str) -> bytes:
        return self.rest[part]


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def encode_rows(batch: pa.RecordBatch, codes: LibraryEncoder, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows and their ids; a text beyond ``most_bytes`` is encoded window by window where cuts are safe."""
    for rows in slices(batch, most_bytes):
        texts = [t or "" for t in rows.column(rows.num_columns - 1).to_pylist()]
        if len(texts) == 1 and codes.cuts and len(texts[0]) > most_bytes:
            yield rows, [np.concatenate([codes.encode([piece])[0] for piece in windows(texts[0], most_bytes)])]
        else:
            yield rows, codes.encode(texts)


def count_tokens(docs: DataFrame, vocabulary: Callable[[], str], keep: list[str], text: str = "text", limit: int = 1024, most_bytes: int = 1 << 20) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each text.

    Only lengths leave the Arrow function. Null text counts as empty: 0 bytes, 0 tokens. Repeated rows
    give repeated results, an empty table an empty one. ``vocabulary`` is called on the executor and
    gives the vocabulary file's path there. Batches hold about ``most_bytes`` of text.
    """
    source = docs.select(*[docs[c] for c in kept(keep, ["n_bytes", "n_tokens", "over_limit"])], docs[text].alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def rows(batches):
        codes = encoder(vocabulary())
        for batch in batches:
            for part, ids in encode_rows(batch, codes, most_bytes):
                n = [len(x) for x in ids]
                size = pc.cast(pc.fill_null(pc.binary_length(part.column(part.num_columns - 1)), 0), pa.int64())
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=schema.names)

    return source.mapInArrow(rows, schema)
