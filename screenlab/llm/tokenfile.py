"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: data frames, each with content size and checksum, holding the ids of whole consecutive
documents as little-endian unsigned 32-bit integers; a skippable frame with the document index; and the
seek table of the public zstandard seekable format, the last bytes of the file. The seek table has the
compressed and decompressed size and the checksum (low 32 bits of XXH64) of every frame before it, so a
reader fetches the tail, the index and then only the frames of the documents it wants.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counts import encode_rows, encoder
from .files import fresh_name, opened, reader, uri, writer
from .store import new_path, staged

#: Fixed values of the format: magic numbers of skippable frames and of the seek table's foot.
SEEK_FRAME, INDEX_FRAME, SEEK_FOOT = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Seek table descriptor: checksums present.
DESCRIPTOR = 0x80


class TokenFile:
    """Writes documents' ids in the order given."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 1):
        self.out, self.frame_bytes = out, frame_bytes
        self.coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.pending, self.size, self.frames = [], 0, []
        self.ids, self.known, self.lengths, self.frame_of = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """One document; a frame is closed once it holds ``frame_bytes``, so a document never spans two."""
        data = np.ascontiguousarray(ids, "<u4").tobytes()
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.lengths.append(len(ids))
        self.frame_of.append(len(self.frames))
        self.pending.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.pending:
            data = b"".join(self.pending)
            frame = self.coder.compress(data)
            self.out.write(frame)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def finish(self) -> None:
        """Index and seek table."""
        self._close()
        body = struct.pack("<Q", len(self.ids)) + b"".join(np.asarray(x, k).tobytes() for x, k in ((self.ids, "<i8"), (self.known, "u1"), (self.lengths, "<u8"), (self.frame_of, "<u4")))
        body = self.coder.compress(body)
        self.out.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        self.frames.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, SEEK_FOOT)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class TokenReader:
    """Reads documents by place; fetches only the frames asked for."""

    def __init__(self, f):
        self.f, size = f, f.size()
        f.seek(size - 9)
        n, descriptor, foot = struct.unpack("<IBI", f.read(9))
        if foot != SEEK_FOOT or descriptor != DESCRIPTOR:
            raise ValueError("not a token file: no seek table at the end")
        f.seek(size - 9 - 12 * n - 8)
        magic, length = struct.unpack("<II", f.read(8))
        if magic != SEEK_FRAME or length != 12 * n + 9:
            raise ValueError("the seek table is broken")
        self.frames = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], self.frames[:, 0].cumsum()])
        f.seek(int(self.at[n - 1]) + 8)
        body = zstandard.ZstdDecompressor().decompress(f.read(int(self.frames[n - 1, 0]) - 8))
        (docs,) = struct.unpack_from("<Q", body)
        cut = np.cumsum([8, 8 * docs, docs, 8 * docs])
        self.ids, self.known = np.frombuffer(body, "<i8", docs, cut[0]), np.frombuffer(body, "u1", docs, cut[1]).astype(bool)
        self.lengths, self.frame_of = np.frombuffer(body, "<u8", docs, cut[2]).astype(np.int64), np.frombuffer(body, "<u4", docs, cut[3]).astype(np.int64)
        self.before = self.lengths.cumsum() - self.lengths
        self.first = np.concatenate([[0], (self.frames[: n - 1, 1] // 4).cumsum()])

    def frame(self, k: int) -> bytes:
        """Content of one frame, its size and both checksums verified."""
        self.f.seek(int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.frames[k, 0])))
        if len(data) != self.frames[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place, ids as bytes) of the documents at ``places``, all by default; each frame is read once if they ascend."""
        at, data = -1, b""
        for i in range(len(self.ids)) if places is None else places:
            if self.frame_of[i] != at:
                at = int(self.frame_of[i])
                data = self.frame(at)
            start = 4 * int(self.before[i] - self.first[at])
            yield i, data[start : start + 4 * int(self.lengths[i])]


def write_tokens(docs: DataFrame, vocabulary: Callable[[], str], files: int | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, most_bytes: int = 1 << 20) -> DataFrame:
    """Write ids in ascending ``doc_id`` (nulls first, equal ids by text) and return the manifest: part, path, n_docs, n_tokens.

    Rows are dealt by ranges of ``doc_id`` and the text's first characters, so rows without an id or of one
    id are not one task's work. There are ``files`` tasks, by default as many as the table is read in, which
    grows with its bytes, and the session's shuffle partitions at least; every task writes one file, so file
    order and order inside files give the corpus order.
    Null text counts as empty and gives the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    n = files or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_path(spark, "tokens")
    source = docs.select(docs[doc_id].cast("long").alias("__id"), docs[text].alias("__text"))
    order = F.col("__id").asc_nulls_first()
    source = source.repartitionByRange(n, order, F.left("__text", F.lit(32))).sortWithinPartitions(order, "__text")
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def write(batches):
        codes, out, total = encoder(vocabulary()), None, 0
        for batch in batches:
            for rows, ids in encode_rows(batch, codes, most_bytes):
                if out is None:
                    system, path = opened(folder)
                    name = fresh_name(f"part-{TaskContext.get().partitionId():06d}", ".ztok")
                    sink = writer(system, f"{path}/{name}")
                    out = TokenFile(sink)
                for key, x in zip(rows.column(0).to_pylist(), ids):
                    out.add(key, np.append(x, np.uint32(end_id)))
                    total += len(x) + 1
        if out is not None:
            out.finish()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [f"{uri(folder)}/{name}"], "n_docs": [len(out.ids)], "n_tokens": [total]}, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return staged(source.mapInArrow(write, schema), "tokens-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, read from the files."""
    # one row a file: the running total over files is small
    files = manifest.select("path", (F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    files = files.select("path", F.coalesce("base", F.lit(0)).cast("long").alias("base")).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                with reader(path) as f:
                    tokens = TokenReader(f)
                    sums = np.fromiter((zlib.crc32(data) for _, data in tokens.documents()), np.int64, len(tokens.ids))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.ids, mask=~tokens.known), pa.array(base + tokens.before), pa.array(tokens.lengths), pa.array(sums)], schema=arrow)

    return files.mapInArrow(read, schema)


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Ids of some documents of one file, decompressing only their frames."""
    with reader(path) as f:
        tokens = TokenReader(f)
        places = np.flatnonzero(np.isin(tokens.ids, list(doc_ids)) & tokens.known)
        return {int(tokens.ids[i]): np.frombuffer(data, "<u4") for i, data in tokens.documents(places)}


def dumps(documents: Iterable[tuple[int | None, np.ndarray]], frame_bytes: int = 1 << 20) -> bytes:
    """A token file in memory."""
    out = io.BytesIO()
    made = TokenFile(out, frame_bytes)
    for key, ids in documents:
        made.add(key, ids)
    made.finish()
    return out.getvalue()
