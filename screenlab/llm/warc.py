"""Web archives: writing, normalising monolithic gzip files to one member a record, and reading by a sidecar index."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import fresh_name, opened, reader, uri, writer
from .store import new_path, staged

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes read at a time: inflated they are 64 MB at the very most.
_BLOCK = 1 << 16


def with_keepers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """__id, __url, __payload and __keeper: the largest id among equal payloads of ``least_bytes`` or more that occur twice.

    Payloads are told apart by length and SHA-1, counted before any shuffle, and only repeated ones are
    joined back, so the join that carries the pages is one that adaptive execution can split.
    Null html is the empty payload. Null ids are never keepers while another id has the payload.
    """
    rows = pages.select(pages[page_id].cast("long").alias("__id"), pages[url].cast("string").alias("__url"), F.coalesce(pages[html], F.lit("")).alias("__payload"))
    rows = rows.withColumn("__sha", F.sha1(F.encode("__payload", "utf-8"))).withColumn("__size", F.octet_length("__payload"))
    twice = rows.filter(F.col("__size") >= least_bytes).groupBy("__sha", "__size").agg(F.max("__id").alias("__keeper"), F.count("*").alias("__n"))
    twice = twice.filter("__n > 1").select("__sha", "__size", "__keeper")
    return rows.join(twice, ["__sha", "__size"], "left").select("__id", "__url", "__payload", "__keeper")


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of the keeper's record without it.

    Repeated rows of the keeper are responses like it.
    """
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = keeper is not None and keeper != page_id
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{keeper}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, roll_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Write the rows of ``with_keepers`` as archives of one gzip stream each; returns the manifest (path).

    A task starts a new archive once one holds ``roll_bytes`` of records. An empty table gives none.
    """
    folder = new_path(rows.sparkSession, "warc")

    def write(batches):
        system, path = opened(folder)
        made, sink, size = [], None, 0
        for batch in batches:
            for values in zip(*(batch.column(i) for i in range(4))):
                page_id, url, payload, keeper = (v.as_py() for v in values)
                if sink is None:
                    made.append(fresh_name("whole", ".warc.gz"))
                    sink, size = writer(system, f"{path}/{made[-1]}"), 0
                    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, url, payload.encode(), keeper)
                sink.write(coder.compress(data))
                size += len(data)
                if size >= roll_bytes:
                    sink.write(coder.flush())
                    sink.close()
                    sink = None
        if sink is not None:
            sink.write(coder.flush())
            sink.close()
        yield pa.RecordBatch.from_pydict({"path": [f"{uri(folder)}/{x}" for x in made]}, schema=pa.schema([("path", pa.string())]))

    return staged(rows.mapInArrow(write, "path string"), "warc-manifest")


def inflated(f) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, block by block."""
    coder = zlib.decompressobj(31)
    while data := f.read(_BLOCK):
        while data:
            if coder.eof:
                coder = zlib.decompressobj(31)
            if out := coder.decompress(data):
                yield out
            data = coder.unused_data
    if not coder.eof:
        raise ValueError("the gzip stream is cut off")


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def normalise(blocks: Iterator[bytes], out, index, level: int = 1) -> int:
    """Copy each record of an inflated stream to ``out`` as a gzip member; ``index`` gets a line of offset, length, type and id.

    Holds a header and one block at a time, however long the record. Returns the number of records.
    """
    buffer, offset, n = b"", 0, 0
    while True:
        buffer = buffer.lstrip(b"\r\n")
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            more = next(blocks, None)
            if more is None:
                if buffer:
                    raise ValueError("the archive ends inside a record's header")
                return n
            buffer = (buffer + more).lstrip(b"\r\n")
        head, buffer = buffer[: end + 4], buffer[end + 4 :]
        about = fields(head)
        coder, start = zlib.compressobj(level, zlib.DEFLATED, 31), offset
        data = coder.compress(head)
        out.write(data)
        offset += len(data)
        left = int(about["content-length"])
        while left:
            if not buffer and (buffer := next(blocks, b"")) == b"":
                raise ValueError("the archive ends inside a record")
            part, buffer = buffer[:left], buffer[left:]
            left -= len(part)
            if data := coder.compress(part):
                out.write(data)
                offset += len(data)
        data = coder.compress(b"\r\n\r\n") + coder.flush()
        out.write(data)
        offset += len(data)
        index.write(f"{start}\t{offset - start}\t{about['warc-type']}\t{about['warc-record-id']}\n".encode())
        n += 1


def normalise_archives(manifest: DataFrame) -> DataFrame:
    """Rewrite every archive of a manifest with one member a record and a sidecar index; returns path, index_path, n_records."""
    folder = new_path(manifest.sparkSession, "warc-members")
    schema = pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64())])

    def rewrite(batches):
        system, path = opened(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = fresh_name("members", ".warc.gz")
                with reader(source) as f, writer(system, f"{path}/{name}") as out, writer(system, f"{path}/{name}.idx") as index:
                    n = normalise(inflated(f), out, index)
                yield pa.RecordBatch.from_pydict({"path": [f"{uri(folder)}/{name}"], "index_path": [f"{uri(folder)}/{name}.idx"], "n_records": [n]}, schema=schema)

    return staged(_dealt(manifest, "path").mapInArrow(rewrite, "path string, index_path string, n_records long"), "warc-members-manifest")


def _dealt(manifest: DataFrame, *keys: str) -> DataFrame:
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_member(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record at ``offset``."""
    f.seek(offset)
    data = zlib.decompress(f.read(length), 31)
    end = data.index(b"\r\n\r\n") + 4
    about = fields(data[:end])
    return about, data[end : end + int(about["content-length"])]


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, found by the sidecar index.

    Responses are measured and digested anew and must match their header; revisits carry both in theirs.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    page = lambda x: int(x[10:-1]) if x and len(x) > 11 else None

    def read(batches):
        for batch in batches:
            for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                with reader(path) as f, reader(index_path) as index:
                    for line in index.read().splitlines():
                        offset, length, *_ = line.split(b"\t")
                        about, block = read_member(f, int(offset), int(length))
                        digest, size = about["warc-payload-digest"].removeprefix("sha1:"), int(about["payload-length"])
                        if about["warc-type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if (found, len(payload)) != (digest, size):
                                raise ValueError(f"{path}: the payload of {about['warc-record-id']} is damaged")
                        rows.append((page(about["warc-record-id"]), size, digest, about["warc-type"], page(about.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)] if rows else [pa.array([], k.type) for k in schema], schema=schema)

    return _dealt(manifest, "path").select("path", "index_path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read the records back by index."""
    return read_archives(normalise_archives(write_archives(with_keepers(pages, least_bytes=least_bytes))))
