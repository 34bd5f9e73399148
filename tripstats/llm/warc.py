"""WARC archives through a chunked record table.

A payload is whole only in the task that reads it from the pages: there it is
hashed, and there it becomes rows ``(record, chunk_no, bytes)``, a chunk
number and one slice at a time.  Which records revisit another is decided on
ids, digests and sizes alone; only these narrow rows and the chunk rows are
ever dealt between tasks.  The writer streams the chunks into archive files, and the reader streams the files back into rows, each carrying the
SHA-256 of the payload up to that chunk.  The last chunk's digest is the
payload's and is held against the digest that the record's header declares.

Archives are WARC/1.1, one gzip member per record, one file per write task.
A task writes under a name of its own attempt and hands the name back; only
the names in the manifest (a table Spark commits) are ever read, so the file
of a lost or repeated attempt is ignored.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import cut, id_key
from tripstats.session import new_scratch

#: Bytes of payload per chunk row.
CHUNK = 1 << 16
#: Payloads below this size are always written in full.
MIN_SHARED = 100
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest)``; ids as text."""
    p = pages.select(F.col("page_id").cast("string").alias("page_id"),
                     (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    return p.withColumns({"payload_digest": F.sha2("payload", 256),
                          "payload_bytes": F.octet_length("payload").cast("long")})


def revisits(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """``(id, payload_digest, refers_to)`` of the records that revisit another, from ids, digests and sizes alone."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    narrow = pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("n"))
    narrow = cut(narrow.where(F.col("n") >= min_shared).select("page_id", "payload_digest").distinct(), "payloads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id")).alias("first")
    firsts = narrow.groupBy("payload_digest").agg(first, F.count("*").alias("n")).where("n > 1")
    return cut(narrow.join(firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
               .select(id_key(F.col("page_id")).alias("id"), "payload_digest",
                       F.col("first.page_id").cast("string").alias("refers_to")), "revisits")


def chunk_rows(pages: DataFrame, chunk: int = CHUNK, min_shared: int = MIN_SHARED) -> DataFrame:
    """One row per ``chunk`` bytes of payload, at least one per record (one without bytes for a revisit); the
    chunks of a record stay together and in order."""
    last = F.greatest(F.ceil(F.col("payload_bytes") / chunk) - 1, F.lit(0)).cast("int")
    keep = ["page_id", "url", "payload_bytes", "payload_digest"]
    pieces = (payloads(pages).withColumn("row", F.monotonically_increasing_id())
              .select(*keep, "row", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
              .select(*keep, "row", "chunk_no", id_key(F.col("page_id")).alias("id"),
                      F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk")))
    again = revisits(pages, min_shared).withColumn("again", F.lit(True))
    joined = pieces.join(again, ["id", "payload_digest"], "left").where(F.col("again").isNull() | (F.col("chunk_no") == 0))
    return (joined.select(*keep, F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), "refers_to",
                          "row", "chunk_no", F.when(F.col("again").isNull(), F.col("chunk")).alias("chunk"))
            .sortWithinPartitions("row", "chunk_no").drop("row"))


def _filesystem(root: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")


def _header(r: dict) -> bytes:
    """The record's header block; values are percent-quoted so that none can break a line."""
    from urllib.parse import quote
    revisit = r["record_type"] == "revisit"
    url = quote(r["url"] or "urn:none", safe=":/?#[]@!$&'()*+,;=%~")
    lines = [VERSION, f"WARC-Type: {r['record_type']}".encode(),
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(r['page_id']))}>".encode(),
             f"WARC-Target-URI: {url}".encode(),
             b"WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha256:{r['payload_digest']}".encode(),
             *([] if r["page_id"] is None else [f"Page-Id: {quote(r['page_id'], safe='')}".encode()]),
             f"Payload-Length: {r['payload_bytes']}".encode(),
             b"Content-Type: text/html; charset=utf-8",
             f"Content-Length: {0 if revisit else r['payload_bytes']}".encode()]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}".encode(),
                  f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(r['refers_to']))}>".encode(),
                  f"Refers-To-Page: {quote(r['refers_to'], safe='')}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n"


HEAD = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n, member = None, "", 0, None
        fs, base = _filesystem(root)
        for batch in batches:
            heads = [batch.column(c) for c in HEAD]
            numbers, chunks = batch.column("chunk_no"), batch.column("chunk")
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                if numbers[i].as_py() == 0:
                    if member:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    out.write(member.compress(_header({c: h[i].as_py() for c, h in zip(HEAD, heads)})))
                if piece := chunks[i].as_py():
                    out.write(member.compress(piece))
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})
    return write


def write_archives(chunks: DataFrame, root: str) -> DataFrame:
    """Write records (see :func:`chunk_rows`) below ``root``; the manifest ``(file, records)``."""
    return cut(chunks.mapInArrow(_writer(root), "file string, records long"), "manifest")


class _Member:
    """Decompressed bytes of an archive, in pieces of at most ``step``."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.raw, self.buf, self.z = stream, step, b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data or self.raw, zlib.decompressobj(31)
            self.raw = self.raw or self.stream.read(self.step)
            if not self.raw:
                return False
            got = self.z.decompress(self.raw, self.step)
            self.raw = self.z.unconsumed_tail if not self.z.eof else b""
            if got:
                self.buf += got
                return True

    def head(self) -> bytes | None:
        while (at := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buf.strip():
                    raise ValueError("archive ends within a header")
                return None
        out, self.buf = self.buf[:at], self.buf[at + 4:]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self.more():
                raise ValueError("archive ends within a record")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


READ = ("page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
        "chunk_no int, last boolean, digest_so_far string, chunk binary")


def _reader(root: str, chunk: int, with_data: bool):
    from urllib.parse import unquote
    fields = [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int32()),
              ("last", pa.bool_()), ("digest_so_far", pa.string()), ("chunk", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(root)
        rows, held = [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)],
                                              [f for f, _ in fields])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    m = _Member(stream, chunk)
                    while (head := m.head()) is not None:
                        lines = head.split(b"\r\n")
                        if lines[0] != VERSION:
                            raise ValueError(f"{name}: not a WARC record: {lines[0][:40]!r}")
                        h = dict(x.decode().split(": ", 1) for x in lines[1:])
                        left, no, sha = int(h["Content-Length"]), 0, hashlib.sha256()
                        page, to = (unquote(h[k]) if k in h else None for k in ("Page-Id", "Refers-To-Page"))
                        declared = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        while True:
                            piece = m.take(min(left, chunk))
                            sha.update(piece)
                            left -= len(piece)
                            rows.append((page, int(h["Payload-Length"]), declared, h["WARC-Type"], to, no,
                                         left == 0, sha.hexdigest(), piece if with_data else None))
                            held += len(piece) * with_data + 200
                            if held >= 8 << 20:
                                yield full()
                                rows, held = [], 0
                            no += 1
                            if not left:
                                break
                        if h["WARC-Type"] == "response" and sha.hexdigest() != declared:
                            raise ValueError(f"{name}: payload of page {page} does not have its declared digest")
                        m.take(4)
        if rows:
            yield full()
    return read


def read_archives(manifest: DataFrame, root: str, chunk: int = CHUNK, with_data: bool = True,
                  id_type: str = "long") -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names; ids, text in the archives, as ``id_type``.

    One row per chunk: the record's header fields, ``chunk_no``, ``last``,
    ``digest_so_far`` (SHA-256 of the payload up to here) and the bytes
    (null unless ``with_data``).  A revisit is one row without bytes.
    A payload that does not match its declared digest raises.
    """
    files = manifest.select("file")
    # a task per file: by bytes the manifest is so small that it would all go to one task
    rows = files.repartition(max(1, files.count()), "file").mapInArrow(_reader(root, chunk, with_data), READ)
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, chunk: int = CHUNK, min_shared: int = MIN_SHARED,
                  with_data: bool = False) -> DataFrame:
    """Write ``pages`` (``page_id``, ``html``, optionally ``url``) as WARC archives and read them back.

    Null html is the empty payload.  Of equal payloads of at least
    ``min_shared`` bytes the smallest ``page_id`` is the response (null ids
    last) and the others revisit it; rows that repeat that smallest id are
    each a response.  Other columns are ignored; no pages give no rows.
    """
    root = new_scratch(pages.sparkSession, "warc")
    manifest = write_archives(chunk_rows(pages, chunk, min_shared), root)
    return read_archives(manifest, root, chunk, with_data, dict(pages.dtypes)["page_id"])
