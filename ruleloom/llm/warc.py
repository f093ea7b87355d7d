"""WARC archives: writing, normalising monolithic gzip files to a member per record with an offset index, reading."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fields, shared_path

CHUNK = 1 << 20
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Runs of records are read by so many tasks at most; with more, a task reads several.
MAX_TASKS = 20_000
#: Zlib level of the archives: they are read once, so speed counts.
LEVEL = 1


# -- one archive, as bytes ---------------------------------------------------------------------------------------------


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit carries digest and length of the full payload but no block."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(uri.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """Bytes of a gzip stream of one or more members, in one pass; no chunk exceeds CHUNK bytes, however well it was packed."""
    unzip = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if out := unzip.decompress(data, CHUNK):
                yield out
            data = unzip.unconsumed_tail or unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    while not unzip.eof and (out := unzip.decompress(b"", CHUNK)):
        yield out


class Records:
    """Cuts a stream of chunks into records; holds one record and one chunk at most."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        for chunk in self.chunks:
            if chunk:
                self.held += chunk
                return True
        return False

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers (lower-case names) and the whole record's bytes."""
        while True:
            while self.held[:2] == b"\r\n":  # stray blank lines between records
                del self.held[:2]
            seen = 0
            while (at := self.held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
                seen = len(self.held)
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record's headers")
                    return
            lines = bytes(self.held[:at]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            end = at + 4 + int(headers["content-length"])
            while len(self.held) < end:
                if not self._more():
                    raise ValueError("the archive ends inside a record's block")
            while len(self.held) < end + 4 and self._more():
                pass
            yield headers, bytes(self.held[:end]) + b"\r\n\r\n"
            del self.held[:end]
            for _ in range(2):
                if self.held[:2] == b"\r\n":
                    del self.held[:2]


def normalise(source: BinaryIO, out: BinaryIO, index: BinaryIO) -> int:
    """Rewrites a gzip archive of any member layout so that each record is a member of its own; returns their number.

    The source is inflated once, front to back. index gets a JSON line per record: id, type, offset and length of its
    member, so a reader can fetch one record without reading what comes before.
    """
    offset = count = 0
    for headers, whole in Records(inflated(source)):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(whole) + z.flush()
        out.write(member)
        line = {"id": headers.get("warc-record-id", ""), "type": headers.get("warc-type", ""), "offset": offset, "length": len(member)}
        index.write(json.dumps(line).encode() + b"\n")
        offset, count = offset + len(member), count + 1
    return count


# -- files -------------------------------------------------------------------------------------------------------------


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _name(record_id: int | None, nth: str) -> str:
    return f"urn:page:{record_id}" if record_id is not None else f"urn:page:none:{nth}"


def write_archives(pages: DataFrame, folder: str, prefix: str = "part") -> DataFrame:
    """Writes rows (page_id, url, html binary, digest, record_type, refers_to) as archives under folder, one per task.

    Each task streams its records into one monolithic gzip file, normalises that to a member per record with its
    index beside it, drops the first, and moves the result to its final name at once, so a task that is run again
    leaves the same files. Returns (archive, n_records). Files are written through a file system of the folder's
    scheme, never to a local folder of a worker.
    """

    schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        final = f"{root}/{prefix}-{part:06d}.warc.gz"
        own = f"{root}/.{prefix}-{part:06d}-{uuid.uuid4().hex}"
        n = 0
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        with files.open_output_stream(f"{own}.whole", compression=None) as out:
            for b in batches:
                for page_id, url, html, digest, kind, refers in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")]):
                    body = html if kind == "response" else b""
                    out.write(z.compress(record(kind, _name(page_id, f"{part}-{n}"), url or "", body, digest, len(html), None if refers is None else _name(refers, ""))))
                    n += 1
            out.write(z.flush())
        if n:
            with files.open_input_stream(f"{own}.whole", compression=None) as src, files.open_output_stream(f"{own}.gz", compression=None) as out, files.open_output_stream(f"{own}.idx", compression=None) as index:
                assert normalise(src, out, index) == n
            files.move(f"{own}.idx", f"{final}.idx")
            files.move(f"{own}.gz", final)
            yield batch(schema, [folder.rstrip("/") + final[len(root.rstrip("/")) :]], [n])
        files.delete_file(f"{own}.whole")

    return pages.mapInArrow(write, "archive string, n_records long")


def read_archives(archives: DataFrame, split: int = 1024) -> DataFrame:
    """Records of the archives of a table (archive, n_records), found through their indexes.

    record_id, record_type, payload_bytes and payload_digest of the full payload, refers_to, url, payload (the block).
    Work is dealt out in runs of up to `split` records, so a large archive is read by many tasks. The payload of a
    response is hashed again and compared with its header: a damaged record raises.
    """
    run_schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("archive").to_pylist():
                files, path = _open(uri)
                with files.open_input_stream(f"{path}.idx") as f, io.TextIOWrapper(f) as lines:
                    start = length = n = 0
                    for line in lines:
                        r = json.loads(line)
                        if n == 0:
                            start, length = r["offset"], 0
                        length, n = length + r["length"], n + 1
                        if n == split:
                            yield batch(run_schema, [uri], [start], [length], [n])
                            n = 0
                    if n:
                        yield batch(run_schema, [uri], [start], [length], [n])

    out = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, length, n in zip(*[b.column(i).to_pylist() for i in range(4)]):
                files, path = _open(uri)
                rows, held = [], 0
                with files.open_input_file(path) as f:
                    f.seek(start)

                    class Limited:
                        left = length

                        def read(self, size: int) -> bytes:
                            data = f.read(min(size, self.left))
                            self.left -= len(data)
                            return data

                    for h, whole in Records(inflated(Limited())):
                        size = int(h["content-length"])
                        payload = whole[len(whole) - 4 - size : len(whole) - 4]
                        digest = h["warc-payload-digest"].partition(":")[2]
                        if h["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{h['warc-record-id']}: its payload does not match its digest")
                        rows.append((h["warc-record-id"].strip("<>"), h["warc-type"], int(h["warc-payload-length"]), digest, h.get("warc-refers-to", "").strip("<>") or None, h["warc-target-uri"], payload))
                        held += size
                        if held > 4 * CHUNK:
                            yield batch(out, *zip(*rows))
                            rows, held = [], 0
                if rows:
                    yield batch(out, *zip(*rows))

    # A run is a few numbers here but up to `split` records there, so their tasks are counted, not merged by size.
    tasks = max(1, archives.agg(F.sum(F.ceil(F.col("n_records") / split))).first()[0] or 1)
    dealt = archives.select("archive").mapInArrow(runs, "archive string, offset long, length long, n long").repartition(min(tasks, MAX_TASKS), "archive", "offset")
    return dealt.mapInArrow(read, "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string, payload binary")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (UTF-8, null: empty), digest, record_type, refers_to.

    Of pages with equal payloads of at least 100 bytes the smallest page_id is the response, the others revisit it.
    The smallest ids come from partial minima per digest; the join back, on page_id and digest, can be split where one
    payload is very common. Rows that share a page_id are judged each by its own payload: with other payloads they are
    pages of their own, and all rows equal to the response are responses. Rows without page_id are responses.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = fields(pages, page_id=pages["page_id"].cast("long"), url=pages["url"].cast("string"), html=html).withColumn("digest", F.sha2("html", 256))
    ids = rows.filter((F.length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first_id"))
    again = ids.join(first, ids.digest == first.d).filter("page_id <> first_id")
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again"), F.col("first_id").alias("refers_to")).distinct()
    rows = rows.join(again, (rows.page_id == again.again_id) & (rows.digest == again.again), "left").drop("again_id", "again")
    return rows.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages as WARC archives to a shared folder, reads them back: a row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload; rows without
    page_id are responses and come back with a null id; no pages, no archives and no rows.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    done = spark.createDataFrame(write_archives(with_revisits(pages), folder).collect(), "archive string, n_records long")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    back = read_archives(done)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
