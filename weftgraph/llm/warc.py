"""WARC archives: write as one gzip stream each, normalise to a member per record with an index, read back."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import pieces
from weftgraph.runtime import fresh_path, materialize, ship_package

CHUNK = 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder; works on the driver and in tasks."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    system.create_dir(path, recursive=True)
    return system, path


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def response_or_revisit(page_id, url, html, digest: str, kind: str, refers_to) -> bytes:
    """The record of one page. A revisit has no payload; its headers keep the payload's size and digest."""
    payload = (html or "").encode()
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if kind == "revisit":
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["X-Refers-To-Page"] = str(refers_to)
        payload = b""
    return record(headers, HTTP_HEAD + payload)


class _Pull:
    """Bytes of a stream, read on demand and kept only until they are taken."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buf = chunks, bytearray()

    def _more(self) -> bool:
        c = next(self.chunks, None)
        if c is None:
            return False
        self.buf += c
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and including ``mark``; None at a clean end."""
        at = 0
        while (k := self.buf.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.buf)
            if not self._more():
                if self.buf:
                    raise ValueError("the archive ends inside a record head")
                return None
        out = bytes(self.buf[: k + len(mark)])
        del self.buf[: k + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def inflate(read) -> Iterator[bytes]:
    """Chunks of a gzip file of one or many members, inflated once in order with bounded memory."""
    d, fresh = zlib.decompressobj(31), True
    while raw := read(CHUNK):
        while raw:
            out = d.decompress(raw, 4 * CHUNK)
            fresh = False
            if out:
                yield out
            raw = d.unconsumed_tail
            if d.eof:
                raw, d, fresh = d.unused_data, zlib.decompressobj(31), True
    while not fresh and (out := d.decompress(b"", 4 * CHUNK)):
        yield out
    if not (fresh or d.eof):
        raise ValueError("the gzip stream is cut short")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, whole record) of each record."""
    pull = _Pull(chunks)
    while (head := pull.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        yield headers, head + pull.exactly(int(headers["content-length"]) + 4)


def decide(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages + payload size and digest, record_type and refers_to.

    Among records with equal payloads of at least ``least`` bytes the one with the smallest page_id
    is the response and the others revisit it; each smaller one is a response. Rows that repeat
    that smallest id are responses too. A row without an id revisits if the group has an id.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html").cast("long"))
    groups = p.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k"))
    groups = groups.where("k > 1 and first is not null").select(F.col("digest").alias("group_digest"), "first")
    # short pages match nothing: a key of their own keeps a very common one from meeting in a task
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"), F.col("digest"))
    out = p.withColumn("__key", F.when(F.col("n") >= least, F.col("digest")).otherwise(own)).join(groups, F.col("__key") == F.col("group_digest"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, raw_size: int = 32 << 20) -> DataFrame:
    """Writes each task's records as monolithic gzip files of about ``raw_size`` inflated bytes.

    Returns (archive, records). A file gets a name of its own, so a repeated attempt of a task
    never touches another's file; only files that the returned table names count.
    """
    ship_package(pages.sparkSession)
    rows = decide(pages)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        out, done = None, []
        for r in (r for b in it for part in pieces(b) for r in part.to_pylist()):
            if out is None:
                name, raw, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out, z = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
            data = response_or_revisit(r["page_id"], r["url"], r["html"], r["digest"], r["kind"], r["refers_to"])
            out.write(z.compress(data))
            raw, n = raw + len(data), n + 1
            if raw >= raw_size:
                out.write(z.flush())
                out.close()
                out = None
                done.append((name, n))
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return rows.mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Inflates each archive once as a stream and writes every record as its own gzip member.

    Beside each new archive goes ``<name>.idx``, a JSON line for each record: offset and length of
    its member, type, target and id. Returns (archive, records) of the new folder. Memory holds one record.
    """
    ship_package(archives.sparkSession)

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (src, src_path), (dst, dst_path) = open_folder(source), open_folder(target)
        for b in it:
            for name in b.column(0).to_pylist():
                new, pos, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with src.open_input_stream(f"{src_path}/{name}", compression=None) as f, dst.open_output_stream(f"{dst_path}/{new}", compression=None) as out, dst.open_output_stream(f"{dst_path}/{new}.idx") as idx:
                    for headers, data in records(inflate(f.read)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        idx.write((json.dumps({"offset": pos, "length": len(member), "type": headers["warc-type"], "target": headers.get("warc-target-uri"), "id": headers["warc-record-id"]}) + "\n").encode())
                        pos, n = pos + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([n], pa.int64())], ["archive", "records"])

    return archives.select("archive").mapInArrow(rewrite, "archive string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record, fetched through the index, its size and digest checked against the payload."""
    ship_package(archives.sparkSession)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for b in it:
            for name in b.column(0).to_pylist():
                out = []
                with system.open_input_stream(f"{path}/{name}.idx") as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                with system.open_input_file(f"{path}/{name}") as f:
                    for e in index:
                        f.seek(e["offset"])
                        (headers, data), = records(iter([zlib.decompress(f.read(e["length"]), 31)]))
                        head, _, block = data.partition(b"\r\n\r\n")
                        payload = block[:-4].partition(b"\r\n\r\n")[2]
                        digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                        if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name} at {e['offset']}: payload does not match its digest")
                        page, first = headers.get("x-page-id"), headers.get("x-refers-to-page")
                        out.append((None if page is None else int(page), size, digest, headers["warc-type"], None if first is None else int(first)))
                cols = list(zip(*out)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("archive").mapInArrow(read, ROWS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back all pages: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html counts as empty. Repeated rows give repeated records; null ids and urls are kept;
    an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    first, second = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc")
    whole = materialize(write_archives(pages, first), "warc-whole-list")
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    parts = materialize(normalise(whole.repartition(max(tasks, int(whole.count()))), first, second), "warc-list")
    return read_archives(parts.repartition(max(tasks, int(parts.count()))), second)
