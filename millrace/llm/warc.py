"""WARC archives: monolithic gzip files, rewritten to one member a record with a sidecar offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, partitions, small, table, utf8, work_dir, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a task starts the next archive; bytes read from a store at once.
ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 20


def opened(uri: str):
    """The file system of a URI and the path in it; works for every store pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page is None else page}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file read once, whatever its members, in pieces of at most CHUNK bytes however well they pack."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            begun = True
            piece = z.decompress(data, CHUNK)
            if piece:
                yield piece
            data = z.unused_data if z.eof else z.unconsumed_tail
    while begun and not z.eof and (piece := z.decompress(z.unconsumed_tail, CHUNK)):
        yield piece
    if begun and not z.eof:
        raise ValueError("the gzip stream ends early")


def lines(stream) -> Iterator[bytes]:
    """The lines of a stream, read in pieces of CHUNK bytes."""
    rest = b""
    while data := stream.read(CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and bytes of each record in a run of plain WARC bytes; holds one record at a time."""
    buf, want, fields = bytearray(), 0, None
    for chunk in chunks:
        buf += chunk
        at = 0
        while True:
            if fields is None:
                end = buf.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = parse_head(bytes(buf[at:end]))
                want = end - at + 4 + int(fields["content-length"]) + 4
            if len(buf) - at < want:
                break
            yield fields, bytes(buf[at : at + want])
            at += want
            fields = None
        del buf[:at]
    if buf:
        raise ValueError("the archive ends inside a record")


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def marked(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int, folder: str) -> DataFrame:
    """Pages with ``p`` (payload) and ``r``: the page whose equal payload stands for this one's, else null.

    Only digests and ids are grouped: payloads stay where they are, unless so many digests repeat that their list is
    joined by shuffle. Digests of 160 bits and the payload's length stand for the payload.
    """
    pages, (id_, url, html) = numbered(pages, id_col, url_col, html_col)
    src = pages.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), F.coalesce(utf8(html), F.lit(b"")).alias("p"))
    src = src.withColumn("h", F.when(F.length("p") >= least, F.unhex(F.sha1("p"))))
    again = src.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("f"), F.max("id").alias("l")).where("f < l").drop("l")
    again = small(written(again, f"{folder}-again"), 6)
    return src.join(again, "h", "left").select("id", "u", "p", F.when(F.col("f") < F.col("id"), F.col("f")).alias("r"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes monolithic ``.warc.gz`` files below ``folder``; rows (path, n_records).

    A page whose payload of at least ``least`` bytes equals that of a page with a smaller id becomes a revisit of
    the smallest such page. Null payloads and URLs are empty; rows without an id are responses; rows that repeat
    an id and payload get a record each; an empty table writes no file. Names are unique to the attempt: the listing,
    written once, names the files of the attempts that succeeded.
    """

    def run(batches):
        out, path, n, size, z = None, "", 0, 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    fs, base = opened(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out, z, n, size = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = make_record(*row)
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield listing([(path, n)])
        if out is not None:
            out.write(z.flush())
            out.close()
            yield listing([(path, n)])

    def listing(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["path", "n_records"])

    return written(marked(pages, id_col, url_col, html_col, least, folder).mapInArrow(run, "path string, n_records bigint"), f"{folder}-list")


def _each_file(listed: DataFrame) -> DataFrame:
    """One task a file, up to four for each shuffle partition."""
    n = listed.count()
    return listed.repartition(max(1, min(n, 4 * partitions(listed.sparkSession))), F.monotonically_increasing_id()) if n > 1 else listed


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives record by record; rows (path, index_path, n_records).

    Each file is inflated once as a stream, each record written as a gzip member of its own, and a sidecar of
    JSON lines tells offset, length, type and id of each. An empty list gives none, an empty file an archive without
    records; a null path is passed over.
    """

    def run(batches):
        for batch in batches:
            for src in filter(None, batch.column(0).to_pylist()):
                fs, at = opened(src)
                to, base = opened(folder)
                to.create_dir(base, recursive=True)
                name, offset, n = uuid.uuid4().hex, 0, 0
                with fs.open_input_stream(at, compression=None) as f, to.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out, to.open_output_stream(f"{base}/{name}.idx") as idx:
                    for fields, data in records(inflate(f)):
                        packed = member(data)
                        out.write(packed)
                        idx.write(json.dumps({"offset": offset, "length": len(packed), "type": fields["warc-type"], "id": fields["warc-record-id"], "digest": fields.get("warc-payload-digest")}).encode() + b"\n")
                        offset, n = offset + len(packed), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([f"{folder}/{name}.idx"]), pa.array([n], pa.int64())], names=["path", "index_path", "n_records"])

    return written(_each_file(archives.select("path")).mapInArrow(run, "path string, index_path string, n_records bigint"), f"{folder}-list")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record, found through the sidecar index: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    A response's payload is measured and digested anew and must agree with its header. A page without an id has a null
    page_id; an empty list of archives gives no rows.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def read(f, entry: dict) -> tuple:
        f.seek(entry["offset"])
        data = zlib.decompress(f.read(entry["length"]), 31)
        head, _, block = data.partition(b"\r\n\r\n")
        fields = parse_head(head)
        payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
        said, size, ref = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]), fields.get("x-refers-to-page")
        if fields["warc-type"] == "response" and (size != len(payload) or said != base32_sha1(payload)):
            raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
        page = fields["x-page-id"]
        row = (int(page) if page else None, size, said, fields["warc-type"], int(ref) if ref else None)
        return (*row, payload if ref is None else None) if with_payload else row

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = opened(path)
                with fs.open_input_file(at) as f, fs.open_input_stream(opened(index)[1]) as idx:
                    rows, size = [], 0
                    for line in lines(idx):
                        rows.append(read(f, json.loads(line)))
                        size += rows[-1][1] if with_payload else 0
                        if len(rows) == 1000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    kinds = ["bigint", "bigint", "string", "string", "bigint", *["binary"] * with_payload]
    return _each_file(archives.select("path", "index_path")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    mono = write_archives(table(spark, sf_dir, "pages"), f"{folder}/mono")
    return read_archives(normalise(mono, f"{folder}/records"), with_payload=False)


def _digit(i: int) -> str:
    """SQL of the i-th base-32 digit: bits 5i to 5i+4 of the hexadecimal digest."""
    return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, {5 * i // 4 + 1}, 2) AS INTEGER) >> {8 - 5 * i % 4 - 5}) & 31 AS INTEGER) + 1, 1)"


OP9_SQL = f"""
WITH s AS (SELECT page_id, COALESCE(html, '') AS p, sha1(COALESCE(html, '')) || '0' AS x FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, {" || ".join(map(_digit, range(32)))} AS payload_digest FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to
FROM (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
"""
