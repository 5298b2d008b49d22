"""WARC archives: a writer with revisit records and a splittable reader.

A record is one gzip member. Readers get byte ranges of the files; a task scans its
range for the gzip magic, decodes the beginning of a candidate member to see whether it is a
WARC header, and owns the records that start inside the range, reading on beyond its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import new_folder, written

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at a time.
CHUNK = 1 << 20

ARCHIVES = "path string, bytes long, records long"
RECORDS = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary, path string, at long, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header only, with the length of the payload it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packed.compress(whole) + packed.flush()


def write_warc(pages: DataFrame, at: str | None = None, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record per row of ``pages`` to files under the URI ``at``; returns the files (path, bytes, records).

    Of rows with equal payloads (by SHA-1; null is empty), those with the largest id are
    responses and the others, those without an id too, revisits of it; payloads that have no id at all are responses. Ids,
    digests and verdicts are joined without the payloads, which are shuffled once, by
    the distinct id. A task writes one file named after its attempt; the returned list,
    itself a table in the shared folder, has only files of attempts that succeeded.
    """
    spark = pages.sparkSession
    at = at or new_folder(spark, "warc")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    digest = F.sha1(body)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    ids = written(pages.select(F.col(id_column).cast("long").alias("page_id"), digest.alias("digest")).distinct(), "digests")
    newest = ids.groupBy("digest").agg(F.max("page_id").alias("newest"))
    revisits = ids.join(newest, "digest").filter("newest IS NOT NULL AND (page_id IS NULL OR page_id < newest)").select("page_id", F.col("digest").alias("_digest"), "newest")
    keyed = rows.withColumn("digest", F.sha1("body"))
    known = keyed["page_id"].eqNullSafe(revisits["page_id"]) & (keyed["digest"] == revisits["_digest"])
    joined = keyed.join(revisits, known, "left").select(keyed["page_id"], "url", "body", "digest", "newest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(at)
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        sink, records, size = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    store.create_dir(folder, recursive=True)
                    sink = store.open_output_stream(path, compression=None)
                hashed = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                member = record(row["page_id"], row["url"], row["body"], hashed, row["newest"], row["newest"] is not None)
                sink.write(member)
                size, records = size + len(member), records + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": records}], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return written(joined.mapInArrow(write, ARCHIVES), "archives")


class _Window:
    """Bytes of a file from a moving start on, read as they are asked for."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data = source, start, b""
        source.seek(start)

    def more(self) -> bool:
        got = self.source.read(CHUNK)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.start = self.data[n:], self.start + n

    def magic(self) -> int:
        """Distance to the next magic, -1 if the file has none."""
        searched = 0
        while (at := self.data.find(MAGIC, max(0, searched - 2))) < 0:
            searched = len(self.data)
            if not self.more():
                return -1
        return at


def _is_header(window: _Window) -> bool:
    """Whether the member at the window's start begins with a WARC version line."""
    unpack = zlib.decompressobj(31)
    if len(window.data) < 4096:
        window.more()
    try:
        return re.match(rb"WARC/\d", unpack.decompress(window.data[:4096], 16)) is not None
    except zlib.error:
        return False


def _member(window: _Window) -> tuple[bytes, int]:
    """The decoded member at the window's start and its length; checks its CRC."""
    unpack, out, at = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        if at >= len(window.data) and not window.more():
            raise EOFError("truncated member")
        out.append(unpack.decompress(window.data[at:]))
        at = len(window.data)
    return b"".join(out), at - len(unpack.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _parsed(whole: bytes) -> dict:
    head, _, rest = whole.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", warc.get(name, ""))) else None
    kind = warc.get("warc-type")
    revisit = kind == "revisit"
    return {
        "record_type": kind,
        "page_id": number("warc-record-id"),
        "url": warc.get("warc-target-uri"),
        "refers_to": number("warc-refers-to"),
        "payload_digest": warc.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(body),
        "payload_bytes": int(_fields(b"\r\n" + http.partition(b"\r\n")[2]).get("content-length", 0)) if revisit else len(body),
        "payload": None if revisit else body,
    }


def records_in(source, start: int, stop: int) -> Iterator[dict]:
    """Records that start in bytes ``start`` to ``stop`` of an open file, with ``at`` and ``error``.

    A member that looks like a record but can't be decoded gives a row with ``error`` alone,
    and the search goes on behind its magic.
    """
    window = _Window(source, start)
    while (skip := window.magic()) >= 0:
        window.drop(skip)
        if window.start >= stop:
            return
        if not _is_header(window):
            window.drop(1)
            continue
        at = window.start
        try:
            whole, length = _member(window)
            found = _parsed(whole)
        except (zlib.error, EOFError, ValueError, KeyError) as e:
            found, length = {"error": f"{type(e).__name__}: {e}"}, 1
        yield found | {"at": at}
        window.drop(length)


def read_warc(archives: DataFrame, split_bytes: int = 8 << 20, payload: bool = True) -> DataFrame:
    """Records of the files in ``archives`` (path, bytes), read in ranges of ``split_bytes``.

    Empty files have none. Without ``payload`` that column is null, and lengths and digests still
    come from the whole payload.
    """
    spark = archives.sparkSession
    splits = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("bytes", F.lit(1)) - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = splits.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with store.open_input_file(where) as source:
                    for found in records_in(source, start, start + split_bytes):
                        size += 200 + len(found.get("payload") or b"")
                        held.append(found | {"path": path} | ({} if payload else {"payload": None}))
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return ranges.mapInArrow(read, RECORDS)




#: SHA-1 in base32 from hexadecimal digits: 160 bits in 32 groups of five.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
     b AS (SELECT page_id, strlen(t) AS n, h, max(page_id) OVER (PARTITION BY h) AS newest,
                  array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + ('0x' || h[i])::INT), 4)), '') AS bits
           FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda k: bits[5 * i + k + 1]::INT * (16 >> k)))::INT]), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM b
"""
