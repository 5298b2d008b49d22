"""Bytes of files to text: decoding, DOCX, provider hooks for the formats that need them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import extractor

MOST_TEXT_BYTES = 4 << 20
#: Bytes of files that a task has in hand at a time; one larger file is a piece of its own.
PIECE_BYTES = 8 << 20
CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
SECTIONS = "object_id string, section_no int, page_number int, section string, text string, error string"


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes: a batch holds rows by number, however long they are."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            # rows of very different lengths: a slice is halved while it is too large
            waiting = [part]
            while waiting:
                part = waiting.pop()
                if part.num_rows > 1 and part.nbytes > 2 * most:
                    waiting += [part.slice(part.num_rows // 2), part.slice(0, part.num_rows // 2)]
                else:
                    yield part


def blobs(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Files under a path as ``path``, ``length`` and ``content``; larger ones are pruned before they are read."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= most_bytes).select("path", "length", "content")


def decoded(data: bytes) -> str:
    """UTF-8, else GB18030 with an exact round trip; control characters are refused."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("gb18030")
        if text.encode("gb18030") != data:
            raise ValueError("bytes don't survive a round trip") from None
    if CONTROL.search(text):
        raise ValueError("control characters")
    return text


def docx_text(data: bytes) -> str:
    """Runs of a DOCX body, a blank after each and a line break before each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if archive.getinfo("word/document.xml").file_size > MOST_TEXT_BYTES:
            raise ValueError("document XML is too large")
        with archive.open("word/document.xml") as stream:
            parts = []
            for event, node in ElementTree.iterparse(stream, events=("start", "end")):
                name = node.tag.rpartition("}")[2]
                if event == "start" and name == "p":
                    parts.append("\n")
                elif event == "end" and name == "t":
                    parts.append((node.text or "") + " ")
                    node.clear()
    text = "".join(parts)
    if len(text.encode()) > MOST_TEXT_BYTES or not text.strip():
        raise ValueError("no text, or too much")
    return text


#: A provider of pages of text: bytes to (page number or null, section, text) of each page.
Reader = Callable[[bytes], list[tuple[int | None, str, str]]]


def extracted(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Sections of files (object_id, mime_type, content); a file that can't be read is one row with ``error``.

    ``readers`` adds kinds (``pdf``, ``image``) that need a library or a service; without
    one these are ``unsupported``. Texts in UTF-8 are checked and decoded in the JVM and pass a task as whole Arrow columns; only the
    other files are read one by one.
    """
    known: dict[str, Reader] = {"text": lambda b: [(None, "", decoded(b))], "docx": lambda b: [(None, "", docx_text(b))]} | (readers or {})
    fields = [("object_id", pa.string()), ("section_no", pa.int32()), ("page_number", pa.int32()), ("section", pa.string()), ("text", pa.string()), ("error", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            plain = batch.column("plain").is_valid()
            if plain.true_count:
                some, n = batch.filter(plain), plain.true_count
                columns = [some.column("object_id"), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array([""] * n), some.column("plain"), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[x for x, _ in fields])
            rest, out = batch.filter(pc.invert(plain)), []
            for key, kind, content in zip(*(rest.column(i).to_pylist() for i in range(3)), strict=True):
                row = dict.fromkeys([n for n, _ in fields]) | {"object_id": key}
                try:
                    if kind not in known:
                        raise LookupError("unsupported file type")
                    pages = known[kind](content or b"")
                    out += [row | {"section_no": i, "page_number": p, "section": s, "text": t} for i, (p, s, t) in enumerate(pages)]
                except LookupError:
                    out.append(row | {"error": "unsupported"})
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    out.append(row | {"error": f"invalid: {type(e).__name__}"})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    kind, text = extractor(F.col("mime_type")), F.coalesce(F.col("content"), F.lit(b"")).cast("string")
    fits = (kind == "text") & F.lit("text" not in (readers or {})) & F.is_valid_utf8(text) & ~text.rlike(CONTROL.pattern)
    rows = files.select("object_id", kind.alias("kind"), F.when(~fits, F.col("content")).alias("content"), F.when(fits, text).alias("plain"))
    return rows.mapInArrow(read, SECTIONS)
