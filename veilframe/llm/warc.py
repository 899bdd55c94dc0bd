"""WARC archives of pages, each record compressed alone with a shared dictionary.

An archive is a series of Zstandard frames: a skippable frame with the
dictionary first, then a frame for each record.  Spark's text writer puts the
frames into files, so any store that Spark writes to will do and a retried task
leaves no half archive.  Its line separator is an empty skippable frame, which
decoders pass over.  Each row of the writer is a whole archive of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import struct
import warnings
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import col, saved

#: First bytes of the dictionary's frame, of any skippable frame
#: (the low four bits are free), of a frame with data and of a dictionary.
DICTIONARY_FRAME, SKIPPABLE, DATA_FRAME, DICTIONARY = 0x184D2A5D, 0x184D2A50, 0xFD2FB528, 0xEC30A437
#: An empty skippable frame, between the other frames.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
#: Payloads of fewer bytes are never replaced by a reference.
LEAST_REVISIT = 100
#: The dictionary: its size, and at most so many records of at most so many characters to learn from.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_CHARS = 64 << 10, 1000, 50_000
#: Lengths of the pieces that records are cut into where they are too few to learn from whole.
PIECES = (1024, 128)
#: An archive is closed once it has so many bytes; a reader holds one archive at a time.
ARCHIVE_BYTES = 32 << 20
#: Compressed bytes that the reader looks at at a time.
STEP = 16 << 10
#: Fixed value of the format: the profile of a record that refers to an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "id string, url string, html binary, digest string, first string"
READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def record_id(page: str | None, digest: str) -> str:
    """A URI from page id and payload; a null id is `-`."""
    return f"<urn:page:{'-' if page is None else '=' + quote(page, safe='')}:{digest[:32]}>"


def _page_of(uri: str) -> str | None:
    page = uri.strip("<>").split(":")[2]
    return None if page == "-" else unquote(page[1:])


def record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """One record: a response, or where `first` names another page, a revisit of it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%|\\^`{}<>\""))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        lines += [f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; the payload's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _page_of(refers) if refers else None, "payload": payload if kind == "response" else None,
    }


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; where they are few, from ever shorter pieces of them.

    Empty, with a warning, where even those are too few: a short record on its own.
    """
    for size in (None, *PIECES):
        pieces = samples if size is None else [s[i : i + size] for s in samples for i in range(0, len(s), size)]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=3).as_bytes()
        except zstandard.ZstdError:
            continue
    if samples:
        warnings.warn(f"{len(samples)} different pages are too little to learn a dictionary from; the archives have none", stacklevel=2)
    return b""


def build_dictionary(pages: DataFrame, html: str) -> bytes:
    """A dictionary from a bounded sample of different records.

    The sample is up to SAMPLE_ROWS different pages with small hashes among those of up
    to SAMPLE_CHARS characters, the same on every run and however often a page is there.
    The hash is first held against a share of the different pages, so that sorting meets
    few of them however large the table is.
    """
    fitting = pages.select(col(html).alias("t")).filter(F.length("t").between(1, SAMPLE_CHARS)).withColumn("h", F.xxhash64("t"))
    distinct = fitting.agg(F.approx_count_distinct("h").alias("n")).first().n
    share = min(1.0, 4 * SAMPLE_ROWS / max(1, distinct))
    some = fitting.filter(F.col("h") <= int(-(1 << 63) + share * ((1 << 64) - 4096)))
    chosen = some.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(SAMPLE_ROWS)
    return train([record("0", "http://example.com/", r.t.encode(), "0" * 64, None, "2000-01-01T00:00:00Z") for r in chosen.collect()])


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z"
) -> None:
    """Write one record per row to the archives in the folder `path`.

    The payload is the page in UTF-8, empty for null.  Of rows with equal payloads
    of at least LEAST_REVISIT bytes the smallest page id is the response and
    other ids refer to it; shorter ones are all responses.  Rows that repeat the
    smallest id are responses too.  Null ids come last: one refers to the
    smallest id, and where equal payloads have no id at all, all are responses.
    Bytes of an address that a header can't hold are percent-encoded; a null
    address leaves its header out.  Other columns are not archived.
    An archive ends with the record that takes it to ARCHIVE_BYTES; a page must fit in
    a row, as it does in `pages`.  An empty table gives a folder without records.
    """
    words = build_dictionary(pages, html)
    opening = struct.pack("<II", DICTIONARY_FRAME, len(words)) + words
    rows = pages.select(
        col(page_id).alias("id"), col(url).alias("url"), F.coalesce(col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    long_ones = rows.filter(F.octet_length("html") >= LEAST_REVISIT)
    first = saved(long_ones.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-pages")
    referring = rows.join(first, "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", F.encode("html", "UTF-8").alias("html"), "digest",
        F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).cast("string").alias("first"),
    )

    def archives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        frames = [opening] if words else []
        empty = size = sum(map(len, frames))
        for batch in batches:
            for row in zip(*batch.columns):
                frames.append(packer.compress(record(*[v.as_py() for v in row], date)))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array([b"".join(frames)], pa.binary())], ["archive"])
                    frames, size = frames[:1] if words else [], empty
        if size > empty:
            yield pa.record_batch([pa.array([b"".join(frames)], pa.binary())], ["archive"])

    made = referring.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of one archive, one at a time."""
    view, at, words = memoryview(archive), 0, None
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & ~0xF == SKIPPABLE:
            size = struct.unpack_from("<I", view, at + 4)[0]
            if magic == DICTIONARY_FRAME:
                raw = bytes(view[at + 8 : at + 8 + size])
                if raw[:4] == struct.pack("<I", DATA_FRAME):  # a dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                words = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        frame, parts = zstandard.ZstdDecompressor(dict_data=words).decompressobj(), []
        while not frame.eof:
            step = view[at : at + STEP]
            if not step:
                raise ValueError("the last record of an archive is cut off")
            parts.append(frame.decompress(step))
            at += len(step) - len(frame.unused_data)
        yield b"".join(parts)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record: page_id and refers_to as text, url, payload_bytes,
    payload_digest, record_type and, if asked for, the payload of responses.

    Sizes and digests are those of the full payload, for revisits too.
    A damaged record is an error.  A folder without records gives no rows.
    """

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in READ.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for data in unpack(content.as_py()):
                    found = parse(data)
                    found["payload"] = found["payload"] if payload else None
                    held.append(found)
                    size += 500 + len(found["payload"] or b"")
                    if size >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, READ)
