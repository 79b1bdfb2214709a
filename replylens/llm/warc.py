"""WARC archives that are written with an index and read back by coalesced byte ranges.

Every record is one gzip member. While archives are written, an index row is kept per record:
file, offset, length, url, digest and type. A reader selects index rows first; the
selected records of a file, sorted by offset, are merged into ranges where little lies between
them, each range is read once, and the records are cut out of it.

Of records with equal payloads of at least `REVISIT_BYTES`, the one with the largest page_id is
the response and the others are revisits, which keep the response's headers but no payload.

Cases: null html is an empty payload; a null url or page_id is left out of the header. A null
page_id is never the largest, unless all are null. Rows that share the largest page_id and the payload are
responses all. An empty table gives no archive and an empty index. Very long payloads
are records like others. Columns other than page_id, url and html are not read.

A task names its archives after itself and its attempt. Only index rows that Spark commits
refer to an archive, so archives of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replylens.llm.common import scratch_path, stored
from replylens.session import join_bounded

REVISIT_BYTES = 1000
# bytes after which an archive is closed and the next begun
ARCHIVE_BYTES = 64 << 20
# unselected bytes that are read rather than starting another range, and the longest range
GAP_BYTES = 64 << 10
# bytes that a task reads back, about
TASK_BYTES = 64 << 20
RANGE_BYTES = 4 << 20

INDEX = "file string, offset long, length long, url string, digest string, page_id long, type string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def one_line(value: str) -> str:
    """A header value; what would end the line is percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in value for c in "%\r\n") else value


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. `refers_to` makes it a revisit."""
    head = HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}:{digest.hex()}')}"
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {one_line(url)}")
    if refers_to is not None:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """The fields of a record, its payload checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its record")
    page = headers["WARC-Record-ID"].strip("<>")
    refers = headers.get("WARC-Refers-To")
    url = headers.get("WARC-Target-URI")
    return {
        "page_id": int(page.removeprefix("urn:page:")) if page.startswith("urn:page:") else None,
        "url": url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if url is not None else None,
        "payload_bytes": size,
        "payload_digest": digest.hex(),
        "record_type": headers["WARC-Type"],
        "refers_to": int(refers.strip("<>").removeprefix("urn:page:")) if refers else None,
        "payload": payload if headers["WARC-Type"] == "response" else None,
    }


def _writer(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for mapInArrow over (page_id, url, payload, digest, refers_to): archives out, index rows back."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        context = TaskContext.get()
        number, sink, name, at = 0, None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if sink is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                        files.create_dir(base, recursive=True)
                        sink, at = files.open_output_stream(f"{base}/{name}", compression=None), 0
                    member = record(row["page_id"], row["url"], row["payload"], bytes.fromhex(row["digest"]), row["refers_to"])
                    sink.write(member)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    index.append((name, at, len(member), row["url"], row["digest"], row["page_id"], kind))
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        sink.close()
                        sink, number = None, number + 1
                if index:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    arrays = [pa.array(list(c), k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["file", "offset", "length", "url", "digest", "page_id", "type"])
        finally:
            if sink is not None:
                sink.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per page below `folder`; returns the stored index."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = F.octet_length("payload") >= REVISIT_BYTES
    first = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # one row per repeated payload; payloads are not shuffled if these are few
    with_first = join_bounded(rows, first, ["digest"], "left")
    # a revisit has to name a response
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to")
    dealt = with_first.select("page_id", "url", "payload", "digest", refers)
    return stored(dealt.mapInArrow(_writer(folder), INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = GAP_BYTES, longest: int = RANGE_BYTES) -> DataFrame:
    """(file, records): the selected records of a file whose bytes are read at once, by offset.

    A window is one archive, whose size is bounded.
    """
    by_offset = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.struct("offset", (F.col("offset") + F.col("length")).alias("end"))).over(by_offset)
    cell: Callable[[Column], Column] = lambda offset: F.floor(offset / F.lit(longest))
    begins = before.isNull() | (F.col("offset") - before["end"] > gap) | (cell(F.col("offset")) != cell(before["offset"]))
    numbered = index.withColumn("begins", begins.cast("int")).withColumn("range", F.sum("begins").over(by_offset))
    return numbered.groupBy("file", "range").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).select("file", "records")


def _reader(folder: str, with_payload: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    kinds += [("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                records = row["records"]
                low, high = records[0]["offset"], max(r["offset"] + r["length"] for r in records)
                with files.open_input_file(f"{base}/{row['file']}") as source:
                    source.seek(low)
                    data = source.read(high - low)
                found = [parsed(data[r["offset"] - low : r["offset"] - low + r["length"]]) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in kinds], names=[n for n, _ in kinds])

    return read


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the index rows given; the payload of a revisit is null."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # a row of a few bytes stands for megabytes to read, so tasks are dealt by those
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = ranges(index).repartition(tasks, "file", F.col("records")[0]["offset"])
    return dealt.mapInArrow(_reader(folder, with_payload), schema + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write all pages to fresh archives in the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, with_payload)
