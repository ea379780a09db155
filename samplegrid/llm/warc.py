"""WARC archives and the normaliser of monolithic gzip streams.

write_archives() puts one record per page into whole-file gzip streams (one member over all records of a partition), as
careless crawlers do. normalise() inflates each such stream once, in bounded pieces, rewrites every record as a gzip
member of its own and returns the sidecar offset index. read_records() opens records by that index alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.bpe import slices
from samplegrid.llm.common import BROADCAST_ROWS, by_key, materialize, scratch_path

#: Payloads of so many bytes at least are stored once; later copies become revisit records.
REVISIT_BYTES = 1000
PIECE = 1 << 20
#: A gzip level that keeps the two passes cheap.
LEVEL = 1


class File:
    """An output file under a temporary name that gets its own when it is whole, so a repeated task does no harm."""

    def __init__(self, folder: str, name: str):
        self.fs, path = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.temp = f"{path}/{name}", f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out, self.at = self.fs.open_output_stream(self.temp), 0

    def write(self, data: bytes) -> None:
        self.at += self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A WARC/1.1 record; a revisit has no block, its payload is described by its headers."""
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {'' if url is None else url.encode('unicode_escape').decode()}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def take_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of bytes, by Content-Length; holds one record and one piece."""
    data = bytearray()
    need, head = 0, None
    for chunk in chunks:
        data += chunk
        while True:
            if head is None:
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = headers(bytes(data[:end]))
                need = end + 8 + int(head["Content-Length"])
            if len(data) < need:
                break
            yield head, bytes(data[:need])
            del data[:need]
            head = None
    if data:
        raise ValueError("a WARC stream ends within a record")


def inflate(file, size: int = PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of at most `size` bytes."""
    z, ended = zlib.decompressobj(31), True
    while data := file.read(size):
        while data:
            yield z.decompress(data, size)
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                z, ended = zlib.decompressobj(31), True
            else:
                ended = False
    if not ended:
        raise ValueError("a gzip stream ends within a member")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, record_type and refers_to. Of equal payloads of at least `least`
    bytes the largest page_id is the response (null ids never are, unless all are null). Only digests that occur twice or
    more are joined back: by a broadcast if there are few, else by a shuffle that leaves hot digests out, so that the pages of one payload
    never meet in one task."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "utf-8")))
    size = F.octet_length("html")
    first = rows.where(size >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "first")
    digests, total = first.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if digests <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(first.drop("n")), "payload_digest", "left")
    else:
        out = by_key(rows.where(size >= least), first, "payload_digest", total, "left").unionByName(rows.where(size < least).withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (size >= least)
    return out.select(
        "page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one monolithic gzip file per partition of revisits()' rows; returns (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, name = None, 0, f"crawl-{TaskContext.get().partitionId():05d}.warc.gz"
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")), strict=True):
                    out = out or File(folder, name)
                    out.write(z.compress(record(row[0], row[1], row[2].encode(), *row[3:])))
                    n += 1
        if out:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return pages.mapInArrow(run, "file string, records long")


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each file of files(file) from folder source to folder target, one gzip member a record; returns the index
    (file, offset, length, record_type, record_id). A stream that is cut off or broken keeps the records before the fault, and
    has one more row of type error, without a length, whose record_id is the fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(source)
                out, rows = File(target, name), []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as file:
                    try:
                        for head, whole in take_records(inflate(file)):
                            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            at = out.at
                            out.write(z.compress(whole) + z.flush())
                            rows.append((name, at, out.at - at, head["WARC-Type"], head["WARC-Record-ID"]))
                    except (ValueError, KeyError, zlib.error) as fault:
                        rows.append((name, out.at, None, "error", str(fault)))
                out.close()
                for k in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[k : k + 10_000], strict=True))
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "offset", "length", "record_type", "record_id"])

    return files.select("file").mapInArrow(run, "file string, offset long, length long, record_type string, record_id string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to, url) of each index row, from the archives.

    The digest of a response is computed from its block and checked against its header; a revisit has it in its header.
    Rows of type error are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if f != name:
                    name, file = f, fs.open_input_file(f"{path}/{f}")
                whole = zlib.decompress(file.read_at(length, offset), 31)
                head = headers(whole[: whole.index(b"\r\n\r\n")])
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                if head["WARC-Type"] == "response":
                    block = whole[len(whole) - 4 - size : len(whole) - 4]
                    if hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"{f} at {offset}: the payload fails its digest")
                out.append((head["WARC-Record-ID"], head["WARC-Type"], size, digest, head.get("WARC-Refers-To"), head["WARC-Target-URI"]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url"])

    return index.where("record_type <> 'error'").mapInArrow(run, "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string")


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Writes pages(page_id, url, html, ...) as archives and normalises them; returns the index and the folder.

    Null html is an empty payload, null urls and ids are written as such; repeated rows give a record each, other columns
    are not read, an empty table gives no files."""
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "crawl"), scratch_path(spark, "warc")
    files = materialize(write_archives(revisits(pages), raw), "files")
    # one task a file, dealt round robin: files are the unit of work
    count = max(1, files.count())
    index = materialize(normalise(files.repartition(count), raw, target), "index")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(raw)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return index, target
