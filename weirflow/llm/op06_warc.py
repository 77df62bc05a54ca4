"""A dictionary-compressed WARC writer and its reader.

A Zstandard dictionary is built from a bounded sample of the records. Every
archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, so an archive needs nothing beside it, and every record is a frame
of its own, so one record can be read by its offset. Of records with equal
payloads the one with the largest page_id is a response; the others become
revisits that refer to it. Every record has an id of its own.

Archives are written by the executors straight to the folder given (any file
system that pyarrow knows by URI), in parts of about `archive_bytes`. A file is
named by its task attempt and only the index that a task returns says that it
exists: what a lost or repeated attempt leaves behind is never read. The index
(page, archive, offset, length) is a small table, stored before any reading.

Defined results: a null payload is an empty one; rows with one page_id and one
payload are the same page and take the same record type; null ids are written
as an empty id and read as null, and a group of only null ids is all responses;
an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, new_path, stored, table

#: Fixed value: the skippable frame that a dictionary in front of WARC records uses.
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed value: the profile of revisits by payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A field of ours: the size of the payload that a revisit leaves out.
SIZE_FIELD = "Payload-Length"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, uri: str | None, date: str, payload_digest: str, size: int, payload: bytes, refers_to=None, place: str = "") -> bytes:
    """One WARC record; payload is empty for a revisit. `place` tells apart records of one page and address."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {place}')}>",
        f"WARC-Date: {date}",
        # A line break in an address would end the field.
        f"WARC-Target-URI: {' '.join((uri or '').split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"{SIZE_FIELD}: {size}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, names in lower case, and its content."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record is cut short")
    return fields, rest[:size]


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from sample records, empty where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


class ArchiveWriter:
    """Archives of one task: a dictionary frame, then a frame a record."""

    def __init__(self, folder: str, name: str, dictionary: bytes, archive_bytes: int, level: int):
        self.fs, self.path = _file_system(folder)
        self.folder, self.name, self.dictionary, self.most = folder.rstrip("/"), name, dictionary, archive_bytes
        self.compressor, self.out, self.n = _compressor(dictionary, level), None, 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        """(archive, offset, length) of the record's frame."""
        if self.out is None:
            self.file = f"{self.name}-{self.n:05d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.path.rstrip('/')}/{self.file}", compression=None)
            self.at = self.out.write(dictionary_frame(self.dictionary))
            self.n += 1
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        at, self.at = self.at, self.at + len(frame)
        found = (f"{self.folder}/{self.file}", at, len(frame))
        if self.at >= self.most:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of an archive, in order, with nothing but the archive."""
    for _, _, raw in scan_archive(uri):
        yield parse(raw)


def scan_archive(uri: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) by reading frame after frame: at any time one
    record and one block of the file are in memory."""
    fs, path = _file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError("no dictionary frame")
        decompressor = _decompressor(f.read(size))
        at, rest = 8 + size, b""
        while True:
            frame, out = decompressor.decompressobj(), []
            used = 0
            while not frame.eof:
                block = rest or f.read(1 << 20)
                rest = b""
                if not block:
                    if used:
                        raise ValueError("an archive is cut short")
                    return
                out.append(frame.decompress(block))
                used += len(block)
            rest = frame.unused_data
            used -= len(rest)
            yield at, used, b"".join(out)
            at += used


def deduplicated(pages: DataFrame, payload: str = "html", page_id: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """pages with __size, __digest (hex) and __of: the largest page_id among
    rows of equal payload, null where the payload is smaller than least_bytes.
    Digests and sizes are compared, not payloads; the largest id of a payload
    comes from an aggregation that combines before the shuffle."""
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    sized = pages.withColumns({"__size": F.octet_length(data).cast("bigint"), "__digest": F.sha1(data)})
    groups = sized.where(F.col("__size") >= least_bytes).groupBy("__digest", "__size").agg(F.max(page_id).alias("__of"), F.count("*").alias("__n"))
    groups = groups.where("__n > 1").select(F.col("__digest").alias("__d2"), F.col("__size").alias("__s2"), "__of")
    return sized.join(groups, (F.col("__digest") == F.col("__d2")) & (F.col("__size") == F.col("__s2")), "left").drop("__d2", "__s2")


def write_archives(
    pages: DataFrame, folder: str, payload: str = "html", page_id: str = "page_id", uri: str = "url", date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0, sample_records: int = 400, sample_bytes: int = 1 << 16, archive_bytes: int = 1 << 28, level: int = 6,
) -> DataFrame:
    """Write all rows as records and return the stored index: page_id, archive,
    offset, length. The dictionary learns from sample_records payloads of at
    most sample_bytes each (documented bounds), drawn by hash."""
    spark = pages.sparkSession
    data = F.col(f"`{payload}`").cast("binary")
    short = pages.where(F.octet_length(data).between(1, sample_bytes)).select(F.col(f"`{page_id}`").alias("i"), F.col(f"`{uri}`").alias("u"), data.alias("d"))
    sample = sorted(drawn(short, F.xxhash64("d", "i"), sample_records).collect(), key=lambda r: r["__h"])
    samples = [record("response", r.i, r.u, date, digest(bytes(r.d)), len(r.d), bytes(r.d)) for r in sample]
    shared = spark.sparkContext.broadcast(train_dictionary(samples))  # 64 KB at any size
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    kind = pages.schema[page_id].dataType.simpleString()

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}", shared.value, archive_bytes, level)
        nth = 0
        for batch in batches:
            found = []
            for page, address, body, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = body or b""
                revisit = of is not None and page is not None and of != page
                # A row without an id refers to the response of its payload like any other.
                revisit = revisit or (of is not None and page is None)
                raw = record("revisit" if revisit else "response", page, address, date, digest(body), len(body), b"" if revisit else body, of, f"{context.partitionId()}/{nth}")
                nth += 1
                found.append((page, *writer.add(raw)))
            ids = pa.array([x[0] for x in found], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())], names=["page_id", "archive", "offset", "length"])
        writer.close()

    rows = deduplicated(pages, payload, page_id, least_bytes).select(F.col(f"`{page_id}`"), F.col(f"`{uri}`"), data, "__of")
    return stored(rows.mapInArrow(write, f"page_id {kind}, archive string, offset bigint, length bigint"), "warc-index")


def read_records(index: DataFrame, kind: str = "bigint") -> DataFrame:
    """One row a record, read back from the archives that the index names:
    page_id, uri, record_type, refers_to, payload_bytes, payload_digest and
    whether the digest of a response is that of its content. Each archive is
    read whole by one task, record after record, and there are as many tasks as
    archives (a number that is given is not made smaller for few bytes)."""
    archives = index.groupBy("archive").agg(F.count("*").alias("records"))
    tasks = max(1, index.select("archive").distinct().count())

    def read(batches):
        for batch in batches:
            for uri, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, n = [], 0
                for fields, content in read_archive(uri):
                    n += 1
                    size, stated = int(fields[SIZE_FIELD.lower()]), fields["warc-payload-digest"].removeprefix("sha1:")
                    response = fields["warc-type"] == "response"
                    if response and (len(content) != size or digest(content) != stated):
                        raise ValueError(f"a record of {uri} has another payload than it says")
                    rows.append((fields["page-id"] or None, fields["warc-target-uri"], fields["warc-type"], None if response else fields["refers-to-page"], size, stated))
                    if len(rows) == 4096:
                        yield batch_of(rows)
                        rows = []
                if n != records:
                    raise ValueError(f"{uri} holds {n} records, {records} were written")
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(columns)], names=["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    found = archives.repartition(tasks).mapInArrow(read, "page_id string, uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string")
    return found.withColumns({x: F.col(x).cast(kind) for x in ("page_id", "refers_to")})


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = write_archives(pages, new_path(spark, "warc"))
    return read_records(index, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (
    SELECT page_id, html, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
            (CAST(concat('0x', substr(concat(sha1(html), '0000000000'), 1 + CAST(10 * (k // 8) AS INTEGER), 10)) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31)) AS INTEGER), 1), '' ORDER BY k)
        FROM range(32) t(k)) AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM sized
"""
