"""WARC archives of pages, with equal payloads stored once and revisited by the other records.

Three jobs over a folder of archives, each with a manifest that names the archives that count:

1. ``write_archives``: a response record for each page, every record a gzip member of its own.
2. ``deduplicate``: the headers alone are read and dealt by payload digest; the first page of a payload is its original,
   every other record becomes a revisit of it. Each archive is then read and written again, record by record.
3. ``read_records`` and ``resolve``: records as rows, revisits joined with the responses they refer to.

Tasks stream: one record is in memory at a time. Each attempt of a task writes archives of names of its own, and the
manifest is committed by Spark, so an attempt that was lost or repeated leaves files that no reader opens.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paypulse.llm.shared import cut, join_sized, ship_package, shuffle_partitions

#: A task begins a new archive beyond so many compressed bytes.
ARCHIVE_BYTES = 128 * 1024 * 1024
#: Bytes read of an archive at a time, and of payloads held for one batch of rows.
READ_BYTES, BATCH_BYTES = 1 << 16, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_VERSION = b"WARC/1.1"
_MANIFEST = "archive string, records long, bytes long"
_RECORD = (
    "archive string, position long, record_type string, record_id string, page_id long, url string, date string, "
    "payload_digest string, payload_sha256 string, payload_bytes long, refers_to_id string, payload binary"
)
_ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind])
                    for name, kind in (field.split() for field in _RECORD.split(", "))])


class Record(NamedTuple):
    """A record's header fields and its block."""

    fields: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record: Record) -> bytes:
    """A record as one gzip member. Line breaks can't get into a field."""
    lines = [f"{k}: {re.sub('[\r\n]+', ' ', v)}".encode() for k, v in record.fields.items()]
    head = b"\r\n".join([_VERSION, *lines, f"Content-Length: {len(record.block)}".encode(), b"", b""])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(record.block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _members(file: BinaryIO) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one after the other."""
    data, parts, packer = file.read(READ_BYTES), [], zlib.decompressobj(31)
    while data:
        parts.append(packer.decompress(data))
        if packer.eof:
            yield b"".join(parts)
            data, parts, packer = packer.unused_data, [], zlib.decompressobj(31)
        else:
            data = b""
        data = data or file.read(READ_BYTES)
    if parts:
        raise ValueError("an archive ends inside a record")


def decode_records(file: BinaryIO) -> Iterator[Record]:
    """The records of an archive with a gzip member for each record."""
    for member in _members(file):
        head, _, rest = member.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields.pop("Content-Length"))
        if not version.startswith("WARC/") or len(rest) < length:
            raise ValueError("not a WARC record")
        yield Record(fields, rest[:length])


def _location(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def _open(uri: str) -> BinaryIO:
    files, path = _location(uri)
    return files.open_input_stream(path, compression=None)


class _Writer:
    """Archives of one attempt of a task; ``close`` gives their rows of the manifest."""

    def __init__(self, folder: str, partition: int, limit: int):
        self.prefix, self.limit = f"{folder}/archives/part-{partition:06}-{uuid.uuid4().hex}", limit
        self.done: list[tuple[str, int, int]] = []
        self.file, self.records, self.size = None, 0, 0

    def add(self, data: bytes) -> None:
        if self.file is not None and self.size + len(data) > self.limit:
            self._end()
        if self.file is None:
            self.uri = f"{self.prefix}-{len(self.done):04}.warc.gz"
            files, path = _location(self.uri)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            self.file, self.records, self.size = files.open_output_stream(path, compression=None), 0, 0
        self.file.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)

    def _end(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.uri, self.records, self.size))
            self.file = None

    def close(self) -> pa.RecordBatch:
        self._end()
        names, records, sizes = zip(*self.done, strict=True) if self.done else ((), (), ())
        columns = [pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["archive", "records", "bytes"])


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _response(record_id: str, page_id: int | None, url: str | None, date: str, payload: bytes) -> Record:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = url
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    fields |= {"WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "application/http; msgtype=response"}
    return Record(fields, http + payload)


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    date: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a response record for each row of ``pages`` below ``folder``; returns the manifest (archive, records, bytes).

    The payload is the text in UTF-8, a null one is empty. ``date`` is the capture date of all records, by default now. A
    null id or url leaves its field out. Repeated rows get a record each. An empty table gives no archive and an empty
    manifest. Other columns are not read. Very long payloads have to fit into memory one at a time.
    """
    stamp = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, _partition(), archive_bytes)
        for batch in batches:
            for page_id, url, payload in zip(*batch.columns, strict=True):
                data = (payload.as_py() or "").encode()
                record = _response(f"<urn:uuid:{uuid.uuid4()}>", page_id.as_py(), url.as_py(), stamp, data)
                writer.add(encode_record(record))
        yield writer.close()

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), url_column, payload_column)
    return _publish(rows.mapInArrow(run, _MANIFEST), folder)


def _publish(manifest: DataFrame, folder: str) -> DataFrame:
    ship_package(manifest.sparkSession)
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(manifest.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit below ``folder``: archive, position (in it), record_type, record_id, page_id, url,
    date, payload_digest (bare base32 SHA-1), payload_sha256, payload_bytes, refers_to_id, payload.

    Digests and sizes of responses are those of the payload read, whatever the header says. A revisit has the digest
    of its header, and neither payload, size nor SHA-256. With ``payloads`` false the payload is left out. Records of other
    types are passed over. No archive: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, size = [], 0
                with _open(archive) as file:
                    for position, record in enumerate(decode_records(file)):
                        if record.fields["WARC-Type"] in ("response", "revisit"):
                            rows.append(_row(archive, position, record, payloads))
                            size += 1000 + len(rows[-1]["payload"] or b"")
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    ship_package(spark)
    return _spread(read_manifest(spark, folder).select("archive")).mapInArrow(run, _RECORD)


def _spread(archives: DataFrame) -> DataFrame:
    """Archives dealt over the tasks."""
    return archives.repartition(max(1, min(archives.count(), 8 * shuffle_partitions(archives.sparkSession))), "archive")


def _row(archive: str, position: int, record: Record, payloads: bool) -> dict:
    fields, revisit = record.fields, record.fields["WARC-Type"] == "revisit"
    payload = None if revisit else record.payload()
    page_id = fields.get("X-Page-ID")
    return {
        "archive": archive, "position": position, "record_type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"],
        "page_id": None if page_id is None else int(page_id), "url": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
        "payload_sha256": None if revisit else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": None if revisit else len(payload), "refers_to_id": fields.get("WARC-Refers-To"),
        "payload": payload if payloads else None,
    }


def revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The responses that repeat the payload of an earlier one: archive, position, and the original's record_id, url, date as
    refers_to_id, refers_to_url, refers_to_date.

    Payloads are equal by length, SHA-1 and SHA-256; those below ``min_bytes`` are left alone. The original is the response
    with the smallest page_id, then record_id; one without page_id only where no other has one. ``headers`` is read more
    than once. Only headers are shuffled, and a payload's headers never meet in one task: those of very frequent
    payloads stay where they are and meet a broadcast of at most a thousand originals.
    """
    key = ["payload_digest", "payload_sha256", "payload_bytes"]
    responses = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url", "date")
    classes = responses.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = responses.select(*key, "archive", "position", "record_id")
    found = join_sized(rows, cut(classes), key, "n").where(F.col("first.record_id") != F.col("record_id"))
    return found.select(
        "archive", "position", F.col("first.record_id").alias("refers_to_id"), F.col("first.url").alias("refers_to_url"),
        F.col("first.date").alias("refers_to_date"),
    )


def _revisit(record: Record, refers_to: tuple[str, str | None, str]) -> Record:
    """``record`` without its payload, under fresh header fields that name the original."""
    record_id, url, date = refers_to
    fields = dict(record.fields) | {
        "WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id, "WARC-Refers-To-Date": date,
        "WARC-Payload-Digest": f"sha1:{payload_digest(record.payload())}",
    }
    if url is not None:
        fields["WARC-Refers-To-Target-URI"] = url
    fields.pop("WARC-Block-Digest", None)
    return Record(fields, record.block[: len(record.block) - len(record.payload())])


def deduplicate(
    spark: SparkSession, source: str, target: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes the archives of ``source`` again below ``target``, repeated payloads as revisits; returns the manifest.

    What a revisit is, and of which record: see ``revisits``. Records of other types and earlier revisits are copied.
    """
    headers = cut(read_records(spark, source, payloads=False))
    changed = revisits(headers, min_bytes)
    archives = read_manifest(spark, source).select("archive", F.lit(-1).cast("long").alias("position"))
    plan = archives.unionByName(changed, allowMissingColumns=True).repartition(shuffle_partitions(spark), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(target, _partition(), archive_bytes)

        def rewrite(archive: str, decided: dict[int, tuple]) -> None:
            with _open(archive) as file:
                for position, record in enumerate(decode_records(file)):
                    writer.add(encode_record(_revisit(record, decided[position]) if position in decided else record))

        archive, decided = None, {}
        for batch in batches:
            for name, position, *refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != archive:
                    if archive is not None:
                        rewrite(archive, decided)
                    archive, decided = name, {}
                if position >= 0:
                    decided[position] = tuple(refers_to)
        if archive is not None:
            rewrite(archive, decided)
        yield writer.close()

    return _publish(plan.sortWithinPartitions("archive", "position").mapInArrow(run, _MANIFEST), target)


def resolve(records: DataFrame) -> DataFrame:
    """Each record of ``read_records`` with page_id, url, payload_bytes, payload_digest, record_type and refers_to.

    A revisit gets the size and the page_id (refers_to) of the response that it refers to; both are null where that one is
    missing or has another digest. A response has refers_to null.
    """
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type")
    records = cut(records.select("record_id", "refers_to_id", *names))
    referring = records.where("record_type = 'revisit'")
    referred = referring.groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count("*").alias("n"))
    originals = cut(records.where("record_type = 'response'").join(referred, "record_id").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("size"),
        F.col("payload_digest").alias("digest"), "n",
    ))
    found = join_sized(referring.drop("payload_bytes"), originals, ["refers_to_id"], "n")
    same = F.col("digest") == F.col("payload_digest")
    found = found.withColumn("payload_bytes", F.when(same, F.col("size"))).withColumn("refers_to", F.when(same, F.col("original")))
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(*names, "refers_to").unionByName(found.select(*names, "refers_to"))
