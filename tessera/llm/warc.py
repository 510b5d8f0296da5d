"""Web archives in Zstandard: a writer, and a reader that checks what it reads.

An archive begins with a skippable frame that holds the dictionary (itself a
frame or plain), then has one frame a WARC record.  The reader loads the
dictionary, decodes one frame at a time, and checks the version line, the header
fields, ``Content-Length``, the end of the record and, for responses, the
``WARC-Payload-Digest``; anything wrong raises :class:`ArchiveError`.

Records of equal payloads: the one with the largest page id is the response, the
others are ``revisit`` records that name it.  Archives are written to the shared
folder under a name of their own for each attempt, and only those that the
manifest of the finished tasks names are read, so lost executors and repeated
attempts leave no doubles.

Defined cases: null html is an empty payload; a null url is an empty target; a
null page id is smaller than all others; rows that repeat the largest id of a
group are responses too; an empty table gives no archive and no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shuffle_partitions
from tessera.session import scratch_path

DICTIONARY_FRAME = 0x184D2A5D
LEAST_REVISIT = 1000
#: The dictionary of an archive is trained on its first records: at most so many, of so many bytes in all.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 4_000_000, 32_768
ARCHIVE_BYTES = 64_000_000
LEVEL = 3


class ArchiveError(ValueError):
    """An archive or record that is not what its headers say."""


def open_file(path: str, mode: str):
    """A binary stream of a path on any file system that executors share (a plain path or a URI)."""
    from pyarrow import fs

    plain = path if "://" in path or not path.startswith("file:") else "file://" + path[5:]
    system, place = fs.FileSystem.from_uri(plain if "://" in plain else "file://" + os.path.abspath(plain))
    if mode == "rb":
        return system.open_input_stream(place)
    system.create_dir(os.path.dirname(place), recursive=True)
    return system.open_output_stream(place)


def record_bytes(kind: str, page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; a revisit carries the digest and length of the payload but not the payload."""
    digest = hashlib.sha1(payload)
    name = "" if page_id is None else str(page_id)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        body += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{name}:{target}:{digest.hexdigest()}')}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        f"X-Page-ID: {name}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(3, f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class ArchiveWriter:
    """Records to one stream, a frame each, after a frame with the dictionary if one was trained."""

    def __init__(self, out, samples: list[bytes]):
        import zstandard

        self.out, self.records, self.bytes = out, 0, 0
        dictionary = None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 8 else None
        except zstandard.ZstdError:  # too few or too short records to train on: the archive has none
            pass
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def write(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1


def read_dictionary(stream) -> tuple[bytes | None, bytes]:
    """The dictionary of the leading skippable frame (None without one) and the bytes read beyond it."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        return None, head
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        return None, head
    data = stream.read(size)
    if len(data) != size:
        raise ArchiveError("the dictionary frame is cut off")
    if data[:4] == b"\x28\xb5\x2f\xfd":
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 24)
    if data[:4] != b"\x37\xa4\x30\xec":
        raise ArchiveError("the leading frame holds no dictionary")
    return data, b""


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record, checked."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"not a record: {record[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"not a header field: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ArchiveError(f"no {needed}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"content-length {fields['content-length']} does not match {len(rest) - 4} bytes")
    _, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    if not mark:
        raise ArchiveError("no end of the response's headers")
    if fields["warc-type"] == "response":
        if "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields.get("warc-payload-digest"):
            raise ArchiveError("the payload does not match its digest")
        if "x-payload-length" in fields and int(fields["x-payload-length"]) != len(payload):
            raise ArchiveError("the payload does not match its length")
    return fields, payload


def read_archive(stream, chunk: int = 1 << 20):
    """Headers and payload of each record of an archive; memory holds one record and one chunk."""
    import zstandard

    dictionary, ahead = read_dictionary(stream)
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpacker = zstandard.ZstdDecompressor(dict_data=given)
    data = ahead
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise ArchiveError("the last frame is cut off")
        yield parse_record(b"".join(parts))


def plan_records(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, refers_to``: the page that a revisit refers to, null for responses."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    groups = base.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and last is not null").select("digest", "last")
    # Pages below the bound have no digest; a key of their own keeps them from meeting in one task.
    alone = F.concat(F.lit("page "), F.xxhash64("page_id", "url", "html").cast("string"))
    planned = base.withColumn("digest", F.coalesce("digest", alone)).join(groups, "digest", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return planned.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of :func:`plan_records` to archives under ``folder``; returns the manifest ``path, records, bytes``."""

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in batch.columns)

        writer = out = path = None
        held, size, done = [], 0, []

        def start():
            nonlocal writer, out, path
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            out = open_file(path, "wb")
            writer = ArchiveWriter(out, held)
            for r in held:
                writer.write(r)

        def finish():
            nonlocal writer
            out.close()
            done.append((path, writer.records, writer.bytes))
            writer = None

        for page_id, url, text, refers_to in rows():
            record = record_bytes("response" if refers_to is None else "revisit", page_id, url, text.encode("utf-8", "surrogatepass"), refers_to)
            if writer is None:
                held.append(record)
                size += len(record)
                if len(held) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
                    start()
                    held, size = [], 0
            else:
                writer.write(record)
                if writer.bytes >= archive_bytes:
                    finish()
        if writer is None and held:
            start()
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(3)], names=["path", "records", "bytes"])

    return materialize(records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every record (payload null for revisits)."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def run(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, count = [], 0, 0
                with open_file(path, "rb") as stream:
                    for fields, payload in read_archive(stream):
                        count += 1
                        response = fields["warc-type"] == "response"
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-target-uri"], fields["warc-type"],
                                     None if response else int(fields["x-refers-to-page-id"]), int(fields["x-payload-length"]), digest,
                                     payload if response else None))
                        size += len(payload)
                        if size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                if count != expected:
                    raise ArchiveError(f"{path}: {count} records, not {expected}")
                if rows:
                    yield _batch(rows)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    # With a number of partitions, the small rows of the manifest are not put into one task.
    spread = manifest.select("path", "records").repartition(shuffle_partitions(manifest.sparkSession), F.col("path"))
    return spread.mapInArrow(run, schema)


def op7_warc_zstd(pages: DataFrame) -> DataFrame:
    manifest = write_archives(plan_records(pages), scratch_path(pages.sparkSession, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
