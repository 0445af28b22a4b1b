"""WARC archives of one zstandard frame a record, with a dictionary in front.

    skippable frame 0x184D2A5D: dictionary | frame of record 1 | frame of record 2 | ...

A task writes its pages into archives of its own, in the shared checkpoint
folder, through the file system that the folder's URI names. The dictionary is
trained on the archive's first records (SAMPLE_RECORDS and SAMPLE_BYTES at
most; it only decides how small the file gets) and stands in a leading
skippable frame, so that an archive is read by itself. A task writes under a
name of its own attempt and renames what is whole; the same task run again
makes the same files.

Records of equal payloads of at least REVISIT_BYTES bytes are stored once: that
of the largest page_id is a response, the others are revisits of it, which hold
the HTTP head and no payload. Payloads are equal if their SHA-256 is. Which
digests occur more than once is counted with partial sums and written down;
Spark broadcasts that table if its file is under its own limit and else joins
by digest, where a digest of very many pages is split.

The reader loads the dictionary, decodes a frame a record and checks that
frames fill the file, that the version line and the named fields are there,
that Content-Length is the block's length and two line ends follow it, that the
HTTP head's Content-Length is the payload's and that the payload has the digest
named. A record that fails has the reason in the column error; a frame that
cannot be decoded ends its file with such a row.

Null html is an empty payload, a null url leaves the target out; control
characters and spaces in a URL are percent-encoded in the header. Rows of a
null page_id are responses, or revisits of a known id. Rows that repeat the
largest page_id of a payload are responses each. Other columns are not read. An
empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, written

#: Payloads of so many bytes are stored once.
REVISIT_BYTES = 1000
#: Fixed values of the formats.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
FIELD = re.compile("[!#$%&'*+.^_`|~0-9A-Za-z-]+")
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 500, 4 << 20
#: An archive ends after so many bytes, and the task begins another.
ARCHIVE_BYTES = 1 << 30
#: Bytes read at once, and given to the decoder at once.
READ_BYTES, FEED_BYTES = 1 << 20, 1 << 12


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of page refers_to."""
    digest = hashlib.sha1(payload)
    head = HTTP.format(len(payload)).encode()
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest.hexdigest())), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest.hexdigest()))]
    fields += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest.digest()).decode()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}' + chr(13) + chr(10) for k, v in fields)}\r\n".encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of these records; empty if they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to a stream, a frame each, after the dictionary of the first."""

    def __init__(self, out):
        self.out, self.held, self.size, self.n, self.zip, self.at = out, [], 0, 0, None, 0

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.zip is not None:
            self._frame(data)
            return
        self.held.append(data)
        self.size += len(data)
        if len(self.held) >= SAMPLE_RECORDS or self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        known = dictionary(self.held)
        if known:
            self._put(SKIPPABLE.to_bytes(4, "little") + len(known).to_bytes(4, "little") + known)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(known) if known else None, write_checksum=True)
        for data in self.held:
            self._frame(data)
        self.held = []

    def _frame(self, data: bytes) -> None:
        self._put(self.zip.compress(data))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.zip is None:
            self._begin()


class _Source:
    """Bytes of a stream, a buffer at a time."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.before = stream, memoryview(b""), 0, 0

    def some(self, n: int) -> memoryview:
        """The next bytes, n at most, none at the end."""
        if self.at == len(self.data):
            self.before += len(self.data)
            self.data, self.at = memoryview(self.stream.read(READ_BYTES)), 0
        part = self.data[self.at : self.at + n]
        self.at += len(part)
        return part

    def back(self, n: int) -> None:
        """Give back the last n bytes of what some() gave last."""
        self.at -= n

    def whole(self, n: int) -> bytes:
        parts, left = [], n
        while left and (part := self.some(left)):
            parts.append(bytes(part))
            left -= len(part)
        if left:
            raise ValueError("the file ends early")
        return b"".join(parts)

    @property
    def place(self) -> int:
        return self.before + self.at


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(place in the file, record) of an archive: the dictionary is loaded from a leading skippable frame, then each frame is decoded."""
    source = _Source(stream)
    known = None
    first = bytes(source.some(4))
    if first == SKIPPABLE.to_bytes(4, "little"):
        known = source.whole(int.from_bytes(source.whole(4), "little"))
        if known[:4] == ZSTD.to_bytes(4, "little"):  # the format allows a compressed dictionary
            known = zstandard.ZstdDecompressor().decompressobj().decompress(known)
    else:
        source.back(len(first))
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
    while True:
        place, decoder, parts = source.place, unzip.decompressobj(), []
        while not decoder.eof:
            part = source.some(FEED_BYTES)
            if not part:
                if parts or source.place > place:
                    raise ValueError("the last frame is cut off")
                return
            parts.append(decoder.decompress(part))
        source.back(len(decoder.unused_data))
        yield place, b"".join(parts)


def parse(data: bytes) -> dict:
    """record_id, record_type, target_uri, date, refers_to, payload_bytes, payload_digest (hex) and payload of a record; ValueError says what is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or version not in ("WARC/1.0", VERSION):
        raise ValueError("no version line")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not FIELD.fullmatch(name):
            raise ValueError(f"a header line without a field: {line[:40]}")
        fields[name.lower()] = value.strip()
    for name in NEEDED:
        if not fields.get(name.lower()):
            raise ValueError(f"missing field: {name}")
    length = fields["content-length"]
    if not re.fullmatch("[0-9]+", length) or rest[int(length) :] != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's length")
    kind, block = fields["warc-type"], rest[: int(length)]
    out = {"record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "refers_to": fields.get("warc-refers-to")}
    if kind not in ("response", "revisit"):
        return out | {"payload_bytes": len(block), "payload_digest": hashlib.sha1(block).hexdigest(), "payload": block}
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*(?=\r\n|$)", http, re.IGNORECASE)
    if not found or size is None:
        raise ValueError("no HTTP head with a length")
    named = re.fullmatch("sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""))
    if named is None:
        raise ValueError("no SHA-1 of the payload")
    digest = base64.b32decode(named[1]).hex()
    if kind == "response":
        if int(size[1]) != len(payload):
            raise ValueError("the HTTP head's Content-Length is not the payload's length")
        if digest != hashlib.sha1(payload).hexdigest():
            raise ValueError("the payload has another digest")
    elif payload or not out["refers_to"]:
        raise ValueError("a revisit with a payload, or of no record")
    return out | {"payload_bytes": int(size[1]), "payload_digest": digest, "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest page_id of the payload, for pages that are to be revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256)))
    counted = rows.select("page_id", key.alias("key")).filter("key is not null").groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    again = written(counted.filter("n > 1 and largest is not null").select("key", "largest"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return rows.withColumn("key", key).join(again, "key", "left").select("page_id", "url", "html", other.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", least: int = REVISIT_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as archives; returns the manifest (file, records, bytes), a row an archive."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made = TaskContext.get(), []
        store, root = fs.FileSystem.from_uri(folder)
        writer = stream = trial = name = None

        def done():
            writer.close()
            stream.close()
            store.move(trial, f"{root}/{name}")
            made.append({"file": f"{folder}/{name}", "records": writer.n, "bytes": writer.at})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, html, refers_to = (c[k].as_py() for c in columns)
                if writer is None:
                    store.create_dir(root, recursive=True)
                    name = f"pages-{context.partitionId():06d}-{len(made):04d}.warc.zst"
                    trial = f"{root}/.{name}.{context.taskAttemptId()}"
                    stream = store.open_output_stream(trial, compression=None)
                    writer = ArchiveWriter(stream)
                writer.add(record(page_id, url, html.encode(), refers_to, date))
                if writer.at >= ARCHIVE_BYTES:
                    done()
                    writer = None
        if writer is not None:
            done()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return cut(with_revisits(pages, least).mapInArrow(run, "file string, records long, bytes long"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the archives *.warc.zst in a folder, or of a file or pattern; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("path").alias("file"))


COLUMNS = ("file", "place", "record_id", "record_type", "target_uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload", "error")
READ = pa.schema([(c, pa.int64() if c in ("place", "payload_bytes") else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """COLUMNS of every record of the archives in files(file), in one task an archive; payload is null for revisits and, on request, for all."""
    def rows(file: str) -> Iterator[dict]:
        store, root = fs.FileSystem.from_uri(file)
        place = 0
        with store.open_input_stream(root, compression=None) as stream:
            try:
                for place, data in frames(stream):
                    try:
                        found = parse(data)
                    except (ValueError, UnicodeDecodeError) as e:
                        found = {"error": str(e)}
                    yield found | {"file": file, "place": place}
            except (ValueError, zstandard.ZstdError) as e:
                yield {"file": file, "place": place, "error": f"after the record there: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                out, size = [], 0
                for row in rows(file):
                    if not with_payload:
                        row.pop("payload", None)
                    out.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, READ)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, READ)

    schema = ", ".join(f"{c} {'long' if c in ('place', 'payload_bytes') else 'binary' if c == 'payload' else 'string'}" for c in COLUMNS)
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """Write pages, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to), a row a page. A record that does not pass the reader's checks fails the job."""
    rows = read(write(pages), with_payload=False)
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("file", F.lit(", "), F.col("place").cast("string"), F.lit(": "), "error")).cast("string"))
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), number("refers_to").alias("refers_to"))
