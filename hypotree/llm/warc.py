"""Zstandard WARC archives: a writer, and a reader that decodes one frame per record.

An archive begins with a skippable frame that holds its dictionary; each record is a frame of its own. The reader loads
the dictionary, decodes frame after frame and checks the version line, the needed headers, the lengths of block and
payload, the closing line ends and the payload's digest; a record that fails raises. Archives are files in a folder that
all machines share; each writing attempt has names of its own and only the manifest of attempts that ended counts, so lost
executors leave nothing wrong behind.

Of pages with equal payloads of at least `least` bytes the one with the largest page_id is a response and the others are
revisits of it; smaller payloads are responses.

Defined results: null html is an empty payload; null url leaves the target out; a null page_id can't be referred to and
revisits if some page can be, and reads back as null; rows that repeat the response's page_id are responses too; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, slices, write_table

#: Fixed values of the formats: the skippable frame's magic number, the profile of identical-payload revisits.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, record_type string, target string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a URI or a local path."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


class ArchiveWriter:
    """Writes one archive. samples: records that the dictionary is made from."""

    def __init__(self, sink: io.RawIOBase, samples: list[bytes], dictionary_size: int = 16_384) -> None:
        import zstandard

        raw = _dictionary(samples, dictionary_size)
        self.sink, self.bytes, self.records = sink, 0, 0
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.bytes += len(raw)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1


def read_frames(source: io.RawIOBase, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each frame of an archive, in bounded memory apart from one record."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    raw = source.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary is cut short")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    held = b""
    while held or (held := source.read(step)):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            held = held or source.read(step)
            if not held:
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """The record's fields; raises ValueError where headers, lengths or digest don't hold."""
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    if lines[0] != "WARC/1.1" or not split or any(k not in fields for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")):
        raise ValueError(f"headers are missing: {lines[:4]}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, not {n}")
    http, split, payload = rest[:n].partition(b"\r\n\r\n")
    http_lines = http.decode().split("\r\n")
    size = int({k.lower(): v for k, _, v in (x.partition(": ") for x in http_lines[1:])}["content-length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']}: length or digest is wrong")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT):
        raise ValueError(f"revisit {fields['warc-record-id']} is malformed")
    return {"page_id": page(fields["warc-record-id"]), "record_type": kind, "target": fields.get("warc-target-uri"), "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest, "payload": payload}


def with_types(pages: DataFrame, *, least: int = 1000, small_table: int = 100_000) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload, digest, revisit, refers_to.

    The repeated digests are found by a partial aggregation over digests alone. They are broadcast only while they are at
    most small_table rows; beyond that they are joined by a shuffle, where Spark splits skewed digests.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("first")).where("copies > 1 and first is not null")
    repeated = write_table(repeated.select(F.col("digest").alias("same"), "first"), "warc-repeated")
    small = repeated.count() <= small_table
    joined = rows.join(F.broadcast(repeated) if small else repeated.hint("merge"), (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(typed: DataFrame, folder: str, *, max_bytes: int = 64 << 20, sample_bytes: int = 1 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of with_types() into archives of about max_bytes in folder; the manifest: path, records, bytes."""
    columns = ["page_id", "url", "payload", "digest", "refers_to", "revisit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        writer, sink, path, waiting, held = None, None, "", [], 0

        def opened() -> None:
            nonlocal writer, sink, path, waiting, held
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            sink = system.open_output_stream(path)
            writer = ArchiveWriter(sink, waiting)
            for record in waiting:
                writer.add(record)
            waiting, held = [], 0

        def closed() -> pa.RecordBatch:
            nonlocal writer
            sink.close()
            done, writer = writer, None
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([done.records], pa.int64()), "bytes": pa.array([done.bytes], pa.int64())})

        for batch in slices(batches, "payload"):
            for page_id, url, payload, digest, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in columns)):
                record = record_bytes(page_id, url, payload, digest, refers_to, revisit, date)
                if writer is None:  # the first records make the dictionary
                    waiting.append(record)
                    held += len(record)
                    if held >= sample_bytes:
                        opened()
                else:
                    writer.add(record)
                if writer is not None and writer.bytes >= max_bytes:
                    yield closed()
        if writer is None and waiting:
            opened()
        if writer is not None:
            yield closed()

    return typed.select(*columns).mapInArrow(run, MANIFEST)


def read_archives(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """One row for each record of the manifest's archives; raises if a record or a count is wrong."""
    files = max(1, manifest.count())
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    if not with_payload:
        names, kinds = names[:-1], kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, records, base in zip(*(batch.column(c).to_pylist() for c in ("path", "records", "base"))):
                system, _ = open_folder(base)
                rows, held, seen = [], 0, 0
                with system.open_input_stream(uri) as source:
                    for raw in read_frames(source):
                        rows.append(parse_record(raw))
                        seen, held = seen + 1, held + len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{uri} has {seen} records, not {records}")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    dealt = manifest.repartition(min(files, 10_000), "path")
    return dealt.mapInArrow(run, ", ".join(RECORD.split(", ")[: len(names)]))


def round_trip(pages: DataFrame, **kw: int) -> DataFrame:
    """Writes pages into archives in the shared folder and reads them back: RECORD without the payload."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_table(write_archives(with_types(pages), folder, **kw).withColumn("base", F.lit(folder)), "warc-manifest")
    return read_archives(manifest, with_payload=False)
