"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of bounded size; a skippable frame at the end
holds the seek table (sizes of all frames, the public seekable format), and an index maps
every record to its bundle, frame and offset in the frame. One record is then read by
decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from eventloom.llm.storage import new_path, stored

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Frames of a bundle that one task reads in a row, and plain bytes of a task.
FRAMES_AT_ONCE = 16
READ_BYTES = 128 << 20
#: Fixed values of the seekable format: magic number of the skippable frame, and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def file_system(path: str):
    """(file system, path in it) for a folder that executors share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC record. Line breaks in a URL are percent-encoded; a null id or URL has no field."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if kind == "response" else b""
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parsed_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """(fields, body, end) of the record at a place of a decompressed frame."""
    stop = data.index(b"\r\n\r\n", start)
    fields = dict(line.split(": ", 1) for line in data[start:stop].decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    return fields, data[stop + 4:stop + 4 + size], stop + 4 + size + 4


class BundleWriter:
    """One bundle file: frames, then the seek table."""

    def __init__(self, folder: str):
        import zstandard
        self.codec = zstandard.ZstdCompressor(level=3)
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        # A name of its own: what a lost attempt leaves is in no index.
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = system.open_output_stream(f"{path}/{self.path.rpartition('/')[2]}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.pending = self.size = 0

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        """Place of the record: bundle, frame, offset in the frame, length."""
        if self.pending and self.pending + len(record) > FRAME_BYTES:
            self.flush()
        place = (self.path, len(self.frames), self.pending, len(record))
        self.parts.append(record)
        self.pending += len(record)
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.codec.compress(b"".join(self.parts))
            self.out.write(frame)
            self.frames.append((len(frame), self.pending))
            self.size += len(frame)
            self.parts, self.pending = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, bundle: str):
        import zstandard
        self.codec = zstandard.ZstdDecompressor()
        system, path = file_system(bundle)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER:
            raise ValueError(f"{bundle} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.starts, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.starts.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.starts[number]
        return self.codec.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        fields, body, _ = parsed_record(self.frame(frame), offset)
        return fields, body


INDEX = T.StructType().add("page_id", "long").add("bundle", "string").add("frame", "integer").add(
    "offset", "long").add("length", "long")
READ = T.StructType().add("page_id", "long").add("url", "string").add("payload_bytes", "long").add(
    "payload_digest", "string").add("record_type", "string").add("refers_to", "long").add("payload", "binary")


def planned_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, size, kind, refers_to): which pages are stored in full.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the smallest
    page_id are responses and others revisit it; a page_id of null comes last. Null html
    is an empty payload."""
    held = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    held = held.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    first = held.filter(F.col("size") >= least_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    # Stored, so that the join meets a plain table, whose frequent digests Spark can split.
    first = stored(first, "bundle-firsts")
    joined = held.join(first, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "sha", "size",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write every page as a record to bundles below ``folder`` (by default a new one in the shared
    folder) and return the index (page_id, bundle, frame, offset, length), stored beside them.

    A task writes its own bundles, under names no other attempt has, and only bundles in
    the index count: a task that runs again leaves files nobody reads."""
    folder = folder or new_path(pages.sparkSession, "bundles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                places = []
                for row in part.to_pylist():
                    payload = (row["html"] or "").encode()
                    digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                    writer = writer or BundleWriter(folder)
                    places.append(writer.add(record_bytes(
                        row["page_id"], row["url"], payload, digest, row["size"], row["kind"], row["refers_to"])))
                    if writer.size >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                bundles, frames, offsets, lengths = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bundles, pa.string()), pa.array(frames, pa.int32()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=INDEX.names)
        if writer:
            writer.close()

    return stored(planned_records(pages, least_bytes).mapInArrow(run, INDEX), "bundle-index")


def _row(fields: dict[str, str], body: bytes, with_payload: bool) -> tuple:
    def page(name):
        return int(fields[name][len("<urn:page:"):-1]) if name in fields else None
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if payload_digest(body) != digest:
            raise ValueError(f"payload of {fields.get('WARC-Record-ID')} does not match its digest")
    size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
    return (page("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, kind, page("WARC-Refers-To"),
            body if with_payload else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=READ.names)


def read_bundles(index: DataFrame, with_payload=True, frames_at_once: int = FRAMES_AT_ONCE,
                 read_bytes: int = READ_BYTES) -> DataFrame:
    """All records of the bundles an index names: (page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload). Digests of stored payloads are recomputed and must match."""
    # Stretches of frames, not bundles, are the unit of work. Rows of frames are small, whatever they stand for,
    # so the number of tasks comes from the plain bytes.
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // read_bytes), index.sparkSession.sparkContext.defaultParallelism)
    frames = index.select("bundle", "frame").distinct().repartition(
        tasks, "bundle", F.floor(F.col("frame") / frames_at_once)).sortWithinPartitions("bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            for bundle, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bundle != opened:
                    reader, opened = BundleReader(bundle), bundle
                data, at, rows = reader.frame(frame), 0, []
                while at < len(data):
                    fields, body, at = parsed_record(data, at)
                    rows.append(_row(fields, body, with_payload))
                yield _batch(rows)

    return frames.mapInArrow(run, READ)


def fetch_records(index: DataFrame, with_payload=True) -> DataFrame:
    """Only the records an index lists, each by decompressing its frame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bundle"] != opened:
                    reader, opened = BundleReader(row["bundle"]), row["bundle"]
                rows.append(_row(*reader.record(row["frame"], row["offset"]), with_payload))
            if rows:
                yield _batch(rows)

    return index.select("page_id", "bundle", "frame", "offset").mapInArrow(run, READ)
