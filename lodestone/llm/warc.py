"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a run
of frames followed by a seek table in a skippable frame, as in the public
seekable Zstandard format.  Each bundle row also maps its record identifiers to
(frame, offset inside the frame, length), so that one record is read by
decompressing one frame.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one
with the smallest id is a response and the others revisit it.  The smallest id
of a payload comes from a map-side combined aggregate by SHA-256; records meet
it in a join on the digest, whose hot keys are left to Spark's adaptive skew
join.  Bundles are rows of a Parquet table that Spark writes: a task builds them
from its own records, so a lost task is simply run again, and the bundle id is
the digest of its bytes.

Defined results: null payload counts as empty, a null url has no target header,
null ids revisit the smallest id that isn't null; rows that repeat the smallest
id are responses too; an empty table gives no bundles; a very long payload is a frame
of its own; other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .workspace import Workspace, slices

MIN_REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 8 << 20, 3

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

_INDEX = "array<struct<record: string, frame: int, offset: int, length: int>>"
_ARROW_INDEX = pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def record_uri(record_id: int | None) -> str:
    return f"urn:record:{'none' if record_id is None else record_id}"


def _id_of(uri: str) -> int | None:
    tail = uri.rpartition(":")[2]
    return None if tail == "none" else int(tail)


def format_record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_uri(record_id)}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """All records of a decompressed frame; payloads are checked against their digests."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(head["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        at = end + 8 + length
        cut = block.index(b"\r\n\r\n") + 4
        full = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
        digest = head["warc-payload-digest"].partition(":")[2]
        revisit = head["warc-type"] == "revisit"
        payload = None if revisit else block[cut:]
        if payload is not None and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
        yield {
            "id": _id_of(head["warc-record-id"][1:-1]),
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "payload_bytes": full,
            "payload_digest": digest,
            "refers_to": _id_of(head["warc-refers-to"][1:-1]) if revisit else None,
            "payload": payload,
        }


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open = bytearray()
        self.bytes = 0

    def add(self, name: str, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._flush()
        self.index.append({"record": name, "frame": len(self.sizes), "offset": len(self.open), "length": len(record)})
        self.open += record
        self.bytes += len(record)

    def _flush(self) -> None:
        if self.open:
            packed = self.zstd.compress(bytes(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.open = bytearray()

    def finish(self) -> bytes:
        """The bundle: frames, then the seek table in a skippable frame."""
        self._flush()
        table = b"".join(ENTRY.pack(*s) for s in self.sizes) + FOOTER.pack(len(self.sizes), 0, SEEK_MAGIC)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table])


class BundleReader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, data: bytes):
        count, flags, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != SEEK_MAGIC or flags:
            raise ValueError("no seek table")
        at = len(data) - FOOTER.size - count * ENTRY.size
        if struct.unpack_from("<II", data, at - 8) != (SKIPPABLE_MAGIC, len(data) - at):
            raise ValueError("the seek table is damaged")
        self.data, self.frames, start = data, [], 0
        for k in range(count):
            packed, full = ENTRY.unpack_from(data, at + k * ENTRY.size)
            self.frames.append((start, packed, full))
            start += packed
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        start, packed, full = self.frames[k]
        out = self.zstd.decompress(self.data[start : start + packed], max_output_size=full)
        if len(out) != full:
            raise ValueError(f"frame {k} is damaged")
        return out

    def record(self, frame: int, offset: int, length: int) -> dict:
        """One record, from one frame."""
        return next(parse_records(self.frame(frame)[offset : offset + length]))


def plan_records(pages: DataFrame, workspace: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """id, url, payload, digest, low: the id that equal payloads refer to, if any."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("low"), F.count("*").alias("n"))
        .where("n > 1 AND low IS NOT NULL")
        .select("digest", "low")
    )
    # Written, so that the join below is fed by plain exchanges, which can be split.
    first = workspace.save(first, "first")
    return rows.join(first, "digest", "left").select("id", "url", "payload", "digest", "low")


def write_bundles(
    pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, workspace: Workspace | None = None, **columns
) -> DataFrame:
    """Write the archives of ``pages`` to the Parquet table ``path``; returns it:
    bundle_id, data (one seekable .warc.zst file), index of its records."""
    spark = ship(pages.sparkSession)
    ws = workspace or Workspace(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(frame_bytes)

        def row(w: BundleWriter) -> pa.RecordBatch:
            data = w.finish()
            return pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([w.index], _ARROW_INDEX)], ["bundle_id", "data", "index"]
            )

        for batch in slices(batches):
            ids, urls, payloads, digests, lows = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                i, low = ids[k].as_py(), lows[k].as_py()
                revisit = low is not None and i != low
                record = format_record(i, urls[k].as_py(), payloads[k].as_py(), digests[k].as_py(), low, revisit)
                writer.add(record_uri(i), record)
                if writer.bytes >= bundle_bytes:
                    yield row(writer)
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield row(writer)

    planned = plan_records(pages, ws, **columns)
    planned.mapInArrow(run, f"bundle_id string, data binary, index {_INDEX}").write.parquet(path)
    return spark.read.parquet(path)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of bundles (column ``data``; that of Spark's binaryFile source
    is called ``content`` and works as well), frame by frame."""
    ship(bundles.sparkSession)
    column = "data" if "data" in bundles.columns else "content"
    names = RECORD_SCHEMA.names
    arrow = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                reader = BundleReader(data.as_py())
                for k in range(len(reader.frames)):
                    records = list(parse_records(reader.frame(k)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in records], arrow.field(c).type) for c in names], names)

    return bundles.select(column).mapInArrow(run, RECORD_SCHEMA)


def locate(bundles: DataFrame) -> DataFrame:
    """record, bundle_id, frame, offset, length for every record."""
    return bundles.select("bundle_id", F.explode("index").alias("at")).select("at.record", "bundle_id", "at.frame", "at.offset", "at.length")


def export_files(bundles: DataFrame, folder: str) -> list[str]:
    """Write each bundle as a ``.warc.zst`` file in a folder of any file system that Spark
    knows; the paths, in order.  The driver holds one bundle at a time; a bundle that is
    written again replaces the same file."""
    context = bundles.sparkSession.sparkContext
    paths, conf = [], context._jsc.hadoopConfiguration()
    for row in bundles.select("bundle_id", "data").orderBy("bundle_id").toLocalIterator():
        target = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row.bundle_id}.warc.zst")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytes(row.data))
        out.close()
        paths.append(target.toString())
    return paths
