"""WARC archives as seekable Zstandard bundles.

A bundle (*.warc.zst) is a row of independent Zstandard frames, each holding some whole WARC/1.1 records, then
two skippable frames: the record table of this library and, last, the public seek table. A plain `zstd -d`
gives the records; a reader of one record decompresses one frame.

    record frame   Zstandard frame of about FRAME bytes of records
    ...
    record table   0x184D2A5C, size, then for each record: int64 page id (the smallest number for null),
                   uint32 frame, uint32 offset in the decompressed frame, uint32 length
    seek table     0x184D2A5E, size, then for each record frame: uint32 compressed and decompressed size;
                   footer: uint32 frames, byte 0, 0x8F92EAB1

All numbers are little-endian.

Of pages with equal payloads of at least LEAST bytes, the one with the smallest page id is the response and
the others revisit it; shorter payloads are all responses. A revisit record has no payload of its own but names
the response, the digest and the size.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import make_folder, resting, saved
from .files import write_file

FRAME, BUNDLE = 256 << 10, 8 << 20
LEAST = 100
RECORDS, SEEK, SEEK_END = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One date for all records: output must not depend on when a task runs.
DATE = "2024-01-01T00:00:00Z"


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record. Line ends cannot stand in a header, so they become blanks in urls."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    clean = lambda u: " ".join((u or "").split())
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin, size = end + 4, int(head["Content-Length"])
    return head, data[begin : begin + size], begin + size + 4


class Bundle:
    """Gathers records into frames."""

    def __init__(self, level: int = 3):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.seek: list[tuple[int, int]] = []
        self.table: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.size = 0

    def add(self, page: int | None, data: bytes) -> None:
        self.table.append((NO_ID if page is None else page, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        if self.held >= FRAME:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.frames.append(packed)
            self.seek.append((len(packed), self.held))
            self.size += len(packed)
            self.open, self.held = [], 0

    def to_bytes(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<qIII", *t) for t in self.table)
        seek = b"".join(struct.pack("<II", *s) for s in self.seek) + struct.pack("<IBI", len(self.seek), 0, SEEK_END)
        return b"".join([*self.frames, struct.pack("<II", RECORDS, len(table)), table, struct.pack("<II", SEEK, len(seek)), seek])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each record frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_END:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, packed, size))
        at += packed
    return out


def record_table(data: bytes) -> list[tuple[int | None, int, int, int]]:
    """Page id, frame, offset in the decompressed frame and length of each record."""
    at = sum(s[1] for s in seek_table(data))
    _, size = struct.unpack_from("<II", data, at)
    return [(None if p == NO_ID else p, f, o, n) for p, f, o, n in struct.iter_unpack("<qIII", data[at + 8 : at + 8 + size])]


def read_one(data: bytes, page: int) -> tuple[dict[str, str], bytes]:
    """One record by its page id: decompresses its frame only."""
    import zstandard

    frame, offset = next((f, o) for p, f, o, _ in record_table(data) if p == page)
    at, packed, size = seek_table(data)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=size), offset)[:2]


def choose(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, digest, refers_to, refers_url of each row. Groups of
    equal payloads meet as one row a digest, summed up before the shuffle; only the join's stream side can be
    hot, which adaptive execution splits."""
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first.page_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_url"))


def write_bundles(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", bundle_bytes: int = BUNDLE) -> DataFrame:
    """Write archives to `folder`; return the table of records: page_id, file, frame, frame_offset,
    offset_in_frame, length.

    Null payloads count as empty. Rows with a null page id are responses. Rows repeated under one page id
    with an equal payload are responses alike (the smallest id is theirs). A task orders its rows before it
    writes, so one that runs again writes the same files again. Without rows there are no archives, and
    reading gives no rows. Other columns are not read.
    """
    make_folder(pages.sparkSession, folder)
    rows = choose(pages, page, url, html).sortWithinPartitions("page_id", "digest", "url")

    @resting
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def close() -> pa.RecordBatch:
            nonlocal bundle, seq
            name = f"{folder}/pages-{part:06d}-{seq:06d}.warc.zst"
            write_file(name, bundle.to_bytes())
            at = [0]
            for packed, _ in bundle.seek:
                at.append(at[-1] + packed)
            t = bundle.table
            out = pa.RecordBatch.from_arrays(
                [pa.array([None if p == NO_ID else p for p, *_ in t], pa.int64()), pa.array([name] * len(t)), pa.array([f for _, f, _, _ in t], pa.int64()), pa.array([at[f] for _, f, _, _ in t], pa.int64()), pa.array([o for _, _, o, _ in t], pa.int64()), pa.array([n for *_, n in t], pa.int64())],
                names=["page_id", "file", "frame", "frame_offset", "offset_in_frame", "length"],
            )
            bundle, seq = Bundle(), seq + 1
            return out

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to", "refers_url")]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                bundle.add(row[0], record(*row))
                if bundle.size >= bundle_bytes:
                    yield close()
        if bundle.table:
            yield close()

    return saved(rows.mapInArrow(write, "page_id long, file string, frame long, frame_offset long, offset_in_frame long, length long"), "warc-records")


def read_bundles(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Read all records back: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, on
    demand, payload (null for revisits). Digest and size of a response are worked out from its payload and
    must agree with its header."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    @resting
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        number = lambda name: None if name == "<urn:page:null>" else int(name[10:-1])
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_py()
                table, frames = record_table(data), seek_table(data)
                by_frame: dict[int, list[int]] = {}
                for _, frame, offset, _ in table:
                    by_frame.setdefault(frame, []).append(offset)
                for frame, offsets in by_frame.items():
                    at, packed, size = frames[frame]
                    plain = unzip.decompress(data[at : at + packed], max_output_size=size)
                    rows = []
                    for offset in offsets:
                        head, payload, _ = parse(plain, offset)
                        kind, digest, length = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                            raise ValueError("a payload does not have its digest")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, length, digest, number(head["WARC-Refers-To"]) if kind == "revisit" else None, payload if payloads and kind == "response" else None))
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return raw.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
