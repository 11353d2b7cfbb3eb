"""Operator 2: WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding a group of WARC/1.1 records, then a skippable frame with
a seek table (compressed and full size of each frame; footer with the number of frames and the seekable format's magic
number). Any Zstandard reader gets the records in order; with the table, one frame is enough for one record. The index maps
each record's id to its frame and to its place in that frame.

Of records with equal payloads of at least min_bytes bytes, the one with the smallest id is a response, the others are
revisits that name it and carry no payload. Bundles are rows (binary) of a table in the shared folder, which Spark's
committer writes, so lost executors leave no half bundle.

Null html is an empty payload. Rows that repeat the smallest page_id of their payload are all responses. A null page_id is
larger than all others; copies that all have a null page_id are all responses. Other columns are ignored; an empty table
gives no bundle and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import arrow_schema, map_batches, materialize

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, revisits: int | None, has_target: bool) -> bytes:
    """One WARC record. A revisit has no payload; its full length stands in a header field of its own."""
    name = "null" if page_id is None else str(page_id)
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if has_target else "response"), f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%" + "".join(f"{b:02X}" for b in c.encode()) for c in url))
    if has_target:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{revisits}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record that begins at a place."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    begin = stop + 4
    end = begin + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, data[begin:end], end + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.compressor, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.total = 0
        self.index: list[tuple[int | None, int, int, int]] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and self.held + len(data) > self.frame_bytes:
            self.cut()
        self.index.append((page_id, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)

    def cut(self) -> None:
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.held))
            self.total += len(packed)
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self.cut()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed size and full size of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for packed, full in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    import zstandard

    at, packed, full = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=full)


def read_record(bundle: bytes, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """The record at a place in a frame, by reading that frame alone."""
    fields, payload, _ = parse(read_frame(bundle, frame), at)
    return fields, payload


_BUNDLES = "bundle string, n_records long, content binary, record_ids array<long>, frames array<int>, places array<int>, lengths array<int>"


def with_targets(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """pages(page_id, url, html) as page_id, url, payload (null for revisits), digest, size, refers_to, is_revisit."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    out = rows.join(firsts, "digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("is_revisit"))


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles of with_targets()'s rows and returns their table."""

    schema = arrow_schema(_BUNDLES)

    def run(batches):
        from pyspark import TaskContext

        part, seq, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def out():
            nonlocal seq, writer
            content = writer.finish()
            ids, frames, places, lengths = map(list, zip(*writer.index, strict=True))
            row = [f"bundle-{part:05d}-{seq:05d}.warc.zst", len(ids), content, ids, frames, places, lengths]
            seq, writer = seq + 1, BundleWriter(frame_bytes)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for page, url, payload, digest, size, refers, revisit in zip(*(c for c in batch.columns), strict=True):
                writer.add(page.as_py(), record(page.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), size.as_py(), refers.as_py(), revisit.as_py()))
                if writer.total >= bundle_bytes:
                    yield out()
        if writer.index:
            yield out()

    return materialize(records.mapInArrow(run, _BUNDLES), "warc")


def _reader():
    import zstandard

    unpack = zstandard.ZstdDecompressor()

    def read(batch: pa.RecordBatch) -> Iterator[list]:
        for bundle, ids, frames, places in zip(*(batch.column(k) for k in range(4)), strict=True):
            data, wanted = bundle.as_py(), list(zip(frames.as_py(), places.as_py(), ids.as_py(), strict=True))
            rows, k = [], 0
            for frame, (at, packed, full) in enumerate(seek_table(data)):
                text = unpack.decompress(data[at : at + packed], max_output_size=full)
                while k < len(wanted) and wanted[k][0] == frame:
                    fields, payload, _ = parse(text, wanted[k][1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record {wanted[k][2]} is damaged")
                    target = fields.get("WARC-Refers-To", "<urn:page:None>")[10:-1]
                    rows.append((wanted[k][2], size, digest, kind, None if target == "None" else int(target)))
                    k += 1
            yield [list(x) for x in zip(*rows, strict=True)]

    return read


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Reads the archives back through seek table and index, and verifies each payload by its digest."""
    return map_batches(bundles.select("content", "record_ids", "frames", "places"), _reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    return read_bundles(write_bundles(with_targets(pages, min_bytes)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS m FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to FROM q LEFT JOIN f USING (payload_digest)
"""
