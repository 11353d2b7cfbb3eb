"""Operator 1: token ids in patched frame-of-reference blocks.

A segment is a self-contained binary image: header, index of block starts, the documents' ids and lengths, then blocks of
BLOCK ids. Each block subtracts its minimum and packs the rest at the width that holds a chosen percentile of its values;
the values that don't fit (outliers) stand in the block's exception list as (position, high bits), and patch it on reading.

Files are tables of segments in the shared folder, range-sorted by doc_id, written by Spark's committer, so an executor that
is lost leaves no half file. A segment ends with a document; a document longer than a segment has one of its own.

Null text is empty; an empty document holds the end id alone. Rows with the same doc_id follow each other by text order.
A null doc_id sorts first. Other columns are ignored. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import map_batches, materialize
from rasterloom.llm.wordbpe import Memory, Parts, library_encode

BLOCK = 256
SEGMENT_TOKENS = 1 << 18
PERCENTILE = 90.0
MAGIC = b"PFOR1\0\0\0"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values under 2**width as (blocks, BLOCK / 64 * width) 64-bit words."""
    n = len(values)
    lanes = np.ascontiguousarray(values.reshape(n * BLOCK // 64, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        k, shift = divmod(i * width, 64)
        words[k] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[k + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(n, -1)


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(n * BLOCK // 64, width).T)
    out = np.zeros((64, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        k, shift = divmod(i * width, 64)
        out[i] = lanes[k] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= lanes[k + 1] << np.uint64(64 - shift)
    out &= mask
    return np.ascontiguousarray(out.T).reshape(n, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The blocks of ids (under 2**32), with their index."""
    n = len(ids)
    many = -(-n // BLOCK)
    full = np.zeros(many * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(many, BLOCK)
    low = full.min(axis=1)
    full -= low[:, None]
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    chosen = np.partition(full, rank, axis=1)[:, rank]
    widths = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64)
    over = full.astype(np.uint64) >> widths.astype(np.uint64)[:, None] if widths.max(initial=0) > 31 else full >> widths.astype(np.uint32)[:, None]
    at, pos = np.nonzero(over)
    high = over[at, pos].astype("<u4")
    n_over = np.bincount(at, minlength=many)
    payload = [b""] * many
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        if width:
            words = pack(full[own].astype(np.uint64) & np.uint64((1 << int(width)) - 1), int(width))
            for i, row in zip(own, words, strict=True):
                payload[i] = row.tobytes()
    ends = np.cumsum(n_over)
    pos = pos.astype("u1")
    blocks = [p + pos[e - c : e].tobytes() + high[e - c : e].tobytes() for p, c, e in zip(payload, n_over, ends, strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = struct.pack("<QQ", n, many) + low.astype("<u4").tobytes() + widths.astype("u1").tobytes() + n_over.astype("<u2").tobytes() + starts.tobytes()
    return head + b"".join(blocks)


def decode_blocks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last (all of them if not given), found through the index of block starts."""
    n, many = struct.unpack_from("<QQ", data)
    at = 16
    low = np.frombuffer(data, "<u4", many, at)
    widths = np.frombuffer(data, "u1", many, at + 4 * many)
    n_over = np.frombuffer(data, "<u2", many, at + 5 * many)
    starts = np.frombuffer(data, "<u8", many + 1, at + 7 * many).astype(np.int64)
    base = at + 7 * many + 8 * (many + 1)
    last = many if last is None else min(last, many)
    first = min(first, last)
    out = np.zeros((last - first, BLOCK), np.uint64)
    for width in np.unique(widths[first:last]):
        own = np.flatnonzero(widths[first:last] == width)
        w = int(width)
        if w:
            size = BLOCK // 64 * w
            raw = b"".join([data[base + s : base + s + 8 * size] for s in starts[own + first].tolist()])
            out[own] = unpack(np.frombuffer(raw, "<u8").reshape(len(own), size), w, len(own))
    for i in np.flatnonzero(n_over[first:last]):
        c, s = int(n_over[i + first]), base + int(starts[i + first]) + BLOCK // 8 * int(widths[i + first])
        high = np.frombuffer(data, "<u4", c, s + c).astype(np.uint64)
        out[i, np.frombuffer(data, "u1", c, s)] |= high << np.uint64(widths[i + first])
    out += low[first:last].astype(np.uint64)[:, None]
    return out.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)].astype("<u4")


def segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], "u1")
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<Q", len(doc_ids)) + keys.tobytes() + null.tobytes() + np.asarray(lengths, "<u8").tobytes() + encode_blocks(ids)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a segment")
    (n,) = struct.unpack_from("<Q", data, 8)
    keys = np.frombuffer(data, "<i8", n, 16)
    null = np.frombuffer(data, "u1", n, 16 + 8 * n)
    lengths = np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], lengths, decode_blocks(data[16 + 17 * n :])


_STATE: dict = {}


def _memory(path: str) -> Memory:
    if path not in _STATE:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        parts = Parts(t)
        _STATE[path] = Memory(parts, library_encode(t, parts))
    return _STATE[path]


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers: the library encodes each distinct part of the texts once."""
    return list(map(_memory(path).text, texts))


def _writer(path: str, end_id: int, segment_tokens: int):
    end = np.array([end_id], "<u4").tobytes()
    held: dict = {"docs": [], "ids": [], "n": 0}

    def flush() -> list:
        if not held["docs"]:
            return []
        lengths = np.array([len(x) // 4 for x in held["ids"]], np.int64)
        out = [held["docs"][0], len(held["docs"]), int(lengths.sum()), segment(held["docs"], lengths, np.frombuffer(b"".join(held["ids"]), "<u4"))]
        held.update(docs=[], ids=[], n=0)
        return [out]

    def add(batch: pa.RecordBatch) -> Iterator[list]:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, ids in zip(part.column(0).to_pylist(), encode_texts(path, [x or "" for x in part.column(1).to_pylist()]), strict=True):
                held["docs"].append(doc)
                held["ids"].append(ids + end)
                held["n"] += len(ids) // 4 + 1
                if held["n"] >= segment_tokens:
                    yield from flush()

    return add, flush


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Writes the token files of docs(doc_id, text) in ascending doc_id order and returns the table of segments:
    shard (ascending with doc_id), seq (order in the shard), first_doc, n_docs, n_tokens, data."""

    def run(batches):
        from pyspark import TaskContext

        add, flush = _writer(tokenizer_path, end_id, segment_tokens)
        shard, seq = TaskContext.get().partitionId(), 0
        names = ["shard", "seq", "first_doc", "n_docs", "n_tokens", "data"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def rows():
            for batch in batches:
                yield from add(batch)
            yield from flush()

        for row in rows():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([shard, seq, *row], types, strict=True)], names=names)
            seq += 1

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "shard int, seq int, first_doc long, n_docs long, n_tokens long, data binary"), "tokens")


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds start: tokens of all segments before. Sums by shard first, so the one ordered window has a row for each shard."""
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    base = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    inner = segments.select("shard", "seq", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("_in"))
    starts = inner.join(base, "shard").select("shard", "seq", (F.col("_base") + F.col("_in")).alias("start"))
    return segments.join(F.broadcast(starts) if _few(starts) else starts, ["shard", "seq"])


def _few(starts: DataFrame, most: int = 100_000) -> bool:
    """Whether starts has at most so many rows (24 bytes each), which makes it small enough to send to all."""
    return starts.limit(most + 1).count() <= most


def _reader():
    def read(batch: pa.RecordBatch) -> Iterator[list]:
        for data, start in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            docs, lengths, ids = read_segment(data.as_py())
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
            yield [docs, start + ends - lengths, lengths, crc]

    return read


def read_tokens(segments: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens and ids_crc32 of each document."""
    return map_batches(with_starts(segments).select("data", "start"), _reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_blocks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer_path))
