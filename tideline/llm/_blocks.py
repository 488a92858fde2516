"""Blocks of documents, and exchanges between blocks and buckets of keys.

A block is one row with the ids and the compressed bytes of some consecutive documents
(about ``size`` bytes; a longer document has a block of its own). Operators that must look
up many keys for each document (words, windows of bytes) send each block's distinct keys
to buckets as packed arrays and get packed answers back, which keeps both the number of
rows and the bytes shuffled far below one row for each occurrence. A key that is frequent
in the corpus arrives at its bucket once for each block, not once for each occurrence.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._shared import stage

BLOCK = 1 << 20
#: Text bytes for each bucket.
BUCKET = 12 << 20
#: Types that packed arrays may have, by code (fixed values).
_KINDS = ["|u1", "<u2", "<u4", "<u8", "<i8", "<f4", "<f8", "|b1"]
MISSING = np.iinfo(np.int64).max

BLOCK_SCHEMA = "block long, payload binary, n_bytes long"
PART_SCHEMA = "bucket long, block long, blob binary"
#: A part's bucket has the round of the exchange above this many bits.
ROUND = 40
#: How staged blocks are written: they are compressed already, and a task reads a few.
STORED = {"parquet.block.size": str(16 << 20), "compression": "none"}


@functools.cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays in one compressed string; wider numbers byte by byte (all first bytes, then all
    second ones ...), so that small numbers and differences cost little."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [_KINDS.index(a.dtype.str), a.size]
        raw = np.ascontiguousarray(a).view(np.uint8)
        body.append(raw.reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 else raw.tobytes())
    return _compressor(level).compress(b"".join([np.array(head, "<i8").tobytes(), *body]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _decompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for kind, size in head.reshape(n, 2).tolist():
        width = np.dtype(_KINDS[kind]).itemsize
        part = np.frombuffer(raw, np.uint8, size * width, at)
        out.append(np.ascontiguousarray(part.reshape(width, size).T).view(_KINDS[kind]).ravel() if width > 1 else part.view(_KINDS[kind]))
        at += size * width
    return out


def _pack_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offsets = B.text_buffer(batch.column("text"))
            ids, extra = batch.column("doc_id").fill_null(MISSING).to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False)
            for a, b in B.pieces(offsets, size):
                at = offsets[a : b + 1]
                body = buf[at[0] : at[-1]]
                blob = pack(body, at - at[0], ids[a:b].astype(np.int64), extra[a:b].astype(np.uint8), level=6)
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), pa.array([len(body)], pa.int64())], names=["block", "payload", "n_bytes"])
                number += 1

    return run


def blocks(docs: DataFrame, mark=None, size: int = BLOCK) -> DataFrame:
    """The staged blocks of docs (doc_id, text without nulls); mark: a small number of each
    document that goes along. unpack(payload) gives bytes, offsets, ids, marks; a null
    doc_id is the largest number."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(0) if mark is None else mark).cast("int").alias("mark"))
    packed = read.mapInArrow(_pack_batches(size), BLOCK_SCHEMA)
    return keep(packed)


def keep(packed: DataFrame) -> DataFrame:
    """Blocks staged in buckets by their number: answers come to them, they stay where they are."""
    return stage(packed, "blocks", by="block", **STORED)


def bucket_count(packed: DataFrame) -> int:
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    floor = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-total // BUCKET))


def parts_table(bucket: np.ndarray | list, block: np.ndarray | list | int, blobs: list[bytes]) -> pa.Table:
    block = [block] * len(blobs) if np.isscalar(block) else block
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "block": pa.array(block, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def emit(packed: DataFrame, each: Callable[[int, list[np.ndarray]], pa.Table]) -> DataFrame:
    """Parts (bucket, block, blob) that each(block, arrays) makes of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                yield from each(block, unpack(payload.as_buffer())).to_batches()

    return packed.select("block", "payload").mapInArrow(run, PART_SCHEMA)


def answer(parts: DataFrame, each: Callable[[int, list[int], list[list[np.ndarray]]], list[bytes]]) -> DataFrame:
    """For every bucket, each(bucket, blocks, arrays of each part) gives a blob for each part, and may
    give more, for no block (-1)."""

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("block")
        bucket, block = order["bucket"][0].as_py(), order["block"].to_pylist()
        blobs = each(bucket, block, [unpack(x.as_buffer()) for x in order["blob"]])
        return parts_table([bucket] * len(blobs), block + [-1] * (len(blobs) - len(block)), blobs)

    return parts.groupBy("bucket").applyInArrow(run, PART_SCHEMA)


def finish(packed: DataFrame, answers: DataFrame, each: Callable[[int, list[np.ndarray], dict[int, list[np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """each(block, arrays, answers by bucket) of every block."""
    empty = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {b: unpack(x.as_buffer()) for b, x in zip(right["bucket"].to_pylist(), right["blob"], strict=True)}
        made = [each(block, unpack(payload.as_buffer()), found) for block, payload in zip(left["block"].to_pylist(), left["payload"], strict=True)]
        return pa.concat_tables(made) if made else pa.table({c: pa.array([], empty[k]) for c, k in (x.split() for x in schema.split(", "))})

    return packed.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of the runs of sorted bucket numbers."""
    if not len(bucket):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
