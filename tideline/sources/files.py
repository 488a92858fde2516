"""Files of a folder and all below it, by Spark's binaryFile and text sources.

A listing reads no content: only path and length are asked for. A hash takes the bytes of a file as
its lines, which the text source passes on as they are. SHA-256 goes on from byte to byte, so a file is read as
one split and hashed there. Where Spark deals it out in several nevertheless (settings that are held, over a
terabyte), pieces of its splits meet in order in one task. No task holds a file: it holds batches, what Spark
sorts of such pieces before it spills, and the longest stretch without a newline (up to 2 GB).
Spark's file sources pass over files without a byte, so those are not listed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of files that Spark's text source unpacks; those are read whole, up to 2 GB each.
PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")
#: Bytes of a piece.
PIECE = 1 << 11
#: Bytes up to which a file is one split.
SPLIT = 1 << 40
#: The mark that the text source takes off the start of a file.
MARK = b"\xef\xbb\xbf"
#: What tasks tell of a file: pieces by the first byte of their split and place in it, and before them its length (LISTED) or its digest (DONE).
TOLD = {"path": "string", "start": "long", "place": "int", "bytes": "long", "content": "binary"}
LISTED, DONE = -2, -1


def _name(path: Column) -> Column:
    """A file's name, from a path as _metadata has it: a URL, where a plus stands for itself."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def _unsplit(spark: SparkSession) -> SparkSession:
    """A session whose sources read each file as one split, and one in a task; else with spark's settings, as far as
    they can be set (static ones are the context's), with those of stores (fs. ...)."""
    made, wide = spark.newSession(), {f"spark.sql.files.{c}": str(SPLIT) for c in ("maxPartitionBytes", "openCostInBytes")}
    for key, value in (spark.conf.getAll | wide).items():
        if made.conf.get(key, None) != value and (made.conf.isModifiable(key) or not key.startswith("spark.")):
            made.conf.set(key, value)
    return made


def _files(spark: SparkSession, source: str, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """The source over the files whose suffix is among suffixes; others are not opened."""
    found = spark.read.format(source).option("recursiveFileLookup", "true").option("lineSep", "\n").load(folder)
    path, among = F.col("_metadata.file_path"), F.lit(False)
    plain = [s for s in suffixes if re.fullmatch(r"\.[a-z0-9_+-]+", s)]  # the end of a URL tells these, which is cheap for each line
    for suffix in plain:
        among |= F.lower(path).endswith(suffix)
    if others := set(suffixes) - set(plain):
        among |= F.lower(F.regexp_extract(_name(path), r"(\.[^.]*)$", 1)).isin(*others)
    return found.where(among)


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """name, bytes of the files whose lower-cased suffix is among suffixes (with the point)."""
    return _files(spark, "binaryFile", folder, suffixes).select(_name(F.col("_metadata.file_path")).alias("name"), F.col("length").alias("bytes"))


def hashed(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """name, bytes, sha256 (lower-case hex) of the same files."""
    told = ", ".join(f"{c} {t}" for c, t in TOLD.items())
    meta, length = lambda c: F.col(f"_metadata.{c}"), F.col("length").alias("bytes")
    at = lambda start: (meta("file_path").alias("path"), F.lit(start).cast("long").alias("start"), F.lit(0).alias("place"))
    whole = tuple(s for s in suffixes if s in PACKED)
    lines = _files(_unsplit(spark), "text", folder, tuple(s for s in suffixes if s not in PACKED))
    one = (meta("file_block_start") == 0) & (meta("file_block_length") == meta("file_size"))
    lines = lines.select(at(0)[0], meta("file_block_start").alias("start"), F.when(one, meta("file_size")).alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    rows = _files(spark, "binaryFile", folder, suffixes).select(*at(LISTED), length, F.lit(None).cast("binary").alias("content")).unionByName(lines.mapInArrow(_read, told))
    if whole:
        rows = rows.unionByName(_files(spark, "binaryFile", folder, whole).select(*at(0), length, "content"))
    ordered = rows.repartition("path").sortWithinPartitions("path", "start", "place")
    return ordered.mapInArrow(_hashed, "path string, bytes long, sha256 string").select(_name(F.col("path")).alias("name"), "bytes", "sha256")


class _Digest:
    """SHA-256 of a file from its lines' bytes. Each line was given a newline, also a last one that has none, and
    a mark at the start is not among them: the file's length, known in the end, tells what there was."""

    def __init__(self):
        self.read, self.last, self.plain, self.marked = 0, b"", hashlib.sha256(), hashlib.sha256(MARK)

    def add(self, data: memoryview) -> None:
        if not data:
            return
        for digest in (self.plain, self.marked):
            digest.update(self.last)
            digest.update(data[:-1])
        self.read, self.last = self.read + len(data), bytes(data[-1:])

    def end(self, path: str, size: int) -> bytes:
        over = self.read - size
        if over not in (0, 1, -len(MARK), 1 - len(MARK)):
            raise ValueError(f"{path}: {self.read} bytes read of {size}")
        digest = self.marked if over < 0 else self.plain
        digest.update(b"" if over in (1, 1 - len(MARK)) else self.last)
        return digest.digest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the files that a task reads whole, and the pieces of other splits (size is null), read one after another."""
    at, size, place, held, digest = None, None, 0, b"", None

    def ended():
        if at is None:
            return []
        return [(*at, place, len(held), held)] if size is None else [(at[0], DONE, 0, size, digest.end(at[0], size))]

    def table(rows):
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), TOLD.values())], list(TOLD))

    for batch in batches:
        path, start, out = batch["path"].dictionary_encode(), batch["start"].to_numpy(), []
        codes, lines = path.indices.to_numpy(), batch["line"].to_numpy(zero_copy_only=False)
        turns = (np.flatnonzero((codes[1:] != codes[:-1]) | (start[1:] != start[:-1])) + 1).tolist()
        for i, j in zip([0, *turns], [*turns, len(lines)]):
            if i < j and (here := (path[i].as_py(), int(start[i]))) != at:
                out += ended()
                at, size, place, held, digest = here, batch["size"][i].as_py(), 0, b"", _Digest()
            data = b"".join([held, *lines[i:j]])
            if size is not None:
                digest.add(memoryview(data))
                continue
            cuts = range(0, len(data) - PIECE + 1, PIECE)
            out += [(*at, place + k, PIECE, data[c : c + PIECE]) for k, c in enumerate(cuts)]
            place, held = place + len(cuts), data[len(cuts) * PIECE :]
        if out:
            yield table(out)
    if at is not None:
        yield table(ended())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each file from what is told of it, in order."""
    each = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("path", "start", "bytes")), batch["content"]))
    for path, rows in groupby(each, key=lambda row: row[0]):
        size, done, digest = None, None, _Digest()
        for _, start, count, content in rows:
            if start == LISTED:
                size = count
            elif start == DONE:
                done = (count, content.as_py())
            else:
                digest.add(memoryview(content.as_buffer()))
        if size is None or done and (done[0] != size or digest.read):
            raise ValueError(f"{path}: changed while it was read")
        found = done[1] if done else digest.end(path, size)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([found.hex()])], ["path", "bytes", "sha256"])
