"""What the trained operators share: labelled rows (a bounded sample, or all of them in parts of
bounded size), training in one task or over parts, hashed word features, and Adam."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._blocks import pack, unpack
from tideline.llm._shared import fits_broadcast, release, stage

#: Most labelled rows that a model is fitted on: those with the least hash of their id.
SAMPLE = 6000
PIECE = 1 << 20
#: Labelled rows and text bytes of a part, and numbers of a slice of what parts are summed to.
PART_ROWS, PART_BYTES = 6000, 10 << 20
SLICE = 1 << 14


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, ...) of at most n labelled ids, with their label (an int). An id
    labelled more than once takes its mean label, rounded; null ids and labels do not count."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    ids = stage(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n), "sample")  # n rows: bounded, so it may be broadcast
    return one_text(docs.join(F.broadcast(ids), "doc_id"))


def all_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) of every labelled id, with their label (an int), staged; one text for each id.
    An id labelled more than once takes its mean label, rounded; null ids and labels do not count."""
    one = stage(labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label")).where("label in (0, 1)"), "labels")
    made = stage(one_text(docs.join(F.broadcast(one) if fits_broadcast(one.count(), 64) else one, "doc_id")), "labelled")
    release(one)
    return made


def part_count(rows: DataFrame, most: int) -> int:
    """How many parts of at most about ``most`` rows, and PART_BYTES of text, rows are dealt into."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(-(-n // most), -(-size // PART_BYTES))


def in_parts(rows: DataFrame, n: int, prepare: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """rows dealt into n parts by the hash of their id, staged as a row (part, payload) each: what prepare makes of its table, packed."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"][:1], "payload": pa.array([pack(*prepare(table.sort_by("doc_id")))], pa.binary())})

    dealt = rows.withColumn("part", F.expr(f"pmod(xxhash64(doc_id), {n})"))
    return stage(dealt.groupBy("part").applyInArrow(run, "part long, payload binary"), "parts", **{"parquet.block.size": str(16 << 20)})


def summed(parts: DataFrame, each: Callable[[int, list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum over all parts of each(part, arrays), whole numbers of a fixed length, so that no order changes it. A
    task adds up its own parts, slices of these sums meet by number, and the driver gets the total alone."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                got = each(part, unpack(payload.as_buffer()))
                total = got if total is None else total + got
        if total is not None:
            yield _slices({i: total[a : a + SLICE] for i, a in enumerate(range(0, len(total), SLICE))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
                got = unpack(blob.as_buffer())[0]
                totals[i] = totals[i] + got if i in totals else got
        yield _slices(totals)

    made = parts.select("part", "payload").mapInArrow(own, _SLICES).repartition("slice").mapInArrow(meet, _SLICES).collect()
    return np.concatenate([unpack(r.blob)[0] for r in sorted(made, key=lambda r: r.slice)])


_SLICES = "slice int, blob binary"


def _slices(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([pack(x) for x in totals.values()], pa.binary())], names=["slice", "blob"])


def one_text(rows: DataFrame) -> DataFrame:
    """One row for each doc_id: that with the least text by hash, whatever the order of rows."""
    best = rows.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return best.select("doc_id", "row.*")


def fit(sample: DataFrame, train: Callable[[pa.Table], list[np.ndarray]]) -> list[np.ndarray]:
    """The model's arrays, trained in one task on the whole (bounded) sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield pa.record_batch([pa.array([pack(*train(pa.Table.from_batches(got).sort_by("doc_id")))], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return unpack(made[0].model) if made else []


def by_piece(batches: Iterator[pa.RecordBatch], each: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """each(bytes, offsets, rows) of runs of texts of about PIECE bytes together."""
    for batch in batches:
        buf, offsets = B.text_buffer(batch.column("text"))
        for a, b in B.pieces(offsets, PIECE):
            at = offsets[a : b + 1]
            yield each(buf[at[0] : at[-1]], at - at[0], batch.slice(a, b - a))


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by their sorted owner, zeros for owners without rows."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(owner):
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[head]] = np.add.reduceat(values, head, axis=0)
    return out


def bag(hashes: np.ndarray, owner: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed words: owner, feature and value (1 + log of the count, each row of length 1)."""
    keys, count = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(64 - bits)), return_counts=True)
    row, feature = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    value = 1 + np.log(count.astype(np.float32))
    norm = np.sqrt(np.bincount(row, value * value, n))
    return row, feature, (value / norm[row]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Steps on a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = ([np.zeros_like(a) for a in arrays] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for a, m, v, g in zip(self.arrays, self.m, self.v, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= (scale * m / (np.sqrt(v) + 1e-8)).astype(a.dtype)
