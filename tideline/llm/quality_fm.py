"""Quality classifier: a factorisation machine over hashed words, structure statistics
and numeric metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise part in
linear time as half of (square of the sum minus sum of the squares) in each factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._learn import SAMPLE, Adam, bag, by_piece, fit, labelled_sample, sigmoid, sums_by

BITS, FACTORS, EPOCHS, BATCH, RATE = 16, 8, 6, 64, 0.01
#: Statistics of structure, in order (see structure()).
STATISTICS = ("bytes", "words", "word_length", "upper", "digit", "mark", "wide", "space", "lines", "marked_words", "distinct", "top_word", "distinct_pairs")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def structure(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (texts x STATISTICS), hashes of the words and their texts."""
    n = len(offsets) - 1
    low = B.LOWER[buf]
    starts, ends, owner = B.word_spans(low, offsets)
    hashes = B.mix(B.span(B.prefix_sums(low), starts, ends) + (ends - starts).astype(np.uint64))
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / some

    words = np.bincount(owner, minlength=n).astype(float)
    least = np.maximum(words, 1)
    _, count = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)), return_counts=True)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    row = (keys >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, row, count)
    pair = B.mix(hashes[:-1]) + hashes[1:]
    inside = owner[1:] == owner[:-1]
    pairs = np.unique((owner[1:][inside].astype(np.uint64) << np.uint64(44)) | (pair[inside] >> np.uint64(20))) >> np.uint64(44)
    out = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(words) / 8,
            np.bincount(owner, ends - starts, n) / least / 10,
            share(_UPPER[buf]) * 2,
            share(_DIGIT[buf]) * 4,
            share(_MARK[buf]) * 4,
            share(buf >= 128) * 2,
            share(B.SPACE[buf]) * 2,
            share(buf == 10) * 20,
            np.bincount(owner, _MARK[buf[ends - 1]] if len(ends) else None, n) / least,
            np.bincount(row, minlength=n) / least,
            top / least * 2,
            np.bincount(pairs.astype(np.int64), minlength=n) / least,
        ],
        axis=1,
    )
    return out.astype(np.float32), hashes, owner


def features(buf: np.ndarray, offsets: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (owner, feature, value): words, then statistics, then metadata (log(1 + |x|) / 10, null 0), then a constant."""
    n = len(offsets) - 1
    stats, hashes, owner = structure(buf, offsets)
    row, feature, value = bag(hashes, owner, n, BITS)
    dense = np.concatenate([stats, np.log1p(np.abs(np.nan_to_num(meta))).astype(np.float32) / 10, np.ones((n, 1), np.float32)], axis=1)
    rows = np.concatenate([row, np.repeat(np.arange(n), dense.shape[1])])
    ids = np.concatenate([feature, np.tile((1 << BITS) + np.arange(dense.shape[1]), n)])
    values = np.concatenate([value, dense.ravel()])
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], values[order]


def margins(model: list[np.ndarray], row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output before the sigmoid, and the sums of each factor."""
    w, v = model
    vx = v[feature] * value[:, None]
    total = sums_by(row, vx, n)
    squares = sums_by(row, vx * vx, n)
    linear = sums_by(row, w[feature] * value, n)
    return linear + 0.5 * (total * total - squares).sum(axis=1), total


def _train(n_meta: int):
    def run(table: pa.Table) -> list[np.ndarray]:
        label = table["label"].to_numpy().astype(np.float32)
        meta = _meta(table, n_meta)
        rng = np.random.default_rng(7)
        size = (1 << BITS) + len(STATISTICS) + n_meta + 1
        model = [np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)]
        buf, offsets = B.text_buffer(table["text"])
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in B.pieces(offsets, 1 << 20):
            at = offsets[a : b + 1]
            row, feature, value = features(buf[at[0] : at[-1]], at - at[0], meta[a:b])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            rows += [(feature[x:y].astype(np.int32), value[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        step = Adam(model, RATE)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for first in range(0, len(order), BATCH):
                pick = order[first : first + BATCH]
                row = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                feature = np.concatenate([rows[i][0] for i in pick])
                value = np.concatenate([rows[i][1] for i in pick])
                margin, total = margins(model, row, feature, value, len(pick))
                slope = ((sigmoid(margin) - label[pick]) / len(pick)).astype(np.float32)
                gw, gv = np.zeros_like(model[0]), np.zeros_like(model[1])
                np.add.at(gw, feature, slope[row] * value)
                np.add.at(gv, feature, (slope[row] * value)[:, None] * (total[row] - model[1][feature] * value[:, None]))
                step.step([gw + 1e-5 * model[0], gv + 1e-4 * model[1]])
        return model

    return run


def _meta(table, n: int) -> np.ndarray:
    columns = [np.asarray(table[f"meta{i}"].to_pandas(), dtype=float) for i in range(n)]
    return np.stack(columns, axis=1) if columns else np.zeros((table.num_rows, 0))


def score(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: label 1 likelier).

    labels has doc_id and label (0 or 1); at most ``sample`` of its rows are learnt from.
    metadata names numeric columns of docs. Null text is empty and scored by its
    statistics alone; null metadata counts as 0. Without any labelled row every score is
    0.5. Repeated rows are scored alike; other columns are ignored; an empty table gives
    an empty result.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)])
    n = len(metadata)
    model = fit(labelled_sample(read, labels, sample), _train(n))
    if not model:
        return read.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast([model[0], model[1].reshape(-1, FACTORS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(buf: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
            margin, _ = margins(shared.value, *features(buf, offsets, _meta(rows, n)), len(offsets) - 1)
            return pa.record_batch([rows.column("doc_id"), pa.array(sigmoid(margin.astype(float)))], names=["doc_id", "score"])

        return by_piece(batches, each)

    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs whose score reaches the threshold; all columns stay. Rows of one doc_id share
    their best score."""
    id_col = options.get("id_col", "doc_id")
    bad = score(docs, labels, **options).groupBy("doc_id").agg(F.max("score").alias("score")).where(F.col("score") < threshold).select("doc_id")
    return docs.alias("all").join(bad.alias("bad"), F.col(f"all.{id_col}").eqNullSafe(F.col("bad.doc_id")), "left_anti")
