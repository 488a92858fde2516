"""Mixing documents to target domain weights with soft membership.

A softmax classifier over hashed words, trained on a labelled table, predicts each
document's domain posteriors. Document rates r >= 0 then minimise the squared difference
between the expected domain token totals, sum of r_d * tokens_d * p_dk, and the targets,
by projected gradient from r = 1 (each step scaled by the domains' base masses, so steps
of one are stable). A step needs only the K totals of the step before, so the driver sees K
numbers a step and a document's rate is a fold over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._learn import Adam, bag, by_piece, fit, one_text, sums_by
from tideline.llm._shared import stage

BITS, EPOCHS, BATCH, RATE = 16, 4, 64, 0.02
#: Labelled rows learnt from at most: those with the least hash of their id.
SAMPLE = 5000
STEPS, TOLERANCE = 60, 1e-4


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _train(table: pa.Table) -> list[np.ndarray]:
    names = sorted(set(table["domain"].to_pylist()))
    k = len(names)
    label = np.array([names.index(x) for x in table["domain"].to_pylist()])
    buf, offsets = B.text_buffer(table["text"])
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in B.pieces(offsets, 1 << 20):
        at = offsets[a : b + 1]
        hashes, owner = B.word_hashes(buf[at[0] : at[-1]], at - at[0])
        row, feature, value = bag(hashes, owner, b - a, BITS)
        cut = np.searchsorted(row, np.arange(b - a + 1))
        rows += [(feature[x:y].astype(np.int32), value[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    weights, bias = np.zeros((1 << BITS, k), np.float32), np.zeros(k, np.float32)
    step, rng = Adam([weights, bias], RATE), np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            row = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            feature, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            slope = _softmax(sums_by(row, weights[feature] * value[:, None], len(pick)) + bias)
            slope[np.arange(len(pick)), label[pick]] -= 1
            slope /= len(pick)
            gradient = np.stack([np.bincount(feature, slope[row, c] * value, 1 << BITS) for c in range(k)], axis=1)
            step.step([gradient.astype(np.float32), slope.sum(axis=0)])
    return [weights.ravel(), bias, np.frombuffer("\0".join(names).encode(), np.uint8)]


def posteriors(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(key columns, n_tokens, p) of every row, and the domains' names in the order of p.
    labelled has doc_id and domain; rows with a null do not count."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = stage(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")  # bounded, so it may be broadcast
    arrays = fit(one_text(read.join(F.broadcast(ids), "doc_id")), _train)
    kind = read.schema["doc_id"].dataType.simpleString()
    names = arrays[2].tobytes().decode().split("\0") if arrays else ["all"]
    k = len(names)
    model = [arrays[0].reshape(-1, k), arrays[1]] if arrays else [np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(buf: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
            n = len(offsets) - 1
            weights, bias = shared.value
            hashes, owner = B.word_hashes(buf, offsets)
            row, feature, value = bag(hashes, owner, n, BITS)
            p = _softmax(sums_by(row, weights[feature] * value[:, None], n) + bias).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(p.ravel()))
            return pa.record_batch([rows.column("doc_id"), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), lists], names=["doc_id", "n_tokens", "p"])

        return by_piece(batches, each)

    return stage(read.mapInArrow(run, f"doc_id {kind}, n_tokens long, p array<double>"), "posteriors"), names


def _fold(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(p))
    for m in moves:
        rate = np.maximum(0, rate - p @ m)
    return rate


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch.column("p").flatten()).reshape(-1, k)


def rates(scored: DataFrame, names: list[str], targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate, copies (the rate rounded
    up or down at random by a hash of doc_id, right on average: how often to take the
    document), and off_target: the largest difference, on every row the same, between a
    domain's expected share of tokens and its target, under TOLERANCE if the targets are met."""
    k = len(names)
    total = sum(targets.get(x, 0.0) for x in names) or 1.0
    want = np.array([targets.get(x, 0.0) / total for x in names])

    def totals(moves: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = _matrix(batch, k)
                t = np.asarray(batch.column("n_tokens"), float) * _fold(p, moves)
                yield pa.record_batch([pa.array([v]) for v in t @ p], names=[f"t{c}" for c in range(k)])

        sums = scored.mapInArrow(run, ", ".join(f"t{c} double" for c in range(k))).agg(*[F.sum(f"t{c}") for c in range(k)]).first()
        return np.array([x or 0.0 for x in sums])

    moves: list[np.ndarray] = []
    base = totals(moves)
    tokens = max(base.sum(), 1.0)
    mass = np.maximum(base / tokens, 1e-9)
    off = base / tokens - want if base.sum() else np.zeros(k)
    while np.abs(off).max() >= TOLERANCE and len(moves) < STEPS:
        moves.append(off / mass)
        off = totals(moves) / tokens - want
    left = float(np.abs(off).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch, k)
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            columns = [batch.column("doc_id"), batch.column("n_tokens"), pa.array([names[b] for b in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(_fold(p, moves))]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "domain", "posterior", "rate"])

    kind = scored.schema["doc_id"].dataType.simpleString()
    made = scored.mapInArrow(run, f"doc_id {kind}, n_tokens long, domain string, posterior double, rate double")
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return made.withColumns({"copies": F.floor(F.col("rate") + chance).cast("long"), "off_target": F.lit(left)})


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """One row per input row: doc_id, n_tokens, domain, posterior, rate, copies, off_target.

    targets maps domains to weights (scaled to sum to 1; a domain without one gets 0); the
    token total stays that of docs. A target for a domain that no document has any share of
    can't be met; rates then come as close as STEPS
    steps get, and off_target tells how close. Null text is empty: no
    tokens, the classifier's prior as posterior, a rate like any other. Without labelled
    rows there is one domain and all rates go to its target. Repeated rows get equal rates;
    other columns are ignored; an empty table gives an empty result.
    """
    scored, names = posteriors(docs, labelled, **options)
    if names == ["all"]:
        targets = {"all": 1.0}
    return rates(scored, names, targets)
