"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word, its first four and its first
six bytes. Filters of widths 1, 2 and 3 slide over the word vectors of a text, each keeps
its maximum over the whole text, and a logistic layer reads the maxima. Embeddings start
from log-odds of the training texts in one coordinate and are trained with the rest.

Thresholds are calibrated by language on held-back training rows, and the language is read
from the text itself (profiles of frequent words learnt from the training rows), so no
column but the text enters a score. Scores are shifted so that every language's threshold
lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._blocks import unpack
from tideline.llm._learn import PART_ROWS, PIECE, Adam, all_labelled, by_piece, fit, in_parts, part_count, sigmoid, summed, sums_by
from tideline.llm._shared import release

BITS, DIM, FILTERS, WIDTHS = 17, 12, 8, (1, 2, 3)
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE = 10, 32, 0.005
#: Share of the words whose own key, and each prefix, is hidden in a training step, so that unseen forms of a word count.
HIDE = (0.7, 0.1, 0.7)
LANG_BITS = 14
TABLE = len(PREFIXES) + 1


def word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed ids of every word (words x TABLE; 0 is none), its text, and the words' ids for language profiles.
    Marks around a word are not part of it."""
    low = B.LOWER[buf]
    starts, ends, owner = B.word_spans(low, offsets)
    for _ in range(3):
        starts = starts + (_MARK[low[starts]] & (ends - starts > 1))
        ends = ends - (_MARK[low[ends - 1]] & (ends - starts > 1))
    sums = B.prefix_sums(low)
    whole = B.mix(B.span(sums, starts, ends), 1)
    keys = [whole] + [B.mix(B.span(sums, starts, np.minimum(starts + p, ends)), 1 + p) for p in PREFIXES]
    return np.stack([np.maximum(k >> np.uint64(64 - BITS), np.uint64(1)).astype(np.int64) for k in keys], axis=1), owner, (whole >> np.uint64(64 - LANG_BITS)).astype(np.int64)


_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _responses(model: list[np.ndarray], x: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """The filters of each width on the words from each word on; zeros stand beyond the text's end."""
    y = x @ np.concatenate([model[1 + 2 * k][j * DIM : (j + 1) * DIM] for k, width in enumerate(WIDTHS) for j in range(width)], axis=1)
    same = [(owner[j:] == owner[: len(owner) - j]).astype(np.float32)[:, None] for j in range(max(WIDTHS))]
    out, at = [], 0
    for k, width in enumerate(WIDTHS):
        z = y[:, at : at + FILTERS] + model[2 + 2 * k]
        for j in range(1, width):
            z[: max(0, len(z) - j)] += y[j:, at + j * FILTERS : at + (j + 1) * FILTERS] * same[j]
        at += width * FILTERS
        out.append(z)
    return out


def _vectors(model: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    x = model[0][keys[:, 0]]
    for c in range(1, TABLE):
        x += model[0][keys[:, c]]
    return x


def _pooled(model: list[np.ndarray], keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of every filter over each text, and the word that has each (-1: none)."""
    x = _vectors(model, keys)
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    text = owner[head]
    top, at = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1)
    for k, z in enumerate(_responses(model, x, owner) if len(x) else []):
        most = np.maximum.reduceat(z, head, axis=0)
        columns = slice(k * FILTERS, (k + 1) * FILTERS)
        top[text, columns] = np.maximum(most, 0)
        size = np.diff(np.append(head, len(x)))
        word, f = np.divmod(np.flatnonzero((z == np.repeat(most, size, axis=0)) & (z > 0)), FILTERS)
        at[owner[word[::-1]], k * FILTERS + f[::-1]] = word[::-1]  # the first word that has it comes last
    return top, at


#: Words whose windows are held at once; a longer text goes on in the next ones.
HELD = 1 << 18


def _top(model: list[np.ndarray], keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The maxima alone."""
    top = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    for a in range(0, len(owner), HELD):
        b = min(a + HELD, len(owner))
        more = slice(a, b + max(WIDTHS) - 1)
        x = _vectors(model, keys[more])
        mine = owner[a:b]
        head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        for k, z in enumerate(_responses(model, x, owner[more])):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            top[mine[head], columns] = np.maximum(top[mine[head], columns], np.maximum.reduceat(z[: b - a], head, axis=0))
    return top


def _log_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities of words by language (languages x words)."""
    return np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << LANG_BITS))).astype(np.float32)


def _languages(profiles: np.ndarray, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return sums_by(owner, profiles[:, words].T, n).argmax(axis=1)


def _prepare(names: list[str]) -> Callable[[pa.Table], list[np.ndarray]]:
    """What training reads of labelled rows: keys of the distinct words, which of them each word is, where each text's begin,
    labels, languages (1 + their place in names, 0: none), and the fifth of the rows that is kept back for the thresholds."""
    place = {x: i + 1 for i, x in enumerate(names)}

    def run(table: pa.Table) -> list[np.ndarray]:
        label = table["label"].to_numpy().astype(np.uint8)
        lang = np.array([place.get(x, 0) for x in table["lang"].to_pylist()], np.uint32)
        buf, offsets = B.text_buffer(table["text"])
        n = len(label)
        packed, size = [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
        for a, b in B.pieces(offsets, PIECE):
            at = offsets[a : b + 1]
            k, o, _ = word_keys(buf[at[0] : at[-1]], at - at[0])
            packed.append((k @ (1 << BITS * np.arange(TABLE))).astype(np.uint64))
            size[a:b] = np.bincount(o, minlength=b - a)
        distinct, word = np.unique(np.concatenate(packed), return_inverse=True)
        keys = np.stack([(distinct >> np.uint64(BITS * c)) & np.uint64((1 << BITS) - 1) for c in range(TABLE)], axis=1).astype(np.uint32)
        return [keys.ravel(), word.astype(np.uint32), np.append(0, size.cumsum()), label, lang, np.arange(n) % 5 == 0]

    return run


def _counts(n_lang: int) -> Callable[[int, list[np.ndarray]], np.ndarray]:
    """Of prepared rows: texts of either label that hold a key and texts of either label (those kept back left out), and words by language."""

    def run(_: int, arrays: list[np.ndarray]) -> np.ndarray:
        keys, word, cut, label, lang, check = arrays
        keys = keys.reshape(-1, TABLE)
        words = keys[:, 0][word] >> BITS - LANG_BITS
        seen = np.zeros((2, 1 << BITS), np.int64)
        for i in np.flatnonzero(~check):
            seen[label[i], np.unique(keys[np.unique(word[cut[i] : cut[i + 1]])])] += 1
        spoken = np.repeat(lang, np.diff(cut))
        by_lang = [np.bincount(words[spoken == c + 1], minlength=1 << LANG_BITS) for c in range(n_lang)]
        return np.concatenate([seen.ravel(), np.bincount(label[~check], minlength=2), *by_lang]).astype(np.int64)

    return run


def _start(counts: np.ndarray, n_lang: int, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """The model before its first step, and the profiles."""
    seen, total, spoken = np.split(counts, [2 << BITS, (2 << BITS) + 2])
    seen, total = seen.reshape(2, -1), np.maximum(1, total)
    # log-odds of occurring in a toxic text
    odds = (np.log((seen[1] + 1) / (total[1] + 2)) - np.log((seen[0] + 1) / (total[0] + 2))).astype(np.float32)
    odds[seen[0] + seen[1] < 3] = 0
    model = [rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)]
    model[0][:, 0] = np.clip(odds, -1, 5)
    model[0][0] = 0
    for width in WIDTHS:
        w = rng.normal(0, 0.2, (width * DIM, FILTERS)).astype(np.float32)
        w[::DIM, : FILTERS // 2] = 0.3
        model += [w, np.full(FILTERS, -0.5, np.float32)]
    return [*model, np.full(FILTERS * len(WIDTHS), 0.2, np.float32), np.array([-2], np.float32)], _log_shares(spoken.reshape(n_lang, -1))


def _steps(model: list[np.ndarray], dense: Adam, arrays: list[np.ndarray], epoch: int, rng: np.random.Generator) -> None:
    """One epoch over prepared rows, in place."""
    keys, word, cut, label, _, check = arrays
    keys, label = keys.reshape(-1, TABLE), label.astype(np.float32)
    order = rng.permutation(np.flatnonzero(~check))
    rate = 0.05 / (1 + epoch)
    for first in range(0, len(order), BATCH):
        pick = order[first : first + BATCH]
        k = keys[np.concatenate([word[cut[i] : cut[i + 1]] for i in pick])]
        k = np.where(rng.random(k.shape, np.float32) < HIDE, 0, k)
        o = np.repeat(np.arange(len(pick)), [cut[i + 1] - cut[i] for i in pick])
        top, at = _pooled(model, k, o, len(pick))
        slope = (sigmoid(top @ model[-2] + model[-1]) - label[pick]) / len(pick)
        gradients = [np.zeros_like(a) for a in model[1:]]
        gradients[-2][:], gradients[-1][:] = top.T @ slope, slope.sum()
        into = slope[:, None] * model[-2][None, :] * (at >= 0)
        for c, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                where = at[:, c * FILTERS + f]
                use = np.flatnonzero(where >= 0)
                if not len(use):
                    continue
                g = into[use, c * FILTERS + f]
                w = model[1 + 2 * c]
                for j in range(width):
                    here = where[use] + j
                    inside = here < len(o)
                    inside[inside] = o[here[inside]] == use[inside]
                    here, gj = here[inside], g[inside]
                    x = model[0][k[here]].sum(axis=1)
                    gradients[2 * c][j * DIM : (j + 1) * DIM, f] += gj @ x
                    np.add.at(model[0], k[here].ravel(), np.repeat(-rate * gj[:, None] * w[j * DIM : (j + 1) * DIM, f][None, :], TABLE, axis=0))
                gradients[2 * c + 1][f] += g.sum()
        model[0][0] = 0
        dense.step(gradients)


def _judged(model: list[np.ndarray], profiles: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margin, language as read from the text, and label of the prepared rows that were kept back."""
    keys, word, cut, label, _, check = arrays
    keys, rows = keys.reshape(-1, TABLE), np.flatnonzero(check)
    margin, guess = np.zeros(len(rows), np.float32), np.zeros(len(rows), np.int32)
    for a in range(0, len(rows), 256):
        some = rows[a : a + 256]
        spans = [slice(cut[i], cut[i + 1]) for i in some]
        owner = np.repeat(np.arange(len(some)), [s.stop - s.start for s in spans])
        k = keys[np.concatenate([word[s] for s in spans])]
        margin[a : a + 256] = _top(model, k, owner, len(some)) @ model[-2] + model[-1]
        guess[a : a + 256] = _languages(profiles, k[:, 0] >> BITS - LANG_BITS, owner, len(some))
    return margin, guess, label[rows]


def _train(table: pa.Table) -> list[np.ndarray]:
    """The model of rows that are one part."""
    names = sorted({x for x in table["lang"].to_pylist() if x is not None}) or [""]
    arrays = _prepare(names)(table)
    rng = np.random.default_rng(11)
    model, profiles = _start(_counts(len(names))(0, arrays), len(names), rng)
    dense = Adam(model[1:], RATE)
    for epoch in range(EPOCHS):
        _steps(model, dense, arrays, epoch, rng)
    margin, guess, label = _judged(model, profiles, arrays)
    limits = np.array([_threshold(margin[guess == c], label[guess == c]) for c in range(len(names))], np.float32)
    return [*(a.ravel() for a in model), profiles.ravel(), limits]


#: Moves are summed as whole numbers of this fraction; margins of more rows than a part are counted in cells of this width.
FRACTION, CELL = 2.0**36, 1 / 256


def _train_parts(rows: DataFrame, n: int) -> list[np.ndarray]:
    """The model of rows in n parts. Words are counted over all of them. In an epoch every part makes its own steps from the
    shared model; then the moves are averaged, those of a word's embedding over the parts that moved it. Thresholds come from
    all rows kept back, their margins counted in cells."""
    context = rows.sparkSession.sparkContext
    names = sorted(r.lang for r in rows.select("lang").where("lang is not null").distinct().collect()) or [""]
    parts = in_parts(rows, n, _prepare(names))
    model, profiles = _start(summed(parts, _counts(len(names))), len(names), np.random.default_rng(11))
    state = Adam(model[1:], RATE)
    for epoch in range(EPOCHS):
        shared = context.broadcast((model, state.m, state.v, state.t))
        total = summed(parts, _moves(shared, epoch)) / FRACTION
        embedding, touched, moved, steps, learnt = np.split(total, np.cumsum([model[0].size, len(model[0]), 3 * sum(a.size for a in model[1:]), 1]))
        shared.destroy()
        model[0] += (embedding.reshape(-1, DIM) / np.maximum(touched * FRACTION, 1)[:, None]).astype(np.float32)
        dense, at = [*model[1:], *state.m, *state.v], 0
        for a in dense:
            a += (moved[at : at + a.size] / max(1, learnt[0] * FRACTION)).reshape(a.shape).astype(a.dtype)
            at += a.size
        state.t += round(steps[0] / max(1, learnt[0]))
    final = context.broadcast((model, profiles))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                margin, guess, label = _judged(*final.value, unpack(payload.as_buffer()))
                yield pa.record_batch([pa.array(guess), pa.array(margin.astype(float)), pa.array(label.astype(np.int32))], names=["language", "margin", "label"])

    cell = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("margin"))) / CELL)
    found = parts.select("payload").mapInArrow(judged, "language int, margin double, label int").groupBy("language", cell.alias("cell"))
    cells = found.agg(F.min("margin").alias("low"), F.max("margin").alias("high"), F.sum("label").alias("ones"), F.count_if(F.col("label") == 0).alias("zeros")).toPandas().sort_values(["language", "cell"])
    limits = np.zeros(len(names), np.float32)
    for c, mine in cells.groupby("language"):
        limits[c] = _limit(*(mine[x].to_numpy() for x in ("low", "high", "ones", "zeros")))
    release(parts)
    return [*(a.ravel() for a in model), profiles.ravel(), limits]


def _moves(shared: Broadcast, epoch: int) -> Callable[[int, list[np.ndarray]], np.ndarray]:
    """What an epoch over a part moves: embeddings, which of them moved, the other arrays and Adam's means, its steps, 1."""

    def run(part: int, arrays: list[np.ndarray]) -> np.ndarray:
        start, m, v, t = shared.value
        model = [a.copy() for a in start]
        dense = Adam(model[1:], RATE)
        dense.m, dense.v, dense.t = [a.copy() for a in m], [a.copy() for a in v], t
        _steps(model, dense, arrays, epoch, np.random.default_rng([11, part, epoch]))
        embedding = model[0] - start[0]
        pairs = zip([*model[1:], *dense.m, *dense.v], [*start[1:], *m, *v], strict=True)
        moved = [embedding.ravel(), *((a - b).ravel() for a, b in pairs)]
        whole = [np.rint(a.astype(float) * FRACTION).astype(np.int64) for a in moved]
        return np.concatenate([whole[0], embedding.any(axis=1), *whole[1:], [dense.t - t, int(dense.t > t)]]).astype(np.int64)

    return run


def _threshold(margin: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap between two margins that gives the best F1, false alarms
    counted twice (label 1 is the rarer one), the widest gap among equals; 0
    without both labels."""
    order, at = np.unique(np.asarray(margin, float), return_inverse=True)
    return _limit(order, order, np.bincount(at, label), np.bincount(at, 1.0 - label))


def _limit(low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The threshold by cells in order of their margins: least and largest margin, rows of either label."""
    if len(low) < 2 or not ones.sum() or not zeros.sum():
        return 0.0
    hit, wrong = (x[::-1].cumsum()[::-1][1:] for x in (ones, zeros))
    score = 2 * hit / np.maximum(1, ones.sum() + hit + 2 * wrong)
    return float(max(zip(score, low[1:] - high[:-1], (low[1:] + high[:-1]) / 2, strict=True))[2])


def _unflatten(arrays: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    model = [arrays[0].reshape(-1, DIM)]
    for k, width in enumerate(WIDTHS):
        model += [arrays[1 + 2 * k].reshape(width * DIM, FILTERS), arrays[2 + 2 * k]]
    model += [arrays[1 + 2 * len(WIDTHS)], arrays[2 + 2 * len(WIDTHS)]]
    return model, arrays[-2].reshape(-1, 1 << LANG_BITS), arrays[-1]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", part: int = PART_ROWS) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1; 0.5 is the threshold of the text's language), language (its number, read from the text).

    labels has doc_id and label (0 or 1); all of its rows are learnt from, in parts of about ``part``
    if there are more, and lang_col is read only for those, to learn the profiles. Null text is empty: no
    filter fires. Without any labelled row every score is 0.5. Repeated rows are scored
    alike; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learnt = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    rows = all_labelled(learnt, labels)
    n = part_count(rows, part)
    arrays = fit(rows, _train) if n < 2 else _train_parts(rows, n)
    release(rows)
    if not arrays:
        return read.select("doc_id", F.lit(0.5).alias("score"), F.lit(0).alias("language"))
    shared = docs.sparkSession.sparkContext.broadcast(_unflatten(arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, profiles, limits = shared.value

        def each(buf: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
            n = len(offsets) - 1
            keys, owner, words = word_keys(buf, offsets)
            language = _languages(profiles, words, owner, n)
            margin = _top(model, keys, owner, n) @ model[-2] + model[-1] - limits[language]
            return pa.record_batch([rows.column("doc_id"), pa.array(sigmoid(margin.astype(float))), pa.array(language.astype(np.int32))], names=["doc_id", "score", "language"])

        return by_piece(batches, each)

    return read.mapInArrow(run, f"doc_id {kind}, score double, language int")
