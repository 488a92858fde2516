"""Language identification by a linear-chain conditional random field over words.

A word's emission adds learnt weights of its hashed prefixes, suffixes and byte trigrams
and a scaled lexicon (log-probabilities of frequent words by language); transitions and
start scores are learnt with them. Training sequences are spans of words cut from whole
documents of different languages and laid end to end, so that transitions see switches.
Forward-backward gives each word's posterior; a document's language is the one with the
largest share of its words.

Chains of a piece of text are scanned together: products of 64 steps at a time, then a
scan over these products, then the steps again with the right message; a document's first
word resets the chain, so this is exact forward-backward for every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._learn import by_piece, fit, one_text, sums_by
from tideline.llm._shared import stage

BITS, LEX_BITS, STEP = 18, 15, 64
#: Documents learnt from at most: those with the least hash of their id.
SAMPLE = 2500
EPOCHS, BATCH, LENGTH, RATE = 3, 256, 64, 0.1
AFFIXES = (1, 2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


class Words:
    """Words of consecutive texts: the distinct ones with their features, and which each is."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = B.LOWER[buf]
        starts, ends, self.owner = B.word_spans(low, offsets)
        sums = B.prefix_sums(low)
        whole = B.mix(B.span(sums, starts, ends) + (ends - starts).astype(np.uint64))
        kinds, one, self.kind = np.unique(whole, return_index=True, return_inverse=True)
        s, e = starts[one], ends[one]
        self.lexical = (kinds >> np.uint64(64 - LEX_BITS)).astype(np.int64)
        letters = np.concatenate([[0], np.cumsum(_LETTER[low])])
        self.votes = (letters[e] - letters[s] > 0)[self.kind]
        keys, rows = [], []
        number = np.arange(len(one))
        for j, n in enumerate(AFFIXES):
            for end in (0, 1):
                a, b = (s, np.minimum(s + n, e)) if not end else (np.maximum(e - n, s), e)
                keys.append(B.mix(B.span(sums, a, b), 41 + 2 * j + end))
                rows.append(number)
        size = np.maximum(e - s - 2, 0)
        row = np.repeat(number, size)
        at = s[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        keys.append(B.mix(B.span(sums, at, at + 3), 61))
        rows.append(row)
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        self.row = row[order]
        self.feature = (np.concatenate(keys)[order] >> np.uint64(64 - BITS)).astype(np.int32)
        self.n = len(one)

    def emissions(self, weights: np.ndarray, lexicon: np.ndarray, scale: float) -> np.ndarray:
        """Scores of the distinct words by language."""
        return sums_by(self.row, weights[self.feature], self.n) + scale * lexicon[self.lexical]


#: Numbers in the transfer matrices that are held at once.
HELD = 1 << 24


def posteriors(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward over words laid end to end; first marks each chain's first word."""
    n, k = emission.shape
    if n == 0:
        return emission
    steps = -(-n // STEP)
    pad = steps * STEP - n
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k), e.dtype)]).reshape(steps, STEP, k)
    first = np.concatenate([first, np.ones(pad, bool)]).reshape(steps, STEP)
    t, s = np.exp(transition - transition.max()).astype(e.dtype), np.exp(start - start.max()).astype(e.dtype)
    slices = [slice(a, a + max(1, HELD // (STEP * k * k))) for a in range(0, steps, max(1, HELD // (STEP * k * k)))]

    def into(at: slice) -> np.ndarray:
        return np.where(first[at][:, :, None, None], s[None, None, None, :], t[None, None, :, :]) * e[at][:, :, None, :]

    only = into(slices[0]) if len(slices) == 1 else None  # what fits is worked out once
    product = np.empty((steps, k, k), e.dtype)
    for at in slices:
        m = into(at) if only is None else only
        acc = m[:, 0]
        for j in range(1, STEP):
            acc = acc @ m[:, j]
            acc /= acc.sum(axis=(1, 2), keepdims=True)
        product[at] = acc
    ahead, behind = np.empty((steps, k), e.dtype), np.empty((steps, k), e.dtype)
    v = np.full(k, 1 / k, e.dtype)
    for c in range(steps):
        ahead[c] = v
        v = v @ product[c]
        v /= v.sum()
    v = np.full(k, 1 / k, e.dtype)
    for c in range(steps - 1, -1, -1):
        behind[c] = v
        v = product[c] @ v
        v /= v.sum()
    out = np.empty_like(e)
    for at in slices:
        m, f, b = into(at) if only is None else only, ahead[at], behind[at]
        for j in range(STEP):
            f = np.einsum("ci,cij->cj", f, m[:, j])
            f /= f.sum(axis=1, keepdims=True)
            out[at, j] = f
        for j in range(STEP - 1, -1, -1):
            out[at, j] *= b
            b = np.einsum("cij,cj->ci", m[:, j], b)
            b /= b.sum(axis=1, keepdims=True)
    out = out.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def _train(table: pa.Table) -> list[np.ndarray]:
    names = sorted(set(table["lang"].to_pylist()))
    k = len(names)
    lang = np.array([names.index(x) for x in table["lang"].to_pylist()])
    words = Words(*B.text_buffer(table["text"]))
    label = lang[words.owner]
    rng = np.random.default_rng(5)
    count = np.zeros((k, 1 << LEX_BITS))
    for c in range(k):
        count[c] = np.bincount(words.lexical[words.kind[label == c]], minlength=1 << LEX_BITS)
    lexicon = np.log(count + 0.5) - np.log(count.sum(axis=1, keepdims=True) + 1)
    lexicon = (lexicon - lexicon.mean(axis=0)).T.astype(np.float32)
    # spans of 5 to 60 words from all documents, in random order
    edges, at = [0], 0
    while at < len(label):
        at = min(at + int(rng.integers(5, 61)), len(label))
        edges.append(at)
    edges = np.unique(np.concatenate([edges, np.flatnonzero(np.diff(words.owner)) + 1]))
    parts = [np.arange(edges[i], edges[i + 1]) for i in rng.permutation(len(edges) - 1)]
    line = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    rows = len(line) // LENGTH
    weights, scale = np.zeros((1 << BITS, k), np.float32), np.full(1, 0.3, np.float32)
    transition, start = np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    arrays = [weights, scale, transition, start]
    squares = [np.full_like(a, 1e-2) for a in arrays]
    if rows:
        line = line[: rows * LENGTH].reshape(rows, LENGTH)
        cut = np.searchsorted(words.row, np.arange(words.n + 1))
        mark = np.zeros((BATCH, LENGTH), bool)
        mark[:, 0] = True
        for _ in range(EPOCHS):
            order = rng.permutation(rows)
            for b in range(0, rows, BATCH):
                pick = line[order[b : b + BATCH]]
                kinds, where = np.unique(words.kind[pick.ravel()], return_inverse=True)
                size = cut[kinds + 1] - cut[kinds]
                at = np.repeat(cut[kinds] - np.cumsum(size) + size, size) + np.arange(size.sum())
                feature, owner = words.feature[at], np.repeat(np.arange(len(kinds)), size)
                lex = lexicon[words.lexical[kinds]]
                emission = (sums_by(owner, weights[feature], len(kinds)) + scale * lex)[where]
                truth = label[pick.ravel()]
                gamma, pairs = _expected(emission.reshape(len(pick), LENGTH, k), transition, start)
                wrong = gamma.reshape(-1, k).copy()
                wrong[np.arange(len(truth)), truth] -= 1
                by_word = np.stack([np.bincount(where, wrong[:, c], len(kinds)) for c in range(k)], axis=1).astype(np.float32)
                gw = np.zeros_like(weights)
                for c in range(k):
                    gw[:, c] = np.bincount(feature, by_word[owner, c], 1 << BITS)
                t2 = truth.reshape(len(pick), LENGTH)
                seen = np.bincount((t2[:, :-1] * k + t2[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
                gradients = [gw, np.array([(by_word * lex).sum()], np.float32), (pairs - seen).astype(np.float32), (gamma[:, 0].sum(axis=0) - np.bincount(t2[:, 0], minlength=k)).astype(np.float32)]
                for a, q, g in zip(arrays, squares, gradients, strict=True):
                    g /= len(pick)
                    q += g * g
                    a -= RATE * g / np.sqrt(q)
    text = np.frombuffer("\0".join(names).encode(), np.uint8)
    return [weights.ravel(), scale, transition.ravel(), start, lexicon.ravel(), text]


def _expected(emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words and expected counts of the transitions of equally long sequences."""
    b, n, k = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    t = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = np.exp(start - start.max()) * e[:, 0]
    for j in range(n):
        if j:
            alpha[:, j] = (alpha[:, j - 1] @ t) * e[:, j]
        alpha[:, j] /= alpha[:, j].sum(axis=1, keepdims=True)
    for j in range(n - 2, -1, -1):
        beta[:, j] = (beta[:, j + 1] * e[:, j + 1]) @ t.T
        beta[:, j] /= beta[:, j].sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return gamma, pair.sum(axis=(0, 1))


def _no_letter(text: np.ndarray) -> bool:
    return not any(c.isalpha() for c in text.tobytes().decode("utf-8", "ignore"))


def label_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (mean posterior of lang_pred over
    the words with letters), n_switches (changes of the most likely language from one such
    word to the next).

    Learns from at most ``sample`` rows where ``train`` holds and lang_col is not null. A
    text that is null, empty or has no letter gets "und" with score 0. Without any row to
    learn from all texts are "und". Repeated rows are labelled alike; other columns are
    ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.where(train & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    ids = stage(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")  # bounded, so it may be broadcast
    arrays = fit(one_text(read.join(F.broadcast(ids), "doc_id")), _train)
    if not arrays:
        return read.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_switches"))
    names = arrays[5].tobytes().decode().split("\0")
    k = len(names)
    model = [arrays[0].reshape(-1, k), float(arrays[1][0]), arrays[2].reshape(k, k), arrays[3], arrays[4].reshape(-1, k)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scale, transition, start, lexicon = shared.value

        def each(buf: np.ndarray, offsets: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
            n = len(offsets) - 1
            words = Words(buf, offsets)
            first = np.append(True, words.owner[1:] != words.owner[:-1])[: len(words.owner)]
            gamma = posteriors(words.emissions(weights, lexicon, scale)[words.kind], first, transition, start)
            voting = np.flatnonzero(words.votes)
            total = sums_by(words.owner[voting], gamma[voting].astype(np.float64), n)
            count = np.bincount(words.owner[voting], minlength=n)
            best = total.argmax(axis=1)
            score = np.where(count > 0, total[np.arange(n), best] / np.maximum(count, 1), 0.0)
            top, owner = gamma[voting].argmax(axis=1), words.owner[voting]
            change = (top[1:] != top[:-1]) & (owner[1:] == owner[:-1])
            switches = np.bincount(owner[1:][change], minlength=n)
            plain = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
            ascii_letters = plain[offsets[1:]] - plain[offsets[:-1]]
            pred = [names[x] for x in best]
            for d in np.flatnonzero(ascii_letters == 0):
                if count[d] == 0 or _no_letter(buf[offsets[d] : offsets[d + 1]]):
                    pred[d], score[d], switches[d] = "und", 0.0, 0
            return pa.record_batch([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(switches.astype(np.int64))], names=["doc_id", "lang_pred", "score", "n_switches"])

        return by_piece(batches, each)

    return read.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_switches long")
