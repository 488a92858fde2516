"""The gradients that the trained operators step along, against finite differences of their losses."""

import itertools
import math

import numpy as np
import pyarrow as pa

from tideline.llm import language_crf, quality_fm, toxicity_cnn

TEXTS = ["The house, and the garden!", "one", "a b a b a", "ÄÖ 12 34 ### x y z", "some words that go on and on", "vile rot, again and again it is vile", "two words", "x y z w v u t s r"]
LABELS = [0, 1, 0, 1, 0, 1, 1, 0]


class Recorder:
    """In place of the optimiser: moves to a point of its own, keeps gradients, makes no step."""

    def __init__(self, arrays, rate):
        rng = np.random.default_rng(8)
        for a in arrays:
            a += rng.normal(0, 0.1, a.shape).astype(a.dtype)
        self.arrays = arrays
        type(self).made, self.gradients = self, None

    def step(self, gradients):
        self.gradients = [g.copy() for g in gradients]


def logistic(margin, label):
    return float(np.mean(np.logaddexp(0, margin) - label * margin))


def slope(loss, array, at, eps=1e-5):
    was, ends = array[at], []
    for step in (eps, -eps):
        array[at] = was + step
        ends.append(loss())
    array[at] = was
    return (ends[0] - ends[1]) / (2 * eps)


def test_factorisation_machine(monkeypatch):
    for name, value in (("EPOCHS", 1), ("BATCH", 100), ("Adam", Recorder)):
        monkeypatch.setattr(quality_fm, name, value)
    meta = np.arange(len(TEXTS), dtype=float)[:, None]
    quality_fm._train(1)(pa.table({"text": TEXTS, "label": LABELS, "meta0": meta[:, 0]}))
    w, v = (a.astype(float) for a in Recorder.made.arrays)
    raw = [t.encode() for t in TEXTS]
    row, feature, value = quality_fm.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), meta)
    used, place = np.unique(feature, return_inverse=True)
    x = np.zeros((len(TEXTS), len(used)))
    np.add.at(x, (row, place), value)
    label, w, v = np.array(LABELS), w[used], v[used]

    def loss():
        pairs = 0.5 * ((x @ v) ** 2 - (x**2) @ (v**2)).sum(axis=1)
        return logistic(x @ w + pairs, label) + 0.5e-5 * (w**2).sum() + 0.5e-4 * (v**2).sum()

    gw, gv = (g[used] for g in Recorder.made.gradients)
    assert len(used) > 30 and np.abs(gv).max() > 1e-3
    for i in range(len(used)):
        assert math.isclose(slope(loss, w, i), gw[i], rel_tol=1e-3, abs_tol=2e-6)
        assert math.isclose(slope(loss, v, (i, i % v.shape[1])), gv[i, i % v.shape[1]], rel_tol=1e-3, abs_tol=2e-6)


def test_random_field():
    rng = np.random.default_rng(9)
    b, n, k = 3, 4, 3
    emission, transition, start = rng.normal(0, 1, (b, n, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)

    def partition():
        """The sum of the sequences' log partition functions, over all paths."""
        total = 0.0
        for s in range(b):
            paths = itertools.product(range(k), repeat=n)
            scores = [start[p[0]] + sum(emission[s, i, c] for i, c in enumerate(p)) + sum(transition[p[i], p[i + 1]] for i in range(n - 1)) for p in paths]
            total += np.logaddexp.reduce(scores)
        return total

    gamma, pairs = language_crf._expected(emission, transition, start)
    for at in itertools.product(range(b), range(n), range(k)):
        assert math.isclose(slope(partition, emission, at), gamma[at], abs_tol=1e-6)
    for at in itertools.product(range(k), range(k)):
        assert math.isclose(slope(partition, transition, at), pairs[at], abs_tol=1e-6)
    for c in range(k):
        assert math.isclose(slope(partition, start, c), gamma[:, 0, c].sum(), abs_tol=1e-6)


def test_convolutions(monkeypatch):
    pooled, kept = toxicity_cnn._pooled, {}

    def keep(model, keys, owner, n):
        kept.update(before=[a.astype(float) for a in model], keys=keys, owner=owner, embedding=model[0])
        return pooled(model, keys, owner, n)

    for name, value in (("EPOCHS", 1), ("BATCH", 100), ("HIDE", 0), ("Adam", Recorder), ("_pooled", keep)):
        monkeypatch.setattr(toxicity_cnn, name, value)
    # texts of different lengths, so that the batch's order can be told from them
    words = ["vile", "rot", "fine", "day", "tree", "stone", "bread", "sun"]
    texts = [" ".join(words[(i * j + i) % len(words)] for j in range(i + 1)) for i in range(20)]
    labels = [i % 3 == 0 for i in range(20)]
    toxicity_cnn._train(pa.table({"text": texts, "label": np.array(labels, int), "lang": ["en"] * 20}))
    model, keys, owner = kept["before"], kept["keys"], kept["owner"]
    size = np.bincount(owner)
    assert sorted(size) == [i + 1 for i in range(20) if i % 5]
    label = np.array([labels[s - 1] for s in size], float)
    starts = np.cumsum(size) - size

    def loss():
        x, tops = model[0][keys].sum(axis=1), []
        for c, width in enumerate(toxicity_cnn.WIDTHS):
            padded = np.concatenate([np.stack([np.concatenate([x[s + j : s + z], np.zeros((min(j, z), x.shape[1]))]) for j in range(width)], axis=1) for s, z in zip(starts, size, strict=True)])
            z = padded.reshape(len(x), -1) @ model[1 + 2 * c] + model[2 + 2 * c]
            tops.append(np.maximum(0, np.maximum.reduceat(z, starts, axis=0)))
        return logistic(np.concatenate(tops, axis=1) @ model[-2] + model[-1][0], label)

    rng = np.random.default_rng(10)
    # embeddings step inside the loop over filters, so later filters see them moved a little: 3 % of the largest
    for a, g in zip(model[1:], Recorder.made.gradients, strict=True):
        for at in {tuple(rng.integers(0, s) for s in a.shape) for _ in range(12)}:
            assert math.isclose(slope(loss, a, at), g[at], rel_tol=0.03, abs_tol=0.03 * np.abs(g).max() + 1e-7)
    used = np.unique(keys[keys > 0])
    moved = (model[0] - kept["embedding"]) / 0.05
    assert np.abs(moved).max() > 1e-4 and not np.delete(moved, np.append(used, 0), axis=0).any()
    for key in rng.choice(used, 12):
        d = int(rng.integers(0, toxicity_cnn.DIM))
        assert math.isclose(slope(loss, model[0], (key, d)), moved[key, d], rel_tol=0.03, abs_tol=0.03 * np.abs(moved).max())
