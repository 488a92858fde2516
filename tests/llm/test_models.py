"""The trained operators' arithmetic against plain loops: all pairs, all paths, every window, dense least squares."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language_crf, mixing, quality_fm, toxicity_cnn
from tideline.llm._learn import one_text


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_factorisation_machine_over_all_pairs():
    rng = np.random.default_rng(1)
    texts = ["The house, and the garden!", "", "one", "a b a b a", "ÄÖ 12 34 ### x y z"]
    row, feature, value = quality_fm.features(*joined(texts), rng.normal(0, 3, (len(texts), 1)))
    size = int(feature.max()) + 1
    w, v = rng.normal(0, 1, size).astype(np.float32), rng.normal(0, 0.3, (size, quality_fm.FACTORS)).astype(np.float32)
    got, _ = quality_fm.margins([w, v], row, feature, value, len(texts))
    for t in range(len(texts)):
        x = [(int(f), float(a)) for r, f, a in zip(row, feature, value, strict=True) if r == t]
        want = sum(float(w[f]) * a for f, a in x)
        want += sum(float(v[f] @ v[g]) * a * b for (f, a), (g, b) in itertools.combinations(x, 2))
        assert math.isclose(got[t], want, rel_tol=1e-3, abs_tol=1e-3)


@pytest.mark.parametrize("held", [1 << 24, 1])
def test_forward_backward_over_all_paths(monkeypatch, held):
    monkeypatch.setattr(language_crf, "HELD", held)
    rng = np.random.default_rng(2)
    k, chains = 3, [5, 1, 6, 2]
    emission = rng.normal(0, 2, (sum(chains), k))
    transition, start = rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    first = np.zeros(sum(chains), bool)
    first[np.cumsum([0, *chains[:-1]])] = True
    got, at = language_crf.posteriors(emission, first, transition, start), 0
    for n in chains:
        weight = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            score = start[path[0]] + sum(emission[at + i, c] for i, c in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False))
            for i, c in enumerate(path):
                weight[i, c] += math.exp(score)
        assert np.allclose(got[at : at + n], weight / weight.sum(axis=1, keepdims=True), atol=1e-6)
        at += n


def test_forward_backward_in_slices_is_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    emission, first = rng.normal(0, 2, (1000, 5)), rng.random(1000) < 0.01
    first[0] = True
    whole = language_crf.posteriors(emission, first, rng.normal(0, 1, (5, 5)), np.zeros(5))
    rng = np.random.default_rng(3)
    rng.normal(0, 2, (1000, 5)), rng.random(1000)
    monkeypatch.setattr(language_crf, "HELD", 5000)
    assert np.allclose(whole, language_crf.posteriors(emission, first, rng.normal(0, 1, (5, 5)), np.zeros(5)))


@pytest.mark.parametrize("held", [1 << 18, 4])
def test_convolution_and_pooling_by_loops(monkeypatch, held):
    monkeypatch.setattr(toxicity_cnn, "HELD", held)
    rng = np.random.default_rng(4)
    texts = ["some words that go on and on for a while, in one text", "", "two words", "x", "again the words of another text here"]
    keys, owner, _ = toxicity_cnn.word_keys(*joined(texts))
    dim, filters = toxicity_cnn.DIM, toxicity_cnn.FILTERS
    model = [rng.normal(0, 1, (1 << toxicity_cnn.BITS, dim)).astype(np.float32)]
    for width in toxicity_cnn.WIDTHS:
        model += [rng.normal(0, 1, (width * dim, filters)).astype(np.float32), rng.normal(0, 1, filters).astype(np.float32)]
    got = toxicity_cnn._top(model, keys, owner, len(texts))
    assert np.allclose(got, toxicity_cnn._pooled(model, keys, owner, len(texts))[0], atol=1e-4)
    for t in range(len(texts)):
        vectors = [sum(model[0][k] for k in keys[i]) for i in np.flatnonzero(owner == t)]
        for c, width in enumerate(toxicity_cnn.WIDTHS):
            for f in range(filters):
                best = 0.0
                for i in range(len(vectors)):
                    window = [vectors[i + j] if i + j < len(vectors) else np.zeros(dim) for j in range(width)]
                    best = max(best, float(np.concatenate(window) @ model[1 + 2 * c][:, f] + model[2 + 2 * c][f]))
                assert math.isclose(got[t, c * filters + f], best, rel_tol=1e-3, abs_tol=1e-3)


def test_threshold_by_trying_all():
    rng = np.random.default_rng(5)
    for _ in range(50):
        margin, label = np.round(rng.normal(0, 1, 12), 1), rng.integers(0, 2, 12)
        t = toxicity_cnn._threshold(margin, label)
        if len(set(label)) < 2:
            assert t == 0
            continue

        def f1(x):
            hit, wrong = ((margin >= x) & (label == 1)).sum(), ((margin >= x) & (label == 0)).sum()
            return 2 * hit / max(1, label.sum() + hit + 2 * wrong)

        order = np.unique(margin)
        assert math.isclose(f1(t), max((f1((a + b) / 2) for a, b in zip(order[:-1], order[1:], strict=True)), default=f1(t)))


def test_rates_by_dense_least_squares(spark):
    rng = np.random.default_rng(6)
    n, names, targets = 300, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2}
    p = rng.dirichlet([0.4, 0.4, 0.2], n)
    size = rng.integers(0, 60, n)
    rows = [(i, int(size[i]), p[i].tolist()) for i in range(n)] + [(None, 7, [1.0, 0.0, 0.0])]
    p, size = np.vstack([p, [1.0, 0, 0]]), np.append(size, 7)
    got = mixing.rates(spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").repartition(3), names, targets).collect()
    rate = {r.doc_id: r.rate for r in got}
    r = np.array([rate[i] for i in range(n)] + [rate[None]])
    mass = (size[:, None] * p) / size.sum()
    want = np.array([targets[x] for x in names])
    # the same steps, densely
    dense = np.ones(n + 1)
    for _ in range(mixing.STEPS):
        off = dense @ mass - want
        if np.abs(off).max() < mixing.TOLERANCE:
            break
        dense = np.maximum(0, dense - p @ (off / mass.sum(axis=0)))
    assert np.allclose(r, dense, atol=1e-9) and (r >= 0).all()
    # the optimum: expected totals meet the targets, so that the objective is (nearly) 0
    assert np.abs(r @ mass - want).max() < mixing.TOLERANCE and all(x.off_target < mixing.TOLERANCE for x in got)
    assert abs(sum(x.copies for x in got) - sum(r)) < 25
    # where they can't be (all tokens shall be of one domain), the rest is told
    far = mixing.rates(spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>"), names, {"a": 1.0}).collect()
    rate = {x.doc_id: x.rate for x in far}
    r = np.array([rate[i] for i in range(n)] + [rate[None]])
    assert all(x.off_target > mixing.TOLERANCE and math.isclose(x.off_target, np.abs(r @ mass - [1, 0, 0]).max(), rel_tol=1e-6) for x in far)


def test_repeated_ids_are_learnt_from_one_text_each(spark):
    rows = [(1, "b", 1), (1, "a", 2), (2, "c", 3), (1, "a", 2)]
    once = sorted(map(tuple, one_text(spark.createDataFrame(rows, "doc_id long, text string, x int")).collect()))
    again = sorted(map(tuple, one_text(spark.createDataFrame(rows[::-1], "doc_id long, text string, x int").repartition(4)).collect()))
    assert once == again and [r[0] for r in once] == [1, 2]


def test_an_id_labelled_both_ways_counts_once(spark):
    texts = spark.createDataFrame([(i, f"fine words number {i} " + ("vile rot " if i % 2 else "")) for i in range(60)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (8, 1), (7, 1)], "doc_id long, label int")
    scores = [{r.doc_id: r.score for r in toxicity_cnn.score(texts, rows).collect()} for rows in (labels, labels.orderBy(F.desc("doc_id"), "label").repartition(3))]
    assert scores[0] == scores[1]
