"""Prefix trie, ranked search and nearest neighbours against brute force, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import lexical_search, permutation_index, prefix_trie

TALK = "conv_id long, turn long, role string, text string, size string, depth string, n string, h1 int"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)

    def rolled(node):
        below = [rolled(k) for k in kids[node]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        return (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)

    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if made[c] == list(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), *rolled(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks():
    draw = random.Random(5)
    rows = []
    for c in [*range(90), 1000, 1001, 1003, -7, -20]:
        hot = c % 3 == 0
        turns = [("system", "the same long beginning of it")] * 3 if hot else []
        turns += [(draw.choice(["user", "assistant", None]), draw.choice(["a b", "a  b c", "", None, "ü ö x"])) for _ in range(draw.randrange(0 if hot else 1, 5))]
        rows += [(c, None if i == 0 and c % 5 == 0 else i, role, text, "s", "d", "n", 1) for i, (role, text) in enumerate(turns)]
    rows += [(2000, i, "user", f"turn {i} of many words", "s", "d", "n", 1) for i in range(300)]
    rows += [(2001, 1, "user", "twice", "s", "d", "n", 1)] * 2 + [(None, 0, "user", "no conversation", "s", "d", "n", 1), (2002, 0, "user", "long " * 50_000, "s", "d", "n", 1)]
    return rows


@pytest.mark.parametrize("limit, pool, upper", [(prefix_trie.LIMIT, prefix_trie.POOL, 9), (5, 16, prefix_trie.UPPER), (1, 8, prefix_trie.UPPER), (40, 64, 2)])
def test_trie(spark, limit, pool, upper):
    rows = talks()
    got = prefix_trie.trie(spark.createDataFrame(rows, TALK).repartition(5), limit, pool, upper).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_trie(rows)))


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    one = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3][0]
    got = prefix_trie.trie(spark.createDataFrame([(one, 0, "user", "gone", "", "", "", 0)], TALK)).collect()
    assert list(map(tuple, got)) == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]
    assert prefix_trie.trie(spark.createDataFrame([], TALK)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "x", "", "", "", 0)], TALK)).collect() == []


def test_louds_parents_and_rollups():
    draw, level, parent, before = np.random.default_rng(3), [], [], np.array([-1])
    for d in range(1, 6):
        size = 7 * d
        start = len(level)
        level += [d] * size
        parent += draw.choice(before, size).tolist()
        before = np.arange(start, start + size)
    trie = prefix_trie.Louds(np.array(level), np.array(parent))
    up = trie.parents()
    assert len(trie.bits) == 2 * len(level) + 1 and trie.bits.sum() == len(level)
    for i, p in enumerate(parent):
        assert up[trie.number[i] - 1] == (0 if p < 0 else trie.number[p])
    ones = np.ones(len(level) + 1, np.int64)
    trie.roll(ones)
    want = np.ones(len(level) + 1, np.int64)
    for i in range(len(level)):
        at = i
        while at >= 0:
            at = parent[at]
            want[0 if at < 0 else trie.number[at]] += 1
    assert ones.tolist() == want.tolist()


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_rank(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, words in asked.items():
        scores = []
        for d, c in held:
            m = 10 + (90 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def corpus():
    draw = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Straße", "über-all", "x_y", "42", "naïve"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 40)))) for i in range(300)]
    docs += [(500 + i, "the tie of all w1 w2") for i in range(15)] + [(7, "w1 w1 again"), (7, "w1 w1 again"), (None, "w1 w2 w3 no id"), (600, None), (601, ""), (602, " .,;!?  "), (603, "w5 " * 80_000 + "end")]
    items = [(i, " ".join(draw.choices(words, k=9))) for i in range(12)]
    items += [(3, "w59 more of three"), (50, "nothing found zzz"), (51, None), (52, ""), (None, "w1"), (53, "w1 W1 w2"), (54, "end 42")]
    return docs, items


@pytest.mark.parametrize("block, piece, at_once", [(1 << 18, 1 << 20, 1 << 22), (20, 300, 50)])
def test_rank(spark, monkeypatch, block, piece, at_once):
    monkeypatch.setattr(lexical_search, "SORTED", at_once)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in docs], "doc_id long, text string, score string, rank int, term string").repartition(5)
    q = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(map(str, brute_rank(docs, items, 10)))
    assert sorted(map(str, map(tuple, lexical_search.rank(d, q, terms=block).collect()))) == want
    none = spark.createDataFrame([], d.schema)
    assert lexical_search.rank(none, q).collect() == [] and lexical_search.rank(d, spark.createDataFrame([], q.schema)).collect() == []


def test_long_texts_are_cut_between_terms():
    text = ("wort " * 50 + "x" * 500 + "-ende ü " * 40).encode()
    other = b"a b c"
    buf = np.frombuffer(text + other, np.uint8)
    offsets = np.array([0, len(text), len(text) + len(other)])
    whole, pieces = lexical_search.term_hashes(buf, offsets), lexical_search.term_hashes(buf, offsets, 64)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_radix_order_is_the_stable_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) // 1000 * 7
    assert (lexical_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical_search.radix_order(np.zeros(0, np.int64))) == 0


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**12])
    assert lexical_search.lengths(n, 10**9, 10**12).tolist() == [10 + 90 * int(x) * 10**9 // 10**12 for x in n]


VECTORS = "vec_id long, embedding array<float>, v string, ids string, rep int, score double"


def dot(x, y):
    total = 0.0  # sum() would compensate
    for a, b in zip(x, y, strict=False):
        total += a * b
    return total


def brute_nearest(rows, k, queries):
    v = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v[i] = [float(np.float32(x)) for x in e]
    out = []
    for q in v:
        if queries(q):
            score = {i: dot(v[q], e) for i, e in v.items() if i != q}
            best = sorted(score, key=lambda i: (-score[i], i))[:k]
            out += [(q, r + 1, i, score[i]) for r, i in enumerate(best)]
    return out


def vectors(n=900):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(n, 6)) * draw.uniform(0.5, 3, size=(n, 1))
    rows = [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0] if i % 3 == 0 else base[i].tolist()) for i in range(n)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (2080, [float("nan")] * 6), (2100, [float("inf"), 1.0, 0.0, 0.0, 0.0, 0.0])]
    return [*rows, (2120, [5.0, 1.0]), (None, [1.0] * 6), (20, rows[20][1]), (-40, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("shard, block", [(16384, 4096), (100, 7)])
def test_nearest_where_all_is_reranked(spark, shard, block):
    rows = vectors()
    table = spark.createDataFrame([(i, e, "x", "y", 1, 0.5) for i, e in rows], VECTORS).repartition(5)
    got = permutation_index.search(table, F.col("vec_id") % 20 == 0, k=20, shard=shard, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_nearest(rows, 20, lambda i: i % 20 == 0))


def test_nearest_of_few_and_of_none(spark):
    everything = F.lit(True)
    few = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])]
    got = permutation_index.search(spark.createDataFrame([(i, e, "", "", 1, 0.5) for i, e in few], VECTORS), everything, k=5).collect()
    assert sorted(map(tuple, got)) == sorted(brute_nearest(few, 5, lambda i: True))
    for rows in ([], [(1, [0.0, 0.0])], [(1, [1.0, 0.0])]):
        assert permutation_index.search(spark.createDataFrame([(i, e, "", "", 1, 0.5) for i, e in rows], VECTORS), everything).collect() == []
    one = spark.createDataFrame([(5, [1.0, 2.0], "", "", 1, 0.5), (5, [3.0, 4.0], "", "", 1, 0.5), (6, [1.0, 1.0], "", "", 1, 0.5)], VECTORS)
    first, again = (sorted(map(tuple, permutation_index.search(x, everything).collect())) for x in (one, one.orderBy(F.desc("embedding"))))
    assert first == again and len(first) == 2


def test_recall_where_a_quarter_is_reranked(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = permutation_index.search(table, F.col("vec_id") % 100 == 0, least=0, shard=2000).collect()
    found = defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert r.score == dot(x[r.query_id].tolist(), x[r.vec_id].tolist())
    hits = 0
    for q, mine in found.items():
        near = x @ x[q]
        near[q] = -9
        hits += len(mine & set(np.argsort(-near)[:20].tolist()))
    assert len(found) == 60 and hits >= 0.9 * 20 * 60


def test_footrule_weights_by_brute_force():
    draw = np.random.default_rng(6)
    found = np.array([draw.permutation(12)[:5] for _ in range(40)], np.uint8)
    weights = permutation_index.footrule_weights(found, 12)
    for asked in found[:10]:
        place = {p: j for j, p in enumerate(asked.tolist())}
        for got, row in zip(weights(asked), found.tolist(), strict=True):
            other = {p: j for j, p in enumerate(row)}
            footrule = sum(abs(place.get(p, 5) - other.get(p, 5)) for p in {*place, *other})
            assert footrule == 2 * sum(5 - j for j in range(5)) - 2 * got
