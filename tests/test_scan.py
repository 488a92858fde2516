"""Closure, two-level scans and doubled pointers against loops, with one key in most rows."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import graph, intervals, scan
from tideline.operators.staging import shared_folder


def line_of(n, seed, users=(1,)):
    """Shots (user, ordinal, start, end, excluded) one after another; ranges of very different length."""
    draw, rows = random.Random(seed), []
    for user in users:
        at = 0
        for i in range(n if user == users[0] else 25):
            end = at + draw.choice([1, 5, 40, 400])
            rows.append((user, i, at, end, draw.random() < 0.02))
            at = end
    return rows


def scenes_by_loop(rows, longest):
    out, first, number, before = [], {}, {}, {}
    for user, ordinal, start, end, excluded in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        new = user not in first or excluded or before[user] or end - first[user] > longest
        if new:
            first[user], number[user] = start, number.get(user, -1) + 1
        before[user] = excluded
        out.append((user, ordinal, number[user]))
    return out


@pytest.mark.parametrize("most", [scan.MOST, 30])
def test_scenes_of_a_hot_line(spark, most):
    rows = line_of(700, 3, users=(1, 2, 3))
    shots = spark.createDataFrame(rows, "user_id long, ordinal long, start_ms long, end_ms long, excluded boolean").repartition(5)
    got = intervals.scenes(shots, "user_id", 600, most=most)
    assert sorted(map(tuple, got.collect())) == sorted(scenes_by_loop(rows, 600))


def test_hot_line_is_dealt_over_ranges(spark):
    rows = spark.range(4000).select(F.lit(7).alias("k"), "id", (F.col("id") % 97).alias("v"))
    dealt = scan.ranged(rows, "k", ["id"]).groupBy("_range").count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 2000


@pytest.mark.parametrize("most", [scan.MOST, 10])
def test_thinned_cuts_of_a_hot_key(spark, most):
    draw = random.Random(4)
    rows = [(k, draw.randrange(20_000)) for k in [1] * 900 + [2] * 8 + [None] * 12]
    got = intervals.thinned(spark.createDataFrame(rows, "k long, cut long").repartition(3), "k", "cut", 37, F.lit(15_000), most=most)
    want = []
    for k in (1, 2, None):
        last = 0
        for c in sorted({c for x, c in rows if x == k}):
            if c - last >= 37 and c < 15_000:
                last = c
                want.append((k, c))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [scan.MOST, 20])
def test_running_sums_and_places(spark, most):
    draw = random.Random(5)
    rows = [(draw.choice([1, 1, 1, 1, 2, 3, None]), i, draw.randrange(-5, 50)) for i in range(800)]
    table = spark.createDataFrame(rows, "k long, at long, v long").repartition(6)
    got = scan.running(table, "k", ["at"], {"before": F.col("v")}, {"whole": F.col("v")}, number="place", most=most)
    want, sums, places = [], {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want.append((k, at, v, sums.get(k, 0), sum(x for y, _, x in rows if y == k), places.get(k, 0)))
        sums[k], places[k] = sums.get(k, 0) + v, places.get(k, 0) + 1
    assert sorted(map(str, map(tuple, got.select("k", "at", "v", "before", "whole", "place").collect()))) == sorted(map(str, want))


def test_following_across_ranges(spark):
    draw = random.Random(6)
    targets = [(k, draw.randrange(100_000)) for k in [1] * 60 + [2] * 3]
    rows = [(k, draw.randrange(110_000)) for k in [1] * 500 + [2] * 40 + [3] * 5]
    got = scan.following(spark.createDataFrame(rows, "k long, at long"), "k", "at", spark.createDataFrame(targets, "k long, t long"), "t")
    for r in got.collect():
        sorted_ = sorted(t for k, t in targets if k == r.k)
        i = bisect.bisect_left(sorted_, r["at"])
        assert r["_next"] == (sorted_[i] if i < len(sorted_) else None)


def test_closure_and_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "e"), ("e", None), ("a", "b"), ("s", "s")]
    closed = {(r.root, r.node): r.depth for r in graph.closure(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = {}
    for root in "abcdexs":
        at, depth = {root}, 0
        while at:
            depth += 1
            at = {b for a, b in edges if a in at and b and (root, b) not in want}
            want |= {(root, b): depth for b in at}
    assert closed == want
    cyc = graph.cycles(graph.closure(spark.createDataFrame(edges, "src string, dst string"))).collect()
    assert sorted(map(tuple, cyc)) == [("a", 3), ("b", 3), ("c", 3), ("s", 1)]
    some = graph.closure(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("x",), ("nowhere",)], "root string"))
    assert list(map(tuple, some.collect())) == [("x", "e", 1)]
    assert graph.closure(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
