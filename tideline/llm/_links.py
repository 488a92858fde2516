"""Connected components of a table of links, by union-find inside partitions and
star contraction between them. Nothing but a count reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import fits_broadcast, release, stage

#: Rows of one key from which on its join partner goes to them instead.
HOT = 1000
#: Parts that the rows of a hot key are dealt into where hot keys are too many to broadcast.
SALT = 32


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: str, width: int = 64) -> DataFrame:
    """rows joined with one, which has one row for each key; n: its column with the number of
    rows that have the key, dropped. Keys of more than HOT rows are broadcast (if their rows
    in one, of width bytes, are few enough), so that no task gets all rows of one key; the
    others meet by a shuffle."""
    heavy = one.where(F.col(n) > HOT).drop(n)
    count = heavy.count()
    if not count:
        return rows.join(one.drop(n), key)
    if not fits_broadcast(count, width):  # so many hot keys that each gets SALT parts of rows instead
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int")
        each = F.when(F.col(n) > HOT, F.sequence(F.lit(0), F.lit(SALT - 1)))
        cold = rows.join(one.where(F.col(n) <= HOT).drop(n), key)
        hot = rows.withColumn("_part", part).join(one.where(F.col(n) > HOT).withColumn("_part", F.explode(each)).drop(n), [key, "_part"]).drop("_part")
        return hot.unionByName(cold)
    keys = F.broadcast(heavy.select(F.col(key).alias("__hot")))
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(keys, F.col(key) == F.col("__hot"), "left_anti")
    return hot.unionByName(rest.join(one.where(F.col(n) <= HOT).drop(n), key))


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one partition, batch by batch: each node with its root."""
    for frame in frames:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"u": nodes, "v": [root(x) for x in nodes]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (u, v): the smallest node that it reaches."""
    pairs = stage(links.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInPandas(_contract, "u long, v long"), "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        # large star: larger neighbours move to the least neighbour
        large = join_hot(both.where("v > u"), least, "u", "n", width=16).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where("u > v"), "large")
        release(pairs, least)
        # small star: smaller neighbours, and the node itself, move to the least of them
        down = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "down")
        moved = join_hot(large, down, "u", "n", width=16)
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        small = stage(small, "small")
        release(large, down)
        # done when every node has one link, to a node without a smaller neighbour
        open_ends = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        twice = small.count() - small.select("u").distinct().count()
        pairs = small
        if not open_ends and not twice:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
