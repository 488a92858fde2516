"""Transitive closure of a directed graph, semi-naive: a round joins only the pairs that the
last one found with the edges, drops those known already and is staged; the first round
without a new pair ends it. So every pair is joined once, at its least depth, and cycles
end by themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.staging import release, stage


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, node, depth: all nodes that a root reaches over edges (src, dst), with the fewest
    edges to them. roots: a column root; without it every src is one. A root that reaches itself
    lies on a cycle of depth edges. Edges with a null end lead nowhere; repeated ones count once."""
    step = stage(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    first = step if roots is None else step.join(roots.select(F.col("root").alias("src")).distinct(), "src", "left_semi")
    new = stage(first.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth")), "closure")
    found, depth = [new], 1
    while True:
        depth += 1
        onward = new.select("root", F.col("node").alias("src")).join(step, "src").select("root", F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, found).select("root", "node")
        new = stage(onward.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if new.isEmpty():
            release(new, step)
            return reduce(DataFrame.unionByName, found)
        found.append(new)


def cycles(closed: DataFrame) -> DataFrame:
    """root and length of the shortest cycle through each node of a closure that lies on one."""
    return closed.where("root = node").select("root", F.col("depth").alias("length"))
