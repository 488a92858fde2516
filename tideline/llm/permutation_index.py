"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order of nearness. The pivots are
a bounded sample of the vectors, by hash. Each shard of vectors posts them in one inverted
file for each pivot, with the pivot's place in the vector's order. A query walks the files of
its own nearest pivots; a pivot that both have, at places a and b, lowers the footrule distance
of the two prefixes (an absent pivot stands at place PREFIX) by ``2 * (PREFIX - max(a, b))``,
so these weights summed rank a shard's vectors by footrule. The best share of them is
reranked by inner products in doubles.

Nearness is the inner product. For the vectors' order of pivots it is turned into a distance by
one more component that gives all vectors the length of the longest; for vectors of one
length that changes nothing.

Equal vectors are one class with its least ids, as many as an answer can hold, so copies
cost nothing and a query in a huge group of copies is answered once for all of them. Query
blocks meet shards block by block; a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.llm._links import join_hot
from tideline.llm._shared import stage

#: Pivots (at most: the sample), and of them the nearest that stand for a vector.
PIVOTS, PREFIX = 256, 32
#: Vectors of a shard and query vectors of a block that meet in one task.
SHARD, BLOCK = 16384, 4096
#: Of a shard, the share that is reranked, and how many at least.
SHARE, LEAST = 0.25, 1024
#: Parts that the rows of one class are dealt into before they meet.
SALT = 32


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, h1, h2) of the vectors that take part; one of each id."""
    v = F.col(vector_col).cast("array<double>")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    read = read.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    read = read.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    return read.groupBy("vec_id").agg(F.min_by(F.struct("v", "h1", "h2"), F.struct("h1", "h2")).alias("r")).select("vec_id", "r.*")


def classes(rows: DataFrame, most: int) -> DataFrame:
    """One row for each distinct vector: h1, h2, ids (its least ids, most of them at most), v."""
    part = W.Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALT))).orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= most)
    least = F.min_by("v", "vec_id").alias("v")  # of equal vectors
    return few.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, most).alias("ids"), least)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones as if they ended in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = flat[at[0] : at[-1]]
    return out


def _nearest(nearness: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first, equal ones by number."""
    return np.argsort(-nearness, axis=1, kind="stable")[:, :prefix].astype(np.uint8)


def _permuted(pivots: np.ndarray, prefix: int, dim: int, scale: float, longest: float):
    """Rows with the orders of pivots of their vector as one to be found and as a query."""

    def rest(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))

    own = rest(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dim)
            x = v / scale
            near = x @ pivots.T
            found = _nearest(near + np.outer(rest(x), own), prefix)
            asked = _nearest(near, prefix)
            binary = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (v, found, asked)]
            yield pa.record_batch([batch.column("rep"), batch.column("ids"), batch.column("asks"), *binary], names=["rep", "ids", "asks", "v", "found", "asked"])

    return run


def footrule_weights(found: np.ndarray, pivots: int):
    """weights(asked): for a query's order of pivots, how far the pivots it shares with each row
    of found lower the footrule distance, halved, by the rows' inverted files."""
    n, prefix = found.shape
    order = np.argsort(found.ravel(), kind="stable")
    row, place = order // prefix, (order % prefix).astype(np.int64)
    first = np.searchsorted(found.ravel()[order], np.arange(pivots + 1))

    def weights(asked: np.ndarray) -> np.ndarray:
        files = [slice(first[p], first[p + 1]) for p in asked.tolist()]
        rows = np.concatenate([row[f] for f in files])
        shared = np.concatenate([prefix - np.maximum(place[f], j) for j, f in enumerate(files)])
        return np.bincount(rows, shared, n)

    return weights


def _searched(pivots: int, dim: int, most: int, share: float, least: int):
    """For each query of a block, the nearest found in one shard: ids and scores, packed."""

    def rows_of(table: pa.Table, column: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table[column].to_pylist()), kind).reshape(table.num_rows, -1)

    def run(shard: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if shard.num_rows and asking.num_rows:
            shard = shard.sort_by("rep")
            x, q = rows_of(shard, "v", np.float64), rows_of(asking, "y", np.float64)
            asked, ids = rows_of(asking, "order", np.uint8), shard["ids"].to_pylist()
            weights = footrule_weights(rows_of(shard, "found", np.uint8), pivots)
            # what sums in another order may differ by
            slack = 4e-16 * dim * np.sqrt((x * x).sum(axis=1).max())
            n = min(len(x), max(least, int(np.ceil(share * len(x)))))
            for rep, order, y in zip(asking["query"].to_pylist(), asked, q, strict=True):
                near = np.arange(len(x)) if n == len(x) else np.argpartition(-weights(order), n - 1)[:n]
                score = x[near] @ y
                if len(score) > most:
                    score_k = np.partition(score, len(score) - most)[len(score) - most]
                    near = near[score >= score_k - slack * np.sqrt(y @ y)]
                exact = np.zeros(len(near))
                for d in range(dim):  # component by component, as a plain loop sums
                    exact += x[near, d] * y[d]
                pairs = sorted(((-s, i) for s, r in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[r]))[:most]
                out[0].append(rep)
                out[1].append([i for _, i in pairs])
                out[2].append([-s for s, _ in pairs])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], names=["rep", "ids", "scores"])

    return run


def search(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = SHARE,
    least: int = LEAST,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the vectors whose id
    meets ``queries`` (a condition on vec_id), among all vectors but its own.

    Every vector is indexed; only pivots (at most 256) are a sample. Null vectors, zero vectors
    and those that hold a null or a number that is not finite take no part, nor do null ids. Of
    vectors that repeat an id one counts, by hash. Shorter vectors count as if they
    ended in zeros. Equal scores go by vec_id. With fewer than k others all are returned; a
    single vector and an empty table give no rows. Other columns are ignored. share, least: how
    much of each shard is reranked; a shard of up to least vectors is searched whole.
    """
    if not 0 < pivots <= 256:
        raise ValueError("pivots are numbered by a byte: 1 to 256")
    most = k + 1  # one may be the query itself
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    kinds = classes(rows, most)
    asking = rows.where(queries).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_asking"))
    kinds = kinds.join(asking, ["h1", "h2"], "left").select(F.col("ids")[0].alias("rep"), "ids", F.coalesce("n_asking", F.lit(0)).alias("asks"), "v", "h1", "h2")
    kinds = stage(kinds, "classes")
    empty = "query_id long, rank int, vec_id long, score double"
    width = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    total = kinds.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(width), F.sum((F.col("asks") > 0).cast("long"))).first()
    if not total[0]:
        return vectors.sparkSession.createDataFrame([], empty)
    n, dim, scale, n_asking = total
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale)))
    longest = kinds.agg(F.max(length)).first()[0]
    sample = kinds.select("h1", "h2", "v").orderBy("h1", "h2").limit(pivots).collect()
    marks = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        marks[i, : len(r.v)] = np.array(r.v) / scale
    prefix = min(prefix, len(marks))
    schema = "rep long, ids array<long>, asks long, v binary, found binary, asked binary"
    index = stage(kinds.select("rep", "ids", "asks", "v").mapInArrow(_permuted(marks, prefix, dim, scale, longest), schema), "index")
    shards, blocks = -(-n // shard), max(1, -(-(n_asking or 0) // block))

    def every(count: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    left = index.select("rep", "ids", "v", "found", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"))
    right = index.where("asks > 0").select(F.col("rep").alias("query"), F.col("v").alias("y"), F.col("asked").alias("order"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), every(shards, "shard"))
    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    near = near.applyInArrow(_searched(len(marks), dim, most, share, least), "rep long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("less"), p["ids"].alias("vec_id")))
    best = near.select("rep", pairs.alias("p")).groupBy("rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, most).alias("best"))
    best = stage(best.join(index.select("rep", F.col("asks").alias("n")), "rep"), "nearest")
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    names = kinds.where("asks > 0").select("h1", "h2", F.col("rep"), F.col("asks").alias("n")).withColumn("key", F.struct("h1", "h2")).drop("h1", "h2")
    asked = join_hot(asked.select("query_id", F.struct("h1", "h2").alias("key")), names, "key", "n", width=40).select("query_id", "rep")
    met = join_hot(asked, best, "rep", "n", width=24 * most + 16)
    others = F.slice(F.filter("best", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    out = met.select("query_id", F.posexplode(others).alias("place", "p"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("p.vec_id").alias("vec_id"), (-F.col("p.less")).alias("score"))
