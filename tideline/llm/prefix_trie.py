"""Prefix trie of conversations as succinct level-order tries.

Every turn is 128 bits of hash and a word count. A conversation's prefixes have additive keys: sums of
hashes salted by the turn's place, so a cumulative sum gives all of them. Conversations of one
sequence of turns become one path first, whose ids are hashed as they stream by in order.

Prefixes below which more than ``LIMIT`` turns of distinct paths lie, and the root, are the heavy
upper levels. Each other path belongs to the shard of its first prefix that is not heavy;
shards are dealt into pools. A pool numbers its nodes level by level, and keeps them as a LOUDS
bit vector (for each node a 1 for every child, then a 0) with arrays of labels; the j-th 1 is
node j, and the 0s before it number its parent. Rollups run over the levels from the last to the
first with ``add.at``. What the shards' tops add up to goes into the upper levels, which are
merged the same way by themselves, in one task: so that its size has a bound, a prefix of a large
table is an upper level only if it has more than one in ``UPPER`` of all turns, which leaves at
most UPPER nodes a level whatever the table's size. Shards then grow instead, to turns / UPPER.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._shared import fits_broadcast, release, stage

#: Turns of distinct paths below a prefix from which on it is an upper level; turns of a pool.
LIMIT, POOL = 4096, 1 << 16
#: Nodes that an upper level has at most.
UPPER = 1 << 16
#: Characters of ids that a row carries to the hash of a node's ids.
CHUNK = 1 << 20
#: Conversations that share the first turns of one of them, and the most turns shared, less one.
FAMILY, SHARED = 20, 4
#: Words of a text (a fixed value).
WORD = r"[^\x20\x09-\x0D]+"
NONE_SHA = hashlib.sha256(b"").hexdigest()
_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, top boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the length of each list."""
    return np.asarray(pc.list_flatten(column)), np.asarray(pc.list_value_length(column)).astype(np.int64)


def _inside(size: np.ndarray) -> np.ndarray:
    """0, 1, ... in each of consecutive runs of these sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def prefix_keys(turn: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Keys of all prefixes of consecutive sequences of turn hashes: running sums of the hashes
    salted by their place."""
    place = B.mix(_inside(size).astype(np.uint64), seed)
    total = np.cumsum(B.mix(turn.view(np.uint64) + place, seed + 1), dtype=np.uint64)
    before = np.append(np.uint64(0), total)[np.cumsum(size) - size]
    return (total - np.repeat(before, size)).view(np.int64)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, size = _lists(batch.column("h1"))
        k1, k2 = prefix_keys(h1, size, 41), prefix_keys(_lists(batch.column("h2"))[0], size, 47)
        at = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        ends = np.cumsum(size) - 1
        last = [np.where(size > 0, k[np.maximum(ends, 0)] if len(k) else 0, 0) for k in (k1, k2)]
        lists = [pa.ListArray.from_arrays(at, pa.array(k)) for k in (k1, k2)]
        yield pa.record_batch([batch.column("conv_id"), pa.array(size), pa.array(last[0]), pa.array(last[1]), *lists, batch.column("words")], names=["conv_id", "size", "f1", "f2", "k1", "k2", "words"])


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int, tuple]]:
    """First row, last row and key of the runs of equal keys."""
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
    if not batch.num_rows:
        return []
    head = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return list(zip(head.tolist(), np.append(head[1:], batch.num_rows).tolist(), zip(*(c[head].tolist() for c in columns), strict=True), strict=True))


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted range, joined for each path, CHUNK characters a row at most and one id at least."""
    names = ["f1", "f2", "size", "first", "n", "ids"]
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        out = []
        for a, b, key in _runs(batch, names[:3]):
            step = max(1, CHUNK // 21)
            out += [(*key, ids[i], min(i + step, b) - i, ",".join(map(str, ids[i : min(i + step, b)]))) for i in range(a, b, step)]
        yield pa.record_batch([pa.array(list(c)) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (*[pa.int64()] * 5, pa.string())], names=names)


def _sha_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path: its least id, how many there are, and the hash of all in order."""
    names, types = ["f1", "f2", "size", "rep", "n", "sha"], [*[pa.int64()] * 5, pa.string()]
    key, rep, n, sha = None, 0, 0, hashlib.sha256()

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        rows, first, count, ids = [], batch.column("first").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")
        for a, b, found in _runs(batch, names[:3]):
            if found != key:
                if key is not None:
                    rows.append((*key, rep, n, sha.hexdigest()))
                key, rep, n, sha = found, first[a], 0, hashlib.sha256()
            for i in range(a, b):
                sha.update((b"," if n else b"") + ids[i].as_py().encode())
                n += count[i]
        yield told(rows)
    yield told([] if key is None else [(*key, rep, n, sha.hexdigest())])


class Louds:
    """A level-order trie below one root, node 0. level and parent of each node in any order that
    has parents at the level before; order: the nodes' numbers, level by level."""

    def __init__(self, level: np.ndarray, parent: np.ndarray):
        # parent: of nodes given by place, -1 for the root's children; nodes come sorted by level, then label
        n = len(level)
        self.first = np.searchsorted(level, np.arange(1, (level[-1] if n else 0) + 2)) + 1  # where levels 1, 2, ... begin
        number = np.empty(n, np.int64)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            above = parent[a - 1 : b - 1]
            order = np.argsort(np.where(above < 0, 0, number[np.maximum(above, 0)] if n else 0), kind="stable")
            number[a - 1 + order] = np.arange(a, b)
        self.number = number
        above = np.where(parent < 0, 0, number[np.maximum(parent, 0)]) if n else parent
        degree = np.bincount(above, minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        self.degree = degree

    def parents(self) -> np.ndarray:
        """The parent of nodes 1, 2, ..., read from the bits: the 0s before the node's own 1."""
        return np.cumsum(~self.bits)[self.bits]

    def roll(self, *values: np.ndarray, least: np.ndarray | None = None) -> None:
        """Add every node's values to its ancestors', the last level first; least takes minima."""
        up = self.parents()
        for a, b in zip(self.first[:-1][::-1].tolist(), self.first[1:][::-1].tolist(), strict=True):
            for v in values:
                np.add.at(v, up[a - 1 : b - 1], v[a:b])
            if least is not None:
                np.minimum.at(least, up[a - 1 : b - 1], least[a:b])


def _pool(table: pa.Table) -> pa.Table:
    """All nodes of a pool's shards; the tops' parents are upper levels."""
    k1, size = _lists(table["k1"])
    k2, words = _lists(table["k2"])[0], _lists(table["words"])[0]
    upper = table["upper"].to_numpy()
    level = _inside(size) + 1
    order = np.lexsort((k2, k1, np.repeat(upper, size), level))
    head = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (k1, k2, np.repeat(upper, size), level)], axis=0))
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(head) - 1
    one = order[head]
    parent = np.where(level == 1, -1, np.append(-1, node[:-1]))[one]
    trie = Louds(level[one], parent)
    n, last = len(one) + 1, trie.number[node[np.cumsum(size) - 1]]
    label = np.zeros(n, np.int64)  # an entry of each node
    label[trie.number] = one
    convs, reps = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(convs, last, table["n"].to_numpy())
    np.minimum.at(reps, last, table["rep"].to_numpy())
    trie.roll(convs, least=reps)
    leaves = (trie.degree == 0).astype(np.int64)
    saved = (convs - 1) * words[label].astype(np.int64)
    trie.roll(leaves, saved)
    sha = np.full(n, NONE_SHA, object)
    sha[last] = table["sha"].to_pylist()
    path = np.repeat(np.arange(len(size)), size)[label[1:]]
    top, above = level[label[1:]] == 1, trie.parents()
    columns = [upper[path] + level[label[1:]], k1[label[1:]], k2[label[1:]], table["p1"].to_numpy()[path], table["p2"].to_numpy()[path], top, reps[1:]]
    columns.append(pa.array(reps[above], pa.int64(), mask=top))
    return pa.table([*columns, convs[1:], trie.degree[1:], leaves[1:], saved[1:], pa.array(sha[1:].tolist(), pa.string())], names=_NAMES)


def _upper(table: pa.Table) -> pa.Table:
    """The upper levels, with what the shards' tops below each add up to."""
    table = table.sort_by([(c, "ascending") for c in ("depth", "k1", "k2")])
    depth, k1, k2, p1, p2 = (table[c].to_numpy() for c in ("depth", "k1", "k2", "p1", "p2"))
    place = {key: i for i, key in enumerate(zip(depth.tolist(), k1.tolist(), k2.tolist(), strict=True))}
    parent = np.array([place[d - 1, a, b] - 1 for d, a, b in zip(depth[1:].tolist(), p1[1:].tolist(), p2[1:].tolist(), strict=True)], np.int64)
    trie = Louds(depth[1:], parent)
    given = {c: table[c].to_numpy().astype(np.int64) for c in ("conv_id", "n_convs", "words", "children", "leaves", "saved")}
    row = np.zeros(len(depth), np.int64)
    row[trie.number] = np.arange(1, len(depth))
    children = trie.degree + given["children"][row]
    leaves = given["leaves"][row] + (children == 0)
    saved = (given["n_convs"][row] - 1) * given["words"][row] + given["saved"][row]
    trie.roll(leaves, saved)
    conv, above = given["conv_id"][row], np.append(0, trie.parents())
    up = pa.array(conv[above], pa.int64(), mask=np.arange(len(row)) == 0)
    sha = table["sha"].take(pa.array(row))
    return pa.table([depth[row], k1[row], k2[row], p1[row], p2[row], np.zeros(len(row), bool), conv, up, given["n_convs"][row], children, leaves, saved, sha], names=_NAMES)


def rebuilt(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id and the hashes (h1, h2) and words of its turns in order, the first h of them from
    the family's first conversation: h = crc32(decimal conv_id) mod SHARED."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    turns = conversations.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    own = stage(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "turns")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("head"))
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    both = met.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("t"))
    return both.select("conv_id", *(F.col(f"t.{c}").alias(c) for c in ("h1", "h2", "words")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(rows, 160) else df


def trie(conversations: DataFrame, limit: int = LIMIT, pool: int = POOL, upper: int = UPPER) -> DataFrame:
    """One row for each prefix of a conversation (a node): depth, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, as the module's contract has them.

    conversations (conv_id, turn, role, text): turns are in order of turn, null first; equal
    ones by their hash. A null role or text is empty; rows that repeat a turn all
    count. Rows without conv_id belong to no conversation. Other columns are ignored; an empty
    table has no node. A conversation is held as packed arrays of 20 bytes a turn; texts never
    meet. limit, pool: turns of distinct paths below an upper level (at least), and of a pool; upper:
    nodes of an upper level at most. Results don't depend on these.
    """
    spark = conversations.sparkSession
    keyed = rebuilt(conversations).mapInArrow(_key_batches, "conv_id long, size long, f1 long, f2 long, k1 array<long>, k2 array<long>, words array<int>")
    keyed = stage(keyed, "keyed")
    key = ["f1", "f2", "size"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = keyed.select("conv_id", *key).repartitionByRange(n, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_chunk_batches, "f1 long, f2 long, size long, first long, n long, ids string")
    ends = chunks.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(_sha_batches, "f1 long, f2 long, size long, rep long, n long, sha string")
    paths = keyed.join(ends.select(F.col("rep").alias("conv_id"), "n", "sha"), "conv_id")
    paths = stage(paths.withColumnRenamed("conv_id", "rep"), "paths")
    release(keyed)
    sums = paths.agg(F.sum("n"), F.min("rep"), F.sum("size")).first()
    if sums[0] is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    each = paths.select("rep", "n", "size", F.posexplode(F.arrays_zip("k1", "k2", "words", F.concat(F.array(F.lit(0).cast("long")), F.col("k1")).alias("p1"), F.concat(F.array(F.lit(0).cast("long")), F.col("k2")).alias("p2"))).alias("at", "e"))
    each = each.where("at < size").select("rep", "n", "size", (F.col("at") + 1).cast("long").alias("depth"), "e.k1", "e.k2", "e.p1", "e.p2", "e.words")
    node = ["depth", "k1", "k2"]
    below = F.sum(F.col("size") - F.col("depth") + 1)
    limit = max(limit, int(sums[2]) // upper)
    heavy = stage(each.groupBy(*node).agg(below.alias("w")).where(F.col("w") > limit).select(*node), "heavy")
    n_heavy = heavy.count()
    hits = stage(each.join(_small(heavy, n_heavy), node), "hits")
    uppers = hits.groupBy(*node).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("words").alias("words"))
    zero = F.lit(0).cast("long")
    root = paths.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs")).select(*(zero.alias(c) for c in (*node, "p1", "p2")), "conv_id", "n_convs", F.lit(0).alias("words"))
    uppers = uppers.unionByName(root)
    placed = paths.join(hits.groupBy("rep").agg(F.max("depth").alias("upper")), "rep", "left").withColumn("upper", F.coalesce("upper", zero))
    placed = stage(placed, "placed")

    def at(column: str, place: Column) -> Column:
        return F.when(place < 1, zero).otherwise(F.try_element_at(column, F.greatest(place, F.lit(1)).cast("int")))

    up = F.col("upper")
    pools = max(n, -(-int(sums[2]) // pool))
    light = placed.where("size > upper").select(
        F.pmod(F.xxhash64(up, at("k1", up + 1), at("k2", up + 1)), F.lit(pools)).alias("pool"), "upper", "rep", "n", "sha", at("k1", up).alias("p1"), at("k2", up).alias("p2"),
        *(F.slice(c, (up + 1).cast("int"), F.size(c)).alias(c) for c in ("k1", "k2", "words")),
    )
    light = stage(light.groupBy("pool").applyInArrow(_pool, _NODE), "nodes")
    tops = light.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    tops = tops.agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    stop = placed.where("size = upper").select(up.alias("depth"), F.col("f1").alias("k1"), F.col("f2").alias("k2"), "sha")
    uppers = uppers.join(tops, node, "left").join(stop, node, "left")
    uppers = uppers.select(*node, "p1", "p2", "conv_id", "n_convs", "words", *(F.coalesce(c, zero).alias(c) for c in ("children", "leaves", "saved")), F.coalesce("sha", F.lit(NONE_SHA)).alias("sha"))
    uppers = stage(uppers.groupBy(F.lit("all")).applyInArrow(_upper, _NODE), "upper")
    release(placed, hits, paths)
    above = uppers.select(F.col("depth").alias("d"), F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("conv_id").alias("up"))
    named = light.join(_small(above, n_heavy + 1), F.col("top") & (F.col("depth") == F.col("d") + 1) & (F.col("p1") == F.col("a")) & (F.col("p2") == F.col("b")), "left")
    named = named.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*_NAMES)
    return named.unionByName(uppers).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
