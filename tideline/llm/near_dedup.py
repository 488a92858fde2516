"""Near-duplicate groups by SuperMinHash.

A document is its set of distinct word shingles. SuperMinHash draws, for each element, a
random permutation of the signature's slots; the element offers slot ``p[j]`` the value
``j + r``, so the ranks within an element are correlated and signatures vary less than
with independent hashes. Level ``j`` is only worked out while some slot holds a value of
that level or more, which for long documents stops after two or three levels.

Equal sets form classes first; only one representative of a class is banded. In a bucket
each representative is paired with the least one. Pairs whose signatures agree in a third
of their slots make up families. In buckets that then still hold several families, members
of different families are held against each other, in blocks, and families with a pair that
may be similar enough become one: whatever may be linked lies in one family.

Links are confirmed exactly, on full sets, in two rounds. First each member meets the head
that it is likest to: n near copies give n comparisons and, mostly, one component. A family
that is one component is done. Where others remain, their members meet all of the family, and those
of its largest component only them: both are dealt out in blocks, and each pair of blocks
meets in one task, where union-find skips pairs that are connected already. A last
union-find joins the links of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _bytes as B
from tideline.llm._links import components, join_hot
from tideline.llm._shared import fits_broadcast, release, stage

#: Slots, and slots of a band: (1 - 0.8^5)^32 = 3e-6 of the pairs at 0.8 share no bucket.
SLOTS, ROWS = 160, 5
BANDS = SLOTS // ROWS
#: Estimates this far below the similarity asked for rule a pair out (over 4.5 standard errors).
SLACK = 0.15
#: Share of the slots that makes a pair related, and members of a family's block.
RELATED, MEMBERS = 0.33, 256
#: Members of a bucket's block, and rows that a task holds against each other at once.
CROSS, POOL = 2048, 16384
PIECE = 1 << 20
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (52-bit hashes) of consecutive texts, sorted within each,
    and their counts. A text of fewer words, but not none, has one shingle: all its words."""
    hashes, owner = B.word_hashes(buf, offsets)
    n = len(offsets) - 1
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    window = hashes.copy()
    for j in range(1, k):
        window[: len(hashes) - j] = B.mix(window[: len(hashes) - j]) + hashes[j:]
    inside = np.arange(len(hashes)) + k <= first[owner + 1] if len(hashes) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < k))
    for d in short:  # at most k - 1 words each
        acc = hashes[first[d] : first[d] + 1].copy()
        for w in hashes[first[d] + 1 : first[d + 1]]:
            acc = B.mix(acc) + w
        window[first[d]] = acc[0]
        inside[first[d]] = True
    keys = (owner[inside].astype(np.uint64) << np.uint64(52)) | (B.mix(window[inside], 7) >> np.uint64(12))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & np.uint64((1 << 52) - 1), np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=n)


def super_minhash(elements: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots, uint32: level in the top byte, fraction below) of consecutive sets."""
    n = len(counts)
    sig = np.full(n * slots, _EMPTY, np.uint32)
    owner = np.repeat(np.arange(n), counts)
    h, perm = elements, None
    for j in range(slots):
        if j:
            need = sig.reshape(n, slots).max(axis=1) >= (j << 24)
            stay = need[owner]
            if not stay.any():
                break
            owner, h = owner[stay], h[stay]
            perm = perm[stay] if perm is not None else None
        r = B.mix(h, 2 * j + 11)
        pick = j + ((r >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        value = ((j << 24) | (r & np.uint64(0xFFFFFF)).astype(np.int64)).astype(np.uint32)
        if perm is None and j == 0:
            slot = pick
            zero = pick
        else:
            rows = np.arange(len(h))
            if perm is None:  # the permutations after the first swap
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
                swapped = zero[stay]
                perm[rows, swapped] = 0
                perm[:, 0] = swapped
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, owner * slots + slot, value)
    return sig.reshape(n, slots)


def _signature_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.text_buffer(batch.column("text"))
            for a, b in B.pieces(offsets, PIECE):
                for lo in range(a, b, 2048):  # 12 bits number the texts of a piece
                    hi = min(lo + 2048, b)
                    at = offsets[lo : hi + 1]
                    elements, counts = shingle_sets(buf[at[0] : at[-1]], at - at[0], k)
                    sig = super_minhash(elements, counts)
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    sums = []
                    for seed in (101, 102):
                        total = np.append(np.uint64(0), np.cumsum(B.mix(elements, seed), dtype=np.uint64))  # a plain 0 would make floats of them
                        sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                    bands = np.zeros((hi - lo, BANDS), np.uint64)
                    for c in range(BANDS):
                        acc = np.full(hi - lo, c + 1, np.uint64)
                        for s in range(c * ROWS, (c + 1) * ROWS):
                            acc = B.mix(acc) + sig[:, s].astype(np.uint64)
                        bands[:, c] = B.mix(acc)
                    short = _short(sig)
                    yield pa.record_batch(
                        [
                            batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                            pa.array(counts.astype(np.int64)),
                            pa.array(sums[0]),
                            pa.array(sums[1]),
                            pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                            pa.array([row.tobytes() for row in short], pa.binary()),
                            batch.column("rk").slice(lo, hi - lo),
                        ],
                        names=["doc_id", "n_shingles", "s1", "s2", "bands", "sig", "rk"],
                    )

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.text_buffer(batch.column("text"))
            for a, b in B.pieces(offsets, PIECE):
                for lo in range(a, b, 2048):
                    hi = min(lo + 2048, b)
                    at = offsets[lo : hi + 1]
                    elements, counts = shingle_sets(buf[at[0] : at[-1]], at - at[0], k)
                    sig = _short(super_minhash(elements, counts))
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    raw = elements.view(np.int64).tobytes()
                    sets = [raw[8 * ends[i] : 8 * ends[i + 1]] for i in range(hi - lo)]
                    rows = [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), B.binary_array(sets), B.binary_array([r.tobytes() for r in sig])]
                    yield pa.record_batch(rows, names=["id", "set", "sig"])

    return run


def _short(sig: np.ndarray) -> np.ndarray:
    """A byte of each slot: unlike values agree once in 256."""
    return (B.mix(sig.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _related_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree in RELATED of the slots or more, and in how many."""
    for batch in batches:
        a, b = (np.frombuffer(B.text_buffer(batch.column(c))[0], np.uint8).reshape(-1, SLOTS) for c in ("sig_u", "sig_v"))
        alike = (a == b).sum(axis=1)
        keep = alike >= RELATED * SLOTS
        yield pa.record_batch([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep)), pa.array(alike[keep], pa.int32())], names=["u", "v", "alike"])


def _across(percent: int):
    """Pairs of different families in one bucket whose sizes and estimates allow a link: for
    the families of a pool of buckets, as few as join what such pairs join."""
    need = (percent / 100 - SLACK) * SLOTS

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys, size = [table[c].to_numpy() for c in ("band", "i", "j")], table["n_shingles"].to_numpy()
        order = np.lexsort((size, *keys[::-1]))
        keys, size = [k[order] for k in keys], size[order]
        group = np.cumsum(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) - 1
        rep, block, within = table["rep"].to_numpy()[order], table["block"].to_numpy()[order], keys[1] == keys[2]
        sig = np.frombuffer(B.text_buffer(table["sig"])[0], np.uint8).reshape(-1, SLOTS)[order]
        _, family = np.unique(table["family"].to_numpy()[order], return_inverse=True)
        root = np.arange(family.max() + 1)
        u, v = [], []

        def top(f: int) -> int:
            while root[f] != f:
                f = root[f]
            return f

        x, step = np.arange(len(rep)), 0
        while True:
            step += 1
            x = x[x + step < len(rep)]
            # members stand by size: once a later one is too large, all after it are
            x = x[(group[x] == group[x + step]) & (100 * size[x] >= percent * size[x + step])]
            if not len(x):
                break
            y = x + step
            open_ = (root[family[x]] != root[family[y]]) & (within[x] | (block[x] != block[y]))
            a, b = x[open_], y[open_]
            near = (sig[a] == sig[b]).sum(axis=1) >= need
            for p, q in zip(a[near].tolist(), b[near].tolist(), strict=True):
                f, g = top(family[p]), top(family[q])
                if f != g:
                    root[max(f, g)] = min(f, g)
                    u.append(rep[p])
                    v.append(rep[q])
            if near.any():
                while (root[root] != root).any():
                    root = root[root]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted) are alike enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _confirmed(percent: int):
    """Links between a head and the members of one of its blocks."""

    def run(table: pa.Table) -> pa.Table:
        head, sets = table["head"][0].as_py(), dict(zip(table["id"].to_pylist(), table["set"], strict=True))
        own = np.frombuffer(sets.pop(head).as_buffer(), np.uint64) if head in sets else np.zeros(0, np.uint64)
        v = [x for x, raw in sets.items() if len(own) and _similar(own, np.frombuffer(raw.as_buffer(), np.uint64), percent)]
        return pa.table({"u": pa.array([head] * len(v), pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _linked(percent: int):
    """Links between the members of two blocks (or within one) that connect all that is similar enough."""
    need = (percent / 100 - SLACK) * SLOTS

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        sig = np.frombuffer(B.text_buffer(table["sig"])[0], np.uint8).reshape(-1, SLOTS)
        size = np.array([len(x) for x in sets])
        within = table["i"][0].as_py() == table["j"][0].as_py()
        label = np.unique(table["part"].to_numpy(), return_inverse=True)[1]
        u, v = [], []
        for x in range(len(ids)):
            others = np.arange(x + 1, len(ids))
            others = others[(label[others] != label[x]) & (100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])) & (within | (block[others] != block[x]))]
            alike = (sig[others] == sig[x]).sum(axis=1)
            others, alike = others[alike >= need], alike[alike >= need]
            for y in others[np.argsort(-alike, kind="stable")]:
                if label[y] == label[x]:
                    continue
                if _similar(sets[x], sets[y], percent):
                    label[label == label[y]] = label[x]
                    u.append(ids[x])
                    v.append(ids[y])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their sets of
    ``shingle``-word shingles (words of any length, A-Z lower-cased; a text of fewer words
    is one shingle). Null, empty and blank texts have no shingle and are linked with
    nothing. A null doc_id is linked with nothing and kept, with a null component_id. Rows
    that repeat a doc_id are one document: where their texts are unlike, one of them (by a hash of its
    set, whatever the order of the rows) makes the links of all. Other columns are ignored; an empty table gives
    an empty result.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("rk", F.xxhash64("text"))
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary, rk long"
    signed = stage(read.mapInArrow(_signature_batches(shingle), schema), "signatures")
    key = ["n_shingles", "s1", "s2"]
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # of ids with unlike texts, the one whose set has the least sums counts
    one = F.struct("s1", "s2", "n_shingles")
    unlike = linked.groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("doc_id", "lo")
    others = stage(linked.join(unlike, "doc_id").where(one != F.col("lo")).select("doc_id", "rk").distinct(), "others")
    if not others.isEmpty():
        linked, read = (x.join(others, ["doc_id", "rk"], "left_anti") for x in (linked, read))
    linked = linked.withColumn("class", F.struct(*key))
    least = stage(linked.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "sets")
    member = stage(join_hot(linked.select("doc_id", "class"), least, "class", "n", width=48).select("doc_id", "rep"), "members")
    reps = linked.join(least.select("class", F.col("rep").alias("doc_id")), ["class", "doc_id"])
    reps = reps.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig").dropDuplicates(["rep", "n_shingles"])
    reps = stage(reps, "reps")

    slots = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    heads = slots.groupBy("band").agg(F.min(F.struct("rep", "n_shingles")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = stage(heads.select("band", F.col("head.rep").alias("head"), F.col("head.n_shingles").alias("size"), "n"), "heads")
    near = F.least("n_shingles", "size") >= RELATED * F.greatest("n_shingles", "size")
    stars = join_hot(slots, heads, "band", "n").where((F.col("rep") != F.col("head")) & near)
    pairs = stars.select(F.col("head").alias("u"), F.col("rep").alias("v")).distinct()
    sig = reps.select("rep", "sig").dropDuplicates(["rep"])
    most = heads.groupBy(F.col("head").alias("u")).agg(F.sum("n").alias("n"))
    of_head = sig.withColumnsRenamed({"rep": "u", "sig": "sig_u"}).join(most, "u")
    pairs = join_hot(pairs, of_head, "u", "n", width=256).join(sig.withColumnsRenamed({"rep": "v", "sig": "sig_v"}), "v")
    related = stage(pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(_related_batches, "u long, v long, alike int"), "related")
    families = stage(components(related.select("u", "v")), "related_families")
    # buckets that still hold several families: the star compared their members with the head alone
    held = join_hot(slots, heads.select("band", "n", F.col("n").alias("size")), "band", "n").withColumnRenamed("size", "n").join(families.withColumnRenamed("node", "rep"), "rep", "left")
    held = stage(held.select("band", "n", "rep", "n_shingles", F.coalesce("component", "rep").alias("family")), "held")
    several = held.groupBy("band").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("band")
    open_ = held.join(several, "band", "left_semi").withColumn("blocks", F.ceil(F.col("n") / CROSS).cast("int"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    pools = max(1, -(-open_.count() // POOL))
    open_ = open_.join(reps.select("rep", "n_shingles", "sig"), ["rep", "n_shingles"]).withColumn("pool", F.pmod(F.xxhash64("band", "i", "j"), F.lit(pools)))
    open_ = open_.select("pool", "band", "i", "j", "block", "rep", "n_shingles", "family", "sig")
    more = stage(open_.groupBy("pool").applyInArrow(_across(percent), "u long, v long"), "across")
    release(held, heads)
    if not more.isEmpty():
        joined = stage(components(families.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "joined_families")
        release(families)
        families = joined
    families = families.select("node", F.col("component").alias("family"))

    def sets_of(wanted: DataFrame, n: int) -> DataFrame:
        some = F.broadcast(wanted) if fits_broadcast(n, 16) else wanted
        return read.join(some, "doc_id", "left_semi").mapInArrow(_set_batches(shingle), "id long, set binary, sig binary")

    # each member meets the head that it is likest to
    best = related.where(F.col("alike") >= (percent / 100 - SLACK) * SLOTS).groupBy("v").agg(F.max(F.struct("alike", (-F.col("u")).alias("less"))).alias("best"))
    best = stage(best.select(F.col("v").alias("id"), (-F.col("best.less")).alias("head")), "best")
    stars = stage(best.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")), "stars")
    roles = join_hot(best, stars, "head", "n", width=24).select("id", "head", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    roles = roles.unionByName(stars.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    wanted = stage(roles.select(F.col("id").alias("doc_id")).distinct(), "met")
    met = sets_of(wanted, wanted.count()).select("id", "set").join(roles, "id").select("head", "block", "id", "set")
    links = stage(met.groupBy("head", "block").applyInArrow(_confirmed(percent), "u long, v long"), "links")
    parts = stage(components(links), "parts")
    release(best, stars, wanted, related)

    # families that are several components so far: the others' members meet all, those of the largest only them
    placed = stage(families.join(parts, "node", "left").select("node", "family", F.coalesce("component", "node").alias("part")), "placed")
    sized = placed.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.groupBy("family").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n")).where("parts > 1")
    rest = F.ceil((F.col("n") - F.col("top.n")) / MEMBERS).cast("int")
    sized = stage(sized.select("family", F.col("top.part").alias("largest"), F.ceil(F.col("top.n") / MEMBERS).cast("int").alias("first"), rest.alias("rest"), "n"), "unresolved")
    left = join_hot(placed, sized, "family", "n", width=40)
    large = F.col("part") == F.col("largest")
    block = F.when(large, F.pmod(F.xxhash64("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    others = F.sequence(F.when(large, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)
    left = stage(left.select(F.col("node").alias("id"), "family", "part", block.alias("block"), others.alias("others")), "left")
    dealt = sets_of(left.select(F.col("id").alias("doc_id")), left.count()).join(left, "id").withColumn("other", F.explode("others"))
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "part", "id", "set", "sig")
    across = stage(dealt.groupBy("family", "i", "j").applyInArrow(_linked(percent), "u long, v long"), "across_links")
    if not across.isEmpty():
        joined = stage(components(links.unionByName(across)), "joined_parts")
        release(parts)
        parts = joined
    release(placed, sized, left, links)

    placed = member.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates; all columns stay."""
    id_col = options.get("id_col", "doc_id")
    keep = near_groups(docs, **options).where("kept").select("doc_id").distinct()
    return docs.alias("all").join(keep.alias("keep"), F.col(f"all.{id_col}").eqNullSafe(F.col("keep.doc_id")), "left_semi")
