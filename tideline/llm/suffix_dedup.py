"""Removal of long repeated substrings by longest-previous-factor arrays.

Each run of ``LENGTH`` bytes has an anchor, the 26-byte gram with the least hash in it,
which depends on the run's bytes alone; equal runs have equal anchors at equal offsets. So
the suffixes of all documents fall into groups by anchor, and a group can be sorted by
itself:

1. Blocks send the hashes of their anchors to buckets and learn which occur elsewhere.
2. For these, blocks send the distinct surroundings (24 bytes before and after the anchor)
   with the smallest document that has each.
3. A bucket lays the surroundings of its groups end to end, puts their suffixes in order
   by induced ranks, and takes each suffix's previous and next smaller positions in that
   order: the nearest suffixes of smaller documents. The longer of the prefixes shared with
   these two is the longest previous factor.
4. Blocks learn which of their runs have a previous factor of ``LENGTH`` bytes or more, and
   cut the bytes that these runs cover.

Only whether a factor has ``LENGTH`` bytes decides, so lengths are worked out up to that.
Comparisons go by 64-bit hashes of whole byte strings within one bucket, and groups are
confirmed by ranks of the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import _blocks as K
from tideline.llm import _bytes as B
from tideline.llm._shared import stage, texts

LENGTH, GRAM = 50, 26
SIDE = LENGTH - GRAM
WIDTH = SIDE + GRAM + SIDE
RESULT = "doc_id long, n_bytes long, starts binary, ends binary, kept binary"


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all runs of LENGTH bytes inside a document, ascending, and their hashes."""
    n = len(buf)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < LENGTH:
        return none
    sums = B.prefix_sums(buf)
    _, down = B.powers(n)
    gram = B.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= SIDE + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < SIDE + 1:
        rest = SIDE + 1 - span
        least = np.minimum(least[:-rest], least[rest:])
    crossing = np.zeros(n + LENGTH + 1, np.int32)
    np.add.at(crossing, np.maximum(offsets[1:] - LENGTH + 1, 0), 1)
    np.add.at(crossing, offsets[1:], -1)
    inside = np.cumsum(crossing)[: len(least)] == 0
    at = (least[inside] & low).astype(np.int64)
    if not len(at):
        return none
    at = at[np.append(True, at[1:] != at[:-1])]
    return at, gram[at]


def _place(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in the upper and a key in the lower 32 bits."""
    h = B.mix(gram, 5)
    return ((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))


def _first_round(buckets: int):
    def each(block: int, arrays: list[np.ndarray]) -> pa.Table:
        buf, offsets, ids, _ = arrays
        at, gram = anchors(buf, offsets)
        place = _place(gram, buckets)
        order = np.argsort(place, kind="stable")
        place, doc = place[order], ids[np.searchsorted(offsets, at[order], side="right") - 1]
        new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        keys = place[first]
        runs = K.by_bucket((keys >> np.uint64(32)).astype(np.int64))
        return K.parts_table([r[0] for r in runs], block, [K.pack(keys[a:b].astype(np.uint32), several[a:b]) for _, a, b in runs])

    return each


def _repeated(bucket: int, blocks: list[int], parts: list[list[np.ndarray]]) -> list[bytes]:
    keys = np.concatenate([p[0] for p in parts])
    several = np.concatenate([p[1] for p in parts])
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = (count > 1) | (np.bincount(where, several) > 0)
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [K.pack(x) for x in np.split(twice[where], cut)]


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a byte matrix whose width is a multiple of 8."""
    wide = np.ascontiguousarray(rows).view(np.uint64)
    acc = np.zeros(len(rows), np.uint64)
    for j in range(wide.shape[1]):
        acc = B.mix(acc ^ wide[:, j], j + 1)
    return acc


def _surroundings(buf: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each anchor: the bytes around it (0 outside its document), then how many before and after are inside."""
    owner = np.searchsorted(offsets, at, side="right") - 1
    before = np.minimum(at - offsets[owner], SIDE)
    after = np.minimum(offsets[owner + 1] - at - GRAM, SIDE)
    padded = np.concatenate([np.zeros(SIDE, np.uint8), buf, np.zeros(WIDTH, np.uint8)])
    rows = np.zeros((len(at), WIDTH + 6), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)
    rows[:, :WIDTH] = windows[at]
    col = np.arange(WIDTH)
    rows[:, :WIDTH][(col < (SIDE - before)[:, None]) | (col >= (SIDE + GRAM + after)[:, None])] = 0
    rows[:, WIDTH], rows[:, WIDTH + 1] = before, after
    return rows


def _found(arrays: list[np.ndarray], answers: dict[int, list[np.ndarray]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and places of the block's anchors that occur in several documents, in the order of the places, and their rows."""
    buf, offsets, _, _ = arrays
    at, gram = anchors(buf, offsets)
    place = _place(gram, buckets)
    order = np.argsort(place, kind="stable")
    at, place = at[order], place[order]
    new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
    kept = np.concatenate([answers[b][0] for b in sorted(answers)]) if answers else np.zeros(0, bool)
    stay = kept[np.cumsum(new) - 1] if len(place) else np.zeros(0, bool)
    at, place = at[stay], place[stay]
    return at, place, _surroundings(buf, offsets, at)


def _distinct(place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its class (equal bucket and equal surroundings), numbered in the order of the buckets; one row of each class."""
    bucket, h = place >> np.uint64(32), _row_hash(rows)
    order = np.lexsort((h, bucket))
    head = np.ones(len(order), bool)
    head[1:] = (bucket[order][1:] != bucket[order][:-1]) | (h[order][1:] != h[order][:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(head) - 1
    return kind, order[head]


def _second_round(buckets: int):
    def each(block: int, arrays: list[np.ndarray], answers: dict[int, list[np.ndarray]]) -> pa.Table:
        offsets, ids = arrays[1], arrays[2]
        at, place, rows = _found(arrays, answers, buckets)
        if not len(at):
            return K.parts_table([], block, [])
        kind, one = _distinct(place, rows)
        doc = np.full(len(one), K.MISSING, np.int64)
        np.minimum.at(doc, kind, ids[np.searchsorted(offsets, at, side="right") - 1])
        rows = rows[one][:, : WIDTH + 2]
        runs = K.by_bucket((place[one] >> np.uint64(32)).astype(np.int64))
        return K.parts_table([1 << K.ROUND | r[0] for r in runs], block, [K.pack(rows[a:b].ravel(), doc[a:b]) for _, a, b in runs])

    return each


def _ranks(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks (or bytes), in order."""
    return np.unique((upper.astype(np.uint64) << np.uint64(32)) | lower.astype(np.uint64), return_inverse=True)[1]


def suffix_ranks(rows: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each of the SIDE + 1 starts, the rank in suffix order of the LENGTH bytes that
    follow, among rows of one group (same anchor). Ranks are induced: the part before the
    anchor from one byte and the rank of the start behind it, the part after the anchor
    from the rank one byte shorter."""
    left = [group]
    for s in range(SIDE - 1, -1, -1):
        left.append(_ranks(rows[:, s].astype(np.uint64) | (group.astype(np.uint64) << np.uint64(8)), left[-1]))
    left.reverse()
    out, right = [], np.zeros(len(rows), np.int64)
    for s in range(SIDE + 1):
        if s:
            right = _ranks(right, rows[:, SIDE + GRAM + s - 1])
        out.append(_ranks(left[s], right))
    return out


def smaller_positions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest positions before and after each one whose value is smaller; -1 and n if there is none.

    Pointers jump together: what lies between a position and its pointer is no smaller, and
    so is what lies between the pointer's value and its own pointer.
    """
    n = len(values)
    found = []
    for v in (values, values[::-1]):
        at = np.arange(n) - 1
        wrong = np.flatnonzero(v[at] >= v)
        wrong = wrong[at[wrong] >= 0]
        while len(wrong):
            at[wrong] = at[at[wrong]]
            wrong = wrong[at[wrong] >= 0]
            wrong = wrong[v[at[wrong]] >= v[wrong]]
        found.append(at)
    return found[0], (n - 1 - found[1])[::-1]


def previous_factors(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lengths of the longest previous factors, up to LENGTH: what each suffix shares with one
    of a smaller document. rank: of the suffixes' first LENGTH bytes, in suffix order; unlike
    ranks share less than LENGTH bytes, which counts as nothing."""
    order = np.argsort(rank, kind="stable")
    head = np.append(True, rank[order][1:] != rank[order][:-1])
    run = np.cumsum(head) - 1  # neighbours in one run share LENGTH bytes
    before, after = smaller_positions(doc[order])
    n = len(order)
    longest = np.zeros(n, np.int64)
    for at in (before, after):
        inside = (at >= 0) & (at < n)
        longest[inside] = np.maximum(longest[inside], LENGTH * (run[at[inside]] == run[inside]))
    out = np.empty(n, np.int64)
    out[order] = longest
    return out


def _compare(bucket: int, blocks: list[int], parts: list[list[np.ndarray]]) -> list[bytes]:
    """For each surroundings sent: the smallest document that has it, and which of its SIDE + 1
    runs (bits) have a previous factor of LENGTH bytes in a smaller one."""
    rows = np.concatenate([p[0] for p in parts]).reshape(-1, WIDTH + 2)
    doc = np.concatenate([p[1] for p in parts])
    wide = np.zeros((len(rows), WIDTH + 6), np.uint8)
    wide[:, : WIDTH + 2] = rows
    _, one, kind = np.unique(_row_hash(wide), return_index=True, return_inverse=True)
    least = np.full(len(one), K.MISSING, np.int64)
    np.minimum.at(least, kind, doc)
    grams = np.zeros((len(one), 32), np.uint8)
    grams[:, :GRAM] = rows[one][:, SIDE : SIDE + GRAM]
    _, group, size = np.unique(_row_hash(grams), return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    earlier = np.zeros(len(one), np.uint32)
    if len(several):
        around = rows[one[several]]
        before, after = around[:, WIDTH].astype(np.int64), around[:, WIDTH + 1].astype(np.int64)
        for start, rank in enumerate(suffix_ranks(around, group[several])):
            real = np.flatnonzero((start >= SIDE - before) & (start <= after))
            factor = previous_factors(rank[real], least[several[real]])
            earlier[several[real[factor >= LENGTH]]] |= np.uint32(1 << start)
    cut = np.cumsum([len(p[1]) for p in parts])[:-1]
    return [K.pack(least[mine], earlier[mine]) for mine in np.split(kind, cut)]


def _cut(buckets: int):
    def each(block: int, arrays: list[np.ndarray], answers: dict[int, list[np.ndarray]]) -> pa.Table:
        buf, offsets, ids, _ = arrays
        first = {b: x for b, x in answers.items() if b >> K.ROUND == 0}
        second = {b: x for b, x in answers.items() if b >> K.ROUND == 1}
        at, place, rows = _found(arrays, first, buckets)
        n = len(buf)
        marks = np.zeros(n + 1, np.int32)
        if len(at):
            kind, one = _distinct(place, rows)
            told = [second[b] for b in sorted(second)]
            least, earlier = (np.concatenate([t[i] for t in told])[kind] for i in (0, 1))
            doc = ids[np.searchsorted(offsets, at, side="right") - 1]
            start = np.arange(SIDE + 1)
            real = (start >= SIDE - rows[:, WIDTH][:, None].astype(np.int64)) & (start <= rows[:, WIDTH + 1][:, None])
            # all of the surroundings are in a smaller document, or this run is
            hit = real & ((least < doc)[:, None] | ((earlier[:, None] >> start.astype(np.uint32)) & 1 > 0))
            begin = (at[:, None] - SIDE + start)[hit]
            marks += np.bincount(begin, minlength=n + 1).astype(np.int32)
            marks -= np.bincount(begin + LENGTH, minlength=n + 1).astype(np.int32)
        covered = np.cumsum(marks)[:n] > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        # a run that goes on into the next document is two
        border = np.zeros(n + 1, bool)
        border[offsets[1:-1]] = True
        both = border[:n] & covered & np.append(False, covered[:-1])
        starts = np.flatnonzero((edge[:n] == 1) | both)
        ends = np.flatnonzero((edge == -1) | np.append(both, False))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        rank = np.searchsorted(owner, np.arange(len(ids) + 1))
        out = {"doc_id": [], "n_bytes": [], "starts": [], "ends": [], "kept": []}
        for d in range(len(ids)):
            a, b = int(offsets[d]), int(offsets[d + 1])
            s, e = starts[rank[d] : rank[d + 1]] - a, ends[rank[d] : rank[d + 1]] - a
            out["doc_id"].append(None if ids[d] == K.MISSING else int(ids[d]))
            out["n_bytes"].append(b - a)
            out["starts"].append(s.astype("<i8").tobytes())
            out["ends"].append(e.astype("<i8").tobytes())
            out["kept"].append(buf[a:b][~covered[a:b]].tobytes())
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "starts": pa.binary(), "ends": pa.binary(), "kept": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return each


def _spans(batches):
    for batch in batches:
        lists = []
        for c in ("starts", "ends"):
            raw, offsets = B.text_buffer(batch.column(c))
            lists.append(pa.ListArray.from_arrays(pa.array(offsets // 8, pa.int32()), pa.array(raw.view(np.int64))))
        gone = pa.array(np.asarray(batch.column("n_bytes")) - np.diff(B.text_buffer(batch.column("kept"))[1]), pa.int64())
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), gone, *lists, batch.column("kept")], names=["doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, starts and ends (byte offsets of
    the maximal removed runs), kept (the remaining bytes, which may cut a character).

    A byte goes if a 50-byte string that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input. Null text is empty; texts below 50
    bytes lose nothing. Rows with one doc_id remove nothing from each other; a null doc_id
    counts as the largest. Other columns are ignored; an empty table gives an empty result.
    """
    packed = K.blocks(texts(docs, id_col, text_col))
    buckets = K.bucket_count(packed)
    repeated = stage(K.answer(K.emit(packed, _first_round(buckets)), _repeated), "repeated")
    around = K.finish(packed, repeated, _second_round(buckets), K.PART_SCHEMA)
    earlier = K.answer(around, _compare)
    made = K.finish(packed, repeated.unionByName(earlier), _cut(buckets), RESULT)
    return made.mapInArrow(_spans, "doc_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")
