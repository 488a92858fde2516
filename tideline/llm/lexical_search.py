"""Ranked lexical search by sort-based accumulation.

One pass over the documents looks up the items' terms in each piece of text and keeps what
matched as packed arrays (document, term, times), with each document's length. From these come
the statistics of the whole corpus: N, L and the document frequencies. The second pass reads
the kept arrays only. For each piece, which is a range of documents, the postings of the items
turn matches into (item, document, impact) arrays; packed keys item * documents + document
are radix sorted, ``reduceat`` sums the impacts of equal keys, and a selection keeps the
best of each item. So a document's score is whole where its range is, and only the best of each
task meet: no impact is shuffled.

Items are dealt into blocks of a bounded number of terms; each block is one such run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.llm import _blocks as K
from tideline.llm import _bytes as B
from tideline.llm._shared import release, stage

#: Bytes that part terms: all of ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
#: Bytes of text that are taken at once, and (item, term) pairs of a block of items.
PIECE, TERMS = 1 << 20, 1 << 18
#: Impacts that are sorted at once.
SORTED = 1 << 22


def term_hashes(buf: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of consecutive texts, and the text's number of each. A text longer than
    size is taken in slices that end between terms."""
    found, owners = [], []
    for a, b in B.pieces(offsets, size):
        at, end = int(offsets[a]), int(offsets[b])
        if end - at <= size or b - a > 1:
            h, owner = B.word_hashes(buf[at:end], offsets[a : b + 1] - at, GAP)
            found.append(h)
            owners.append(owner + a)
            continue
        while at < end:
            stop = min(at + size, end)
            while stop < end and not GAP[buf[stop - 1]]:
                stop += 1
            h, _ = B.word_hashes(buf[at:stop], np.array([0, stop - at]), GAP)
            found.append(h)
            owners.append(np.full(len(h), a))
            at = stop
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers, 16 bits at a time, which numpy sorts by radix."""
    order, top, shift = np.arange(len(keys)), int(keys.max(initial=0)), 0
    while shift == 0 or top >> shift:
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = B.text_buffer(batch.column("text"))
        term, owner = term_hashes(buf, offsets)
        yield pa.record_batch([batch.column("item_id").take(pa.array(owner)), pa.array(term.view(np.int64))], names=["item_id", "term"])


def _match_batches(terms: np.ndarray):
    """Of each piece of text: documents with a term, their lengths in terms, and which of the
    (sorted) terms they hold how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = B.text_buffer(batch.column("text"))
            ids = batch.column("doc_id").fill_null(K.MISSING).to_numpy(zero_copy_only=False)
            for a, b in B.pieces(offsets, PIECE):
                at = offsets[a : b + 1]
                term, owner = term_hashes(buf[at[0] : at[-1]], at - at[0])
                length = np.bincount(owner, minlength=b - a)
                where = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
                hit = terms[where] == term if len(terms) else np.zeros(len(term), bool)
                key = owner[hit] * len(terms) + where[hit]
                key = key[radix_order(key)]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                times, key = np.diff(np.append(head, len(key))), key[head]
                doc, term = np.divmod(key, max(len(terms), 1))
                met = np.bincount(doc, minlength=b - a)
                used = np.flatnonzero(met)
                blob = K.pack(ids[a:b][used].astype(np.int64), length[used].astype(np.int64), met[used].astype(np.uint32), term.astype(np.uint32), times.astype(np.int64))
                sums = [np.array([x], np.int64) for x in (np.count_nonzero(length), len(owner))]
                yield pa.record_batch([*map(pa.array, sums), pa.array([blob], pa.binary())], names=["n_docs", "n_terms", "blob"])

    return run


def _frequencies(n_terms: int):
    """In how many documents each term is, of a task's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for x in batch.column("blob"):
                df += np.bincount(K.unpack(x.as_buffer())[3], minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], names=["term", "df"])

    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The documents' m. Beyond 64 bits the product is taken in whole numbers of any size."""
    wide = n.astype(object) if len(n) and int(n.max()) * 90 * n_docs >= 1 << 63 else n
    return (10 + (90 * wide * n_docs) // n_terms).astype(np.int64)


class _Best:
    """The k best (score, then least id) of each item so far."""

    def __init__(self, k: int):
        self.k = k
        self.held = [np.zeros(0, np.int64)] * 3

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in zip(self.held, (item, score, doc), strict=True))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        keep = np.arange(len(item)) - first < self.k
        self.held = [item[keep], score[order][keep], doc[order][keep]]


def _selected(item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the scores, grouped by item, may be among its k best: those not below the kth."""
    keep, ends = np.ones(len(item), bool), np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1
    for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        if b - a > k:
            keep[a:b] = score[a:b] >= np.partition(score[a:b], b - a - k)[b - a - k]
    return keep


def _rank_batches(post: np.ndarray, post_items: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best of each item among a task's documents. post: where each term's items begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for x in batch.column("blob"):
                ids, n, met, term, times = K.unpack(x.as_buffer())
                doc = np.repeat(np.arange(len(ids)), met)
                impact = impacts(weight[term], times, lengths(n, n_docs, n_terms)[doc])
                wide = np.cumsum(post[term.astype(np.int64) + 1] - post[term])
                a = 0
                while a < len(ids):  # documents whose items are about SORTED, one at least
                    lo = int(np.searchsorted(doc, a))
                    done = int(wide[lo - 1]) if lo else 0
                    hi = int(np.searchsorted(wide, done + SORTED, side="right"))
                    b = max(a + 1, int(doc[hi]) if hi < len(doc) else len(ids))
                    best.add(*_summed(doc[lo:], term[lo:], impact[lo:], a, b, ids))
                    a = b
        item, score, found = best.held
        known = pa.array(found, pa.int64(), mask=found == K.MISSING)
        yield pa.record_batch([pa.array(item, pa.int64()), known, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    def _summed(doc, term, impact, a, b, ids):
        last = np.searchsorted(doc, b)
        doc, term, impact = doc[:last] - a, term[:last].astype(np.int64), impact[:last]
        size = post[term + 1] - post[term]
        ends = np.cumsum(size)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        key = post_items[np.repeat(post[term], size) + inside] * (b - a) + np.repeat(doc, size)
        order = radix_order(key)
        key, summand = key[order], np.repeat(impact, size)[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(summand, head) if len(head) else np.zeros(0, np.int64)
        item, at = np.divmod(key[head], b - a)
        some = total > 0
        item, total, at = item[some], total[some], at[some]
        some = _selected(item, total, k)
        return item[some], total[some], ids[at[some] + a]

    return run


def _ranked_block(read: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, score: the best of each task's documents for the items of a block."""
    pairs = block.toPandas()
    item_of = pairs["item_id"].drop_duplicates().tolist()
    number = {v: i for i, v in enumerate(item_of)}
    term = pairs["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(term, kind="stable")
    terms, first = np.unique(term[order], return_index=True)
    post = np.append(first, len(order)).astype(np.int64)
    post_items = pairs["item_id"].map(number).to_numpy(np.int64)[order]
    matches = stage(read.mapInArrow(_match_batches(terms), "n_docs long, n_terms long, blob binary"), "matches")
    n_docs, n_terms = (int(x or 0) for x in matches.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    counted = matches.select("blob").mapInArrow(_frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(terms), np.int64)
    df[counted["term"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    best = matches.select("blob").mapInArrow(_rank_batches(post, post_items, weights(n_docs, df), n_docs, max(n_terms, 1), k), "item long, doc_id long, score long")
    best = stage(best, "best")
    release(matches)
    names = block.sparkSession.createDataFrame(list(enumerate(item_of)), "item long, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 of each item,
    equal scores by doc_id.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and of all other characters
    beyond ASCII. Null and empty texts have none. Rows that repeat a doc_id are documents of their
    own; a null doc_id sorts last. Rows that repeat an item_id are one item with the terms of all;
    rows without one are no items. Items without terms, and terms that no document has, match
    nothing. Other columns are ignored; an empty table on either side gives no rows. terms: pairs of
    item and term that a block of items holds, on the driver too; an item is never split.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null")
    pairs = stage(named.mapInArrow(_item_batches, "item_id long, term long").distinct(), "items")
    blocks = -(-pairs.count() // terms)
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    of_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [_ranked_block(read, pairs.where(of_block == b), k) for b in range(blocks)])
    best = W.Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
