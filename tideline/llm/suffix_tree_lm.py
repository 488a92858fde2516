"""Probabilistic suffix tree over words, counted and scored by exchanges.

States are contexts of one word and more. A context is retained if it was seen at
least ``SEEN`` times in training and passes a divergence test against its suffix, whether
or not its own prefix or suffix passed: the
gain in log-likelihood of its next symbols, each predicted from the other occurrences
(leave-one-out), must exceed ``GAIN``. A retained state's distribution is smoothed with
its suffix's: ``(N(s, x) + T(s) * P_suffix(x)) / (N(s) + T(s))``, T the number of distinct
next symbols; the root is the add-one unigram. A token's probability is that of the
longest retained suffix of what precedes it, so the tree is one proper distribution.

Contexts grow by a word a round for as long as any is seen ``SEEN`` times, and up to
``depth`` words: every longer one is inside a copied passage of more than that.

Counts cover all training documents. Blocks of documents send distinct (context, symbol)
keys to the context's bucket, which sums, tests and answers; contexts with more than a
bucket's share of all tokens are split over several buckets by symbol. Their sums meet
in a small table (``HOT`` rows a round at most, by the share that makes a context hot), and only
then are they tested, by these sums, so that no score depends on how they were dealt.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import _blocks as K
from tideline.llm import _bytes as B
from tideline.llm._shared import crc_mod, release, stage

DEPTH, SEEN, GAIN = 3, 2, 3.0
#: Bytes of text in a block.
BLOCK = 4 << 20
#: Most contexts that are split over buckets: each has more than 1 / HOT of all tokens.
HOT = 1 << 20
#: Hashes of the symbols before and after a text.
START, END = np.uint64(3), np.uint64(5)
RESULT = "doc_id long, train long, n_tokens long, n_known long, base_score double, score double"
#: Of hashes, this many lower bits are not sent: 48 bits tell keys of one bucket apart.
_LOW = np.uint64(16)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text followed by END, and where each text starts."""
    words, owner = B.word_hashes(buf, offsets)
    n = len(offsets) - 1
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.empty(first[-1], np.uint64)
    out[np.arange(len(words)) + owner] = words
    out[first[1:] - 1] = END
    return out, first


def _token_batches(size: int):
    """Blocks of texts as tokens: distinct hashes in order (as differences), and which each token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offsets = B.text_buffer(batch.column("text"))
            ids, mark = batch.column("doc_id").fill_null(K.MISSING).to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False)
            for a, b in B.pieces(offsets, size):
                at = offsets[a : b + 1]
                tok, first = tokens(buf[at[0] : at[-1]], at - at[0])
                tok = B.mix(tok, 5)
                one, word = _distinct(tok)
                blob = K.pack(_steps(tok[one]), word.astype(np.uint32), first, ids[a:b].astype(np.int64), mark[a:b].astype(np.uint8), level=3)
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([blob], pa.binary()), pa.array([int(at[-1] - at[0])], pa.int64())], names=["block", "payload", "n_bytes"])
                number += 1

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of hashes, so that the order of the hashes is that of the buckets too."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct value is, in their order, and the rank of every value's.
    As np.unique does, with a faster sort: which of equal values is found does not matter here."""
    order = np.argsort(values)
    ascending = values[order]
    head = np.ones(len(values), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=head[1:])
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(head) - 1
    return order[head], rank


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences, the first from 0."""
    return np.diff(ascending, prepend=np.uint64(0))


class Block:
    """What a block knows after the answers of the rounds so far."""

    def __init__(self, arrays: list[np.ndarray], model: dict):
        steps, word, self.first, self.ids, self.train = arrays
        self.model, self.buckets = model, model["buckets"]
        self.words, self.word = np.cumsum(steps, dtype=np.uint64), word.astype(np.int64)
        self.tok = self.words[self.word]
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        self.weight = self.train[self.doc].astype(np.int64)

    def word_parts(self, block: int) -> pa.Table:
        counts = np.bincount(self.word, self.weight, len(self.words)).astype(np.uint64)
        runs = K.by_bucket(_bucket(self.words, self.buckets))
        return K.parts_table([r[0] for r in runs], block, [K.pack(_steps(self.words[a:b] >> _LOW), counts[a:b]) for _, a, b in runs])

    def take_words(self, answers: dict[int, list[np.ndarray]]) -> None:
        found = [answers[b][0] for b in sorted(answers) if b >> K.ROUND == 0]
        self.count = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
        self.c = self.count[self.word]
        self.p = (self.c + 1) / (self.model["N"] + self.model["V"] + 1)
        self.root = self.p
        # depth 0: every token has the empty context, seen often enough
        self.context = np.zeros(len(self.tok), np.uint64)
        self.open = np.ones(len(self.tok), bool)
        self.seen = None

    def lengthen(self, depth: int) -> None:
        """Contexts of depth words, and at which tokens they may be states."""
        at = np.arange(len(self.tok)) - depth
        begin = self.first[self.doc]
        symbol = np.full(len(self.tok), START)
        inside = at >= begin
        symbol[inside] = self.tok[at[inside]]
        self.context = B.mix(self.context * np.uint64(0x9E3779B97F4A7C15) + symbol, depth)
        self.open &= at >= begin - 1
        if depth == 1:
            # the start of a text was seen as often as its end is, and always counts as often enough
            times = np.maximum(SEEN, self.c[self.first[self.doc + 1] - 1])
            times[inside] = self.c[at[inside]]
        else:  # how often the context's last word followed the rest of it
            times = np.zeros(len(self.tok), np.int64)
            times[1:] = self.seen[:-1]
        self.open &= times >= SEEN
        self.times = times

    def keys(self) -> None:
        """Distinct (context, symbol) of the open tokens, in the order of the contexts' salted hashes."""
        at = np.flatnonzero(self.open)
        context, symbol, times = self.context[at], self.tok[at], self.times[at]
        one, kind = _distinct(B.mix(context + B.mix(symbol, 17), 19))
        share = max(1, self.model["N"] // min(self.buckets, HOT))
        split = np.maximum(1, times[one] // share).astype(np.uint64)
        h = B.mix(context[one] + B.mix(symbol[one], 23) % split, 29)
        # by hash, then as they stand, which no other machine would sort otherwise
        low = np.uint64((1 << max(16, len(h).bit_length())) - 1)
        order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.at, self.kind, self.one = at, back[kind], one[order]
        self.h, self.split = h[order], split[order]

    def pair_parts(self, block: int, depth: int) -> pa.Table:
        count = np.bincount(self.kind, self.weight[self.at], len(self.one)).astype(np.uint64)
        context, symbol = self.context[self.at[self.one]], self.tok[self.at[self.one]]
        # the suffix's probability is asked for with symbols that training has here: at first
        # the root's, as the symbol's count, which packs better
        p = np.where(count > 0, (self.c if depth == 1 else self.p)[self.at[self.one]], 0).astype(np.uint32 if depth == 1 else np.float32)
        symbol = B.mix(symbol, 31)
        blobs, runs = [], K.by_bucket(_bucket(self.h, self.buckets))
        for _, a, b in runs:
            head = np.flatnonzero(np.append(True, self.h[a + 1 : b] != self.h[a : b - 1]))
            size, split = np.diff(np.append(head, b - a)), self.split[a:b][head]
            blobs.append(
                K.pack(
                    _steps(self.h[a:b][head] >> _LOW), split.astype(np.uint32), size.astype(np.uint32), context[a:b][head][split > 1],
                    (symbol[a:b] >> np.uint64(32)).astype(np.uint32), (symbol[a:b] >> np.uint64(24)).astype(np.uint8), count[a:b].astype(np.uint32), p[a:b],
                )
            )
        return K.parts_table([depth << K.ROUND | r[0] for r in runs], block, blobs)

    def take_pairs(self, answers: dict[int, list[np.ndarray]], depth: int) -> None:
        """Counts of the states; at tokens whose context is retained, the new probability."""
        mine = [answers[b] for b in sorted(answers) if b >> K.ROUND == depth]
        total, kinds, count = np.zeros(len(self.one)), np.zeros(len(self.one)), np.zeros(len(self.one))
        if mine:
            size = np.concatenate([x[2] for x in mine])
            total = np.repeat(np.concatenate([x[0] for x in mine]), size).astype(float)
            kinds = np.repeat(np.concatenate([x[1] for x in mine]), size).astype(float)
            count = np.concatenate([x[3] for x in mine]).astype(float)
        wide = self.split > 1
        if wide.any():
            total[wide] = kinds[wide] = 0
            hot, found = self.model["hot"][depth].value, self.context[self.at[self.one]]
            if len(hot[0]):
                where = np.minimum(np.searchsorted(hot[0], found), len(hot[0]) - 1)
                wide &= hot[0][where] == found
                total[wide], kinds[wide] = hot[1][where[wide], 0], hot[1][where[wide], 1]
        kept = total > 0
        self.seen = np.zeros(len(self.tok), np.int64)
        n, t, c = total[self.kind], kinds[self.kind], count[self.kind]
        use = kept[self.kind]
        at = self.at[use]
        self.seen[self.at] = c.astype(np.int64)
        self.p = self.p.copy()
        self.p[at] = (c[use] + t[use] * self.p[at]) / (n[use] + t[use])


def _known(arrays: list[np.ndarray], model: dict, answers: dict[int, list[np.ndarray]], depth: int) -> Block:
    """The block after the rounds below depth."""
    b = Block(arrays, model)
    b.take_words(answers)
    for d in range(1, depth):
        b.lengthen(d)
        b.keys()
        b.take_pairs(answers, d)
    return b


def _sum_words(bucket: int, blocks: list[int], parts: list[list[np.ndarray]]) -> list[bytes]:
    # 48 bits of the hash and the bucket tell words apart
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    words, where = np.unique(key, return_inverse=True)
    total = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.uint64)
    cut = np.cumsum([len(p[0]) for p in parts])[:-1]
    own = np.zeros(len(words), np.uint64)
    out, at = [], 0
    for p, answer in zip(parts, np.split(total[where], cut), strict=True):
        # each word's total is told once to the sums of the corpus, by the first part that has it
        mine = where[at : at + len(p[0])]
        at += len(p[0])
        new = own[mine] == 0
        own[mine] = 1
        fresh = total[mine[new]]
        out.append(K.pack(answer, np.array([fresh.sum(), (fresh > 0).sum()], np.uint64)))
    return out


def _test_contexts(sums: tuple[int, int], bucket: int, blocks: list[int], parts: list[list[np.ndarray]]) -> list[bytes]:
    """Whether the contexts pass, with the counts of their symbols; sums: N and V of the root."""
    context = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    split = np.concatenate([p[1] for p in parts])
    size = np.concatenate([p[2] for p in parts])
    states, s_part = np.unique(context, return_inverse=True)
    wide, name = np.zeros(len(states), np.int64), np.zeros(len(states), np.uint64)
    wide[s_part] = split
    name[s_part[split > 1]] = np.concatenate([p[3] for p in parts])  # of the parts of one context
    s = np.repeat(s_part, size)
    # 40 bits of a symbol's hash tell the symbols of one context in one bucket apart
    x = (np.concatenate([p[4] for p in parts]).astype(np.uint64) << np.uint64(8)) | np.concatenate([p[5] for p in parts])
    count, sent = np.concatenate([p[6] for p in parts]), np.concatenate([p[7] for p in parts])
    one, where = _distinct((s.astype(np.uint64) << np.uint64(40)) | x)
    p = np.zeros(len(one))
    p[where[sent > 0]] = sent[sent > 0]  # all that send one send the same
    if sent.dtype == np.uint32:
        p = (p + 1) / (sums[0] + sums[1] + 1)
    n_sx = np.bincount(where, count, len(one))
    state = s[one]
    n_s = np.bincount(state, n_sx, len(states))
    t_s = np.bincount(state, n_sx > 0, len(states))
    keep = (n_s >= SEEN) & (_gains(state, n_sx, p, n_s, t_s) > GAIN) & (wide == 1)
    answers = n_sx.astype(np.uint32)[where]  # of all contexts: the next round goes by true counts
    out, at, key_at = [], 0, 0
    for part in parts:
        mine, keys = s_part[at : at + len(part[0])], int(part[2].sum())
        answer = answers[key_at : key_at + keys]
        at, key_at = at + len(part[0]), key_at + keys
        out.append(K.pack((n_s * keep)[mine].astype(np.uint64), (t_s * keep)[mine].astype(np.uint32), part[2], answer))
    # contexts that lie in several buckets are tested once their sums are known: what the test needs of this one
    split, met = np.flatnonzero(wide > 1), (wide > 1)[state] & (n_sx > 0)
    if len(split):
        size = np.bincount(state[met], minlength=len(states))[split]
        out.append(K.pack(name[split], n_s[split].astype(float), t_s[split].astype(float), size.astype(np.int64), n_sx[met].astype(float), p[met]))
    return out


def _gains(state: np.ndarray, n_sx: np.ndarray, p: np.ndarray, n_s: np.ndarray, t_s: np.ndarray) -> np.ndarray:
    """Each state's gain in log-likelihood over its suffix, leave-one-out, from its symbols' counts and
    the suffix's probabilities; n_s, t_s: what it has in all, in other buckets too."""
    n, t = n_s[state], t_s[state]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n_sx * np.log((n_sx - 1 + t * p) / ((n - 1 + t) * p))
    seen = n_sx > 0
    return np.bincount(state[seen], gain[seen], len(n_s)).astype(float)  # whole numbers if there is none


def _corpus_sums(answers: DataFrame) -> tuple[int, int]:
    def run(batches):
        for batch in batches:
            sums = np.array([unpacked[1] for unpacked in (K.unpack(x.as_buffer()) for x in batch.column("blob"))], np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array([int(v)], pa.int64()) for v in sums.sum(axis=0)], names=["n", "v"])

    got = answers.select("blob").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(got[0] or 0), int(got[1] or 0)


def _hot_states(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that were split over buckets and pass the test, sorted, with N and T: each
    has more than 1 / HOT of the tokens, so there are HOT at most. Their sums over all buckets come
    first, and the test then goes by these, bucket by bucket."""
    told = told.select("blob")

    def sums(batches):
        for batch in batches:
            for x in batch.column("blob"):
                states, n, t = K.unpack(x.as_buffer())[:3]
                yield pa.record_batch([pa.array(states.view(np.int64)), pa.array(n), pa.array(t)], names=["s", "n", "t"])

    whole = told.mapInArrow(sums, "s long, n double, t double").groupBy("s").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= SEEN).toPandas()
    states = whole["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(states)
    states, n_all, t_all = states[order], whole["n"].to_numpy(float)[order], whole["t"].to_numpy(float)[order]
    if not len(states):
        return states, np.zeros((0, 2))
    shared = told.sparkSession.sparkContext.broadcast((states, n_all, t_all))

    def gains(batches):
        states, n_all, t_all = shared.value
        for batch in batches:
            for x in batch.column("blob"):
                mine, _, _, size, n_sx, p = K.unpack(x.as_buffer())
                at = np.minimum(np.searchsorted(states, mine), len(states) - 1)
                known = states[at] == mine
                found = _gains(np.repeat(np.arange(len(mine)), size), n_sx, p, n_all[at], t_all[at])
                yield pa.record_batch([pa.array(at[known]), pa.array(found[known])], names=["at", "g"])

    passed = told.mapInArrow(gains, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).where(F.col("g") > GAIN).select("at").toPandas()
    keep = np.sort(passed["at"].to_numpy(np.int64))
    return states[keep], np.stack([n_all[keep], t_all[keep]], axis=1)


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, train (1 or 0), n_tokens, n_known, base_score,
    score (log10), train_tokens; the model learns from the rows where ``train`` (a
    condition on docs) holds.

    Words are runs without white space, A-Z lower-cased; every text ends with one end
    token. Null text is empty: it has one token. Repeated rows each count. Ids are integers; a
    null one stays null. Other columns are ignored; an empty table gives an empty result; without
    training rows every token has probability 1 over the one unknown symbol. depth: words of
    the longest contexts; block: bytes of text that a task holds at once.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), train.cast("int").alias("mark"))
    packed = K.keep(read.mapInArrow(_token_batches(block), K.BLOCK_SCHEMA))
    model = {"buckets": K.bucket_count(packed), "N": 0, "V": 0, "hot": {}}
    answers = stage(K.answer(K.emit(packed, lambda block, arrays: Block(arrays, model).word_parts(block)), _sum_words), "words")
    model["N"], model["V"] = _corpus_sums(answers)
    rounds = 0
    while rounds < depth:
        rounds += 1

        def each(block: int, arrays: list[np.ndarray], got: dict[int, list[np.ndarray]], depth: int = rounds) -> pa.Table:
            b = _known(arrays, model, got, depth)
            b.lengthen(depth)
            b.keys()
            return b.pair_parts(block, depth)

        asked = K.finish(packed, answers, each, K.PART_SCHEMA)
        told = stage(K.answer(asked, functools.partial(_test_contexts, (model["N"], model["V"]))), f"states{rounds}")
        if told.isEmpty():  # no context of so many words is seen often enough
            release(told)
            rounds -= 1
            break
        model["hot"][rounds] = spark.sparkContext.broadcast(_hot_states(told.where("block < 0")))
        answers = answers.unionByName(told.where("block >= 0"))

    def last(block: int, arrays: list[np.ndarray], got: dict[int, list[np.ndarray]]) -> pa.Table:
        b = _known(arrays, model, got, rounds + 1)
        at = b.first[:-1]
        sums = [np.add.reduceat(v, at) if len(at) else np.zeros(0) for v in ((b.c > 0).astype(np.int64), np.log10(b.root), np.log10(b.p))]
        ids = pa.array(b.ids, pa.int64(), mask=b.ids == K.MISSING)
        return pa.table(
            {"doc_id": ids, "train": b.train.astype(np.int64), "n_tokens": np.diff(b.first), "n_known": sums[0].astype(np.int64), "base_score": sums[1].astype(float), "score": sums[2].astype(float)}
        )

    return K.finish(packed, answers, last, RESULT).withColumn("train_tokens", F.lit(model["N"]).cast("long"))


def held_out(column: str = "doc_id"):
    """The rows that the query keeps out of training."""
    return crc_mod(column, 7) == 2
