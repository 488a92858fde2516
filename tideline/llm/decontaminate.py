"""Benchmark decontamination by winnowing.

Every text becomes the hashes of its k-word shingles; the smallest hash of each window of
``span - k + 1`` shingles is its fingerprint, so any shared run of ``span`` words shares a
fingerprint. Fingerprints of the corpus, from one pass over it, meet those of the benchmark
in a join. Documents with a hit are read again: where a shingle is the fingerprint of an
item's window, the hit is extended to the whole window and confirmed word by word. A document
meets its words once, however many places it has to be looked at, and equal
windows are one, of whatever items, which are named last. Items shorter than
a span are one window, found by the hash of all their words.

DataFrame functions only. Higher-order functions work inside one row, joins on hashes
carry ids and positions, and only documents with a fingerprint hit are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tideline.llm._shared import fits_broadcast, stage

#: Words of a window, and of a shingle.
SPAN, SHINGLE = 13, 6
#: What separates words, once A-Z are lower-cased (fixed values).
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z only and splits. The UTF-8 bytes are read as Latin-1, where
    lower() maps no two UTF-8 texts that differ beyond A-Z to one."""
    low = F.lower(F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1"))
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once for each row (a plain reuse would be inlined again and again)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _joined(hashes: Column, first: int, then: int) -> Column:
    return F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + F.lit(j)) for j in range(first, then, first)]))


def _least(values: Column, step: int, times: int) -> Column:
    return F.transform(values, lambda x, i: F.least(x, *[F.get(values, i + F.lit(step * j)) for j in range(1, times)]))


def shingle_hashes(w: Column) -> Column:
    """The hashes of the 6-word shingles at every word (shorter ones at the end), from words."""
    return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(_joined(h, 1, 3), lambda t: _joined(t, 3, SHINGLE)))


def fingerprints(shingles: Column) -> Column:
    """The distinct minima of the windows of 8 shingles, as least of 4 and again of 2."""
    return F.array_distinct(_let(shingles, lambda h: _let(_least(h, 1, 4), lambda m: _least(m, 4, 2))))


def _item_table(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item (a key of the row's content), iw (words); items without words go."""
    return (
        benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("iw"))
        .where(F.size("iw") > 0)
        .withColumn("item", F.xxhash64("item_id", "iw"))
        .dropDuplicates(["item"])
    )


def _item_windows(items: DataFrame) -> DataFrame:
    """win (a key of the words), item_id, n, words, fp and offset (where in the window the fingerprint
    is) of the distinct windows of each item. Equal windows of different items have one win."""
    n = F.least(F.size("iw"), F.lit(SPAN))
    found = items.select("item", "item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("iw") - n + 1), lambda i: F.slice("iw", i, n))).alias("words"))
    found = found.dropDuplicates(["item", "words"])
    least = F.slice(shingle_hashes(F.col("words")), 1, SPAN - SHINGLE + 1)
    found = found.withColumn("fp", F.when(F.col("n") < SPAN, F.xxhash64("words")).otherwise(F.array_min(least)))
    offset = F.when(F.col("n") < SPAN, F.lit(0)).otherwise(F.array_position(least, F.col("fp")) - 1)
    return found.select(F.xxhash64("words").alias("win"), "item_id", "n", "words", "fp", offset.cast("int").alias("offset"))


def _sized(side: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(side) if fits_broadcast(rows, width) else side


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty text has no words and is clean. Items without words match nothing. A
    repeated item counts once; a null item_id's windows count as hits but not as an item.
    Repeated documents each get a row. Extra columns are ignored. An empty benchmark
    leaves every document clean; an empty corpus gives an empty result.
    """
    windows = stage(_item_windows(_item_table(benchmark, item_id_col, item_text_col)), "windows")
    prints = windows.select("fp", "n", "offset").distinct()
    n_prints = prints.count()
    width = windows.agg(F.sum(F.length(F.concat_ws(" ", "words")) + F.length(F.coalesce(F.col("item_id").cast("string"), F.lit(""))) + 64)).first()[0] or 0
    short = [r.n for r in windows.where(F.col("n") < SPAN).select("n").distinct().collect()]  # at most 12 numbers

    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = read.select("doc_id", F.xxhash64("text").alias("rk"), words(F.col("text")).alias("w"))
    probe = fingerprints(shingle_hashes(F.col("w")))
    if short:
        probe = F.array_distinct(F.concat(probe, *[_grams("w", n) for n in short]))
    probes = split.select("doc_id", "rk", F.size("w").alias("n_words"), probe.alias("h"))
    probes = probes.select("doc_id", "rk", "n_words", F.greatest(F.size("h"), F.lit(1)).alias("n_prints"), F.explode_outer("h").alias("fp"))
    targets = prints.select("fp").distinct().withColumn("hit", F.lit(1))
    first = probes.join(_sized(targets, n_prints, 24), "fp", "left")
    # one row for each distinct (doc_id, text), and how often it occurs
    seen = first.groupBy("doc_id", "rk").agg(
        F.max("n_words").alias("n_words"), F.max("hit").alias("hit"), (F.count(F.lit(1)) / F.max("n_prints")).cast("int").alias("times")
    )
    seen = stage(seen, "seen")

    suspects = seen.where("hit = 1").select(F.col("doc_id").alias("d"), F.col("rk").alias("k"))
    suspects = _sized(suspects, suspects.count(), 24)
    again = read.withColumn("rk", F.xxhash64("text")).join(suspects, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k")), "left_semi")
    again = stage(again.dropDuplicates(["doc_id", "rk"]).select("doc_id", "rk", words(F.col("text")).alias("w")), "suspects")

    at = _placed(shingle_hashes(F.col("w")), SPAN)
    if short:
        at = F.concat(at, *[_placed(_grams("w", n), n) for n in short])
    at = again.select("doc_id", "rk", F.size("w").alias("size"), F.explode(at).alias("at")).select("doc_id", "rk", "size", "at.*")
    near = at.join(_sized(prints, n_prints, 40), ["fp", "n"]).select("doc_id", "rk", "n", "size", (F.col("pos") - F.col("offset")).alias("start"))
    # each document meets its text once, with all places where a window may be
    near = near.where("start >= 0 and start + n <= size").groupBy("doc_id", "rk").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    near = near.withColumnsRenamed({"doc_id": "d", "rk": "k"}).join(again, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("rk")))
    near = near.select("doc_id", "rk", "w", F.explode("places").alias("p")).select("doc_id", "rk", "p.*", F.slice("w", F.col("p.start") + 1, F.col("p.n")).alias("found"))
    whole = windows.select("win", "words").distinct()
    whole = F.broadcast(whole) if fits_broadcast(1, width) else whole
    hits = near.withColumn("win", F.xxhash64("found")).join(whole, "win").where("found = words")
    hits = stage(hits.select("doc_id", "rk", "start", "n", "win"), "hits")
    # the words that hits cover: of hits in order, what each adds beyond those before it
    starts = hits.groupBy("doc_id", "rk", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = F.max("end").over(W.Window.partitionBy("doc_id", "rk").orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1))
    none = F.array().cast("array<string>")
    added = starts.select("doc_id", "rk", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("added"), none.alias("ids"))
    # the items of the distinct windows that a document holds
    named = windows.where("item_id is not null").groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    named = F.broadcast(named) if fits_broadcast(1, width) else named
    told = hits.select("doc_id", "rk", "win").distinct().join(named, "win").select("doc_id", "rk", F.lit(0).alias("added"), "ids")
    found = added.unionByName(told).groupBy("doc_id", "rk").agg(F.sum("added").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    found = found.withColumnsRenamed({"doc_id": "d", "rk": "k"})
    base = seen.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _placed(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda x, i: F.struct(i.alias("pos"), x.alias("fp"), F.lit(n).alias("n")))


def _grams(name: str, n: int) -> Column:
    """Hashes of all n-word runs; none if there are fewer words."""
    arr = F.col(name)
    return F.when(F.size(arr) >= n, F.transform(F.sequence(F.lit(1), F.size(arr) - (n - 1)), lambda i: F.xxhash64(F.slice(arr, i, n)))).otherwise(F.array().cast("array<bigint>"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; all columns stay."""
    id_col = options.get("id_col", "doc_id")
    bad = contamination(docs, benchmark, **options).where("contaminated").select("doc_id").distinct()
    return docs.alias("all").join(bad.alias("bad"), F.col(f"all.{id_col}").eqNullSafe(F.col("bad.doc_id")), "left_anti")
