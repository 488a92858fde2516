"""Interval algebra on half-open millisecond ranges, and joins on it.

Range joins never run on the range alone: they carry an equality key, and long lines are
cut in buckets of fixed width so that a key with many rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import scan
from tideline.operators.scan import MOST
from tideline.operators.staging import stage


def contains(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_ms") <= F.col(f"{b}.start_ms")) & (F.col(f"{b}.end_ms") <= F.col(f"{a}.end_ms"))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_ms") < F.col(f"{b}.end_ms")) & (F.col(f"{b}.start_ms") < F.col(f"{a}.end_ms"))


def _bucketed(df: DataFrame, width: int) -> DataFrame:
    first, last = F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width)
    return df.withColumn("_b", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of one key whose ranges overlap, with columns l and r (structs). Each pair
    comes from the one bucket in which the later of the two begins."""
    a = _bucketed(left, width).select(key, "_b", F.struct(*left.columns).alias("l"))
    b = _bucketed(right, width).select(key, "_b", F.struct(*right.columns).alias("r"))
    once = F.col("_b") == F.floor(F.greatest("l.start_ms", "r.start_ms") / width)
    return a.join(b, [key, "_b"]).where(overlaps("l", "r") & once).drop("_b")


def silent_boundaries(shots: DataFrame, speech: DataFrame, key: str, gap_ms: int, width: int) -> DataFrame:
    """Shots whose boundary with the one before has no speech within gap_ms (overlap anti-join)."""
    line = W.partitionBy(key).orderBy("start_ms", "ordinal")
    before = F.lag("end_ms").over(line)
    edge = shots.withColumn("_s", F.when(before.isNotNull(), F.greatest(F.lit(0), before - gap_ms))).where("_s is not null")
    edge = edge.select(key, "ordinal", F.col("_s").alias("start_ms"), (F.col("start_ms") + gap_ms).alias("end_ms")).where("end_ms > start_ms")
    spoken = overlap_join(edge, speech, key, width).select(key, F.col("l.ordinal").alias("ordinal")).distinct()
    return edge.join(spoken, [key, "ordinal"], "left_anti").select(key, "ordinal")


def windows(df: DataFrame, duration: Column, seconds: int) -> DataFrame:
    """Tumbling windows of seconds (60 at least) over a duration; the last is cut short."""
    step = max(60, seconds)
    out = df.withColumn("_d", duration).where("_d > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_d") / step) - 1).cast("int"))))
    return out.withColumn("chunk_start", (F.col("chunk") * step).cast("double")).withColumn("chunk_end", F.least(F.col("_d"), (F.col("chunk") + 1) * F.lit(float(step)))).drop("_d")


def thinned(cuts: DataFrame, key: str, cut: str, gap_ms: int, end: Column, most: int = MOST) -> DataFrame:
    """Cuts (whole numbers) kept greedily: at least gap_ms after the last kept one (0 at first), before
    end. One row for each kept cut: key, cut. The cuts of a key are folded in order; of keys with more
    than most of them each cut points to the first that is gap_ms later, and pointers are doubled."""
    each = cuts.where(F.col(cut) < end).select(key, F.col(cut).cast("long").alias(cut)).distinct()
    hot = scan.hot_keys(each, key, most)
    large, rest = (None, each) if hot is None else scan.split(each, hot, key)
    listed = rest.groupBy(key).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    fold = F.aggregate(
        "cuts",
        F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept")),
        lambda s, c: F.when(c - s["last"] >= gap_ms, F.struct(c.alias("last"), F.concat(s["kept"], F.array(c)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    kept = listed.select(key, F.explode(fold).alias(cut))
    if large is None:
        return kept
    large = stage(large, "cuts")
    pointers = scan.following(large.withColumn("_from", F.col(cut) + gap_ms), key, "_from", large, cut)
    first = large.where(F.col(cut) >= gap_ms).groupBy(key).agg(F.min(cut).alias(cut))
    return kept.unionByName(scan.reached(pointers, key, cut, "_next", first))


def scenes(shots: DataFrame, key: str, max_scene_ms: int, silent: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """Each shot's scene number: a scene ends at an excluded shot, at silence, and before a
    shot that would make it longer than max_scene_ms. Shots of a key follow one another. Hard breaks make
    islands by a running sum. Inside an island the span guard is a fold over its shots in
    order; in islands of more than most shots each shot points to the first that ends
    beyond its span, and pointers are doubled from the island's first shot."""
    line = W.partitionBy(key).orderBy("start_ms", "ordinal")
    flagged = shots if silent is None else shots.join(silent.withColumn("_q", F.lit(True)), [key, "ordinal"], "left")
    quiet = F.lit(False) if silent is None else F.coalesce("_q", F.lit(False))
    hot = scan.hot_keys(shots, key, most)
    if hot is None:
        return _numbered(_islands(flagged, key, quiet, line), key, max_scene_ms)
    large, rest = scan.split(flagged, hot, key)
    return _numbered(_islands(rest, key, quiet, line), key, max_scene_ms).unionByName(_long_scenes(large, key, quiet, max_scene_ms))


def _islands(flagged: DataFrame, key: str, quiet: Column, line) -> DataFrame:
    hard = F.col("excluded") | F.coalesce(F.lag("excluded").over(line), F.lit(True)) | quiet
    return flagged.withColumn("_i", F.sum(hard.cast("long")).over(line))


def _long_scenes(shots: DataFrame, key: str, quiet: Column, max_scene_ms: int) -> DataFrame:
    """Scenes of lines that are too long for one task, by ranges: places by a two-level scan, islands by
    a second one, pointers by a search in ranges, scene numbers by a third scan over the starts."""
    placed = stage(scan.running(shots.select(key, "ordinal", "start_ms", "end_ms", "excluded", quiet.alias("_quiet")), key, ["start_ms", "ordinal"], number="_p", most=0), "placed")
    before = placed.where("excluded").select(key, (F.col("_p") + 1).alias("_p")).withColumn("_after", F.lit(True))
    hard = F.col("excluded") | F.coalesce("_after", F.lit(False)) | F.col("_quiet") | (F.col("_p") == 0)
    placed = placed.join(before, [key, "_p"], "left").withColumn("_hard", hard).drop("_after")
    placed = stage(scan.running(placed, key, ["_p"], {"_i": F.col("_hard").cast("long")}, most=0).withColumn("_i", F.col("_i") + F.col("_hard").cast("long")), "islands")
    # ends never fall along a line: the first shot that ends at _beyond or later breaks the span
    ends = placed.groupBy(key, "end_ms").agg(F.min("_p").alias("_stop"))
    found = scan.following(placed.select(key, "_p", "_i", (F.col("start_ms") + max_scene_ms + 1).alias("_beyond")), key, "_beyond", placed, "end_ms")
    to = found.join(ends.withColumnRenamed("end_ms", "_next"), [key, "_next"]).select(key, "_p", "_i", F.greatest("_stop", F.col("_p") + 1).alias("_to"))
    to = to.join(placed.select(key, F.col("_p").alias("_to"), F.col("_i").alias("_j")), [key, "_to"]).where("_i = _j")
    starts = scan.reached(to, key, "_p", "_to", placed.where("_hard"))
    marked = placed.join(starts.withColumn("_starts", F.lit(1)), [key, "_p"], "left").withColumn("_starts", F.coalesce("_starts", F.lit(0)).cast("long"))
    numbered = scan.running(marked, key, ["_p"], {"_scene": F.col("_starts")}, most=0)
    return numbered.select(key, "ordinal", (F.col("_scene") + F.col("_starts") - 1).cast("long").alias("scene"))


def _numbered(island: DataFrame, key: str, max_scene_ms: int) -> DataFrame:
    each = island.groupBy(key, "_i").agg(F.array_sort(F.collect_list(F.struct("start_ms", "ordinal", "end_ms"))).alias("_s"))
    # the fold keeps only where scenes begin (from 1), so that it copies nothing for most shots
    begins = F.aggregate(
        "_s",
        F.struct(F.lit(None).cast("long").alias("first"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("begins")),
        lambda a, s: F.when(
            a["first"].isNull() | (s["end_ms"] - a["first"] > max_scene_ms),
            F.struct(s["start_ms"].alias("first"), (a["at"] + 1).alias("at"), F.concat(a["begins"], F.array(a["at"])).alias("begins")),
        ).otherwise(F.struct(a["first"].alias("first"), (a["at"] + 1).alias("at"), a["begins"].alias("begins"))),
        lambda a: a["begins"],
    )
    folded = each.select(key, "_i", F.col("_s.ordinal").alias("_o"), begins.alias("_begins"))
    cut = folded.select(key, "_i", "_o", "_begins", F.posexplode("_begins").alias("_n", "_from"))
    size = F.coalesce(F.get("_begins", F.col("_n") + 1), F.size("_o") + 1) - F.col("_from")
    placed = cut.select(key, "_i", "_n", F.explode(F.slice("_o", F.col("_from"), size)).alias("ordinal"))
    number = F.dense_rank().over(W.partitionBy(key).orderBy("_i", "_n")) - 1
    return placed.select(key, "ordinal", number.cast("long").alias("scene"))


def placed_by(rows: DataFrame, bucket: list[Column], order: list) -> DataFrame:
    """rows with _place, their place (from 1) in the order of bucket and then of order. bucket
    must be coarse (some thousands of values): counts of the buckets are summed in one task,
    places inside a bucket are given where it is."""
    names = [f"_b{i}" for i in range(len(bucket))]
    marked = rows.withColumns(dict(zip(names, bucket, strict=True)))
    counts = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(*names).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy(*names).orderBy(*order))
    return marked.withColumn("_own", own).join(F.broadcast(counts.select(*names, before.alias("_before"))), names).withColumn("_place", F.col("_before") + F.col("_own")).drop("_own", "_before", *names)
