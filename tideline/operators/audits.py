"""Rule audits over outputs, segments and clips: one table of measures, then one filter a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.text import normal_purpose

#: Purposes that add editorial value, and those that only retell (fixed values).
EDITORIAL = [
    "ORIGINAL_HOOK", "CONTEXT", "CAUSAL_ANALYSIS", "CHARACTER_ANALYSIS", "RELATIONSHIP_CHANGE", "HIDDEN_DETAIL", "COMPARISON", "CRITIQUE", "INTERPRETATION",
    "CONSEQUENCE", "THEMATIC_INSIGHT", "ORIGINAL_CONCLUSION", "ORIGINAL_DIALOGUE_EVIDENCE",
]
DESCRIPTIVE = ["RECAP", "PLOT_DESCRIPTION", "CHRONOLOGY", "SUMMARY"]
EVIDENCE = "ORIGINAL_DIALOGUE_EVIDENCE"


def segments(clips: DataFrame) -> DataFrame:
    """Measures of each segment: clip count, summed and longest clip, shortest clip, speed."""
    length = F.col("end_ms") - F.col("start_ms")
    return clips.groupBy("render_id", "segment_id", "segment_type", "purpose").agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.bround(F.sum(F.greatest(F.lit(0.0), length))).cast("long").alias("visual_ms"),
        F.max(length).alias("longest_ms"),
        F.min(F.greatest(F.lit(0.0), length)).alias("shortest_ms"),
        F.max("speed").alias("speed"),
    )


def output_metrics(parts: DataFrame) -> DataFrame:
    """Narration, dialogue and editorial measures of each output."""
    tagged = parts.withColumn("p", normal_purpose("purpose"))
    narration, analytic = F.col("segment_type") == "narration", F.col("p").isin(EDITORIAL) & (F.col("p") != EVIDENCE)
    grouped = tagged.groupBy("render_id").agg(
        F.count_if(narration).alias("narration_segments"),
        F.count_if(narration & analytic).alias("editorial_segments"),
        F.coalesce(F.sum(F.when(narration, F.col("visual_ms"))), F.lit(0)).alias("narration_ms"),
        F.coalesce(F.sum(F.when(F.col("segment_type") == "original_dialogue", F.col("visual_ms"))), F.lit(0)).alias("dialogue_ms"),
        F.array_sort(F.collect_set(F.when(F.col("p") != "", F.col("p")))).alias("purposes"),
    )
    total = F.col("narration_ms") + F.col("dialogue_ms")
    return grouped.withColumn("commentary_ratio", F.when(total > 0, F.col("narration_ms") / total).otherwise(0.0))


def originality_issues(parts: DataFrame) -> DataFrame:
    """(severity, code, render_id, segment_id) of every rule broken; segment_id is empty for outputs."""
    tagged = parts.withColumn("p", normal_purpose("purpose"))
    narration, dialogue = F.col("segment_type") == "narration", F.col("segment_type") == "original_dialogue"
    analytic = F.col("p").isin(EDITORIAL) & (F.col("p") != EVIDENCE)
    of_segment = [
        ("BLOCK", "NON_EDITORIAL_PURPOSE", narration & ~analytic),
        ("BLOCK", "PLOT_DESCRIPTION_ONLY", narration & F.col("p").isin(DESCRIPTIVE)),
        ("WARN", "LONG_THIRD_PARTY_CLIP", narration & (F.col("longest_ms") > 7000)),
        ("BLOCK", "DIALOGUE_WITHOUT_EVIDENCE_PURPOSE", dialogue & (F.col("p") != EVIDENCE)),
        ("BLOCK", "LONG_ORIGINAL_DIALOGUE", dialogue & (F.col("visual_ms") > 15_000)),
    ]
    n = F.col("narration_segments")
    varied = F.size(F.array_intersect("purposes", F.array(*[F.lit(p) for p in EDITORIAL if p != EVIDENCE])))
    of_output = [
        ("BLOCK", "NO_COMMENTARY", n == 0),
        ("BLOCK", "COMMENTARY_NOT_CONSISTENT", (n > 0) & (F.col("editorial_segments") != n)),
        ("BLOCK", "COMMENTARY_NOT_CENTRAL", F.col("commentary_ratio") < 0.60),
        ("BLOCK", "LOW_EDITORIAL_VARIETY", (n >= 2) & (varied < 2)),
    ]
    return _broken(tagged, of_segment, F.col("segment_id")).unionByName(_broken(output_metrics(parts), of_output, F.lit("")))


def _broken(rows: DataFrame, rules: list[tuple[str, str, Column]], segment: Column) -> DataFrame:
    """One pass over rows: the broken rules as an array, exploded."""
    hits = F.filter(F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, test in rules]), lambda x: x.isNotNull())
    return rows.select("render_id", segment.alias("segment_id"), F.explode(hits).alias("i")).select("i.severity", "i.code", "render_id", "segment_id")


def crowded_cuts(clips: DataFrame, order: list[str]) -> DataFrame:
    """Narration segments with more than three cuts in some five seconds of rendered time."""
    line = W.partitionBy("render_id", "segment_id").orderBy(*order)
    length = F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms")) / 1000 / F.col("speed")
    cut = clips.where("segment_type = 'narration' and speed > 0").withColumn("b", F.sum(length).over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inner = cut.withColumn("_l", F.row_number().over(W.partitionBy("render_id", "segment_id").orderBy(*[F.desc(c) for c in order]))).where("_l > 1")
    later = F.lead("b", 3).over(W.partitionBy("render_id", "segment_id").orderBy("b"))
    return inner.withColumn("_n", later).where("_n < b + 5.0").select("render_id", "segment_id").distinct()


def pacing_issues(clips: DataFrame, order: list[str]) -> DataFrame:
    """(code, render_id, segment_id) of the pacing rules a segment breaks."""
    parts = segments(clips).withColumn("p", normal_purpose("purpose")).withColumn("position", F.row_number().over(W.partitionBy("render_id").orderBy("segment_id")))
    narration, dialogue, n = F.col("segment_type") == "narration", F.col("segment_type") == "original_dialogue", F.col("n_clips")
    rules = [
        ("DIALOGUE_SPEED", dialogue & (F.col("speed") != 0) & (F.abs(F.col("speed") - 1.0) > 0.0001)),
        ("HOOK_NOT_CONTINUOUS", dialogue & (F.col("position") == 1) & (n != 1)),
        ("TOO_MANY_CLIPS", narration & (n > 4)),
        ("SHORT_AVERAGE_SHOT", narration & (n > 1) & (F.col("visual_ms") / n < 2000)),
        ("MICRO_CLIP", narration & (n > 2) & (F.col("shortest_ms") < 1500)),
        ("SPEED_OUT_OF_BAND", narration & ~F.col("speed").between(0.90, 1.10)),
        ("CONCLUSION_CLIPS", narration & (F.col("p") == "ORIGINAL_CONCLUSION") & (n > 3)),
    ]
    found = _broken(parts, [("BLOCK", c, t) for c, t in rules], F.col("segment_id")).drop("severity")
    return found.unionByName(crowded_cuts(clips, order).select(F.lit("CROWDED_CUTS").alias("code"), "render_id", "segment_id"))


def video_fit(video: Column, voice: Column, least: float, most: float) -> tuple[Column, Column]:
    """Speed of the picture within [least, most] and the share of it to keep."""
    speed = video / voice
    return F.greatest(F.lit(least), F.least(F.lit(most), speed)), F.when(speed > most, voice * most / video).otherwise(1.0)


def video_padding(video: Column, voice: Column, speed: Column) -> Column:
    return F.greatest(F.lit(0.0), voice - video / speed)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
