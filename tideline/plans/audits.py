"""Queries over outputs, segments and clips: audits, pacing and the edit list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import audits as au
from tideline.operators import captions as cp
from tideline.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}
ORDER = ["clip_order", "l_partkey", "l_suppkey", "l_extendedprice"]

_SEGMENTS = """,
seg AS (SELECT render_id, segment_id, segment_type, purpose, replace(upper(trim(coalesce(purpose, ''))), ' ', '_') AS p, count(*) AS n_clips,
    round_even(sum(greatest(0, end_ms - start_ms)), 0)::BIGINT AS visual_ms, max(end_ms - start_ms) AS longest_ms, min(greatest(0, end_ms - start_ms)) AS shortest_ms, max(speed) AS speed
    FROM clips GROUP BY ALL)"""
_E = "('ORIGINAL_HOOK', 'CONTEXT', 'CAUSAL_ANALYSIS', 'CHARACTER_ANALYSIS', 'RELATIONSHIP_CHANGE', 'HIDDEN_DETAIL', 'COMPARISON', 'CRITIQUE', 'INTERPRETATION', 'CONSEQUENCE', 'THEMATIC_INSIGHT', 'ORIGINAL_CONCLUSION')"
_METRICS = _SEGMENTS + f""",
met AS (SELECT render_id, count(*) FILTER (segment_type = 'narration') AS narration_segments, count(*) FILTER (segment_type = 'narration' AND p IN {_E}) AS editorial_segments,
    coalesce(sum(visual_ms) FILTER (segment_type = 'narration'), 0)::BIGINT AS narration_ms, coalesce(sum(visual_ms) FILTER (segment_type = 'original_dialogue'), 0)::BIGINT AS dialogue_ms,
    coalesce(list_sort(list(DISTINCT p) FILTER (p <> '')), []) AS purposes, count(DISTINCT p) FILTER (p IN {_E}) AS varied FROM seg GROUP BY 1),
metrics AS (SELECT *, CASE WHEN narration_ms + dialogue_ms > 0 THEN narration_ms / (narration_ms + dialogue_ms)::DOUBLE ELSE 0.0 END AS commentary_ratio FROM met)"""


def query(name: str, oracle: str | None = None, *parts: str):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ctes = ",".join(ad.SQL[p] for p in parts)
            ORACLES[name] = f"WITH RECURSIVE {ctes}{'' if oracle.startswith(',') else ' '}{oracle}" if ctes else oracle
        return function

    return add


@query("g6_originality_metrics", _METRICS + " SELECT render_id, narration_segments, editorial_segments, narration_ms, dialogue_ms, round(commentary_ratio, 4) AS commentary_ratio, array_to_string(purposes, ',') AS purposes FROM metrics", "clips")
def g6_originality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = au.output_metrics(au.segments(ad.clips(spark, sf)))
    return found.withColumn("commentary_ratio", F.round("commentary_ratio", 4)).withColumn("purposes", F.array_join("purposes", ","))


_ISSUES = _METRICS + f""",
issues AS (
SELECT 'BLOCK' AS severity, 'NON_EDITORIAL_PURPOSE' AS code, render_id, segment_id FROM seg WHERE segment_type = 'narration' AND p NOT IN {_E}
UNION ALL SELECT 'BLOCK', 'PLOT_DESCRIPTION_ONLY', render_id, segment_id FROM seg WHERE segment_type = 'narration' AND p IN ('RECAP', 'PLOT_DESCRIPTION', 'CHRONOLOGY', 'SUMMARY')
UNION ALL SELECT 'WARN', 'LONG_THIRD_PARTY_CLIP', render_id, segment_id FROM seg WHERE segment_type = 'narration' AND longest_ms > 7000
UNION ALL SELECT 'BLOCK', 'DIALOGUE_WITHOUT_EVIDENCE_PURPOSE', render_id, segment_id FROM seg WHERE segment_type = 'original_dialogue' AND p <> 'ORIGINAL_DIALOGUE_EVIDENCE'
UNION ALL SELECT 'BLOCK', 'LONG_ORIGINAL_DIALOGUE', render_id, segment_id FROM seg WHERE segment_type = 'original_dialogue' AND visual_ms > 15000
UNION ALL SELECT 'BLOCK', 'NO_COMMENTARY', render_id, '' FROM metrics WHERE narration_segments = 0
UNION ALL SELECT 'BLOCK', 'COMMENTARY_NOT_CONSISTENT', render_id, '' FROM metrics WHERE narration_segments > 0 AND editorial_segments <> narration_segments
UNION ALL SELECT 'BLOCK', 'COMMENTARY_NOT_CENTRAL', render_id, '' FROM metrics WHERE commentary_ratio < 0.60::DOUBLE
UNION ALL SELECT 'BLOCK', 'LOW_EDITORIAL_VARIETY', render_id, '' FROM metrics WHERE narration_segments >= 2 AND varied < 2)"""


@query("d1_originality_audit", _ISSUES + " SELECT * FROM issues", "clips")
def d1_originality_audit(spark: SparkSession, sf: str) -> DataFrame:
    return au.originality_issues(au.segments(ad.clips(spark, sf)))


@query("d1_passing_outputs", _ISSUES + " SELECT render_id FROM metrics WHERE render_id NOT IN (SELECT render_id FROM issues WHERE severity = 'BLOCK')", "clips")
def d1_passing_outputs(spark: SparkSession, sf: str) -> DataFrame:
    parts = au.segments(ad.clips(spark, sf))
    blocked = au.originality_issues(parts).where("severity = 'BLOCK'").select("render_id")
    return parts.select("render_id").distinct().join(blocked, "render_id", "left_anti")


_PACING = _SEGMENTS + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY render_id ORDER BY segment_id) AS position FROM seg),
run AS (SELECT *, sum(greatest(0, end_ms - start_ms) / 1000 / speed) OVER (PARTITION BY render_id, segment_id ORDER BY clip_order, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS b,
    row_number() OVER (PARTITION BY render_id, segment_id ORDER BY clip_order DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS l FROM clips WHERE segment_type = 'narration' AND speed > 0),
lead3 AS (SELECT render_id, segment_id, b, lead(b, 3) OVER (PARTITION BY render_id, segment_id ORDER BY b) AS n FROM run WHERE l > 1)"""


@query("d2_pacing_gate", _PACING + """
SELECT 'DIALOGUE_SPEED' AS code, render_id, segment_id FROM pos WHERE segment_type = 'original_dialogue' AND speed <> 0 AND abs(speed - 1.0::DOUBLE) > 0.0001::DOUBLE
UNION ALL SELECT 'HOOK_NOT_CONTINUOUS', render_id, segment_id FROM pos WHERE segment_type = 'original_dialogue' AND position = 1 AND n_clips <> 1
UNION ALL SELECT 'TOO_MANY_CLIPS', render_id, segment_id FROM pos WHERE segment_type = 'narration' AND n_clips > 4
UNION ALL SELECT 'SHORT_AVERAGE_SHOT', render_id, segment_id FROM pos WHERE segment_type = 'narration' AND n_clips > 1 AND visual_ms / n_clips::DOUBLE < 2000
UNION ALL SELECT 'MICRO_CLIP', render_id, segment_id FROM pos WHERE segment_type = 'narration' AND n_clips > 2 AND shortest_ms < 1500
UNION ALL SELECT 'SPEED_OUT_OF_BAND', render_id, segment_id FROM pos WHERE segment_type = 'narration' AND NOT speed BETWEEN 0.90::DOUBLE AND 1.10::DOUBLE
UNION ALL SELECT 'CONCLUSION_CLIPS', render_id, segment_id FROM pos WHERE segment_type = 'narration' AND p = 'ORIGINAL_CONCLUSION' AND n_clips > 3
UNION ALL SELECT DISTINCT 'CROWDED_CUTS', render_id, segment_id FROM lead3 WHERE n < b + 5""", "clips")
def d2_pacing_gate(spark: SparkSession, sf: str) -> DataFrame:
    return au.pacing_issues(ad.clips(spark, sf), ORDER)


@query("w8_crowded_cuts", _PACING + " SELECT DISTINCT render_id, segment_id FROM lead3 WHERE n < b + 5", "clips")
def w8_crowded_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return au.crowded_cuts(ad.clips(spark, sf), ORDER)


@query("g4_clip_durations", _SEGMENTS + " SELECT render_id, segment_id, visual_ms, longest_ms, n_clips FROM seg", "clips")
def g4_clip_durations(spark: SparkSession, sf: str) -> DataFrame:
    return au.segments(ad.clips(spark, sf)).select("render_id", "segment_id", "visual_ms", "longest_ms", "n_clips")


@query("f9_purposes", "SELECT DISTINCT purpose, replace(upper(trim(coalesce(purpose, ''))), ' ', '_') AS p FROM clips", "clips")
def f9_purposes(spark: SparkSession, sf: str) -> DataFrame:
    return ad.clips(spark, sf).select("purpose", T.normal_purpose("purpose").alias("p")).distinct()


_VOICE = "(3 + render_id % 9)::DOUBLE"


@query("m5_video_fit", _SEGMENTS + f"""
SELECT render_id, segment_id, round(greatest(0.85::DOUBLE, least(1.15::DOUBLE, visual_ms / 1000.0::DOUBLE / {_VOICE})), 6) AS fit_speed,
round(CASE WHEN visual_ms / 1000.0::DOUBLE / {_VOICE} > 1.15::DOUBLE THEN {_VOICE} * 1.15::DOUBLE / (visual_ms / 1000.0::DOUBLE) ELSE 1.0 END, 6) AS keep,
round(greatest(0, {_VOICE} - visual_ms / 1000.0::DOUBLE / greatest(0.85::DOUBLE, least(1.15::DOUBLE, visual_ms / 1000.0::DOUBLE / {_VOICE}))), 6) AS pad
FROM seg WHERE segment_type = 'narration' AND visual_ms > 0""", "clips")
def m5_video_fit(spark: SparkSession, sf: str) -> DataFrame:
    parts = au.segments(ad.clips(spark, sf)).where("segment_type = 'narration' and visual_ms > 0")
    video, voice = F.col("visual_ms") / F.lit(1000.0), (F.lit(3) + F.col("render_id") % 9).cast("double")
    speed, keep = au.video_fit(video, voice, 0.85, 1.15)
    return parts.select("render_id", "segment_id", F.round(speed, 6).alias("fit_speed"), F.round(keep, 6).alias("keep"), F.round(au.video_padding(video, voice, speed), 6).alias("pad"))


@query("r1_edit_list", """,
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(greatest(0, end_ms - start_ms) / speed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM clips WINDOW w AS (PARTITION BY render_id ORDER BY segment_id, clip_order, l_partkey, l_suppkey, l_extendedprice))
SELECT render_id, position, segment_id, start_ms, end_ms, round(place, 3) AS timeline_ms FROM o""", "clips")
def r1_edit_list(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of an output in order, with where each begins in rendered time."""
    order = ["segment_id", *ORDER]
    at = cp.running_offset(F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms")) / F.col("speed"), ["render_id"], order)
    position = F.row_number().over(W.partitionBy("render_id").orderBy(*order)) - 1
    return ad.clips(spark, sf).select("render_id", position.cast("long").alias("position"), "segment_id", "start_ms", "end_ms", F.round(at, 3).alias("timeline_ms"))


@query("v11_clip_bounds", "SELECT render_id, segment_id, clip_order, end_ms FROM clips WHERE end_ms > 15.0::DOUBLE * 1000 + 250", "clips")
def v11_clip_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return ad.clips(spark, sf).where(F.col("end_ms") > F.lit(15.0) * 1000 + 250).select("render_id", "segment_id", "clip_order", "end_ms")


@query("g3_counts_by_mode", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS full_recap, count(*) FILTER (o_orderstatus = 'O') AS main_story FROM orders GROUP BY 1")
def g3_counts_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(status == "F").alias("full_recap"), F.count_if(status == "O").alias("main_story"))


@query("u2_editorial_overlap", _METRICS + " SELECT render_id, varied FROM metrics", "clips")
def u2_editorial_overlap(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*[F.lit(p) for p in au.EDITORIAL if p != au.EVIDENCE])
    return au.output_metrics(au.segments(ad.clips(spark, sf))).select("render_id", F.size(F.array_intersect("purposes", wanted)).cast("long").alias("varied"))


@query("w16_hook_segments", _SEGMENTS + " SELECT render_id, arg_min(segment_id, segment_id) AS hook, arg_min(segment_type, segment_id) AS hook_type FROM seg GROUP BY 1", "clips")
def w16_hook_segments(spark: SparkSession, sf: str) -> DataFrame:
    return au.segments(ad.clips(spark, sf)).groupBy("render_id").agg(F.min("segment_id").alias("hook"), F.min_by("segment_type", "segment_id").alias("hook_type"))


@query("k10_nested_documents", """,
s AS (SELECT render_id, segment_id, count(*) AS n, sum(end_ms - start_ms) AS ms FROM clips GROUP BY 1, 2)
SELECT render_id, string_agg(segment_id || ':' || n || ':' || ms::BIGINT, ';' ORDER BY segment_id) AS outline FROM s GROUP BY 1""", "clips")
def k10_nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Clips nested in segments nested in outputs, told as an outline."""
    inner = ad.clips(spark, sf).groupBy("render_id", "segment_id").agg(F.collect_list(F.struct("start_ms", "end_ms")).alias("clips"))
    outer = inner.groupBy("render_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "clips"))).alias("segments"))
    told = F.transform("segments", lambda s: F.concat_ws(":", s["segment_id"], F.size(s["clips"]).cast("string"), F.aggregate(s["clips"], F.lit(0.0), lambda a, c: a + c["end_ms"] - c["start_ms"]).cast("long").cast("string")))
    return outer.select("render_id", F.array_join(told, ";").alias("outline"))


@query("g16_sample_levels", """SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding]) / len(embedding)), 6) AS rms,
round(list_max([abs(x)::DOUBLE for x in embedding]), 6) AS peak, round(len([x for x in embedding if abs(x) < 0.0005::FLOAT]) / len(embedding)::DOUBLE, 6) AS quiet FROM embeddings""")
def g16_sample_levels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size("embedding")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return ad.table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(F.sqrt(square / n), 6).alias("rms"),
        F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double"))), 6).alias("peak"),
        F.round(F.size(F.filter("embedding", lambda x: F.abs(x) < F.lit(0.0005).cast("float"))) / n, 6).alias("quiet"),
    )
