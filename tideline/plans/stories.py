"""Queries over timelines: intervals, scenes, edges and story plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import graph
from tideline.operators import intervals as iv
from tideline.operators import planner as pl
from tideline.sources import adapters as ad

#: The guard on a scene's length and the silence gap, for events hours apart.
SCENE_MS, GAP_MS, WIDTH_MS = 172_800_000, 1500, 86_400_000
#: Length of the probe windows of the slice queries.
PROBE_MS = 3_600_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None, *parts: str):
    """Registers a query; its oracle gets the adapters' CTEs that it names."""

    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ctes = ",".join(ad.SQL[p] for p in parts)
            ORACLES[name] = f"WITH RECURSIVE {ctes}\n{oracle}" if ctes and not oracle.lstrip().startswith(",") else f"WITH RECURSIVE {ctes}{oracle}" if ctes else f"WITH RECURSIVE{oracle}"
        return function

    return add


_BRIDGE = "('CAUSE', 'SETUP', 'PAYOFF', 'CONSEQUENCE')"
_CLASSED = f""",
b AS (SELECT from_event_id AS event_id FROM edges WHERE relation IN {_BRIDGE} UNION SELECT to_event_id FROM edges WHERE relation IN {_BRIDGE}),
r AS (SELECT DISTINCT to_event_id AS event_id FROM edges WHERE relation = 'REVEAL' AND from_event_id % 5 = 0),
classed AS (SELECT t.*, CASE WHEN b.event_id IS NOT NULL OR r.event_id IS NOT NULL OR importance >= 0.7::DOUBLE THEN 'MUST_HAVE'
        WHEN importance >= 0.4::DOUBLE THEN 'SHOULD_HAVE' ELSE 'OPTIONAL' END AS budget_class,
    CASE WHEN b.event_id IS NOT NULL THEN 'causal bridge endpoint (cause/setup/payoff/consequence)' WHEN r.event_id IS NOT NULL THEN 'major reveal target'
        WHEN importance >= 0.7::DOUBLE THEN 'narrative importance ' || printf('%.2f', importance)
        WHEN importance >= 0.4::DOUBLE THEN 'supporting context ' || printf('%.2f', importance) ELSE 'low narrative importance ' || printf('%.2f', importance) END AS reason,
    greatest(1200, ceil((1 + t.event_id % 12) / 2.5::DOUBLE * 1000)::BIGINT) + 600 + 250 AS estimated_ms
    FROM timeline t LEFT JOIN b USING (event_id) LEFT JOIN r USING (event_id))"""
_RANKED = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, budget_class ORDER BY importance DESC, start_ms, ordinal) AS k,
    count(*) OVER (PARTITION BY user_id, budget_class) AS n FROM classed)"""
_PLAN = _CLASSED + _RANKED + """,
kept AS (SELECT * FROM ranked WHERE budget_class <> 'OPTIONAL' OR k <= floor(n * 0.2::DOUBLE)),
sized AS (SELECT *, sum(estimated_ms) OVER (PARTITION BY user_id) - coalesce(sum(estimated_ms) OVER (PARTITION BY user_id
    ORDER BY CASE budget_class WHEN 'OPTIONAL' THEN 0 WHEN 'SHOULD_HAVE' THEN 1 ELSE 2 END, importance, start_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ms,
    sum(CASE WHEN budget_class = 'MUST_HAVE' THEN estimated_ms ELSE 0 END) OVER (PARTITION BY user_id) <= {limit} AS feasible FROM kept),
plan AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) - 1 AS plan_ordinal, event_id, budget_class, reason, estimated_ms, feasible
    FROM sized WHERE budget_class = 'MUST_HAVE' OR over_ms <= {limit})
"""


def _story(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    line = ad.timeline(spark, sf)
    return line, ad.edges(line)


@query("g23_story_plan", _PLAN.format(limit=120000) + "SELECT * FROM plan", "timeline", "edges")
def g23_story_plan(spark: SparkSession, sf: str) -> DataFrame:
    return pl.plan(*_story(spark, sf), pl.Profile())


@query("g22_fit_limit", _PLAN.format(limit=90000) + "SELECT user_id, event_id, budget_class, feasible FROM plan", "timeline", "edges")
def g22_fit_limit(spark: SparkSession, sf: str) -> DataFrame:
    return pl.plan(*_story(spark, sf), pl.Profile(limit_ms=90_000)).select("user_id", "event_id", "budget_class", "feasible")


@query("g19_budget_class", _CLASSED + "SELECT event_id, budget_class, reason FROM classed", "timeline", "edges")
def g19_budget_class(spark: SparkSession, sf: str) -> DataFrame:
    return pl.classify(*_story(spark, sf), pl.Profile()).select("event_id", "budget_class", "reason")


@query("g20_time_estimate", _CLASSED + "SELECT event_id, estimated_ms FROM classed", "timeline", "edges")
def g20_time_estimate(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    return line.select("event_id", pl.estimate_ms(F.lit(1) + F.col("event_id") % 12, pl.Profile()).alias("estimated_ms"))


@query("g21_top_share", _CLASSED + _RANKED + "SELECT user_id, event_id, budget_class FROM ranked WHERE budget_class = 'MUST_HAVE' OR (budget_class = 'SHOULD_HAVE' AND k <= ceil(n * 0.35::DOUBLE))", "timeline", "edges")
def g21_top_share(spark: SparkSession, sf: str) -> DataFrame:
    profile = pl.Profile(style="CINEMATIC", compression=0.35)
    return pl.top_share(pl.classify(*_story(spark, sf), profile), profile).select("user_id", "event_id", "budget_class")


@query("j10_selected_plots", _PLAN.format(limit=120000) + "SELECT DISTINCT user_id, event_type FROM timeline WHERE event_id IN (SELECT event_id FROM plan)", "timeline", "edges")
def j10_selected_plots(spark: SparkSession, sf: str) -> DataFrame:
    line, edges = _story(spark, sf)
    return pl.selected_plots(line, pl.plan(line, edges, pl.Profile()))


@query("g11_plan_duration", _PLAN.format(limit=120000) + "SELECT user_id, sum(estimated_ms)::BIGINT AS total_ms, count(*) AS n_events FROM plan GROUP BY 1", "timeline", "edges")
def g11_plan_duration(spark: SparkSession, sf: str) -> DataFrame:
    plan = pl.plan(*_story(spark, sf), pl.Profile())
    return plan.groupBy("user_id").agg(F.sum("estimated_ms").alias("total_ms"), F.count(F.lit(1)).alias("n_events"))


@query("j13_unexcused_must_have", _PLAN.format(limit=90000) + "SELECT event_id FROM classed WHERE budget_class = 'MUST_HAVE' AND event_id NOT IN (SELECT event_id FROM plan WHERE feasible) AND NOT excluded", "timeline", "edges")
def j13_unexcused_must_have(spark: SparkSession, sf: str) -> DataFrame:
    line, edges = _story(spark, sf)
    must = pl.classify(line, edges, pl.Profile()).where("budget_class = 'MUST_HAVE'").select("event_id")
    chosen = pl.plan(line, edges, pl.Profile(limit_ms=90_000)).where("feasible").select("event_id")
    return must.join(chosen, "event_id", "left_anti").join(line.where("excluded").select("event_id"), "event_id", "left_anti")


@query("g9_bridge_endpoints", f"SELECT from_event_id AS event_id FROM edges WHERE relation IN {_BRIDGE} UNION SELECT to_event_id FROM edges WHERE relation IN {_BRIDGE}", "timeline", "edges")
def g9_bridge_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return pl.bridge_events(_story(spark, sf)[1])


@query("g10_reveal_targets", "SELECT DISTINCT to_event_id AS event_id FROM edges WHERE relation = 'REVEAL' AND from_event_id % 5 = 0", "timeline", "edges")
def g10_reveal_targets(spark: SparkSession, sf: str) -> DataFrame:
    return pl.reveal_targets(_story(spark, sf)[1])


@query("p15_bridge_edges", f"SELECT * FROM edges WHERE relation IN {_BRIDGE}", "timeline", "edges")
def p15_bridge_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _story(spark, sf)[1].where(F.col("relation").isin(*pl.BRIDGES))


@query("s2_timeline_scan", "SELECT event_id, user_id, ordinal, start_ms, end_ms, importance, excluded FROM timeline", "timeline")
def s2_timeline_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ad.timeline(spark, sf).select("event_id", "user_id", "ordinal", "start_ms", "end_ms", "importance", "excluded")


@query("p1_durations", "SELECT user_id, sum(end_ms - start_ms)::BIGINT AS total_ms, max(end_ms - start_ms) AS longest_ms FROM timeline GROUP BY 1", "timeline")
def p1_durations(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("end_ms") - F.col("start_ms")
    return ad.timeline(spark, sf).groupBy("user_id").agg(F.sum(d).alias("total_ms"), F.max(d).alias("longest_ms"))


_PROBES = f""",
probes AS (SELECT event_id AS probe_id, user_id, end_ms - {PROBE_MS} AS start_ms, end_ms + {PROBE_MS} AS end_ms FROM timeline)"""


def _probes(line: DataFrame) -> DataFrame:
    return line.select(F.col("event_id").alias("probe_id"), "user_id", (F.col("end_ms") - PROBE_MS).alias("start_ms"), (F.col("end_ms") + PROBE_MS).alias("end_ms"))


@query("j2_overlap_join", _PROBES + "SELECT probe_id, event_id FROM probes p JOIN timeline t ON p.user_id = t.user_id AND p.start_ms < t.end_ms AND t.start_ms < p.end_ms", "timeline")
def j2_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    found = iv.overlap_join(_probes(line), line.select("user_id", "event_id", "start_ms", "end_ms"), "user_id", WIDTH_MS)
    return found.select("l.probe_id", "r.event_id")


@query("p2_contained_events", _PROBES + "SELECT probe_id, event_id FROM probes p JOIN timeline t ON p.user_id = t.user_id AND p.start_ms <= t.start_ms AND t.end_ms <= p.end_ms", "timeline")
def p2_contained_events(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    found = iv.overlap_join(_probes(line), line.select("user_id", "event_id", "start_ms", "end_ms"), "user_id", WIDTH_MS)
    return found.where(iv.contains("l", "r")).select("l.probe_id", "r.event_id")


@query("j6_keyframes_inside", """,
k AS (SELECT user_id, event_id AS key_id, start_ms + (end_ms - start_ms) // 2 AS t FROM timeline)
SELECT key_id, event_id FROM k JOIN timeline t USING (user_id) WHERE k.t >= start_ms AND k.t < end_ms""", "timeline")
def j6_keyframes_inside(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    at = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)
    points = line.select("user_id", F.col("event_id").alias("key_id"), at.alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 1)
    return iv.overlap_join(points, line.select("user_id", "event_id", "start_ms", "end_ms"), "user_id", WIDTH_MS).select("l.key_id", "r.event_id")


_SPEECH = ", speech AS (SELECT user_id, start_ms, end_ms FROM timeline WHERE event_type IN ('click', 'view') AND end_ms - start_ms < 7200000)"
_SILENT = _SPEECH + f""",
edge AS (SELECT * FROM (SELECT user_id, ordinal, greatest(0, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) - {GAP_MS}) AS bs, start_ms + {GAP_MS} AS be,
    lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) AS prev FROM timeline) WHERE prev IS NOT NULL AND be > bs),
silent AS (SELECT user_id, ordinal FROM edge e WHERE NOT EXISTS (SELECT 1 FROM speech s WHERE s.user_id = e.user_id AND s.start_ms < e.be AND e.bs < s.end_ms))"""


def _speech(line: DataFrame) -> DataFrame:
    return line.where("event_type in ('click', 'view') and end_ms - start_ms < 7200000").select("user_id", "start_ms", "end_ms")


@query("j4_silent_boundaries", _SILENT + " SELECT user_id, ordinal FROM silent", "timeline")
def j4_silent_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    return iv.silent_boundaries(line, _speech(line), "user_id", GAP_MS, WIDTH_MS)


_SCENES = """,
hard AS (SELECT t.user_id, t.ordinal, t.start_ms, t.end_ms, sum(CASE WHEN excluded OR coalesce(px, true) {quiet} THEN 1 ELSE 0 END) OVER (PARTITION BY t.user_id ORDER BY t.start_ms, t.ordinal) AS isl
    FROM (SELECT *, lag(excluded) OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) AS px FROM timeline) t {join}),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY start_ms, ordinal) AS rn FROM hard),
f AS (SELECT user_id, isl, ordinal, rn, start_ms AS first_ms, 0 AS scn FROM n WHERE rn = 1
    UNION ALL SELECT n.user_id, n.isl, n.ordinal, n.rn, CASE WHEN n.end_ms - f.first_ms > {most} THEN n.start_ms ELSE f.first_ms END,
        CASE WHEN n.end_ms - f.first_ms > {most} THEN f.scn + 1 ELSE f.scn END FROM f JOIN n ON n.user_id = f.user_id AND n.isl = f.isl AND n.rn = f.rn + 1),
scenes AS (SELECT user_id, ordinal, dense_rank() OVER (PARTITION BY user_id ORDER BY isl, scn) - 1 AS scene FROM f)"""
_PLAIN = _SCENES.format(quiet="", join="", most=SCENE_MS)


@query("w5_scene_grouping", _PLAIN + " SELECT user_id, ordinal, scene FROM scenes", "timeline")
def w5_scene_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return iv.scenes(ad.timeline(spark, sf), "user_id", SCENE_MS)


@query("w5_scenes_with_silence", _SILENT + _SCENES.format(quiet="OR s.ordinal IS NOT NULL", join="LEFT JOIN silent s ON s.user_id = t.user_id AND s.ordinal = t.ordinal", most=SCENE_MS) + " SELECT user_id, ordinal, scene FROM scenes", "timeline")
def w5_scenes_with_silence(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    return iv.scenes(line, "user_id", SCENE_MS, iv.silent_boundaries(line, _speech(line), "user_id", GAP_MS, WIDTH_MS))


@query("g14_scene_envelopes", _PLAIN + """ SELECT user_id, scene, min(start_ms) AS start_ms, arg_max(end_ms, ordinal) AS end_ms, count(*) AS n_shots
FROM scenes JOIN timeline USING (user_id, ordinal) GROUP BY 1, 2""", "timeline")
def g14_scene_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    joined = iv.scenes(line, "user_id", SCENE_MS).join(line, ["user_id", "ordinal"])
    return joined.groupBy("user_id", "scene").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "ordinal").alias("end_ms"), F.count(F.lit(1)).alias("n_shots"))


@query("w12_previous_summary", _PLAIN + """ SELECT user_id, scene, lag(summary, 1, '') OVER (PARTITION BY user_id ORDER BY scene) AS previous_summary
FROM (SELECT user_id, scene, string_agg(event_type, '>' ORDER BY ordinal) AS summary FROM scenes JOIN timeline USING (user_id, ordinal) GROUP BY 1, 2)""", "timeline")
def w12_previous_summary(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    joined = iv.scenes(line, "user_id", SCENE_MS).join(line, ["user_id", "ordinal"])
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "event_type")))
    told = joined.groupBy("user_id", "scene").agg(F.concat_ws(">", F.transform(listed, lambda s: s["event_type"])).alias("summary"))
    return told.select("user_id", "scene", F.lag("summary", 1, "").over(W.partitionBy("user_id").orderBy("scene")).alias("previous_summary"))


@query("g15_flat_keyframes", _PLAIN + """ SELECT user_id, scene, array_to_string(list(start_ms + (end_ms - start_ms) // 2 ORDER BY ordinal), ',') AS keyframes
FROM scenes JOIN timeline USING (user_id, ordinal) GROUP BY 1, 2""", "timeline")
def g15_flat_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    joined = iv.scenes(line, "user_id", SCENE_MS).join(line, ["user_id", "ordinal"])
    at = F.array(F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", at.alias("k"))))
    flat = F.flatten(F.transform(listed, lambda s: s["k"]))
    return joined.groupBy("user_id", "scene").agg(F.array_join(F.transform(flat, lambda x: x.cast("string")), ",").alias("keyframes"))


@query("p5_excluded_reasons", _PLAIN + """ SELECT user_id, scene, array_to_string(list(event_type ORDER BY ordinal) FILTER (excluded), ',') AS reasons
FROM scenes JOIN timeline USING (user_id, ordinal) GROUP BY 1, 2 HAVING bool_or(excluded)""", "timeline")
def p5_excluded_reasons(spark: SparkSession, sf: str) -> DataFrame:
    line = ad.timeline(spark, sf)
    joined = iv.scenes(line, "user_id", SCENE_MS).join(line.where("excluded"), ["user_id", "ordinal"])
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "event_type")))
    return joined.groupBy("user_id", "scene").agg(F.concat_ws(",", F.transform(listed, lambda s: s["event_type"])).alias("reasons"))


@query("w2_overlap_violations", ", s AS (SELECT user_id, ordinal, start_ms - event_id % 3 * 1000 AS start_ms, end_ms FROM timeline) SELECT user_id, ordinal FROM (SELECT *, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) AS p FROM s) WHERE start_ms < p", "timeline")
def w2_overlap_violations(spark: SparkSession, sf: str) -> DataFrame:
    moved = ad.timeline(spark, sf).withColumn("start_ms", F.col("start_ms") - F.col("event_id") % 3 * 1000)
    return moved.withColumn("p", F.lag("end_ms").over(W.partitionBy("user_id").orderBy("start_ms", "ordinal"))).where("start_ms < p").select("user_id", "ordinal")


@query("w3_ordinal_violations", ", n AS (SELECT user_id, event_id, ordinal + CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END AS ordinal FROM timeline), o AS (SELECT user_id, event_id, ordinal, row_number() OVER (PARTITION BY user_id ORDER BY ordinal, event_id) - 1 AS want FROM n) SELECT user_id, event_id, ordinal, want FROM o WHERE ordinal <> want", "timeline")
def w3_ordinal_violations(spark: SparkSession, sf: str) -> DataFrame:
    numbered = ad.timeline(spark, sf).withColumn("ordinal", F.col("ordinal") + F.when(F.col("event_id") % 11 == 0, 3).otherwise(0))
    want = (F.row_number().over(W.partitionBy("user_id").orderBy("ordinal", "event_id")) - 1).cast("long")
    return numbered.select("user_id", "event_id", "ordinal", want.alias("want")).where("ordinal <> want")


@query("w4_adjacent_flags", "SELECT event_id, coalesce(lag(excluded) OVER w, false) AS after_excluded, start_ms - lag(end_ms) OVER w AS gap_ms FROM timeline WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, ordinal)", "timeline")
def w4_adjacent_flags(spark: SparkSession, sf: str) -> DataFrame:
    line = W.partitionBy("user_id").orderBy("start_ms", "ordinal")
    return ad.timeline(spark, sf).select("event_id", F.coalesce(F.lag("excluded").over(line), F.lit(False)).alias("after_excluded"), (F.col("start_ms") - F.lag("end_ms").over(line)).alias("gap_ms"))


_DAY = "(start_ms % 86400000)"


@query("w11_thinned_cuts", """,
c AS (SELECT user_id, cut, row_number() OVER (PARTITION BY user_id ORDER BY cut) AS rn FROM (SELECT DISTINCT user_id, start_ms % 86400000 AS cut FROM timeline)),
f AS (SELECT user_id, 0 AS rn, 0::BIGINT AS last, false AS keep, 0::BIGINT AS cut FROM c WHERE rn = 1
    UNION ALL SELECT c.user_id, c.rn, CASE WHEN c.cut - f.last >= 3600000 AND c.cut < 80000000 THEN c.cut ELSE f.last END, c.cut - f.last >= 3600000 AND c.cut < 80000000, c.cut
    FROM f JOIN c ON c.user_id = f.user_id AND c.rn = f.rn + 1)
SELECT user_id, cut FROM f WHERE keep""", "timeline")
def w11_thinned_cuts(spark: SparkSession, sf: str) -> DataFrame:
    cuts = ad.timeline(spark, sf).select("user_id", (F.col("start_ms") % 86_400_000).alias("cut"))
    return iv.thinned(cuts, "user_id", "cut", 3_600_000, F.lit(80_000_000)).select("user_id", "cut")


@query("w9_tumbling_chunks", """,
d AS (SELECT user_id, (max(end_ms) - min(start_ms)) / 86400000.0::DOUBLE * 60 AS dur FROM timeline GROUP BY 1)
SELECT user_id, i::INTEGER AS chunk, (i * 90)::DOUBLE AS chunk_start, least(dur, (i + 1) * 90.0::DOUBLE) AS chunk_end FROM d, unnest(range(0, ceil(dur / 90)::BIGINT)) t(i) WHERE dur > 0""", "timeline")
def w9_tumbling_chunks(spark: SparkSession, sf: str) -> DataFrame:
    span = ad.timeline(spark, sf).groupBy("user_id").agg(((F.max("end_ms") - F.min("start_ms")) / F.lit(86_400_000.0) * 60).alias("dur"))
    return iv.windows(span, F.col("dur"), 90).select("user_id", "chunk", "chunk_start", "chunk_end")


@query("w10_even_frames", """,
d AS (SELECT event_id, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM timeline),
m AS (SELECT *, s + least(least(1.0::DOUBLE, greatest(0.05::DOUBLE, (e - s) * 0.03::DOUBLE)), (e - s) / 3) AS lo FROM d),
h AS (SELECT *, greatest(lo, e - least(least(1.0::DOUBLE, greatest(0.25::DOUBLE, (e - s) * 0.03::DOUBLE)), (e - s) / 3)) AS hi FROM m)
SELECT event_id, i::INTEGER AS frame, round(lo + (hi - lo) * i / 7, 3) AS t FROM h, unnest(range(0, 8)) t(i)""", "timeline")
def w10_even_frames(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.timeline(spark, sf).select("event_id", (F.col("start_ms") / F.lit(1000.0)).alias("s"), (F.col("end_ms") / F.lit(1000.0)).alias("e"))
    length = F.col("e") - F.col("s")
    margin = lambda least: F.least(F.least(F.lit(1.0), F.greatest(F.lit(least), length * 0.03)), length / 3)
    d = d.withColumn("lo", F.col("s") + margin(0.05)).withColumn("hi", F.greatest("lo", F.col("e") - margin(0.25)))
    framed = d.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return framed.select("event_id", "frame", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frame") / 7, 3).alias("t"))


@query("j11_dangling_edges", ", n AS (SELECT from_event_id, to_event_id + CASE WHEN to_event_id % 13 = 0 THEN 1000000000 ELSE 0 END AS to_event_id FROM edges) SELECT * FROM n WHERE to_event_id NOT IN (SELECT event_id FROM timeline)", "timeline", "edges")
def j11_dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    line, edges = _story(spark, sf)
    broken = edges.withColumn("to_event_id", F.col("to_event_id") + F.when(F.col("to_event_id") % 13 == 0, 1_000_000_000).otherwise(0))
    known = line.select(F.col("event_id").alias("to_event_id"), "user_id")
    return broken.join(known, ["user_id", "to_event_id"], "left_anti").select("from_event_id", "to_event_id")


@query("w14_duplicate_keys", "SELECT user_id, event_type, start_ms // 3600000 AS hour, count(*) AS n FROM timeline GROUP BY 1, 2, 3 HAVING count(*) > 1", "timeline")
def w14_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ad.timeline(spark, sf).groupBy("user_id", "event_type", F.floor(F.col("start_ms") / 3_600_000).alias("hour")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("g2_next_ordinal", "SELECT user_id, coalesce(max(ordinal), 0) + 1 AS next_ordinal FROM timeline GROUP BY 1", "timeline")
def g2_next_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return ad.timeline(spark, sf).groupBy("user_id").agg((F.coalesce(F.max("ordinal"), F.lit(0)) + 1).alias("next_ordinal"))


@query("i7_job_state_fold", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS attempts, arg_max(event_type, ordinal) AS last_state FROM timeline GROUP BY 1", "timeline")
def i7_job_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ad.timeline(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("attempts"), F.max_by("event_type", "ordinal").alias("last_state"))


@query("p14_bad_transitions", """,
allowed(a, b) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('click', 'view'), ('error', 'view'), ('view', 'error'))
SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) AS before FROM timeline)
WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = before AND b = event_type)""", "timeline")
def p14_bad_transitions(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("error", "view"), ("view", "error")], "before string, event_type string")
    pairs = ad.timeline(spark, sf).select("event_id", "event_type", F.lag("event_type").over(W.partitionBy("user_id").orderBy("start_ms", "ordinal")).alias("before")).where("before is not null")
    return pairs.join(F.broadcast(allowed), ["before", "event_type"], "left_anti").select("event_id")


_HELD = """,
held(src, dst) AS (SELECT 'region ' || n_regionkey, 'nation ' || n_nationkey FROM nation
    UNION ALL SELECT 'nation ' || s_nationkey, 'supplier ' || s_suppkey FROM supplier
    UNION ALL SELECT 'nation ' || c_nationkey, 'customer ' || c_custkey FROM customer
    UNION ALL SELECT 'customer ' || o_custkey, 'order ' || o_orderkey FROM orders WHERE o_orderstatus = 'P')"""
_TRADE = """,
flow AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice) AS worth FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
trade AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY worth DESC, dst) AS k FROM flow) WHERE k = 1)"""


def held(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from what holds to what is held: regions, nations, suppliers and customers, open orders."""
    named = lambda kind, column: F.concat(F.lit(kind + " "), F.col(column).cast("string"))
    pairs = [("nation", "region", "n_regionkey", "nation", "n_nationkey"), ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"), ("customer", "nation", "c_nationkey", "customer", "c_custkey")]
    edges = [ad.table(spark, sf, t).select(named(a, x).alias("src"), named(b, y).alias("dst")) for t, a, x, b, y in pairs]
    edges.append(ad.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(named("customer", "o_custkey").alias("src"), named("order", "o_orderkey").alias("dst")))
    return reduce(DataFrame.unionByName, edges)


@query("c2_stage_descendants", _HELD[1:] + """,
d AS (SELECT src AS root, dst AS node, 1 AS depth FROM held UNION ALL SELECT root, dst, depth + 1 FROM d JOIN held ON src = node)
SELECT root, node, min(depth) AS depth FROM d GROUP BY 1, 2""")
def c2_stage_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All that follows from each node of the graph of what holds what, and how far away it is."""
    return graph.closure(held(spark, sf))


@query("c2_cycles", _TRADE[1:] + """,
d AS (SELECT src AS root, dst AS node, 1 AS depth FROM trade UNION ALL SELECT root, dst, depth + 1 FROM d JOIN trade ON src = node WHERE depth < 25)
SELECT root, min(depth) AS length FROM d WHERE root = node GROUP BY 1""")
def c2_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Nations on a cycle of best trade: each points to the nation that it buys most from, its own apart."""
    t = lambda name: ad.table(spark, sf, name)
    bought = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    flow = bought.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("worth"))
    best = flow.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy(F.desc("worth"), "dst"))).where("k = 1")
    return graph.cycles(graph.closure(best.select("src", "dst")))
