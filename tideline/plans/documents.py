"""Queries over nested documents, probes, manifests, boundaries and small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import graph
from tideline.operators import hierarchy as hi
from tideline.operators import store as st
from tideline.plans import stories
from tideline.plans.audits import _SEGMENTS, ORDER
from tideline.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None, *parts: str):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ctes = ",".join(ad.SQL[p] for p in parts)
            ORACLES[name] = f"WITH RECURSIVE {ctes}{'' if oracle.startswith(',') else ' '}{oracle}" if ctes else oracle
        return function

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return hi.documents(ad.clips(spark, sf), ORDER)


def _s(c: str):
    return F.col(c).cast("string")


@query("a1_nested_clips", "SELECT render_id, segment_id, (row_number() OVER (PARTITION BY render_id, segment_id ORDER BY clip_order, l_partkey, l_suppkey, l_extendedprice) - 1)::INTEGER AS clip, start_ms, end_ms FROM clips", "clips")
def a1_nested_clips(spark: SparkSession, sf: str) -> DataFrame:
    return hi.clip_rows(_docs(spark, sf))


@query("s4_json_documents", "SELECT render_id, segment_id, segment_type, count(*) AS n_clips, max(end_ms) AS last_ms FROM clips GROUP BY 1, 2, 3", "clips")
def s4_json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON text and read back under an explicit schema."""
    rows = hi.segment_rows(hi.from_text(hi.to_text(_docs(spark, sf))))
    return rows.select("render_id", "segment_id", "segment_type", F.size("clips").cast("long").alias("n_clips"), F.array_max(F.transform("clips", lambda c: c["end_ms"])).alias("last_ms"))


_NORMAL = _SEGMENTS + """,
nrm AS (SELECT *, CASE WHEN segment_type = 'narration' THEN (floor(((5 + render_id % 20) * 60000 / 140.0::DOUBLE + 99) / 100) * 100)::BIGINT ELSE 0 END AS voice_ms FROM seg)"""


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    return hi.segment_rows(hi.normalised(_docs(spark, sf), lambda s: F.lit(5) + F.col("render_id") % 20))


@query("m7_segment_timing", _NORMAL + " SELECT render_id, segment_id, visual_ms, voice_ms, CASE WHEN voice_ms > 0 THEN round(visual_ms / voice_ms::DOUBLE, 4) ELSE 1.0 END AS speed FROM nrm", "clips")
def m7_segment_timing(spark: SparkSession, sf: str) -> DataFrame:
    return _normal(spark, sf).select("render_id", "segment_id", "visual_ms", "voice_ms", "speed")


@query("a3_forced_overrides", _NORMAL + " SELECT render_id, segment_id, CASE WHEN segment_type = 'narration' THEN 'mute' ELSE 'preserve' END AS audio, segment_type = 'narration' AS subtitle FROM nrm", "clips")
def a3_forced_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return _normal(spark, sf).select("render_id", "segment_id", "audio", "subtitle")


@query("v9_project_rules", """,
r AS (SELECT render_id, segment_id, clip_order, purpose, start_ms, end_ms, speed, count(*) OVER (PARTITION BY render_id, clip_order) AS n FROM clips)
SELECT 'clip_order_unique' AS rule, render_id::VARCHAR AS key FROM r WHERE n > 1 UNION ALL SELECT 'clip_end_after_start', render_id::VARCHAR FROM r WHERE end_ms <= start_ms
UNION ALL SELECT 'purpose_given', render_id::VARCHAR FROM r WHERE trim(purpose) = '' UNION ALL SELECT 'speed_positive', render_id::VARCHAR FROM r WHERE speed < 0.84::DOUBLE""", "clips")
def v9_project_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.clips(spark, sf).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("render_id", "clip_order")))
    rules = {"clip_order_unique": F.col("n") == 1, "clip_end_after_start": F.col("end_ms") > F.col("start_ms"), "purpose_given": F.trim("purpose") != "", "speed_positive": F.col("speed") >= 0.84}
    return st.violations(rows, rules, "render_id")


@query("v10_declared_modes", "SELECT o_custkey FROM orders GROUP BY 1 HAVING (count(*) FILTER (o_orderstatus = 'F') > 0) <> (o_custkey % 2 = 0) OR count(*) FILTER (o_orderstatus = 'O') > 5")
def v10_declared_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Batches whose outputs do not match the modes that they declare."""
    s = F.col("o_orderstatus")
    seen = ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"))
    return seen.where(((F.col("f") > 0) != (F.col("o_custkey") % 2 == 0)) | (F.col("o") > 5)).select("o_custkey")


@query("v15_missing_dialogue", _SEGMENTS + " SELECT render_id, string_agg(segment_id, ',' ORDER BY segment_id) AS missing FROM seg WHERE segment_type = 'original_dialogue' AND p = '' GROUP BY 1", "clips")
def v15_missing_dialogue(spark: SparkSession, sf: str) -> DataFrame:
    rows = hi.segment_rows(_docs(spark, sf)).where((F.col("segment_type") == "original_dialogue") & (T.normal_purpose("purpose") == ""))
    return rows.groupBy("render_id").agg(F.array_join(F.array_sort(F.collect_list("segment_id")), ",").alias("missing"))


@query("s10_probe_streams", """SELECT p_partkey, 640 + p_size AS width, ((p_size * 90) % 360) AS rotation, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(30000.0::DOUBLE / (p_size % 5 * 1001), 4) END AS rate, 1 + p_size % 2 AS channels FROM part""")
def s10_probe_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Probe output (JSON) to typed columns: first video and audio stream, rotation modulo 360, rate as a fraction."""
    size = F.col("p_size")
    raw = F.to_json(F.struct(F.array(
        F.struct(F.lit("video").alias("codec_type"), (F.lit(640) + size).alias("width"), (size * 90).cast("string").alias("rotation"), F.concat(F.lit("30000/"), (size % 5 * 1001).cast("string")).alias("rate"), F.lit(None).cast("int").alias("channels")),
        F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("string").alias("rotation"), F.lit(None).cast("string").alias("rate"), (F.lit(1) + size % 2).alias("channels")),
    ).alias("streams")))
    schema = "streams array<struct<codec_type:string,width:int,rotation:string,rate:string,channels:int>>"
    probed = ad.table(spark, sf, "part").select("p_partkey", F.from_json(raw, schema)["streams"].alias("s"))
    first = lambda kind: F.get(F.filter("s", lambda x: x["codec_type"] == kind), F.lit(0))
    split = F.split(first("video")["rate"], "/")
    return probed.select(
        "p_partkey", first("video")["width"].alias("width"), F.pmod(first("video")["rotation"].cast("int"), F.lit(360)).alias("rotation"),
        F.round(F.try_divide(split[0].cast("double"), split[1].cast("double")), 4).alias("rate"), first("audio")["channels"].alias("channels"),
    )


@query("s12_manifest_catalog", "SELECT engine, voice_id, CASE WHEN size % 3 = 0 THEN engine || '-default' ELSE style END AS style FROM voices WHERE size > 2", "voices")
def s12_manifest_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """JSON manifests of an engine's voices, one for every 10,000 ids, exploded to voices with
    the engine's defaults."""
    voice = F.struct("voice_id", F.when(F.col("size") % 3 != 0, F.col("style")).alias("style"), "size")
    listed = ad.voices(spark, sf).groupBy("engine", F.floor(F.col("voice_id") / 10_000)).agg(F.collect_list(voice).alias("voices"))
    manifests = listed.select(F.to_json(F.struct("engine", "voices")).alias("json"))
    read = manifests.select(F.from_json("json", "engine string, voices array<struct<voice_id:bigint,style:string,size:int>>").alias("m")).select("m.engine", F.explode("m.voices").alias("v"))
    return read.where("v.size > 2").select("engine", "v.voice_id", F.coalesce("v.style", F.concat("engine", F.lit("-default"))).alias("style"))


@query("k12_path_guard", """WITH steps AS (SELECT conv_id, turn, string_split(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) < 3 THEN '..' WHEN length(w) = 3 THEN '.' ELSE w END), '/'), '/') AS p FROM conversations),
moves AS (SELECT conv_id, turn, list_transform(p, lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('.', '') THEN 0 ELSE 1 END) AS d FROM steps)
SELECT conv_id, turn, list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))) >= 0 AS inside FROM moves""")
def k12_path_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a relative path, its . and .. steps taken, stays under its root. Paths are the
    words of a turn, short ones as steps up (two letters) or in place (three)."""
    step = lambda w: F.when(F.length(w) < 3, "..").when(F.length(w) == 3, ".").otherwise(w)
    path = F.array_join(F.transform(F.split("text", " "), step), "/")
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, p: F.struct(
        (s["d"] + F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)).alias("d"), (s["ok"] & ~((p == "..") & (s["d"] == 0))).alias("ok")), lambda s: s["ok"])
    return ad.table(spark, sf, "conversations").select("conv_id", "turn", depth.alias("inside"))


@query("p4_outside_range", "SELECT event_id FROM timeline WHERE NOT (start_ms >= 1704067200000 AND end_ms <= 1709000000000)", "timeline")
def p4_outside_range(spark: SparkSession, sf: str) -> DataFrame:
    return ad.timeline(spark, sf).where(~((F.col("start_ms") >= 1704067200000) & (F.col("end_ms") <= 1709000000000))).select("event_id")


@query("p6_mode_outputs", "SELECT o_orderkey FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN o_orderstatus = 'F' WHEN '2-HIGH' THEN o_orderstatus = 'O' ELSE true END")
def p6_mode_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs of the type that their mode asks for; a mode that asks for none takes all."""
    wanted = F.try_element_at(F.create_map(F.lit("1-URGENT"), F.lit("F"), F.lit("2-HIGH"), F.lit("O")), F.col("o_orderpriority"))
    return ad.table(spark, sf, "orders").where(wanted.isNull() | (wanted == F.col("o_orderstatus"))).select("o_orderkey")


@query("p12_field_rules", "SELECT 'text' AS rule, doc_id::VARCHAR AS key FROM documents WHERE length(trim(text)) < 20 UNION ALL SELECT 'size', doc_id::VARCHAR FROM documents WHERE NOT n_chars BETWEEN 10 AND 50000 UNION ALL SELECT 'lang', doc_id::VARCHAR FROM documents WHERE NOT regexp_matches(lang, '^(en|de|fr)$')")
def p12_field_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"text": F.length(F.trim("text")) >= 20, "size": F.col("n_chars").between(10, 50000), "lang": F.col("lang").rlike("^(en|de|fr)$")}
    return st.violations(ad.table(spark, sf, "documents"), rules, "doc_id")


@query("p17_authorised_engines", "SELECT voice_id FROM voices WHERE engine IN ('Brand#1', 'Brand#5') AND NOT starts_with(style, 'PROMO')", "voices")
def p17_authorised_engines(spark: SparkSession, sf: str) -> DataFrame:
    allowed = spark.createDataFrame([("Brand#1",), ("Brand#5",)], "engine string")
    return ad.voices(spark, sf).join(F.broadcast(allowed), "engine", "left_semi").where(~F.col("style").startswith("PROMO")).select("voice_id")


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    return stories.w5_scene_grouping(spark, sf).join(ad.timeline(spark, sf), ["user_id", "ordinal"])


_SC = stories._PLAIN + ", placed AS (SELECT * FROM scenes JOIN timeline USING (user_id, ordinal))"


@query("j9_scene_links", _SC + " SELECT user_id, scene, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM placed GROUP BY 1, 2", "timeline")
def j9_scene_links(spark: SparkSession, sf: str) -> DataFrame:
    return _scenes(spark, sf).groupBy("user_id", "scene").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("j17_focus_scenes", _SC + " SELECT user_id, scene FROM placed GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase')", "timeline")
def j17_focus_scenes(spark: SparkSession, sf: str) -> DataFrame:
    seen = _scenes(spark, sf).groupBy("user_id", "scene").agg(F.collect_set("event_type").alias("k"))
    return seen.where(F.array_contains("k", "purchase")).select("user_id", "scene")


@query("j18_foreign_evidence", _SC + """, ev AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ordinal) AS evidence, scene FROM placed)
SELECT event_id, evidence FROM ev WHERE evidence IS NOT NULL AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.user_id = ev.user_id AND p.scene = ev.scene AND p.event_id = ev.evidence)""", "timeline")
def j18_foreign_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence (here the next event) that is not in its event's own scene."""
    placed = _scenes(spark, sf)
    cited = placed.select("user_id", "scene", "event_id", F.lead("event_id").over(W.partitionBy("user_id").orderBy("ordinal")).alias("evidence")).where("evidence is not null")
    known = placed.select("user_id", "scene", F.col("event_id").alias("evidence"))
    return cited.join(known, ["user_id", "scene", "evidence"], "left_anti").select("event_id", "evidence")


@query("g12_found_counts", "SELECT o_custkey, count(*) AS outputs, count(*) FILTER (o_totalprice > 100000) AS found, sum(1 + o_orderkey % 3)::BIGINT AS segments FROM orders GROUP BY 1")
def g12_found_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("outputs"), F.count_if(F.col("o_totalprice") > 100000).alias("found"), F.sum(1 + F.col("o_orderkey") % 3).alias("segments"))


@query("g17_mean_log_probability", "SELECT user_id, round(sum(ln(value + 1)) / greatest(count(*), 1), 4) AS mean FROM events GROUP BY 1")
def g17_mean_log_probability(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.ln(F.col("value") + 1)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("mean"))


@query("o5_ranked_voices", "SELECT engine, voice_id, row_number() OVER (PARTITION BY engine ORDER BY size, -price, voice_id) AS place FROM voices", "voices")
def o5_ranked_voices(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("engine").orderBy("size", F.desc("price"), "voice_id"))
    return ad.voices(spark, sf).select("engine", "voice_id", place.cast("long").alias("place"))


@query("o7_first_by_name", "SELECT engine, arg_min(voice_id, (lower(name), voice_id)) AS voice_id FROM voices GROUP BY 1", "voices")
def o7_first_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return ad.voices(spark, sf).groupBy("engine").agg(F.min_by("voice_id", F.struct(F.lower("name"), F.col("voice_id"))).alias("voice_id"))


@query("u4_forbidden_keys", "SELECT event_id FROM events WHERE list_has_any(json_keys(props), ['k'])")
def u4_forbidden_keys(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.arrays_overlap(F.json_object_keys("props"), F.array(F.lit("k")))
    return ad.table(spark, sf, "events").where(bad).select("event_id")


@query("f5_episode_ids", r"""SELECT p_partkey, CASE WHEN m = '' THEN 'EP' || lpad(p_partkey::VARCHAR, greatest(6, length(p_partkey::VARCHAR))::INT, '0') ELSE upper(regexp_replace(m, '[ ._-]+', '', 'g')) END AS episode FROM (
SELECT p_partkey, regexp_extract(p_name || replace(p_brand, 'Brand#', CASE WHEN p_type IN ('SMALL', 'PROMO') THEN '.part' ELSE '.s' END) || ' - e' || p_size || '.mkv', '(?i)(S\d{1,2}[ ._-]*E\d{1,3})', 1) AS m FROM part)""")
def f5_episode_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The season and episode in a file name, or a number of its own."""
    season = F.replace("p_brand", F.lit("Brand#"), F.when(F.col("p_type").isin("SMALL", "PROMO"), ".part").otherwise(".s"))
    name = F.concat("p_name", season, F.lit(" - e"), _s("p_size"), F.lit(".mkv"))
    mark = F.upper(F.regexp_replace(F.regexp_extract(name, r"(?i)(S\d{1,2}[ ._-]*E\d{1,3})", 1), r"[ ._-]+", ""))
    return ad.table(spark, sf, "part").select("p_partkey", F.when(mark != "", mark).otherwise(F.concat(F.lit("EP"), F.format_string("%06d", "p_partkey"))).alias("episode"))


@query("f8_publication_titles", r"""SELECT doc_id, t AS title, NOT regexp_matches(t, '[<>:"/\\|?*]') AND length(t) BETWEEN 1 AND 235 AND NOT upper(t) IN ('CON', 'NUL') AS ok FROM (
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), '. ') AS t FROM documents)""")
def f8_publication_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.btrim(F.regexp_replace("text", r"\s+", " "), F.lit(". "))
    ok = ~title.rlike(r'[<>:"/\\|?*]') & F.length(title).between(1, 235) & ~F.upper(title).isin("CON", "NUL")
    return ad.table(spark, sf, "documents").select("doc_id", title.alias("title"), ok.alias("ok"))


_RATES = r"""w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '\p{L}+') AS a FROM conversations),
p AS (SELECT conv_id, turn, a, coalesce(lead(a) OVER (PARTITION BY conv_id ORDER BY turn, text), []) AS b FROM w),
dp AS (SELECT conv_id, turn, a, b, 0 AS i, range(0, len(b) + 1) AS line FROM p  -- a row of the table of edit distances at a time
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: list_min(u[1:j + 1]) + j)
  FROM (SELECT *, list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(line[j + 1] + 1, line[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) END - j) AS u FROM dp WHERE i < len(a))),
rates AS (SELECT conv_id, turn, len(a) AS n, line[len(b) + 1]::BIGINT AS distance, round(line[len(b) + 1] / greatest(1, len(a))::DOUBLE, 4) AS wer FROM dp WHERE i = len(a))"""


@query("f14_word_error_rate", f"WITH RECURSIVE {_RATES} SELECT conv_id, turn, distance, wer FROM rates")
def f14_word_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Word edit distance between a turn and the one after it (none: no words), over the turn's length."""
    return _distances(spark, sf).select("conv_id", "turn", "distance", F.round(F.col("distance") / F.greatest(F.lit(1), "n"), 4).alias("wer"))


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    turns = ad.table(spark, sf, "conversations").select("conv_id", "turn", "text", words.alias("a"))
    after = F.lead("a").over(W.partitionBy("conv_id").orderBy("turn", "text"))
    pairs = turns.select("conv_id", "turn", "a", F.coalesce(after, F.slice("a", 1, 0)).alias("b"))
    return pairs.select("conv_id", "turn", T.word_distance("a", "b").alias("distance"), F.size("a").alias("n"))


@query("d4_intelligibility", f"""WITH RECURSIVE {_RATES} SELECT conv_id, wer, rank() OVER (PARTITION BY conv_id % 10 ORDER BY wer DESC) AS place, wer > 1.1 AS failed
FROM (SELECT conv_id, round(sum(distance) / greatest(1, sum(n))::DOUBLE, 4) AS wer FROM rates GROUP BY 1)""")
def d4_intelligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations by the word error rate over all their words, worst first within a batch of ten; above the limit they fail."""
    rates = _distances(spark, sf).groupBy("conv_id").agg(F.round(F.sum("distance") / F.greatest(F.lit(1), F.sum("n")), 4).alias("wer"))
    place = F.rank().over(W.partitionBy(F.col("conv_id") % 10).orderBy(F.desc("wer")))
    return rates.select("conv_id", "wer", place.cast("long").alias("place"), (F.col("wer") > 1.1).alias("failed"))


@query("f18_first_text", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), ''), '') AS first_text FROM documents")
def f18_first_text(spark: SparkSession, sf: str) -> DataFrame:
    first = lambda c: F.nullif(F.trim(c), F.lit(""))
    return ad.table(spark, sf, "documents").select("doc_id", F.coalesce(first(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))), first(F.col("source")), F.lit("")).alias("first_text"))


@query("h4_profile_hash", "SELECT DISTINCT lang, sha256('compression=0.2' || chr(0) || 'language=''' || lang || '''' || chr(0)) AS h FROM documents")
def h4_profile_hash(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "documents").select("lang", T.content_hash(F.lit("compression=0.2"), F.concat(F.lit("language='"), F.col("lang"), F.lit("'"))).alias("h")).distinct()


@query("h6_stage_hash", "SELECT source, sha256(string_agg(lang || ':' || h || chr(0), '' ORDER BY lang)) AS stage FROM (SELECT source, lang, sha256(min(doc_id)::VARCHAR) AS h FROM documents GROUP BY 1, 2) GROUP BY 1")
def h6_stage_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A stage's input hash: the sorted parent:digest parts, a NUL after each."""
    parents = ad.table(spark, sf, "documents").groupBy("source", "lang").agg(F.sha2(F.min("doc_id").cast("string").cast("binary"), 256).alias("h"))
    listed = F.array_sort(F.collect_list(F.struct("lang", "h")))
    return parents.groupBy("source").agg(F.sha2(F.array_join(F.transform(listed, lambda p: F.concat(p["lang"], F.lit(":"), p["h"], F.lit("\0"))), ""), 256).alias("stage"))


@query("v3_transcript_rules", """, m AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 = 3 THEN start_ms - 5000 ELSE start_ms END AS start_ms, end_ms FROM transcript),
o AS (SELECT *, lag(end_ms) OVER (PARTITION BY conv_id ORDER BY start_ms, turn) AS p FROM m)
SELECT 'ordered' AS rule, conv_id::VARCHAR AS key FROM o WHERE start_ms < p UNION ALL SELECT 'not_negative', conv_id::VARCHAR FROM o WHERE start_ms < 0 UNION ALL SELECT 'text', conv_id::VARCHAR FROM o WHERE length(text) < 10""", "transcript")
def v3_transcript_rules(spark: SparkSession, sf: str) -> DataFrame:
    moved = ad.transcript(spark, sf).withColumn("start_ms", F.when(F.col("turn") % 4 == 3, F.col("start_ms") - 5000).otherwise(F.col("start_ms")))
    before = F.lag("end_ms").over(W.partitionBy("conv_id").orderBy("start_ms", "turn"))
    rules = {"ordered": F.col("p").isNull() | (F.col("start_ms") >= F.col("p")), "not_negative": F.col("start_ms") >= 0, "text": F.length("text") >= 10}
    return st.violations(moved.withColumn("p", before), rules, "conv_id")


@query("v4_valid_payloads", "SELECT conv_id, bool_and(start_ms >= 0 AND end_ms > start_ms AND length(trim(text)) > 30) AS valid FROM transcript GROUP BY 1", "transcript")
def v4_valid_payloads(spark: SparkSession, sf: str) -> DataFrame:
    good = (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & (F.length(F.trim("text")) > 30)
    return ad.transcript(spark, sf).groupBy("conv_id").agg(F.bool_and(good).alias("valid"))


@query("v7_edge_rules", ", e AS (SELECT user_id, from_event_id, CASE WHEN from_event_id % 50 = 0 THEN from_event_id ELSE to_event_id END AS to_event_id, relation FROM edges) SELECT 'self_loop' AS rule, from_event_id::VARCHAR AS key FROM e WHERE from_event_id = to_event_id UNION ALL SELECT 'relation', from_event_id::VARCHAR FROM e WHERE relation = 'EFFECT'", "timeline", "edges")
def v7_edge_rules(spark: SparkSession, sf: str) -> DataFrame:
    e = ad.edges(ad.timeline(spark, sf)).withColumn("to_event_id", F.when(F.col("from_event_id") % 50 == 0, F.col("from_event_id")).otherwise(F.col("to_event_id")))
    return st.violations(e, {"self_loop": F.col("from_event_id") != F.col("to_event_id"), "relation": F.col("relation") != "EFFECT"}, "from_event_id")


@query("d6_audio_gate", """SELECT 'rms' AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE NOT sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding]) / len(embedding)) >= 0.126::DOUBLE
UNION ALL SELECT 'peak', vec_id::VARCHAR FROM embeddings WHERE NOT list_max([abs(x)::DOUBLE for x in embedding]) < 0.3::DOUBLE""")
def d6_audio_gate(spark: SparkSession, sf: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rules = {"rms": F.sqrt(square / F.size("embedding")) >= 0.126, "peak": F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double"))) < 0.3}
    return st.violations(ad.table(spark, sf, "embeddings"), rules, "vec_id")


@query("r6_result_identity", _SEGMENTS + " SELECT a.render_id, a.segment_id FROM seg a JOIN seg b ON a.render_id = b.render_id AND a.segment_id = 'A' AND b.segment_id = 'N' WHERE a.n_clips <> b.n_clips OR a.visual_ms <> b.visual_ms", "clips")
def r6_result_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _normal(spark, sf).select("render_id", "segment_id", F.size("clips").alias("n"), "visual_ms")
    a = rows.where("segment_id = 'A'").alias("a")
    b = rows.where("segment_id = 'N'").alias("b")
    return a.join(b, F.col("a.render_id") == F.col("b.render_id")).where("a.n <> b.n or a.visual_ms <> b.visual_ms").select("a.render_id", "a.segment_id")


@query("i3_invalidated_rows", "WITH RECURSIVE" + stories._HELD[1:] + """,
changed AS (SELECT DISTINCT 'nation ' || s_nationkey AS root FROM supplier WHERE s_acctbal < 0),
d AS (SELECT root AS node FROM changed UNION SELECT dst FROM d JOIN held ON src = node)
SELECT node, node IN (SELECT root FROM changed) AS changed FROM d""")
def i3_invalidated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to make again when nations change (those of a supplier in debt): their own and those of all
    that they hold, at any depth."""
    nation = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
    changed = ad.table(spark, sf, "supplier").where("s_acctbal < 0").select(nation.alias("root")).distinct()
    below = graph.closure(stories.held(spark, sf), changed).select("node", F.lit(False).alias("own"))
    return changed.select(F.col("root").alias("node"), F.lit(True).alias("own")).unionByName(below).groupBy("node").agg(F.bool_or("own").alias("changed"))


@query("c3_predecessor_artifacts", """WITH needs AS (SELECT DISTINCT l_partkey AS part, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT part, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS artifacts FROM needs JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def c3_predecessor_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """What came out of the steps that a part needs: the nations of the suppliers of its returned items, each once and in order."""
    needs = ad.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    made = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    return needs.join(made, "s_suppkey").groupBy("part").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("artifacts"))


@query("x2_source_drift", "SELECT c_custkey FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE sha256(c_nationkey::VARCHAR) <> sha256(s_nationkey::VARCHAR)")
def x2_source_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Sources (customers) whose content is not what was recorded for them (by the supplier of the same number)."""
    now = ad.table(spark, sf, "customer").select("c_custkey", F.sha2(F.col("c_nationkey").cast("string"), 256).alias("sha"))
    recorded = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("recorded"))
    return now.join(recorded, "c_custkey").where("sha <> recorded").select("c_custkey")


@query("x9_speech_segments", "SELECT event_id, CASE WHEN value > 1 THEN round_even((value + 0.0005::DOUBLE) * 1000, 0)::BIGINT END AS start_ms, round(least(1, greatest(0, exp(-value / 100))), 6) AS confidence FROM events")
def x9_speech_segments(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return ad.table(spark, sf, "events").select("event_id", F.when(v > 1, F.bround((v + 0.0005) * 1000).cast("long")).alias("start_ms"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-v / 100))), 6).alias("confidence"))


@query("x10_missing_files", "SELECT engine, need FROM (SELECT DISTINCT engine FROM voices), (VALUES (3), (17), (29), (44), (51)) n(need) WHERE NOT EXISTS (SELECT 1 FROM voices v WHERE v.engine = voices.engine AND size = need)".replace("(SELECT DISTINCT engine FROM voices)", "(SELECT DISTINCT engine FROM voices) voices"), "voices")
def x10_missing_files(spark: SparkSession, sf: str) -> DataFrame:
    v = ad.voices(spark, sf)
    wanted = v.select("engine").distinct().select("engine", F.explode(F.array(*[F.lit(n) for n in (3, 17, 29, 44, 51)])).alias("need"))
    return wanted.join(v.select("engine", F.col("size").alias("need")), ["engine", "need"], "left_anti")


@query("x11_pending_migrations", r"""WITH steps AS (SELECT p_partkey, CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END || '_' || replace(p_name, ' ', '_') || '.sql' AS name FROM part)
SELECT name FROM steps WHERE regexp_matches(name, '^\d{4}_[a-z0-9_]+\.sql$') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0)""")
def x11_pending_migrations(spark: SparkSession, sf: str) -> DataFrame:
    """Migrations by a valid name that are not among the applied ones."""
    steps = ad.table(spark, sf, "part").select("p_partkey", F.concat(F.format_string("%04d", "p_partkey"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".sql")).alias("name"))
    applied = ad.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_discount = 0").select(F.col("l_partkey").alias("p_partkey"))
    return steps.where(F.col("name").rlike(r"^(\d{4})_[a-z0-9_]+\.sql$")).join(applied, "p_partkey", "left_anti").select("name")


@query("x12_subtitle_cascade", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' WHEN doc_id IN (SELECT page_id FROM pages) THEN 'sidecar'
WHEN doc_id IN (SELECT conv_id FROM conversations WHERE role = 'user') THEN 'converted' WHEN n_chars > 500 THEN 'embedded' ELSE 'none' END AS subtitle FROM documents""")
def x12_subtitle_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first source of subtitles that a document has."""
    there = lambda table, key, name: ad.table(spark, sf, table).select(F.col(key).alias("doc_id")).distinct().withColumn(name, F.lit(name))
    user = ad.table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("converted", F.lit("converted"))
    docs = ad.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, "embedded").alias("embedded"))
    found = docs.join(there("labels", "doc_id", "cached"), "doc_id", "left").join(there("pages", "page_id", "sidecar"), "doc_id", "left").join(user, "doc_id", "left")
    return found.select("doc_id", F.coalesce("cached", "sidecar", "converted", "embedded", F.lit("none")).alias("subtitle"))


@query("x19_mode_change", """WITH has AS (SELECT l_orderkey, l_returnflag AS mode, count(*) AS n FROM lineitem GROUP BY 1, 2),
o AS (SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS selected, max(mode) AS old, max(n) FILTER (mode = 'R') AS wanted FROM orders LEFT JOIN has ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN selected AND wanted IS NOT NULL THEN 'R' ELSE old END AS mode, CASE WHEN selected THEN coalesce(wanted, 0) END AS n_clips, selected AND wanted IS NULL AS skipped FROM o""")
def x19_mode_change(spark: SparkSession, sf: str) -> DataFrame:
    """Selected orders take the mode R where their items have it, and tell how many; the others that are selected are skipped."""
    has = ad.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    counts = has.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("counts"))
    orders = ad.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("selected")).join(counts, "o_orderkey", "left")
    available = F.coalesce(F.map_contains_key("counts", F.lit("R")), F.lit(False))
    mode = F.when(F.col("selected") & available, "R").otherwise(F.array_max(F.map_keys("counts")))
    n = F.when(F.col("selected"), F.coalesce(F.try_element_at("counts", F.lit("R")), F.lit(0)))
    return orders.select("o_orderkey", mode.alias("mode"), n.alias("n_clips"), (F.col("selected") & ~available).alias("skipped"))
