"""Queries over transcripts: word counts, captions, SRT, chunks and text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import captions as cp
from tideline.operators import scan
from tideline.operators import intervals as iv
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


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "conversations")


@query("f2_word_count", r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS n FROM conversations")
def f2_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", T.word_count("text").alias("n"))


@query("f3_speech_estimate", "SELECT conv_id, turn, start_ms, end_ms FROM transcript", "transcript")
def f3_speech_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return ad.transcript(spark, sf).select("conv_id", "turn", "start_ms", "end_ms")


@query("j3_transcript_chunks", """,
lines AS (SELECT *, printf('[%.1f] ', start_ms / 1000.0::DOUBLE) || text AS line FROM transcript),
span AS (SELECT conv_id, max(end_ms) / 1000.0::DOUBLE AS dur FROM transcript GROUP BY 1),
chunks AS (SELECT conv_id, i::INTEGER AS chunk, (i * 60)::DOUBLE AS s, least(dur, (i + 1) * 60.0::DOUBLE) AS e FROM span, unnest(range(0, ceil(dur / 60)::BIGINT)) t(i))
SELECT conv_id, chunk, left(string_agg(text, chr(10) ORDER BY turn, text), 16000) AS body FROM chunks JOIN transcript USING (conv_id)
WHERE end_ms / 1000.0::DOUBLE >= s AND start_ms / 1000.0::DOUBLE <= e GROUP BY 1, 2""", "transcript")
def j3_transcript_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Closed bounds: a turn that touches a chunk's edge is in both chunks. A turn names its chunks itself, so nothing is joined."""
    seconds = lambda c: F.col(c) / F.lit(1000.0)
    said = ad.transcript(spark, sf).withColumn("dur", F.max(seconds("end_ms")).over(W.partitionBy("conv_id")))
    first, last = F.greatest(F.lit(0), F.ceil(seconds("start_ms") / 60) - 1), F.least(F.floor(seconds("end_ms") / 60), F.ceil(F.col("dur") / 60) - 1)
    joined = said.withColumn("chunk", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return joined.groupBy("conv_id", "chunk").agg(F.substring(F.array_join(F.transform(listed, lambda t: t["text"]), "\n"), 1, 16000).alias("body"))


#: Phrases as DuckDB SQL from rows in(id, text, s, e): words, a fold over them that closes groups,
#: what a short last group takes, and the times that the phrases get.
_PHRASES = r""",
ws AS (SELECT id, s, e, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS w FROM rows_in),
wd AS (SELECT id, i, w[i] AS word, regexp_matches(w[i], '[,;:.!?]["'')\]]*$') AS b FROM ws, unnest(range(1, len(w) + 1)) t(i)),
fold AS (SELECT id, i, word, 0 AS g, 1 AS n, false AS shut FROM wd WHERE i = 1 UNION ALL
  SELECT d.id, d.i, d.word, f.g + f.shut::INT, CASE WHEN f.shut THEN 1 ELSE f.n + 1 END,
    (CASE WHEN f.shut THEN 1 ELSE f.n + 1 END) >= 7 OR ((CASE WHEN f.shut THEN 1 ELSE f.n + 1 END) >= 3 AND d.b) FROM fold f JOIN wd d ON d.id = f.id AND d.i = f.i + 1),
sz AS (SELECT id, g, count(*) AS k FROM fold GROUP BY 1, 2),
ends AS (SELECT a.id, a.g AS lg, a.k AS lk, p.k AS pk, least(3 - a.k, greatest(0, p.k - 3)) AS t FROM sz a JOIN sz p ON p.id = a.id AND p.g = a.g - 1 WHERE a.g = (SELECT max(g) FROM sz z WHERE z.id = a.id) AND a.k < 3),
moved AS (SELECT f.id, f.i, f.word, CASE WHEN x.id IS NULL THEN f.g WHEN lk + t < 3 AND pk + lk <= 7 AND f.g = lg THEN lg - 1 WHEN NOT (lk + t < 3 AND pk + lk <= 7) AND f.g = lg - 1 AND f.n > pk - t THEN lg ELSE f.g END AS g FROM fold f LEFT JOIN ends x ON x.id = f.id),
ph AS (SELECT id, g, string_agg(word, ' ' ORDER BY i) AS phrase FROM moved GROUP BY 1, 2),
wt AS (SELECT *, greatest(1, len(regexp_extract_all(phrase, '[\p{L}\p{N}_''][\p{L}\p{N}_'']*'))) + CASE WHEN regexp_matches(phrase, '[.!?]["'')\]]*$') THEN 0.65::DOUBLE WHEN regexp_matches(phrase, '[,;:]["'')\]]*$') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM ph),
sh AS (SELECT wt.*, s, e, sum(weight) OVER (PARTITION BY id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(weight) OVER (PARTITION BY id) AS share, max(g) OVER (PARTITION BY id) AS top FROM wt JOIN ws USING (id)),
en AS (SELECT *, CASE WHEN g = top THEN e ELSE s + (e - s) * share END AS cue_end FROM sh),
cues AS (SELECT id, g AS cue, coalesce(lag(cue_end) OVER (PARTITION BY id ORDER BY g), s) AS cue_start, cue_end, phrase FROM en)
"""
_TURNS_IN = ", rows_in AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, text, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM transcript)"


@query("f12_caption_phrases", _TURNS_IN + _PHRASES + "SELECT conv_id, turn, cue::INTEGER AS pos, phrase FROM cues JOIN rows_in USING (id)", "transcript")
def f12_caption_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(T.caption_phrases("text")).alias("pos", "words")).select("conv_id", "turn", "pos", F.array_join("words", " ").alias("phrase"))


@query("w7_timed_captions", _TURNS_IN + _PHRASES + "SELECT conv_id, turn, cue::INTEGER AS cue, round(cue_start, 3) AS cue_start, round(cue_end, 3) AS cue_end, phrase FROM cues JOIN rows_in USING (id) WHERE e > s", "transcript")
def w7_timed_captions(spark: SparkSession, sf: str) -> DataFrame:
    said = ad.transcript(spark, sf).select("conv_id", "turn", "text", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    cues = cp.timed_phrases(said, ["conv_id", "turn"], "text", "start_s", "end_s")
    return cues.select("conv_id", "turn", "cue", F.round("cue_start", 3).alias("cue_start"), F.round("cue_end", 3).alias("cue_end"), "phrase")


_TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("f15_time_format", f"SELECT conv_id, turn, {_TIME.format('start_ms')} AS mark FROM transcript", "transcript")
def f15_time_format(spark: SparkSession, sf: str) -> DataFrame:
    return ad.transcript(spark, sf).select("conv_id", "turn", T.srt_time("start_ms").alias("mark"))


@query("f16_time_parse", "SELECT conv_id, turn, round(start_ms / 1000.0::DOUBLE, 3) AS seconds FROM transcript", "transcript")
def f16_time_parse(spark: SparkSession, sf: str) -> DataFrame:
    return ad.transcript(spark, sf).select("conv_id", "turn", F.round(T.srt_seconds(T.srt_time("start_ms")), 3).alias("seconds"))


@query("k8_srt_documents", f""",
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, regexp_replace(trim(text), '\\s+', ' ', 'g') AS t FROM transcript)
SELECT conv_id, string_agg(i || chr(10) || {_TIME.format('start_ms')} || ' --> ' || {_TIME.format('end_ms')} || chr(10) || t || chr(10), chr(10) ORDER BY i) AS srt FROM n GROUP BY 1""", "transcript")
def k8_srt_documents(spark: SparkSession, sf: str) -> DataFrame:
    said = ad.transcript(spark, sf).withColumn("flat", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return cp.srt_document(said, ["conv_id"], ["turn", "text"], "start_ms", "end_ms", "flat")


@query("s7_srt_round_trip", """,
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM transcript)
SELECT conv_id, pos::INTEGER AS pos, round(start_ms / 1000.0::DOUBLE, 3) AS start_s, round(end_ms / 1000.0::DOUBLE, 3) AS end_s, t AS text FROM n WHERE t <> ''""", "transcript")
def s7_srt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Cues parsed back from the SRT documents written from the transcript."""
    cues = cp.parsed_cues(k8_srt_documents(spark, sf), ["conv_id"], "srt")
    return cues.select("conv_id", "pos", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "text")


@query("w6_running_offsets", "SELECT conv_id, turn, (coalesce(sum(end_ms - start_ms) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset_ms FROM transcript", "transcript")
def w6_running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    placed = scan.running(ad.transcript(spark, sf), "conv_id", ["turn", "text"], {"offset_ms": F.col("end_ms") - F.col("start_ms")})
    return placed.select("conv_id", "turn", F.col("offset_ms").cast("long").alias("offset_ms"))


_CUT = """,
cut AS (SELECT conv_id, i AS clip, i * 20000 + 5000 AS cs, i * 20000 + 15000 AS ce FROM (SELECT conv_id, max(end_ms) AS m FROM transcript GROUP BY 1), unnest(range(0, m // 20000 + 1)) t(i)),
off AS (SELECT *, clip * 10000 AS place FROM cut)"""


@query("j5_midpoint_cues", _CUT + """
SELECT conv_id, clip, turn, place + greatest(cs, start_ms) - cs AS cue_start, place + least(ce, end_ms) - cs AS cue_end FROM off JOIN transcript USING (conv_id)
WHERE (start_ms + end_ms) / 2.0::DOUBLE BETWEEN cs AND ce AND least(ce, end_ms) > greatest(cs, start_ms)""", "transcript")
def j5_midpoint_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose midpoint is in a clip, clamped to it and moved to the clip's place."""
    said = ad.transcript(spark, sf)
    clips = said.groupBy("conv_id").agg(F.max("end_ms").alias("m")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 20000))).alias("clip"))
    clips = clips.select("conv_id", "clip", (F.col("clip") * 20000 + 5000).alias("start_ms"), (F.col("clip") * 20000 + 15000).alias("end_ms"))
    middle = (F.col("r.start_ms") + F.col("r.end_ms")) / 2.0
    found = iv.overlap_join(clips, said.select("conv_id", "turn", "start_ms", "end_ms"), "conv_id", 20000).where((middle >= F.col("l.start_ms")) & (middle <= F.col("l.end_ms")))
    at = F.col("l.clip") * 10000 - F.col("l.start_ms")
    return found.select("conv_id", "l.clip", "r.turn", (at + F.greatest("l.start_ms", "r.start_ms")).alias("cue_start"), (at + F.least("l.end_ms", "r.end_ms")).alias("cue_end"))


@query("u1_merged_cues", """
SELECT conv_id, track, start_ms, end_ms, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, end_ms, track, turn) AS pos FROM (
SELECT conv_id, turn, 0 AS track, start_ms, end_ms FROM transcript WHERE role = 'user' UNION ALL SELECT conv_id, turn, 1, start_ms // 2, end_ms // 2 FROM transcript WHERE role <> 'user')""", "transcript")
def u1_merged_cues(spark: SparkSession, sf: str) -> DataFrame:
    said = ad.transcript(spark, sf)
    half = lambda c: F.floor(F.col(c) / 2).alias(c)
    both = said.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("track"), "start_ms", "end_ms").unionByName(
        said.where("role <> 'user'").select("conv_id", "turn", F.lit(1).alias("track"), half("start_ms"), half("end_ms"))
    )
    order = W.partitionBy("conv_id").orderBy("start_ms", "end_ms", "track", "turn")
    return both.select("conv_id", "track", "start_ms", "end_ms", F.row_number().over(order).cast("long").alias("pos"))


_LABELS = """,
lab AS (SELECT conv_id, turn, text, CASE turn % 5 WHEN 0 THEN '  ' || upper(role) || ' ' WHEN 1 THEN role || '  one' WHEN 2 THEN 'Speaker_' || turn WHEN 3 THEN 'UNKNOWN' ELSE initcap_role END AS name
    FROM (SELECT *, upper(left(role, 1)) || substr(role, 2) AS initcap_role FROM transcript)),
keyed AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key FROM lab),
known AS (SELECT *, key = '' OR key = 'unknown' OR regexp_matches(key, '^speaker[_\\- ]?\\d+$') AS unknown FROM keyed)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    role = F.col("role")
    name = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("  "), F.upper(role), F.lit(" ")))
        .when(F.col("turn") % 5 == 1, F.concat(role, F.lit("  one")))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit("Speaker_"), F.col("turn").cast("string")))
        .when(F.col("turn") % 5 == 3, "UNKNOWN")
        .otherwise(F.concat(F.upper(F.substring(role, 1, 1)), F.expr("substr(role, 2)")))
    )
    return ad.transcript(spark, sf).select("conv_id", "turn", "text", name.alias("name")).withColumn("key", T.canonical_key("name")).withColumn("unknown", T.is_unknown_label("name"))


@query("f1_canonical_keys", _LABELS + " SELECT conv_id, turn, key, unknown FROM known", "transcript")
def f1_canonical_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("conv_id", "turn", "key", "unknown")


@query("c1_characters", _LABELS + """,
firsts AS (SELECT conv_id, key, arg_min(regexp_replace(trim(name), '\\s+', ' ', 'g'), turn) AS canonical_name, min(turn) AS first_turn FROM known WHERE NOT unknown GROUP BY 1, 2)
SELECT conv_id, 0 AS character_no, 'UNKNOWN' AS canonical_name FROM (SELECT DISTINCT conv_id FROM known)
UNION ALL SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY first_turn, key), canonical_name FROM firsts""", "transcript")
def c1_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each conversation: exactly one unknown, the rest numbered by first appearance under the first name seen."""
    names = _labels(spark, sf)
    firsts = names.where("not unknown").groupBy("conv_id", "key").agg(F.min_by(F.trim(F.regexp_replace("name", r"\s+", " ")), "turn").alias("canonical_name"), F.min("turn").alias("first_turn"))
    known = firsts.select("conv_id", F.dense_rank().over(W.partitionBy("conv_id").orderBy("first_turn", "key")).cast("long").alias("character_no"), "canonical_name")
    return names.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("character_no"), F.lit("UNKNOWN").alias("canonical_name")).unionByName(known)


@query("j8_participant_default", _LABELS + """
SELECT k.conv_id, k.turn, coalesce(f.first_turn, -1) AS character_turn FROM known k LEFT JOIN (SELECT conv_id, key, min(turn) AS first_turn FROM known WHERE NOT unknown GROUP BY 1, 2) f ON f.conv_id = k.conv_id AND f.key = k.key""", "transcript")
def j8_participant_default(spark: SparkSession, sf: str) -> DataFrame:
    names = _labels(spark, sf)
    known = names.where("not unknown").groupBy("conv_id", "key").agg(F.min("turn").alias("first_turn"))
    return names.join(known, ["conv_id", "key"], "left").select("conv_id", "turn", F.coalesce("first_turn", F.lit(-1)).alias("character_turn"))


@query("g8_ordered_distinct", _LABELS + " SELECT conv_id, string_agg(key, '|' ORDER BY t) AS keys FROM (SELECT conv_id, key, min(turn) AS t FROM known GROUP BY 1, 2) GROUP BY 1", "transcript")
def g8_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("turn", "key")))
    return _labels(spark, sf).groupBy("conv_id").agg(F.array_join(F.array_distinct(F.transform(listed, lambda s: s["key"])), "|").alias("keys"))


@query("f4_safe_ids", r"""SELECT conv_id, turn, CASE WHEN c = '' THEN 'episode' ELSE c END AS safe_id FROM (
SELECT conv_id, turn, trim(regexp_replace(trim(text), '[^A-Za-z0-9._-]+', '-', 'g'), '-._') AS c FROM conversations)""")
def f4_safe_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", T.safe_id("text").alias("safe_id"))


@query("f13_letter_words", r"SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ') AS words FROM conversations")
def f13_letter_words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(words, " ").alias("words"))


@query("f11_speech_text", r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\bMr\.', 'Mister', 'g') || ' season ' || (turn % 20) || ', episode ' || turn AS spoken FROM conversations""")
def f11_speech_text(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.concat(F.lit("  S"), F.lpad((F.col("turn") % 20).cast("string"), 2, "0"), F.lit("E"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    return _turns(spark, sf).select("conv_id", "turn", T.speech_text(F.concat(F.col("text"), mark), "en-US").alias("spoken"))


@query("r4_needs_transcript", "SELECT conv_id, bool_or(role = 'assistant' AND length(text) > 500) AS needed FROM conversations GROUP BY 1")
def r4_needs_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & (F.length("text") > 500)).alias("needed"))


@query("a8_clamped_words", """,
w AS (SELECT conv_id, turn, i, start_ms + (i - 1) * 300 AS s, start_ms + i * 300 AS e, end_ms - 700 AS lim FROM transcript, unnest(range(1, 1 + len(string_split(text, ' ')))) t(i))
SELECT conv_id, turn, count(*) AS n_words, max(least(e, lim)) AS last_ms FROM w WHERE s < lim GROUP BY 1, 2""", "transcript")
def a8_clamped_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that start before a limit, their ends clamped to it."""
    said = ad.transcript(spark, sf).withColumn("lim", F.col("end_ms") - 700).withColumn("w", F.split("text", " "))
    timed = F.transform("w", lambda w, i: F.struct((F.col("start_ms") + i * 300).alias("s"), (F.col("start_ms") + (i + 1) * 300).alias("e")))
    kept = F.filter(timed, lambda x: x["s"] < F.col("lim"))
    return said.withColumn("kept", kept).where("size(kept) > 0").select("conv_id", "turn", F.size("kept").cast("long").alias("n_words"), F.array_max(F.transform("kept", lambda x: F.least(x["e"], F.col("lim")))).alias("last_ms"))


_OFF = ", off AS (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM transcript)"
_SPAN = "place / 1000.0::DOUBLE AS s, (place + end_ms - start_ms) / 1000.0::DOUBLE AS e"
_MS = "SELECT conv_id, turn, cue::INTEGER AS cue, round(cue_start * 1000)::BIGINT AS start_ms, round(cue_end * 1000)::BIGINT AS end_ms, phrase FROM cues JOIN rows_in USING (id) WHERE e > s"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as segments of an output, one after another: at (its place), and how long."""
    at = cp.running_offset(F.col("end_ms") - F.col("start_ms"), ["conv_id"], ["turn", "text"]).cast("long")
    return ad.transcript(spark, sf).withColumn("at", at).withColumn("length", F.col("end_ms") - F.col("start_ms"))


def _cues(rows: DataFrame, keys: list[str], begin, length) -> DataFrame:
    """Timed phrases of rows, in whole milliseconds."""
    timed = cp.timed_phrases(rows.withColumns({"s": begin / 1000, "e": (begin + length) / 1000}), keys, "text", "s", "e")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return timed.select(*keys, "cue", ms("cue_start").alias("start_ms"), ms("cue_end").alias("end_ms"), "phrase")


@query("r2_narration_cues", _OFF + f", rows_in AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, text, {_SPAN} FROM off WHERE role = 'assistant')" + _PHRASES + _MS, "transcript")
def r2_narration_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of the narrated segments, each over its own stretch of the output."""
    return _cues(_placed(spark, sf).where("role = 'assistant'"), ["conv_id", "turn"], F.col("at"), F.col("length"))


_DIALOGUE = _OFF + f""", hit AS (SELECT o.conv_id, o.turn, t.text, o.place + greatest(o.start_ms, t.start_ms) - o.start_ms AS s, o.place + least(o.end_ms, t.end_ms) - o.start_ms AS e, t.turn AS said
  FROM off o JOIN transcript t ON t.conv_id = o.conv_id AND (t.start_ms + t.end_ms) / 2.0::DOUBLE BETWEEN o.start_ms AND o.end_ms AND least(o.end_ms, t.end_ms) > greatest(o.start_ms, t.start_ms) WHERE o.role = 'user' AND length(o.text) >= 200),
rows_in AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, text, {_SPAN} FROM off WHERE role = 'user' AND length(text) < 200
  UNION ALL SELECT conv_id || ':' || turn || '/' || said, conv_id, turn, text, s / 1000.0::DOUBLE, e / 1000.0::DOUBLE FROM hit)"""


@query("r3_dialogue_cues", _DIALOGUE + _PHRASES + _MS, "transcript")
def r3_dialogue_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of original dialogue: of the text that a segment brings along (short ones do),
    else of the turns whose midpoint is in its source range, clamped and moved to its place."""
    placed = _placed(spark, sf).where("role = 'user'")
    given = _cues(placed.where(F.length("text") < 200), ["conv_id", "turn"], F.col("at"), F.col("length"))
    said = ad.transcript(spark, sf).select("conv_id", F.col("turn").alias("said"), "text", "start_ms", "end_ms")
    middle = (F.col("r.start_ms") + F.col("r.end_ms")) / 2.0
    found = iv.overlap_join(placed.where(F.length("text") >= 200).select("conv_id", "turn", "at", "start_ms", "end_ms"), said, "conv_id", 20000)
    found = found.where((middle >= F.col("l.start_ms")) & (middle <= F.col("l.end_ms")))
    begin, end = F.greatest("l.start_ms", "r.start_ms"), F.least("l.end_ms", "r.end_ms")
    found = found.select("conv_id", "l.turn", "r.said", "r.text", (F.col("l.at") + begin - F.col("l.start_ms")).alias("at"), (end - begin).alias("length"))
    return given.unionByName(_cues(found, ["conv_id", "turn", "said"], F.col("at"), F.col("length")).drop("said"))


@query("r5_combined_cues", f"""{_OFF}, narr AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, text, {_SPAN} FROM off WHERE role = 'assistant'), {_DIALOGUE[len(_OFF) + 2:].replace("rows_in AS (", "dial AS (")},
rows_in AS (SELECT * FROM narr UNION ALL SELECT * FROM dial){_PHRASES}, ms AS ({_MS}),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, end_ms, turn, cue, phrase) AS i FROM ms)
SELECT conv_id, string_agg(i || chr(10) || {_TIME.format('start_ms')} || ' --> ' || {_TIME.format('end_ms')} || chr(10) || phrase || chr(10), chr(10) ORDER BY i) AS srt FROM n GROUP BY 1""", "transcript")
def r5_combined_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Narration and dialogue captions of an output in one SRT document."""
    both = r2_narration_cues(spark, sf).unionByName(r3_dialogue_cues(spark, sf))
    return cp.srt_document(both, ["conv_id"], ["start_ms", "end_ms", "turn", "cue", "phrase"], "start_ms", "end_ms", "phrase")
