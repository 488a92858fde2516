"""Domain tables read from the driver's Parquet files: timelines, story edges, transcripts,
edit hierarchies, voice catalogs and artifacts. Each is plain DataFrame work, so filters
and column choices reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T

LAST_EVENT_MS, GAP_MS = 60_000, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as half-open ranges of milliseconds, one line for each user."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr("0").alias("_"), (F.floor(micros / F.lit(1000))).alias("start_ms"))
    line = W.partitionBy("user_id").orderBy("start_ms", "event_id")
    ranged = events.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(line), F.col("start_ms") + LAST_EVENT_MS)).where("end_ms > start_ms")
    return ranged.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "start_ms",
        "end_ms",
        (F.row_number().over(line) - 1).cast("long").alias("ordinal"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("importance"),
        (F.col("event_type") == "error").alias("excluded"),
    )


def edges(line: DataFrame) -> DataFrame:
    """An edge from every event to the next of its user, with a relation by kind of event."""
    after = F.lead("event_id").over(W.partitionBy("user_id").orderBy("start_ms", "event_id"))
    relation = (
        F.when(F.col("event_type") == "signup", "REVEAL")
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0), "CAUSE")
        .when(F.col("event_type") == "purchase", "EFFECT")
        .otherwise("REACTION")
    )
    return line.select("user_id", F.col("event_id").alias("from_event_id"), after.alias("to_event_id"), relation.alias("relation")).where("to_event_id is not null")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations laid one after another, with a gap between them."""
    words = T.unicode_words(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.greatest(F.lit(100).cast("long"), T.speech_ms(words, 145)).alias("dur"))
    before = F.sum(F.col("dur") + GAP_MS).over(W.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(W.unboundedPreceding, -1))
    placed = turns.withColumn("start_ms", F.coalesce(before, F.lit(0)).cast("long"))
    return placed.select("conv_id", "turn", "role", "text", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


#: Purposes that the adapter deals out to segments, in order of order key modulo 8 (fixed values).
PURPOSES = ["CAUSAL_ANALYSIS", "context", "RECAP", "Original Dialogue Evidence", "SUMMARY", "CRITIQUE", "ORIGINAL_CONCLUSION", ""]


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as source clips: order = output, return flag = segment, line = clip."""
    line = table(spark, sf_dir, "lineitem")
    pick = F.element_at(F.array(*[F.lit(p) for p in PURPOSES]), ((F.col("l_orderkey") + F.ascii("l_returnflag")) % 8 + 1).cast("int"))
    start = (F.col("l_partkey") * 10).cast("double")
    return line.select(
        F.col("l_orderkey").alias("render_id"),
        F.col("l_returnflag").alias("segment_id"),
        F.when(F.col("l_returnflag") == "R", "original_dialogue").otherwise("narration").alias("segment_type"),
        pick.alias("purpose"),
        F.col("l_linenumber").alias("clip_order"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        start.alias("start_ms"),
        (start + F.col("l_quantity") * 100 - 300).alias("end_ms"),
        (F.lit(0.8) + (F.col("l_orderkey") % 8) * 0.05).alias("speed"),
    )


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("voice_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("engine"), F.col("p_type").alias("style"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


#: The adapters as DuckDB CTEs, for oracles.
SQL = {
    "timeline": """
tl0 AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS start_ms FROM events),
tl1 AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), start_ms + 60000) AS end_ms FROM tl0),
timeline AS (SELECT event_id, user_id, event_type, value, start_ms, end_ms,
    row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - 1 AS ordinal,
    least(1.0::DOUBLE, value / 100) AS importance, event_type = 'error' AS excluded FROM tl1 WHERE end_ms > start_ms)""",
    "edges": """
edges AS (SELECT * FROM (SELECT user_id, event_id AS from_event_id,
    lead(event_id) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS to_event_id,
    CASE WHEN event_type = 'signup' THEN 'REVEAL' WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'CAUSE'
         WHEN event_type = 'purchase' THEN 'EFFECT' ELSE 'REACTION' END AS relation FROM timeline) WHERE to_event_id IS NOT NULL)""",
    "transcript": r"""
tr0 AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS n FROM conversations),
tr1 AS (SELECT *, greatest(100, CASE WHEN n > 0 THEN (floor((n * 60000 / 145.0::DOUBLE + 99) / 100) * 100)::BIGINT ELSE 0 END) AS dur FROM tr0),
tr2 AS (SELECT *, coalesce(sum(dur + 300) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM tr1),
transcript AS (SELECT conv_id, turn, role, text, start_ms, start_ms + dur AS end_ms FROM tr2)""",
    "clips": """
clips AS (SELECT l_orderkey AS render_id, l_returnflag AS segment_id,
    CASE WHEN l_returnflag = 'R' THEN 'original_dialogue' ELSE 'narration' END AS segment_type,
    (['CAUSAL_ANALYSIS', 'context', 'RECAP', 'Original Dialogue Evidence', 'SUMMARY', 'CRITIQUE', 'ORIGINAL_CONCLUSION', ''])[(l_orderkey + ascii(l_returnflag)) % 8 + 1] AS purpose,
    l_linenumber AS clip_order, l_partkey, l_suppkey, l_extendedprice,
    (l_partkey * 10)::DOUBLE AS start_ms, (l_partkey * 10)::DOUBLE + l_quantity * 100 - 300 AS end_ms,
    0.8::DOUBLE + (l_orderkey % 8) * 0.05::DOUBLE AS speed FROM lineitem)""",
    "voices": "voices AS (SELECT p_partkey AS voice_id, p_name AS name, p_brand AS engine, p_type AS style, p_size AS size, p_retailprice AS price FROM part)",
}
