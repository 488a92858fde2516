"""Nested edit documents: build them from rows, normalise them with array functions, take them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T

DOCUMENT = "render_id bigint, segments array<struct<segment_id:string,segment_type:string,purpose:string,speed:double,clips:array<struct<start_ms:double,end_ms:double>>>>"


def documents(clips: DataFrame, order: list[str]) -> DataFrame:
    """One row for each output, its segments and their clips nested in order."""
    keys = ["render_id", "segment_id", "segment_type", "purpose", "speed"]
    inner = clips.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "start_ms", "end_ms"))).alias("_c"))
    inner = inner.withColumn("clips", F.transform("_c", lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms")))).drop("_c")
    return inner.groupBy("render_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "segment_type", "purpose", "speed", "clips"))).alias("segments"))


def to_text(docs: DataFrame) -> DataFrame:
    return docs.select("render_id", F.to_json(F.struct("render_id", "segments")).alias("json"))


def from_text(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("json", DOCUMENT).alias("d")).select("d.render_id", "d.segments")


def normalised(docs: DataFrame, words_of) -> DataFrame:
    """Each segment gets its visual time, planned voice time and speed, and the audio policy
    that its type forces; dialogue keeps its own sound at its own speed."""

    def each(s):
        visual = F.bround(F.aggregate(s["clips"], F.lit(0.0), lambda a, c: a + F.greatest(F.lit(0.0), c["end_ms"] - c["start_ms"]))).cast("long")
        told = s["segment_type"] == "narration"
        voice = F.when(told, T.speech_ms(words_of(s), 140)).otherwise(F.lit(0).cast("long"))
        speed = F.when(told & (voice > 0), F.round(visual / voice, 4)).otherwise(F.lit(1.0))
        return F.struct(
            s["segment_id"].alias("segment_id"),
            s["segment_type"].alias("segment_type"),
            T.normal_purpose(s["purpose"]).alias("purpose"),
            visual.alias("visual_ms"),
            voice.alias("voice_ms"),
            speed.alias("speed"),
            F.when(told, "mute").otherwise("preserve").alias("audio"),
            told.alias("subtitle"),
            s["clips"].alias("clips"),
        )

    return docs.withColumn("segments", F.transform("segments", each))


def segment_rows(docs: DataFrame) -> DataFrame:
    return docs.select("render_id", F.posexplode("segments").alias("position", "s")).select("render_id", "position", "s.*")


def clip_rows(docs: DataFrame) -> DataFrame:
    return segment_rows(docs).select("render_id", "segment_id", F.posexplode("clips").alias("clip", "c")).select("render_id", "segment_id", "clip", "c.start_ms", "c.end_ms")
