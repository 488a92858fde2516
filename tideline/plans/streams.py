"""Queries that read the events as a stream, in micro-batches, and give what it has told once all is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.operators import staging
from tideline.plans import stories
from tideline.sources import adapters as ad
from tideline.streaming import timelines as tl

#: How late an event may be.
DELAY = "1 hour"
QUERIES: dict = {}
ORACLES: dict = {}


def _drained(spark: SparkSession, sf: str, name: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that operator tells of the events: read to their end, then closed and read on from the checkpoint."""
    root = staging.new_path(spark, name)
    closing, sink = f"{root}/closing", f"{root}/sink"
    spark.createDataFrame([], tl.EVENTS).write.parquet(closing)
    made = operator(tl.events(spark, f"{sf}/events.parquet", closing))
    for last in (False, True):
        if last:
            tl.close(spark, closing)
        tl.drain(made, sink, f"{root}/checkpoint")
    return spark.read.schema(made.schema).parquet(sink)


def w5_streamed_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, "scenes", lambda events: tl.scenes(events, stories.SCENE_MS, DELAY))


def w9_streamed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _drained(spark, sf, "chunks", lambda events: tl.chunks(events, "1 day", DELAY))


QUERIES["w5_streamed_scenes"] = w5_streamed_scenes
ORACLES["w5_streamed_scenes"] = f"WITH RECURSIVE {ad.SQL['timeline']}{stories._PLAIN} SELECT user_id, event_id, ordinal, scene, start_ms, end_ms FROM scenes JOIN timeline USING (user_id, ordinal)"
QUERIES["w9_streamed_chunks"] = w9_streamed_chunks
ORACLES["w9_streamed_chunks"] = """SELECT user_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS chunk_ms, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_excluded,
min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"""
