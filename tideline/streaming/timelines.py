"""Timelines as streams: scenes and tumbling chunks of events that arrive in any order.

Events may be late by up to a watermark delay; later ones are dropped, as a stream must drop
them. What is told is final: a row is written once, when the watermark has passed all that
could change it. A line's last shot has no end before its next event, so it stays in the state
until the stream is closed: ``close`` puts a row at the end of time in a second source, whose
watermark ends every line. A stream that stops without it goes on from its checkpoint.

The state of a line is its events since the watermark and a few numbers, whatever its
length, and a micro-batch holds ``files`` files at most, so a hot line is bounded by both. Lines of
neighbouring user_ids share a group and its state, since a group costs far more than its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lines end here (2250-01-01 UTC, as pandas knows no time after 2262), and take no events from then
#: on; the row that closes a stream is a year later.
END_MS = 8_835_955_200_000
CLOSING_MS = END_MS + 365 * 86_400_000
#: What a shot lasts that nothing follows.
LAST_MS = 60_000
EVENTS = "event_id long, user_id long, start_ms long, excluded boolean"
SCENES = "user_id long, event_id long, ordinal long, scene long, start_ms long, end_ms long"
#: Lines of 2 ** LINE_BITS consecutive user_ids are one group; so groups grow in number with the users, not in size.
LINE_BITS = 6
#: A group's events not told yet, and of each of its lines what was told: shots, scenes, the scene's first
#: millisecond, and whether the last shot was excluded (packed).
_STATE = "pending binary, lines binary"
_PENDING = np.dtype([("user_id", "<i8"), ("start_ms", "<i8"), ("event_id", "<i8"), ("excluded", "?")])
_LINES = np.dtype([("user_id", "<i8"), ("shots", "<i8"), ("scenes", "<i8"), ("first_ms", "<i8"), ("after_excluded", "?")])


def events(spark: SparkSession, path: str, closing: str, files: int | None = None) -> DataFrame:
    """The stream of a Parquet path's events and of the rows that close it. files: the most
    that a micro-batch takes (none: all there is). Events without a time are left out."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    read = (source if files is None else source.option("maxFilesPerTrigger", files)).parquet(f"{path[:-1]}[{path[-1]}]")  # Spark streams a lone file by a pattern only
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1000))
    told = read.select("event_id", "user_id", ms.alias("start_ms"), (F.col("event_type") == "error").alias("excluded"))
    ends = spark.readStream.schema(EVENTS).parquet(closing)
    return told.where(F.col("start_ms") < END_MS).unionByName(ends).withColumn("at", F.timestamp_millis("start_ms"))


def close(spark: SparkSession, closing: str) -> None:
    """Ends every line of a stream that reads closing, once all of its events are read."""
    spark.createDataFrame([(None, None, CLOSING_MS, False)], EVENTS).coalesce(1).write.mode("append").parquet(closing)


def scenes(stream: DataFrame, max_scene_ms: int, delay: str) -> DataFrame:
    """Each shot's scene, by the rules of intervals.scenes: shots last until the line's next event
    (of several in one millisecond the last counts); excluded shots are scenes of their own;
    no scene of several shots is longer than max_scene_ms."""
    lines = stream.withColumn("_lines", F.shiftright("user_id", LINE_BITS)).withWatermark("at", delay).groupBy("_lines")
    return lines.applyInPandasWithState(_told(max_scene_ms), SCENES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _told(max_scene_ms: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, lines = state.get if state.exists else (b"", b"")
        at_line = {x[0]: x[1:] for x in np.frombuffer(lines, _LINES).tolist()}
        parts = [np.frombuffer(told, _PENDING)]
        if not state.hasTimedOut:
            for batch in batches:
                batch = batch[batch["start_ms"] < END_MS]
                part = np.empty(len(batch), _PENDING)
                for name in _PENDING.names:
                    part[name] = batch[name].fillna(0).to_numpy()
                parts.append(part)
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["event_id"], rows["start_ms"], rows["user_id"]))]
        user, begin, excluded = rows["user_id"], rows["start_ms"], rows["excluded"]
        follows = np.append(user[1:] == user[:-1], False)[: len(rows)]  # the next row is of the same line
        end = np.where(follows, np.append(begin[1:], 0)[: len(rows)], begin + LAST_MS)
        # a shot is final when the event after it is; the last such event waits for its end
        final = np.ones(len(rows), bool) if state.hasTimedOut else follows & (end <= state.getCurrentWatermarkMs())
        lasts = np.flatnonzero(final & (end > begin))
        ordinals, numbers = [], []
        for who, from_ms, to_ms, out in zip(*(x[lasts].tolist() for x in (user, begin, end, excluded)), strict=True):
            shots, scene, first, after = at_line.get(who, _NEW)
            if after or out or to_ms - first > max_scene_ms:
                scene, first = scene + 1, from_ms
            ordinals.append(shots)
            numbers.append(scene - 1)
            at_line[who] = shots + 1, scene, first, out
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((rows[~final].tobytes(), np.array([(who, *x) for who, x in at_line.items()], _LINES).tobytes()))
            state.setTimeoutTimestamp(END_MS)
        made = {"user_id": pd.array([None] * len(lasts) if pd.isna(key[0]) else user[lasts], "Int64"), "event_id": rows["event_id"][lasts]}
        yield pd.DataFrame({**made, "ordinal": np.array(ordinals, np.int64), "scene": np.array(numbers, np.int64), "start_ms": begin[lasts], "end_ms": end[lasts]})

    return run


#: A line before its first shot.
_NEW = (0, 0, 0, True)


def chunks(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling chunks of each line: user_id, chunk_ms (where it begins), n, n_excluded, first_ms,
    last_ms. A chunk is told once the watermark has passed its end."""
    rows = stream.withWatermark("at", delay).groupBy("user_id", F.window("at", width).alias("_w"))
    made = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("n_excluded"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    return made.select("user_id", F.unix_millis("_w.start").alias("chunk_ms"), "n", "n_excluded", "first_ms", "last_ms").where(F.col("first_ms") < END_MS)


def drain(made: DataFrame, sink: str, checkpoint: str) -> None:
    """Reads all there is, in as many micro-batches as it takes, into a Parquet sink that has
    every row once, also when a run is broken off and started again."""
    made.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start().awaitTermination()
