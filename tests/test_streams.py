"""Streams against the batch operators: events out of order, stops between micro-batches, late rows, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals as iv
from tideline.sources import adapters as ad
from tideline.streaming import timelines as tl

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BASE_MS = 1_704_067_200_000


def write(spark, rows, path):
    """rows (event_id, ms, user_id, event_type) added to an events table, as one file."""
    made = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string")
    ntz = F.expr("timestampadd(MICROSECOND, ms * 1000, timestamp_ntz'1970-01-01 00:00:00')")
    made.select("event_id", ntz.alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(path)


class Line:
    """One stream with its folders."""

    def __init__(self, spark, root, operator, files=1):
        self.spark, self.operator, self.files = spark, operator, files
        self.path, self.closing, self.sink, self.checkpoint = (f"{root}/{x}" for x in ("events.parquet", "closing", "sink", "checkpoint"))
        spark.createDataFrame([], tl.EVENTS).write.parquet(self.closing)
        self.root = str(root)

    def read_on(self):
        tl.drain(self.operator(tl.events(self.spark, self.path, self.closing, self.files)), self.sink, self.checkpoint)
        return sorted(map(tuple, self.spark.read.parquet(self.sink).collect()), key=str)

    def end(self):
        tl.close(self.spark, self.closing)
        return self.read_on()


def some_events(n=900, users=7, seed=1):
    """Many ties, some users who are null, one user with a third of all rows."""
    rng = random.Random(seed)
    who = lambda: 0 if rng.random() < 0.33 else rng.choice([None, *range(1, users)])
    return [(i, BASE_MS + 2_000 * i // 3, who(), rng.choice(["view", "click", "error", "buy"])) for i in range(n)]


@pytest.mark.parametrize("most", [5_000, 60_000])
def test_scenes_are_those_of_the_batch(spark, tmp_path, most):
    line = Line(spark, tmp_path, lambda e: tl.scenes(e, most, "60 seconds"))
    rows = some_events()
    rng = random.Random(2)
    for at in range(0, len(rows), 300):  # three files; inside and across them rows are up to 40 s early
        part = rows[at : at + 300]
        if at + 300 < len(rows):
            ahead = [rows[at + 300 + j] for j in range(0, 50, 7)]
            rows = [r for r in rows if r not in ahead or r in rows[: at + 300]]
            part = part + ahead
            rows = rows[: at + 300] + ahead + rows[at + 300 :]
        rng.shuffle(part)
        write(spark, part, line.path)
        told = line.read_on()
    again = line.read_on()
    assert told == again  # nothing is told twice
    whole = ad.timeline(spark, line.root)
    want = iv.scenes(whole, "user_id", most).alias("s").join(whole.alias("t"), F.expr("s.user_id <=> t.user_id and s.ordinal = t.ordinal"))
    want = sorted(map(tuple, want.select("t.user_id", "event_id", "t.ordinal", "scene", "start_ms", "end_ms").collect()), key=str)
    assert set(told) < set(want)
    assert line.end() == want


def test_a_late_row_counts_until_the_watermark_has_passed_it(spark, tmp_path):
    line = Line(spark, tmp_path, lambda e: tl.scenes(e, 60_000, "10 seconds"))
    write(spark, [(1, BASE_MS, 1, "view"), (2, BASE_MS + 30_000, 1, "view")], line.path)
    line.read_on()
    write(spark, [(3, BASE_MS + 25_000, 1, "view"), (4, BASE_MS + 5_000, 1, "view")], line.path)
    line.read_on()
    assert [r[1] for r in sorted(line.end(), key=lambda r: r[2])] == [1, 3, 2]  # 4 came after the watermark of 20 s


def test_chunks_are_told_once_their_end_has_passed(spark, tmp_path):
    line = Line(spark, tmp_path, lambda e: tl.chunks(e, "60 seconds", "10 seconds"))
    write(spark, [(1, BASE_MS, 1, "view"), (2, BASE_MS + 59_999, 1, "error"), (3, BASE_MS + 60_000, None, "view"), (4, BASE_MS + 75_000, 1, None)], line.path)
    assert line.read_on() == [(1, BASE_MS, 2, 1, BASE_MS, BASE_MS + 59_999)]
    write(spark, [(5, BASE_MS + 66_000, 1, "view"), (6, BASE_MS + 1_000, 1, "view")], line.path)
    line.read_on()
    assert set(line.end()) == {(1, BASE_MS, 2, 1, BASE_MS, BASE_MS + 59_999), (None, BASE_MS + 60_000, 1, 0, BASE_MS + 60_000, BASE_MS + 60_000), (1, BASE_MS + 60_000, 2, 0, BASE_MS + 66_000, BASE_MS + 75_000)}


@pytest.mark.parametrize("name", ["scenes", "chunks"])
def test_an_empty_table_and_rows_without_a_time(spark, tmp_path, name):
    operator = {"scenes": lambda e: tl.scenes(e, 60_000, "1 second"), "chunks": lambda e: tl.chunks(e, "1 minute", "1 second")}[name]
    line = Line(spark, tmp_path, operator)
    spark.createDataFrame([], EVENTS).write.parquet(line.path)
    line.read_on()
    write(spark, [(1, None, 1, "view"), (None, BASE_MS, None, None)], line.path)
    line.read_on()
    assert [r[0] for r in line.end()] == [None]


def test_lines_share_groups_and_keep_their_scenes(spark, tmp_path):
    line = Line(spark, tmp_path, lambda e: tl.scenes(e, 60_000, "10 seconds"))
    users = [None, -65, -1, 0, 1, 63, 64, 2**62, 2**62 + 1]
    rows = [(i, BASE_MS + 7_000 * i, users[i % len(users)], "error" if i % 13 == 0 else "view") for i in range(180)]
    for part in (rows[:90], rows[90:]):
        write(spark, part, line.path)
        line.read_on()
    state = spark.read.format("statestore").load(line.checkpoint)
    assert state.select("key").distinct().count() == 6  # no group for every line
    whole = ad.timeline(spark, line.root)
    want = iv.scenes(whole, "user_id", 60_000).alias("s").join(whole.alias("t"), F.expr("s.user_id <=> t.user_id and s.ordinal = t.ordinal"))
    assert line.end() == sorted(map(tuple, want.select("t.user_id", "event_id", "t.ordinal", "scene", "start_ms", "end_ms").collect()), key=str)
