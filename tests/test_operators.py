"""Operators on small hand-made tables."""

from pyspark.sql import functions as F

from tideline.operators import audits, captions, intervals, planner, store

SHOTS = "k string, ordinal long, start_ms long, end_ms long, excluded boolean"


def scene_numbers(spark, rows, most=120_000, speech=None, gap=1500):
    shots = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], SHOTS)
    silent = None
    if speech is not None:
        said = spark.createDataFrame([("x", *s) for s in speech], "k string, start_ms long, end_ms long")
        silent = intervals.silent_boundaries(shots, said, "k", gap, 1000)
    return [r.scene for r in intervals.scenes(shots, "k", most, silent).orderBy("ordinal").collect()]


def test_scenes(spark):
    two = [(0, 400, False), (400, 800, False)]
    assert scene_numbers(spark, two, speech=[(0, 800)]) == [0, 0]
    assert scene_numbers(spark, two, speech=[(0, 100), (700, 800)], gap=100) == [0, 1]
    assert scene_numbers(spark, [(0, 400, False), (400, 800, True), (800, 900, False)]) == [0, 1, 2]
    assert scene_numbers(spark, two, most=500) == [0, 1]


def test_scenes_of_one_long_island(spark):
    # every shot takes one step, some two: the guard falls at uneven places
    ends = [10 * (i + 1) + (7 if i % 5 == 0 else 0) for i in range(5000)]
    want, first, n = [], None, -1
    for i, end in enumerate(ends):
        if first is None or end - first > 95:
            first, n = 10 * i, n + 1
        want.append(n)
    assert scene_numbers(spark, [(10 * i, end, False) for i, end in enumerate(ends)], most=95) == want


def test_overlap_join_has_each_pair_once(spark):
    left = spark.createDataFrame([("x", 0, 5000), ("x", 5000, 5001)], "k string, start_ms long, end_ms long")
    right = spark.createDataFrame([("x", 100, 4900), ("x", 5000, 9000), ("y", 0, 10)], "k string, start_ms long, end_ms long")
    pairs = [(r.l.start_ms, r.r.start_ms) for r in intervals.overlap_join(left, right, "k", 700).collect()]
    assert sorted(pairs) == [(0, 100), (5000, 5000)]


def test_plan_drops_optional_first(spark):
    events = spark.createDataFrame([(12, 1, 0, 0, 0.9), (24, 1, 10, 1, 0.5), (36, 1, 20, 2, 0.1)], "event_id long, user_id long, start_ms long, ordinal long, importance double")
    edges = spark.createDataFrame([], "user_id long, from_event_id long, to_event_id long, relation string")
    profile = planner.Profile(compression=1.0, limit_ms=4500)
    got = {r.event_id: r for r in planner.plan(events, edges, profile).collect()}
    assert set(got) == {12, 24} and all(r.feasible for r in got.values()) and sum(r.estimated_ms for r in got.values()) <= 4500
    tight = planner.plan(events.withColumn("importance", F.lit(0.9)), edges, planner.Profile(limit_ms=100)).collect()
    assert len(tight) == 3 and not any(r.feasible for r in tight)


def test_video_fit(spark):
    speed, keep = audits.video_fit(F.lit(20.0), F.lit(10.0), 0.85, 1.15)
    row = spark.range(1).select(speed.alias("s"), keep.alias("k"), audits.video_padding(F.lit(5.0), F.lit(10.0), F.lit(0.85)).alias("p")).first()
    assert (row.s, round(row.k, 6), round(row.p, 6)) == (1.15, 0.575, round(10 - 5 / 0.85, 6))


def test_audit_rules(spark):
    clips = spark.createDataFrame(
        [("o", "a", "narration", "RECAP", 1, 0.0, 8000.0, 1.35), ("o", "b", "original_dialogue", "", 1, 0.0, 16000.0, 1.0)],
        "render_id string, segment_id string, segment_type string, purpose string, clip_order int, start_ms double, end_ms double, speed double",
    )
    codes = {r.code for r in audits.originality_issues(audits.segments(clips)).collect()}
    assert {"NON_EDITORIAL_PURPOSE", "PLOT_DESCRIPTION_ONLY", "LONG_ORIGINAL_DIALOGUE", "DIALOGUE_WITHOUT_EVIDENCE_PURPOSE", "COMMENTARY_NOT_CENTRAL", "LONG_THIRD_PARTY_CLIP"} <= codes
    many = spark.createDataFrame([("o", "a", "narration", "CONTEXT", i, 0.0, 900.0, 1.35) for i in range(6)], clips.schema)
    assert {r.code for r in audits.pacing_issues(many, ["clip_order"]).collect()} == {"TOO_MANY_CLIPS", "SHORT_AVERAGE_SHOT", "MICRO_CLIP", "SPEED_OUT_OF_BAND", "CROWDED_CUTS"}


def test_timed_phrases_end_exactly(spark):
    rows = spark.createDataFrame([(1, "one two three four, five six seven eight nine ten.", 13.43, 17.809)], "i int, t string, s double, e double")
    cues = captions.timed_phrases(rows, ["i"], "t", "s", "e").orderBy("cue").collect()
    assert cues[0].cue_start == 13.43 and cues[-1].cue_end == 17.809
    assert all(a.cue_end == b.cue_start for a, b in zip(cues, cues[1:], strict=False)) and all(len(c.phrase.split()) <= 7 for c in cues)

def test_timed_phrases_do_not_depend_on_spills(spark):
    # a sort that spills hands on equal keys in no fixed order, so sums of doubles must name theirs
    text = " ".join(("a b c, d e f. g h i j k l m" if n % 3 else "a b c; d e f g h.") for n in range(20))
    rows = spark.createDataFrame([(i, f"{text} {'z ' * (i % 11)}", 0.1 * i, 97.3 + i) for i in range(80)], "i int, t string, s double, e double").repartition(1)
    timed = lambda: captions.timed_phrases(rows, ["i"], "t", "s", "e").orderBy("i", "cue").collect()
    want = timed()
    conf, often = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(often, "300")
    try:
        assert timed() == want
    finally:
        conf.remove(often)
    assert len(want) > 2000


def test_store(spark):
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, state string, other string")
    change = spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], now.schema)
    assert sorted(map(tuple, store.upsert(now, change, "id", ["state"]).collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "w")]
    assert sorted(r.id for r in store.insert_absent(now, change, ["id"]).collect()) == [1, 2, 3]
    kept = store.delete_unlinked(now, change.select("id"), "id", F.lit(True))
    assert [r.id for r in kept.collect()] == [2]
    try:
        store.assert_empty(now, "rows")
        raise AssertionError("must raise")
    except ValueError:
        pass
