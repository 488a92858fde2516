"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from tideline.plans import boundaries, published, registry, schemas, streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["g23_story_plan", "w5_scenes_with_silence", "j2_overlap_join", "d1_originality_audit", "d2_pacing_gate", "s7_srt_round_trip", "j5_midpoint_cues", "k2_upsert", "v13_foreign_keys", "p9_native_or_all", "i1_checkpoint_validity"]
SOME += ["f12_caption_phrases", "w7_timed_captions", "r2_narration_cues", "r3_dialogue_cues", "r5_combined_cues", "f14_word_error_rate", "j3_transcript_chunks", "o4_catalog_order", "j16_favourite_rank"]
SOME += ["w5_scene_grouping", "w11_thinned_cuts", "s12_manifest_catalog", "k12_path_guard", "f5_episode_ids", "p6_mode_outputs", "x11_pending_migrations", "x12_subtitle_cascade", "x15_favourite_sets"]
SOME += ["c2_stage_descendants", "c2_cycles", "i3_invalidated_rows", "c3_predecessor_artifacts", "j15_source_cascade", "d4_intelligibility", "x2_source_drift", "x19_mode_change", "m1_seconds_to_ms", "x9_speech_segments", "w6_running_offsets", "g22_fit_limit"]
SOME += [*boundaries.QUERIES, *schemas.QUERIES, *published.QUERIES, *streams.QUERIES]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "is_finite"):
        return f"{float(v):.9g}"
    return v if v is None else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_oracle(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    rows = sorted(str([plain(r[c]) for c in sorted(found.columns)]) for r in found.collect())
    want = duck.sql(registry.ORACLES[name].replace(published.FOLDER, SF))
    places = [want.columns.index(c) for c in sorted(found.columns)]
    assert len(want.columns) == len(found.columns)
    assert rows == sorted(str([plain(r[i]) for i in places]) for r in want.fetchall())


def test_names_are_unique_and_oracles_known():
    assert len(registry.QUERIES) > 100
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_combined_cues_match_their_sql_added_in_order(spark):
    # 61 borders of this table are exactly half a millisecond, so the last bit of a running sum decides them. The setting makes
    # DuckDB add each frame by itself; by default that bit depends on the other rows of the table (REPLY_r03.md, F2)
    large, name = SF.replace("sf0.001", "sf0.1"), "r5_combined_cues"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{large}/conversations.parquet'")
    duck.sql("SET debug_window_mode = 'separate'")
    want = dict(duck.sql(registry.ORACLES[name]).fetchall())
    found = {r.conv_id: r.srt for r in registry.QUERIES[name](spark, large).collect()}
    assert [c for c in want if found.get(c) != want[c]] == [] and len(found) == len(want) == 1000
