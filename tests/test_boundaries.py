"""Schemas, publishing, file scans, lookups, edit distances and drafts on small cases."""

import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.functions import schemas as S
from tideline.functions.text import word_distance
from tideline.operators import lookup
from tideline.operators.staging import shared_folder
from tideline.plans import boundaries
from tideline.sources import files, published
from tideline.sources.drafts import drafts

SCHEMA = {
    "type": "object",
    "required": ["a"],
    "additionalProperties": {"type": ["integer", "null"]},
    "properties": {
        "a": {"$ref": "#/$defs/name"},
        "n": {"type": "number", "minimum": 1, "exclusiveMaximum": 9, "multipleOf": 0.5},
        "list": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"enum": [1, "x", None, True, {"k": [1]}]}},
        "deep": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "array", "items": {"$ref": "#/$defs/name"}}}}, "additionalProperties": False},
    },
    "$defs": {"name": {"type": "string", "minLength": 2, "pattern": "^[a-zü]"}},
}
CASES = {
    '{"a":"ab","n":2.5,"list":[1,"x",null],"deep":{"b":[["xy"],[]]},"z":5,"y":null}': [],
    '{"n":9}': [("$", "required:a"), ("$.n", "exclusiveMaximum")],
    '{"a":"X","n":0.3}': [("$.a", "minLength"), ("$.a", "pattern"), ("$.n", "minimum"), ("$.n", "multipleOf")],
    '{"a":"üb","list":[]}': [("$.list", "minItems")],
    '{"a":"ab","list":[1,1,2,true]}': [("$.list", "maxItems"), ("$.list", "uniqueItems"), ("$.list[2]", "enum")],
    '{"a":"ab","list":[{"k":[1]},{"k":[2]}]}': [("$.list[1]", "enum")],
    '{"a":null,"n":"2","list":{},"deep":[]}': [("$.a", "type"), ("$.n", "type"), ("$.list", "type"), ("$.deep", "type")],
    '{"a":"ab","deep":{"b":[["x",5]],"c":1},"z":1.5}': [("$.deep.b[0][0]", "minLength"), ("$.deep.b[0][1]", "type"), ("$.deep", "additional:c"), ("$.z", "type")],
    "[]": [("$", "type")], "null": [("$", "type")], "7": [("$", "type")], "{no json": [("$", "json")],
}


def test_schema_rules(spark):
    rows = [(i, doc) for i, doc in enumerate([*CASES, None])]
    got = S.violations(spark.createDataFrame(rows, "id long, doc string"), "doc", SCHEMA, "id").collect()
    want = [(i, *x) for i, bad in enumerate(CASES.values()) for x in bad]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(
    "schema",
    [{"typ": "object"}, {"properties": {"a": {"format": "date"}}}, {"items": [{}]}, {"type": "text"}, {"$ref": "other.json"}, {"$ref": "#/$defs/none"}, {"$defs": {"x": {"oneOf": []}}}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}],
)
def test_schemas_that_are_refused(spark, schema):
    with pytest.raises(S.SchemaError):
        S.violations(spark.createDataFrame([(1, "{}")], "id long, doc string"), "doc", schema, "id")


def test_published_schemas_are_known():
    assert S.names() == ["conversation", "event", "order"] and all(S.load(n) for n in S.names())
    with pytest.raises(S.SchemaError):
        S.load("nothing")


def test_publishing_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root = f"{shared_folder(spark)}/publish-test"
    a, b = spark.range(10), spark.range(5).withColumn("x", F.lit("y"))
    assert published.current(spark, root) == {"version": 0, "tables": {}}
    first = published.publish(spark, root, {"a": a, "b": b})
    with monkeypatch.context() as m:  # dies between the parts
        real, calls = published.summary, []

        def failing(df):
            calls.append(1)
            if len(calls) == 3:
                raise KeyboardInterrupt
            return real(df)

        m.setattr(published, "summary", failing)
        with pytest.raises(KeyboardInterrupt):
            published.publish(spark, root, {"a": spark.range(99), "b": spark.range(99)})
    assert published.current(spark, root) == first
    assert published.read(spark, root, "a").count() == 10
    second = published.publish(spark, root, {"b": b.where("id > 2")})
    assert second["version"] == 2 and second["tables"]["a"] == first["tables"]["a"] and published.read(spark, root, "b").count() == 2
    with pytest.raises(published.PublishError):  # another run was first
        published.write_document(spark, f"{root}/manifests/0000000002.json", "{}", replace=False)
    with pytest.raises(published.PublishError):  # its source has changed
        published.publish(spark, root, {"a": a}, {"s": (spark.range(3), published.summary(spark.range(4)))})
    assert published.current(spark, root) == second
    published.publish(spark, root, {"none": spark.range(0)})
    assert published.read(spark, root, "none").columns == ["id"] and published.read(spark, root, "none").count() == 0


def test_files_below_a_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, text in (("a.MP4", "one"), ("deep/b.mp4", "two"), ("deep/er/c.mkv", "3"), ("f.mp4", ""), ("deep/d.txt", "no"), ("e", "no")):
        (tmp_path / name).write_text(text)
    found = files.hashed(spark, str(tmp_path), (".mp4", ".mkv")).collect()
    assert sorted(map(tuple, found)) == [(n, len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in (("a.MP4", "one"), ("b.mp4", "two"), ("c.mkv", "3"))]
    plan = files.listed(spark, str(tmp_path), (".mp4",))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and files.listed(spark, str(tmp_path), (".mp4",)).count() == 2


@pytest.mark.parametrize("held", [False, True])
def test_files_are_hashed_without_being_held(spark, tmp_path, monkeypatch, held):
    # one split a file, or many where the session's settings are held; files with and without a mark, a last newline, or any line, and some at the length of pieces
    draw, mark, whole = random.Random(4), b"\xef\xbb\xbf", files.PIECE
    bodies = [b"\n", b"\n\n", b"x", mark, mark + b"\n", mark + b"x", mark + b"x\n", mark + mark, mark[:2], b"\r\n\r", b"\xff\x00\n\x00", b"\n" * 50_000, bytes(100_000)]
    bodies += [b"y" * (4 * whole + n) + end for n in (-1, 0, 1) for end in (b"", b"\n")] + [start + draw.randbytes(150_000) + end for start in (b"", mark) for end in (b"x", b"\n")]
    names = {f"{i}.mp4": body for i, body in enumerate(bodies)} | {"\u00fc%20 +#.MP4": b"odd", "p.mp4.gz": gzip.compress(b"hi\n" * 99)}
    for name, body in names.items():
        (tmp_path / name).write_bytes(body)
    small = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1000", "spark.sql.sources.binaryFile.maxLength": "1000"}
    for suffixes, n in (((".gz",), 1), ((".mp4",), len(names) - 1), ((".tar.gz", ".p4", "mp4"), 0), ((), 0), (("", ".h d", ".c++"), 3)):
        for name in ("none", "b.H d", "b.C++"):
            (tmp_path / name).write_bytes(b"-")
        assert files.listed(spark, str(tmp_path), suffixes).count() == n
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        splits = lambda: files._files(files._unsplit(spark), "text", str(tmp_path), (".mp4",)).rdd.getNumPartitions()
        if held:
            monkeypatch.setattr(files, "_unsplit", lambda session: session)
        assert (splits() > len(names)) == held
        found = sorted(map(tuple, files.hashed(spark, str(tmp_path), (".mp4", ".gz")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == sorted((n, len(b), hashlib.sha256(b).hexdigest()) for n, b in names.items())


def test_only_containing_by_brute_force(spark):
    draw = random.Random(8)
    names = ["".join(draw.choices("abc", k=draw.randrange(0, 9))) for _ in range(120)] + [None, "ümlaut-ab", "abcabc", "abcabc"]
    needles = ["".join(draw.choices("abc", k=draw.randrange(1, 8))) for _ in range(80)] + [None, "", "ü", "laut", "zzz", "t-a", "abcabc"]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "file long, name string")
    got = lookup.only_containing(spark.createDataFrame([(n,) for n in needles], "needle string"), table, "needle", "name", "file").collect()
    want = {}
    for n in needles:
        hits = [i for i, x in enumerate(names) if x is not None and n and n in x]
        if len(hits) == 1:
            want[n] = hits[0]
    assert {r.needle: r.file for r in got} == want and len(got) == len(want)


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, line[j + 1] + 1, line[j] + (x != y)))
        line = new
    return line[-1]


def test_word_distance(spark):
    draw = random.Random(9)
    pairs = [([f"w{draw.randrange(12)}" for _ in range(draw.randrange(15))], [f"w{draw.randrange(14)}" for _ in range(draw.randrange(15))]) for _ in range(60)]
    many = [f"word{i}" for i in range(60_000)]
    pairs += [(many, many[::40]), (many[:55_500], [])]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a array<string>, b array<string>")
    got = {r.id: r.d for r in rows.select("id", word_distance("a", "b").alias("d")).collect()}
    assert [got[i] for i in range(60)] == [distance(a, b) for a, b in pairs[:60]]
    assert got[60] == 60_000 - 1500 and got[61] == 55_500


def test_shared_words_beyond_the_surrogates(spark):
    many = [f"word{i}" for i in range(56_000)]
    other = [*many[55_000:], "else"]
    rows = spark.createDataFrame([(many[55_000:] + many[:3], other)], "a array<string>, b array<string>")
    assert rows.select(word_distance("a", "b").alias("d")).first().d == 3


def test_drafts_of_a_scene(spark):
    rows = [(1, 0, 2, "b", 0.5, 200), (1, 0, 0, "a", 0.001, 0), (1, 0, 1, "a", 0.002, 100), (1, 1, 3, "b", 1.0, 300), (2, 0, 0, "b", 0.0, 5)]
    got = drafts(spark.createDataFrame(rows, "user_id long, scene long, ordinal long, event_type string, value double, start_ms long")).collect()
    want = [(1, 0, 0, "a", 0, 700, 400, 2), (1, 0, 1, "b", 200, 150_200, 200_200, 1), (1, 1, 0, "b", 300, 300_300, 400_300, 1), (2, 0, 0, "b", 5, 5, 5, 1)]
    assert sorted(map(tuple, got)) == want


def test_manifest_is_json(spark):
    path = f"{shared_folder(spark)}/document-test/a.json"
    published.write_document(spark, path, json.dumps({"ü": 1}))
    published.write_document(spark, path, json.dumps({"ü": 2}))
    assert json.loads(published.read_document(spark, path)) == {"ü": 2}


def test_schemas_are_checked_by_generated_code(spark):
    docs = spark.createDataFrame([(1, "{}")], "id long, doc string")
    plan = S.violations(docs, "doc", {**SCHEMA, "properties": {k: v for k, v in SCHEMA["properties"].items() if k != "list"}}, "id")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("parseJson") == 1  # lambdas are interpreted, node by node


def test_hashes_are_no_join_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = boundaries.x8_verified_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"SortMergeJoin \[l_orderkey#\d+L\], \[l_orderkey#\d+L\], Inner", plan)


def test_ordered_clips_take_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(boundaries, "TASK_ROWS", 1000)
    rows = boundaries.ad.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    plan = boundaries.o3_ordered_clips(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and re.search(rf"hashpartitioning\(render_id#\d+L, {rows // 1000 + 1}\)", plan)
