"""Queries over settings, envelopes, boundaries, audits of inputs, projections and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import scan
from tideline.operators import store as st
from tideline.plans import audits, stories
from tideline.sources import adapters as ad
from tideline.sources.drafts import drafts

QUERIES: dict = {}
ORACLES: dict = {}
#: Rows of a part whose windows one task works out (a fixed value).
TASK_ROWS = 500_000


def query(name: str, oracle: str | None = None, *parts: str):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ctes = ",".join(ad.SQL[p] for p in parts)
            ORACLES[name] = f"WITH RECURSIVE {ctes}{'' if oracle.startswith(',') else ' '}{oracle}" if ctes else oracle
        return function

    return add


def _t(name: str):
    return lambda spark, sf: ad.table(spark, sf, name)


_orders, _events, _documents, _customers = _t("orders"), _t("events"), _t("documents"), _t("customer")


# Settings, envelopes and JSON fields

@query("s13_project_reload", """SELECT o_orderkey AS id, coalesce(o_orderpriority, 'normal') AS priority,
CASE WHEN o_orderstatus IN ('O', 'P') THEN 'PAUSED' ELSE o_orderstatus END AS status, 1 AS parallel FROM orders""")
def s13_project_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Stored projects read back from JSON under the known fields: defaults for what is
    missing, and work that was running or queued is paused."""
    stored = _orders(spark, sf).select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")).alias("doc"))
    known = stored.select(F.from_json("doc", "id long, priority string, status string, parallel int").alias("p")).select("p.*")
    status = F.when(F.col("status").isin("O", "P"), "PAUSED").otherwise(F.col("status"))
    return known.select("id", F.coalesce("priority", F.lit("normal")).alias("priority"), status.alias("status"), F.coalesce("parallel", F.lit(1)).alias("parallel"))


@query("a2_default_fields", """SELECT event_id, coalesce(json_extract_string(props, '$.title'), event_type) AS title, coalesce((props::JSON ->> '$.k')::BIGINT, 0) AS k,
event_type || '-' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position_id FROM events""")
def a2_default_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = F.from_json("props", "title string, k long")
    position = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return _events(spark, sf).select("event_id", F.coalesce(p["title"], "event_type").alias("title"), F.coalesce(p["k"], F.lit(0)).alias("k"), F.concat_ws("-", "event_type", position.cast("string")).alias("position_id"))


@query("a4_merged_policy", """SELECT o_orderkey, 'mode=' || o_orderstatus || ',retries=' || CASE WHEN o_totalprice > 100000 THEN '5' ELSE '2' END || ',voice=on' AS policy FROM orders""")
def a4_merged_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults, then what a project sets itself, then what its price sets: the last one counts."""
    defaults = {"mode": F.lit("none"), "retries": F.lit("2"), "voice": F.lit("on")}
    price = F.when(F.col("o_totalprice") > 100000, F.create_map(F.lit("retries"), F.lit("5"))).otherwise(F.create_map().cast("map<string,string>"))
    layers = [F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v)]), F.create_map(F.lit("mode"), F.col("o_orderstatus")), price]
    merged = F.map_filter(layers[0], lambda k, v: ~F.map_contains_key(layers[1], k) & ~F.map_contains_key(layers[2], k))
    merged = F.map_concat(merged, F.map_filter(layers[1], lambda k, v: ~F.map_contains_key(layers[2], k)), layers[2])
    listed = F.array_sort(F.map_entries(merged))
    return _orders(spark, sf).select("o_orderkey", F.array_join(F.transform(listed, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("policy"))


@query("a5_sorted_json", """SELECT doc_id, '{' || concat_ws(',', '"lang":"' || lang || '"', '"n_chars":' || n_chars, '"source":"' || source || '"') || '}' AS doc FROM documents""")
def a5_sorted_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text with its keys in order, whatever the order of the columns; keys without a value are left out."""
    return _documents(spark, sf).select("doc_id", F.to_json(F.struct(*sorted(["source", "n_chars", "lang"]))).alias("doc"))


_ENVELOPE = "CASE event_type WHEN 'click' THEN '{\"episode\":' || props || '}' WHEN 'view' THEN '{\"episodes\":[' || props || ',{}]}' ELSE props END"


@query("a6_unwrapped_envelope", f"""SELECT event_id, (coalesce(json_extract(j, '$.episode'), json_extract(j, '$.episodes[0]'), j) ->> '$.k')::BIGINT AS k
FROM (SELECT event_id, ({_ENVELOPE})::JSON AS j FROM events)""")
def a6_unwrapped_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """A document may be the episode, hold it, or hold a list of which it is the first."""
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit('{"episode":'), "props", F.lit("}"))).when(F.col("event_type") == "view", F.concat(F.lit('{"episodes":['), "props", F.lit(",{}]}"))).otherwise(F.col("props"))
    one = F.coalesce(F.get_json_object(raw, "$.episode"), F.get_json_object(raw, "$.episodes[0]"), raw)
    return _events(spark, sf).select("event_id", F.get_json_object(one, "$.k").cast("long").alias("k"))


@query("a7_known_fields", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, json_extract_string(props, '$.note') AS note FROM events")
def a7_known_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", F.from_json("props", "k long, note string").alias("p")).select("event_id", "p.k", "p.note")


@query("x24_scalar_guards", """SELECT event_id, 'k_in_range' AS rule FROM events WHERE NOT coalesce((props::JSON ->> '$.k')::BIGINT BETWEEN 5 AND 95, false)
UNION ALL SELECT event_id, 'value_finite' FROM events WHERE NOT (value >= 0 AND isfinite(value)) UNION ALL SELECT event_id, 'type_word' FROM events WHERE NOT regexp_matches(event_type, '^[a-z]{4,7}$')""")
def x24_scalar_guards(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each guard that a field fails, with integers read strictly."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    finite = ~F.isnan("value") & (F.abs("value") != F.lit(float("inf"))) & (F.col("value") >= 0)
    guards = {"k_in_range": F.coalesce(k.between(5, 95), F.lit(False)), "value_finite": finite, "type_word": F.col("event_type").rlike("^[a-z]{4,7}$")}
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in guards.items()]))
    return _events(spark, sf).select("event_id", F.explode(failed).alias("rule"))


# Boundaries and domain rules

_SCENES = stories._PLAIN + """, placed AS (SELECT * FROM scenes JOIN timeline USING (user_id, ordinal)),
env AS (SELECT user_id, scene, min(start_ms) AS s, max(end_ms) AS e, min(ordinal) AS o, count(*) AS n FROM placed GROUP BY 1, 2)"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return stories.w5_scene_grouping(spark, sf).join(ad.timeline(spark, sf), ["user_id", "ordinal"])


@query("v5_scene_labels", _SCENES + """, lab AS (SELECT user_id, scene, arg_min(event_type, ordinal) AS label, least(1.0::DOUBLE, max(value) / 50) AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY scene) - 1 AS pos FROM placed GROUP BY 1, 2)
SELECT user_id, scene, rule FROM (SELECT *, unnest(['label_known', 'confident', 'in_order']) AS rule, unnest([label IN ('click', 'view', 'purchase'), confidence BETWEEN 0.2 AND 0.99, pos = scene]) AS ok FROM lab) WHERE NOT ok""", "timeline")
def v5_scene_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels given to scenes that a boundary rejects: unknown, unsure, or out of order."""
    labels = _placed(spark, sf).groupBy("user_id", "scene").agg(F.min_by("event_type", "ordinal").alias("label"), F.least(F.lit(1.0), F.max("value") / 50).alias("confidence"))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("scene")) - 1
    rules = {"label_known": F.col("label").isin("click", "view", "purchase"), "confident": F.col("confidence").between(0.2, 0.99), "in_order": pos == F.col("scene")}
    return _failed(labels, rules, "user_id", "scene")


def _failed(rows: DataFrame, rules: dict, *keys: str) -> DataFrame:
    """A row for each rule that a row fails."""
    marked = rows.select(*keys, F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(ok, F.lit(True)).alias("ok")) for r, ok in rules.items()]).alias("r"))
    return marked.select(*keys, F.explode(F.filter("r", lambda r: ~r["ok"])).alias("x")).select(*keys, F.col("x.rule").alias("rule"))


_DRAFTS = _SCENES + """,
marked AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id, scene ORDER BY ordinal), false) AS new FROM placed),
runs AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id, scene ORDER BY ordinal) AS draft FROM marked),
drafts AS (SELECT user_id, scene, draft::BIGINT AS draft, any_value(event_type) AS kind, min(start_ms) AS start_ms, max(start_ms + round_even(value * 300000, 0)::BIGINT) AS end_ms,
    arg_min(start_ms + round_even(value * 400000, 0)::BIGINT, ordinal) AS evidence_ms, count(*) AS shots FROM runs GROUP BY 1, 2, 3)"""


@query("udtf_event_drafts", _DRAFTS + " SELECT * FROM drafts", "timeline")
def udtf_event_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Events drafted from each scene's shots by a table function."""
    return drafts(_placed(spark, sf))


@query("v6_event_drafts", _DRAFTS + """, d AS (SELECT * FROM drafts JOIN env USING (user_id, scene))
SELECT user_id, scene, draft, rule FROM (SELECT *, unnest(['in_scene', 'evidence_inside', 'lasting']) AS rule,
unnest([s <= start_ms AND end_ms <= e, start_ms <= evidence_ms AND evidence_ms <= end_ms, end_ms > start_ms]) AS ok FROM d) WHERE NOT ok""", "timeline")
def v6_event_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Drafted events whose range leaves their scene, whose evidence leaves their own range, or that don't last."""
    placed = _placed(spark, sf)
    scenes = placed.groupBy("user_id", "scene").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    rules = {
        "in_scene": (F.col("s") <= F.col("start_ms")) & (F.col("end_ms") <= F.col("e")),
        "evidence_inside": F.col("evidence_ms").between(F.col("start_ms"), F.col("end_ms")),
        "lasting": F.col("end_ms") > F.col("start_ms"),
    }
    return _failed(drafts(placed).join(scenes, ["user_id", "scene"]), rules, "user_id", "scene", "draft")


@query("v8_domain_invariants", """, r AS (SELECT conv_id, turn, text, role, start_ms, end_ms, lead(start_ms) OVER l AS after, row_number() OVER l - 1 AS pos FROM transcript WINDOW l AS (PARTITION BY conv_id ORDER BY turn, text))
SELECT conv_id, turn, rule FROM (SELECT *, unnest(['range', 'no_overlap', 'text_given', 'dense_turns', 'role_known']) AS rule,
unnest([end_ms > start_ms, coalesce(after >= end_ms, true), length(trim(text)) >= 40, pos = turn, role IN ('user', 'assistant')]) AS ok FROM r) WHERE NOT ok""", "transcript")
def v8_domain_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of a transcript that break an invariant of their class."""
    line = W.partitionBy("conv_id").orderBy("turn", "text")
    rows = ad.transcript(spark, sf).withColumns({"after": F.lead("start_ms").over(line), "pos": F.row_number().over(line) - 1})
    rules = {
        "range": F.col("end_ms") > F.col("start_ms"), "no_overlap": F.col("after") >= F.col("end_ms"), "text_given": F.length(F.trim("text")) >= 40,
        "dense_turns": F.col("pos") == F.col("turn"), "role_known": F.col("role").isin("user", "assistant"),
    }
    return _failed(rows, rules, "conv_id", "turn")


@query("x22_entity_checks", """SELECT c_custkey, rule FROM (SELECT *, unnest(['name', 'ordinal', 'sha']) AS rule,
unnest([length(trim(c_name)) > 0 AND NOT ends_with(c_name, '7'), c_nationkey >= 1, regexp_matches(left(sha256(c_name), 60 + c_nationkey % 5), '^[0-9a-f]{64}$')]) AS ok FROM customer) WHERE NOT ok""")
def x22_entity_checks(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.substring(F.sha2("c_name", 256), F.lit(1), F.lit(60) + F.col("c_nationkey") % 5)
    rules = {"name": (F.length(F.trim("c_name")) > 0) & ~F.col("c_name").endswith("7"), "ordinal": F.col("c_nationkey") >= 1, "sha": sha.rlike("^[0-9a-f]{64}$")}
    return _failed(_customers(spark, sf), rules, "c_custkey")


@query("p13_unknown_labels", r"""SELECT event_id, k = '' OR k = 'unknown' OR regexp_matches(k, '^speaker[_\- ]?\d+$') AS unknown FROM (SELECT event_id, lower(trim(CASE event_type WHEN 'error' THEN ' ' WHEN 'signup' THEN 'Unknown ' WHEN 'view' THEN 'Speaker ' || user_id ELSE event_type || user_id END)) AS k FROM events)""")
def p13_unknown_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "error", " ").when(kind == "signup", "Unknown ").when(kind == "view", F.concat(F.lit("Speaker "), F.col("user_id").cast("string"))).otherwise(F.concat(kind, F.col("user_id").cast("string")))
    return _events(spark, sf).select("event_id", T.is_unknown_label(label).alias("unknown"))


@query("p16_locked_type_mismatch", """SELECT render_id, segment_id, clip_order FROM (SELECT *, first_value(segment_type) OVER (PARTITION BY render_id ORDER BY clip_order, segment_id) AS locked FROM clips) WHERE segment_type <> locked""", "clips")
def p16_locked_type_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of another type than the one that their output's first clip locks."""
    locked = F.first("segment_type").over(W.partitionBy("render_id").orderBy("clip_order", "segment_id"))
    return ad.clips(spark, sf).withColumn("locked", locked).where("segment_type <> locked").select("render_id", "segment_id", "clip_order")


@query("p3_overlapping_clips", """SELECT a.render_id, a.clip_order AS first_clip, b.clip_order AS second_clip FROM clips a JOIN clips b ON a.render_id = b.render_id AND a.clip_order < b.clip_order
AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms""", "clips")
def p3_overlapping_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one output's clips (a handful) whose half-open source ranges overlap."""
    c = ad.clips(spark, sf).select("render_id", "clip_order", "start_ms", "end_ms")
    a, b = c.alias("a"), c.alias("b")
    on = (F.col("a.render_id") == F.col("b.render_id")) & (F.col("a.clip_order") < F.col("b.clip_order"))
    found = a.join(b, on).where((F.col("a.start_ms") < F.col("b.end_ms")) & (F.col("b.start_ms") < F.col("a.end_ms")))
    return found.select("a.render_id", F.col("a.clip_order").alias("first_clip"), F.col("b.clip_order").alias("second_clip"))


# Orders, ordinals, unions and lookups

@query("j12_budget_decision", stories._CLASSED + "SELECT from_event_id, to_event_id, coalesce(budget_class, 'NONE') AS budget_class FROM edges LEFT JOIN (SELECT event_id, budget_class FROM classed WHERE budget_class <> 'OPTIONAL') c ON event_id = to_event_id", "timeline", "edges")
def j12_budget_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Each edge with the decision on its target, if there is one."""
    decided = stories.g19_budget_class(spark, sf).where("budget_class <> 'OPTIONAL'").select(F.col("event_id").alias("to_event_id"), "budget_class")
    edges = ad.edges(ad.timeline(spark, sf))
    return edges.join(decided, "to_event_id", "left").select("from_event_id", "to_event_id", F.coalesce("budget_class", F.lit("NONE")).alias("budget_class"))


@query("g5_longest_clip", "SELECT o_orderkey, coalesce(max(end_ms - start_ms), 0) AS longest FROM orders LEFT JOIN clips ON o_orderkey = render_id GROUP BY 1", "clips")
def g5_longest_clip(spark: SparkSession, sf: str) -> DataFrame:
    most = ad.clips(spark, sf).groupBy(F.col("render_id").alias("o_orderkey")).agg(F.max(F.col("end_ms") - F.col("start_ms")).alias("longest"))
    return _orders(spark, sf).select("o_orderkey").join(most, "o_orderkey", "left").select("o_orderkey", F.coalesce("longest", F.lit(0.0)).alias("longest"))


@query("w1_dense_ordinals", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents")
def w1_dense_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Places within a source, which may hold any share of all documents."""
    return scan.running(_documents(spark, sf).select("doc_id", "source"), "source", ["doc_id"], number="ordinal")


@query("o1_chronological", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, ordinal) AS position FROM timeline", "timeline")
def o1_chronological(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("start_ms", "ordinal"))
    return ad.timeline(spark, sf).select("user_id", "event_id", place.cast("long").alias("position"))


@query("o2_most_important", "SELECT user_id, event_id, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, start_ms, ordinal) AS p FROM timeline) WHERE p <= 3", "timeline")
def o2_most_important(spark: SparkSession, sf: str) -> DataFrame:
    """The three most important events of each user; the earlier one of equals."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("importance"), "start_ms", "ordinal"))
    return ad.timeline(spark, sf).withColumn("place", place.cast("long")).where("place <= 3").select("user_id", "event_id", "place")


@query("o3_ordered_clips", """SELECT render_id, segment_id, clip_order, dense_rank() OVER (PARTITION BY render_id ORDER BY first_clip, segment_id) AS segment_place,
row_number() OVER (PARTITION BY render_id ORDER BY first_clip, segment_id, clip_order) AS place FROM (SELECT *, min(clip_order) OVER (PARTITION BY render_id, segment_id) AS first_clip FROM clips)""", "clips")
def o3_ordered_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Places of segments in their output (by their first clip) and of clips in it."""
    first = F.min("clip_order").over(W.partitionBy("render_id", "segment_id"))
    line = W.partitionBy("render_id")
    clips = ad.clips(spark, sf).select("render_id", "segment_id", "clip_order")
    # one exchange for all windows, in parts that grow in number and not in size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), clips.count() // TASK_ROWS + 1)
    rows = clips.repartition(parts, "render_id").withColumn("first_clip", first)
    segment, place = F.dense_rank().over(line.orderBy("first_clip", "segment_id")), F.row_number().over(line.orderBy("first_clip", "segment_id", "clip_order"))
    return rows.select("render_id", "segment_id", "clip_order", segment.cast("long").alias("segment_place"), place.cast("long").alias("place"))


@query("o9_store_orders", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS by_date,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS by_priority FROM orders""")
def o9_store_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Places under the orders in which a store lists a scope."""
    line = W.partitionBy("o_custkey")
    by_date, by_priority = (F.row_number().over(line.orderBy(*c)).cast("long") for c in (["o_orderdate", "o_orderkey"], ["o_orderpriority", F.desc("o_orderdate"), "o_orderkey"]))
    return _orders(spark, sf).select("o_orderkey", by_date.alias("by_date"), by_priority.alias("by_priority"))


@query("u6_distinct_endpoints", "SELECT from_event_id AS event_id FROM edges UNION SELECT to_event_id FROM edges", "timeline", "edges")
def u6_distinct_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    e = ad.edges(ad.timeline(spark, sf))
    return e.select(F.col("from_event_id").alias("event_id")).union(e.select("to_event_id")).distinct()


@query("k1_appended_rows", "SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k1_appended_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A table with new rows behind its own; columns are matched by name."""
    labels = ad.table(spark, sf, "labels")
    fresh = _documents(spark, sf).join(labels, "doc_id", "left_anti").select(F.lit(0).alias("toxic"), "doc_id", F.lit(None).cast("int").alias("quality"))
    return st.append(labels, fresh)


@query("x6_published_checkpoint", """SELECT 'checkpoint' AS kind, source AS key, 'SUCCEEDED' AS state, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT 'link', source || ':' || lang, NULL, count(*) FROM documents GROUP BY source, lang""")
def x6_published_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that publishing appends: a checkpoint for each stage and its links, in one table."""
    docs = _documents(spark, sf)
    points = docs.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("checkpoint").alias("kind"), "key", F.lit("SUCCEEDED").alias("state"), "n")
    links = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit("link").alias("kind"), F.concat("source", F.lit(":"), "lang").alias("key"), F.lit(None).cast("string").alias("state"), "n")
    return st.append(points, links)


@query("x7_row_count_agreement", "SELECT conv_id, max(turn) + 1 AS declared, count(*) AS found FROM conversations GROUP BY 1 HAVING max(turn) + 1 <> count(*) OR count(*) < 3")
def x7_row_count_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts whose rows are not as many as their document declares, or too few."""
    n = ad.table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("declared"), F.count(F.lit(1)).alias("found"))
    return n.where("declared <> found or found < 3")


@query("x8_verified_documents", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE sha256(l_linestatus) = sha256(o_orderstatus)")
def x8_verified_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose content has the hash that was recorded with their order."""
    recorded = _orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    # two hashes of 64 digits: one starts with the other if they are equal. An equality would become a join
    # key, and rows would be sorted by hashes that are worked out anew in each comparison
    same = F.sha2("l_linestatus", 256).startswith(F.sha2("o_orderstatus", 256))
    items = ad.table(spark, sf, "lineitem").join(recorded, "l_orderkey").where(same)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("x3_artifact_match", """SELECT a.event_id, coalesce(length(a.props) = length(d.props) AND sha256(a.props) = sha256(d.props) AND (a.props::JSON->>'k')::BIGINT >= 10, false) AS matches
FROM events a LEFT JOIN events d ON d.event_id = a.event_id + 1""")
def x3_artifact_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an artifact has the size and hash that were declared for it (with the next event) and a level of ten or more."""
    declared = _events(spark, sf).select((F.col("event_id") - 1).alias("event_id"), F.length("props").alias("size"), F.sha2("props", 256).alias("sha"))
    level = F.from_json("props", "k bigint")["k"] >= 10
    good = (F.length("props") == F.col("size")) & (F.sha2("props", 256) == F.col("sha")) & level
    return _events(spark, sf).join(declared, "event_id", "left").select("event_id", F.coalesce(good, F.lit(False)).alias("matches"))


@query("x4_metadata_documents", """SELECT doc_id, 'metadata/' || sha256(coalesce(text, '')) || '.media.json' AS path, '{"sha256":"' || sha256(coalesce(text, '')) || '","size":' || length(coalesce(text, '')) || '}' AS doc FROM documents""")
def x4_metadata_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata document of each text, under its hash; a null text is an empty one."""
    rows = _documents(spark, sf).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("sha256", F.sha2("text", 256))
    return rows.select("doc_id", F.concat(F.lit("metadata/"), "sha256", F.lit(".media.json")).alias("path"), F.to_json(F.struct("sha256", F.length("text").alias("size"))).alias("doc"))


@query("x13_root_cascade", """SELECT s_suppkey, coalesce(o.n_name, h.n_name, 'parent') AS root FROM supplier LEFT JOIN nation o ON o.n_nationkey = s_nationkey AND o.n_regionkey = 1 LEFT JOIN nation h ON h.n_nationkey = (s_nationkey + s_suppkey) % 25 AND h.n_regionkey < 3""")
def x13_root_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first root that exists: the override, the hint, else the document's own folder."""
    nation = ad.table(spark, sf, "nation")
    override = nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("o_key"), F.col("n_name").alias("o_name"))
    hint = nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("h_key"), F.col("n_name").alias("h_name"))
    rows = ad.table(spark, sf, "supplier").join(override, F.col("s_nationkey") == F.col("o_key"), "left").join(hint, (F.col("s_nationkey") + F.col("s_suppkey")) % 25 == F.col("h_key"), "left")
    return rows.select("s_suppkey", F.coalesce("o_name", "h_name", F.lit("parent")).alias("root"))


# Scalars

@query("f7_bounded_paths", r"""SELECT voice_id, dir || '/' || CASE WHEN length(c) <= room THEN c ELSE rtrim(left(c, room - 11), '-._') || '-' || left(sha256(raw), 10) END || '.srt' AS path FROM (
SELECT voice_id, '/out/' || engine AS dir, style || ' ' || name AS raw, trim(regexp_replace(trim(style || ' ' || name), '[^A-Za-z0-9._-]+', '-', 'g'), '-._') AS c, greatest(20, 30 - length('/out/' || engine) - 5) AS room FROM voices)""", "voices")
def f7_bounded_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of at most 30 characters where a name of 20 leaves room for that."""
    folder = F.concat(F.lit("/out/"), "engine")
    raw = F.concat_ws(" ", "style", "name")
    clean = F.btrim(F.regexp_replace(F.trim(raw), "[^A-Za-z0-9._-]+", "-"), F.lit("-._"))
    room = F.greatest(F.lit(20), F.lit(30) - F.length(folder) - F.lit(len(".srt") + 1))
    short = F.concat(F.rtrim(F.substring(clean, F.lit(1), room - 11), F.lit("-._")), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 10))
    return ad.voices(spark, sf).select("voice_id", F.concat(folder, F.lit("/"), F.when(F.length(clean) <= room, clean).otherwise(short), F.lit(".srt")).alias("path"))


@query("f10_folder_names", """SELECT doc_id, coalesce(nullif(trim(trim(regexp_extract(p, '([^/]*)$', 1)), '. '), ''), 'recaps') AS folder FROM (SELECT doc_id, coalesce(source, '') || '/' || CASE lang WHEN 'de' THEN '' WHEN 'fr' THEN ' .fr. ' ELSE coalesce(lang, '') END AS p FROM documents)""")
def f10_folder_names(spark: SparkSession, sf: str) -> DataFrame:
    """The last part of a path without spaces and points around it, or a default."""
    rows = _documents(spark, sf)
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.when(F.col("lang") == "de", "").when(F.col("lang") == "fr", " .fr. ").otherwise(F.coalesce("lang", F.lit(""))))
    last = F.btrim(F.trim(F.element_at(F.split(path, "/"), -1)), F.lit(". "))
    return rows.select("doc_id", F.coalesce(F.nullif(last, F.lit("")), F.lit("recaps")).alias("folder"))


@query("f19_progress", r"SELECT event_id, nullif(regexp_extract(event_type || ' ' || floor(value)::BIGINT || '/' || user_id || ' done', '(\d+)\s*/\s*(\d+)', 1), '')::BIGINT AS done, nullif(regexp_extract(event_type || ' ' || floor(value)::BIGINT || '/' || user_id || ' done', '(\d+)\s*/\s*(\d+)', 2), '')::BIGINT AS total FROM events")
def f19_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a message such as "view 3/14 done"."""
    message = F.concat_ws(" ", "event_type", F.concat(F.floor("value").cast("string"), F.lit("/"), F.col("user_id").cast("string")), F.lit("done"))
    found = [F.nullif(F.regexp_extract(message, r"(\d+)\s*/\s*(\d+)", i), F.lit("")).cast("long") for i in (1, 2)]
    return _events(spark, sf).select("event_id", found[0].alias("done"), found[1].alias("total"))


#: Entities read by f20, the ampersand last (fixed values).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
_PLAIN = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for _mark, _char in ENTITIES.items():
    _PLAIN = f"replace({_PLAIN}, '{_mark}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("f20_plain_text", f"SELECT page_id, trim(regexp_replace({_PLAIN}, '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM pages")
def f20_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    """Tags out, the common entities decoded, white space folded."""
    body = F.regexp_replace("html", "<[^>]*>", " ")
    for mark, char in ENTITIES.items():
        body = F.replace(body, F.lit(mark), F.lit(char))
    return ad.table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(body, "[ \\t\\r\\n]+", " ")).alias("plain"))


@query("f21_voice_labels", "SELECT voice_id, name || ' (' || engine || ')' || CASE WHEN size >= 25 THEN ' - ' || lower(style) ELSE '' END AS label FROM voices", "voices")
def f21_voice_labels(spark: SparkSession, sf: str) -> DataFrame:
    style = F.when(F.col("size") >= 25, F.concat(F.lit(" - "), F.lower("style"))).otherwise("")
    return ad.voices(spark, sf).select("voice_id", F.concat("name", F.lit(" ("), "engine", F.lit(")"), style).alias("label"))


@query("f22_prompt_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'the source language' END AS prompt FROM documents")
def f22_prompt_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German", "fr", "French")])
    return _documents(spark, sf).select("doc_id", F.coalesce(F.try_element_at(names, "lang"), F.lit("the source language")).alias("prompt"))


@query("m6_padding", "SELECT render_id, segment_id, clip_order, CASE WHEN pad > 0.02 THEN round(pad, 3) ELSE 0 END AS padding FROM (SELECT *, greatest(0.0::DOUBLE, 4.0::DOUBLE - (end_ms - start_ms) / 1000 / speed) AS pad FROM clips)", "clips")
def m6_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds that a clip at its speed falls short of its audio (four seconds here); under 0.02 counts as none."""
    pad = F.greatest(F.lit(0.0), F.lit(4.0) - (F.col("end_ms") - F.col("start_ms")) / 1000 / F.col("speed"))
    return ad.clips(spark, sf).select("render_id", "segment_id", "clip_order", F.when(pad > 0.02, F.round(pad, 3)).otherwise(0.0).alias("padding"))


@query("m9_pacing_scalars", """SELECT render_id, count(*) AS n_clips, avg(end_ms - start_ms) < 2000 AS short_on_average, bool_or(end_ms - start_ms < 1500) AS any_very_short,
bool_and(speed BETWEEN 0.9 AND 1.1) AS speed_in_band, count(*) >= 4 AND bool_or(end_ms - start_ms < 1500) AS crowded FROM clips GROUP BY 1""", "clips")
def m9_pacing_scalars(spark: SparkSession, sf: str) -> DataFrame:
    long = F.col("end_ms") - F.col("start_ms")
    n, short = F.count(F.lit(1)), F.bool_or(long < 1500)
    return ad.clips(spark, sf).groupBy("render_id").agg(
        n.alias("n_clips"), (F.avg(long) < 2000).alias("short_on_average"), short.alias("any_very_short"), F.bool_and(F.col("speed").between(0.9, 1.1)).alias("speed_in_band"), ((n >= 4) & short).alias("crowded")
    )


@query("h5_job_hash", "SELECT doc_id, sha256('scan' || chr(0) || 'document' || chr(0) || doc_id || chr(0) || sha256(text) || chr(0) || lang || chr(0)) AS h FROM documents")
def h5_job_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", T.content_hash(F.lit("scan"), F.lit("document"), F.col("doc_id").cast("string"), F.sha2("text", 256), F.col("lang")).alias("h"))


@query("a9_edit_distance", "SELECT voice_id, levenshtein(name, coalesce(lead(name) OVER (PARTITION BY engine ORDER BY voice_id), '')) AS distance FROM voices", "voices")
def a9_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    after = F.coalesce(F.lead("name").over(W.partitionBy("engine").orderBy("voice_id")), F.lit(""))
    return ad.voices(spark, sf).withColumn("after", after).select("voice_id", F.levenshtein("name", "after").cast("long").alias("distance"))


# Audits and projections

@query("d3_voice_previews", """SELECT vec_id, array_to_string(list_filter([CASE WHEN rms < 0.05 THEN 'too_quiet' END, CASE WHEN peak > 0.3 THEN 'clipped' END, CASE WHEN quiet > 0.01 THEN 'silence' END], lambda x: x IS NOT NULL), ',') AS issues FROM (""" + audits.ORACLES["g16_sample_levels"] + ")")
def d3_voice_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of previews by their levels: too quiet, clipped, mostly silent."""
    levels = audits.g16_sample_levels(spark, sf)
    issues = F.array(F.when(F.col("rms") < 0.05, "too_quiet"), F.when(F.col("peak") > 0.3, "clipped"), F.when(F.col("quiet") > 0.01, "silence"))
    return levels.select("vec_id", F.array_join(F.array_compact(issues), ",").alias("issues"))


@query("d5_readiness", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN c_custkey IS NULL THEN 'no_customer' END, CASE WHEN n IS NULL THEN 'no_clips' END, CASE WHEN o_totalprice < 50000 THEN 'no_budget' END, CASE WHEN o_orderstatus = 'P' THEN 'still_open' END], lambda x: x IS NOT NULL), ',') AS missing
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN (SELECT render_id, count(*) AS n FROM clips WHERE end_ms > start_ms GROUP BY 1) ON render_id = o_orderkey""", "clips")
def d5_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps a project from being run: its owner, its clips, its budget, its state."""
    owner = _customers(spark, sf).where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("owned"))
    usable = ad.clips(spark, sf).where("end_ms > start_ms").groupBy(F.col("render_id").alias("o_orderkey")).count()
    rows = _orders(spark, sf).join(owner, "o_custkey", "left").join(usable, "o_orderkey", "left")
    missing = F.array(F.when(F.col("owned").isNull(), "no_customer"), F.when(F.col("count").isNull(), "no_clips"), F.when(F.col("o_totalprice") < 50000, "no_budget"), F.when(F.col("o_orderstatus") == "P", "still_open"))
    return rows.select("o_orderkey", F.array_join(F.array_compact(missing), ",").alias("missing"))


@query("k9_reports", """SELECT render_id, '{"render_id":' || render_id || ',"clips":' || count(*) || ',"segments":' || count(DISTINCT segment_id) || ',"duration_ms":' || sum(greatest(0, end_ms - start_ms))::BIGINT || '}' AS report FROM clips GROUP BY 1""", "clips")
def k9_reports(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum(F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms"))).cast("long")
    made = ad.clips(spark, sf).groupBy("render_id").agg(F.count(F.lit(1)).alias("clips"), F.count_distinct("segment_id").alias("segments"), total.alias("duration_ms"))
    return made.select("render_id", F.to_json(F.struct("render_id", "clips", "segments", "duration_ms")).alias("report"))


@query("x21_audit_reports", """SELECT render_id, '{"passes":' || (bool_and(end_ms > start_ms) AND count(*) <= 6)::VARCHAR || ',"metrics":{"clips":' || count(*) || ',"purposes":' || count(DISTINCT purpose) || '},"issues":[' ||
array_to_string(list_filter([CASE WHEN NOT bool_and(end_ms > start_ms) THEN '"empty_clip"' END, CASE WHEN count(*) > 6 THEN '"too_many"' END], lambda x: x IS NOT NULL), ',') || ']}' AS report FROM clips GROUP BY 1""", "clips")
def x21_audit_reports(spark: SparkSession, sf: str) -> DataFrame:
    found = ad.clips(spark, sf).groupBy("render_id").agg(F.count(F.lit(1)).alias("clips"), F.count_distinct("purpose").alias("purposes"), F.bool_and(F.col("end_ms") > F.col("start_ms")).alias("whole"))
    issues = F.array_compact(F.array(F.when(~F.col("whole"), "empty_clip"), F.when(F.col("clips") > 6, "too_many")))
    return found.select("render_id", F.to_json(F.struct((F.size(issues) == 0).alias("passes"), F.struct("clips", "purposes").alias("metrics"), issues.alias("issues"))).alias("report"))


@query("x16_health_candidates", "SELECT engine, arg_min(voice_id, (name, voice_id)) AS voice_id FROM voices WHERE size >= 10 OR price < 1000 GROUP BY 1", "voices")
def x16_health_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable voice of each engine in catalog order."""
    usable = ad.voices(spark, sf).where((F.col("size") >= 10) | (F.col("price") < 1000))
    return usable.groupBy("engine").agg(F.min_by("voice_id", F.struct("name", "voice_id")).alias("voice_id"))


@query("x17_installed_engines", "SELECT voice_id, engine IN (SELECT engine FROM voices WHERE size = 50) AS installed FROM voices", "voices")
def x17_installed_engines(spark: SparkSession, sf: str) -> DataFrame:
    present = ad.voices(spark, sf).where("size = 50").select("engine").distinct().withColumn("found", F.lit(True))
    return ad.voices(spark, sf).join(present, "engine", "left").select("voice_id", F.coalesce("found", F.lit(False)).alias("installed"))


@query("x18_catalog_choices", "SELECT voice_id, name || ' / ' || engine AS choice, voice_id IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50) AS favourite FROM voices", "voices")
def x18_catalog_choices(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog as a list of choices, those that were ordered by the fifty marked."""
    favourites = ad.table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("voice_id")).distinct().withColumn("f", F.lit(True))
    rows = ad.voices(spark, sf).join(favourites, "voice_id", "left")
    return rows.select("voice_id", F.concat_ws(" / ", "name", "engine").alias("choice"), F.coalesce("f", F.lit(False)).alias("favourite"))


@query("x20_project_records", """SELECT render_id, first_engine AS voice_engine, n, o_orderstatus = 'F' AS enabled FROM (SELECT render_id, arg_min(engine, (price, voice_id)) AS first_engine, count(*) AS n FROM clips JOIN voices ON voice_id = l_partkey GROUP BY 1) JOIN orders ON o_orderkey = render_id""", "clips", "voices")
def x20_project_records(spark: SparkSession, sf: str) -> DataFrame:
    """A project record for each episode, with the voice that comes first for it."""
    rows = ad.clips(spark, sf).join(ad.voices(spark, sf), F.col("l_partkey") == F.col("voice_id"))
    made = rows.groupBy("render_id").agg(F.min_by("engine", F.struct("price", "voice_id")).alias("voice_engine"), F.count(F.lit(1)).alias("n"))
    return made.join(_orders(spark, sf), F.col("render_id") == F.col("o_orderkey")).select("render_id", "voice_engine", "n", (F.col("o_orderstatus") == "F").alias("enabled"))


@query("v14_normalised_episodes", """, o AS (SELECT o_orderkey AS episode, CASE WHEN o_orderstatus = 'F' THEN 'FULL_RECAP' ELSE 'MAIN_STORY' END AS type, trim(regexp_replace('  ' || o_orderpriority || ' . ', '\\s+', ' ', 'g'), '. ') AS title FROM orders)
SELECT episode, title, title || '.mp4' AS file_name, title || '.narration.srt' AS narration_file, segment_id, CASE WHEN segment_type = 'original_dialogue' THEN 'original_dialogue' ELSE 'narration' END AS subtitle_source, 'UNVERIFIED' AS rights, count(*) AS n_clips
FROM o JOIN clips ON render_id = episode WHERE type = 'FULL_RECAP' AND title <> '' GROUP BY ALL""", "clips")
def v14_normalised_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes as they are run: outputs of the chosen mode alone, titles fit for files,
    forced subtitle sources by type of segment, rights unverified unless they are given."""
    kind = F.when(F.col("o_orderstatus") == "F", "FULL_RECAP").otherwise("MAIN_STORY")
    raw = F.concat(F.lit("  "), "o_orderpriority", F.lit(" . "))
    title = F.btrim(F.regexp_replace(raw, r"\s+", " "), F.lit(". "))
    episodes = _orders(spark, sf).where(kind == "FULL_RECAP").select(F.col("o_orderkey").alias("episode"), title.alias("title"), F.lit(None).cast("string").alias("given")).where("title <> ''")
    source = F.when(F.col("segment_type") == "original_dialogue", "original_dialogue").otherwise("narration")
    rows = episodes.join(ad.clips(spark, sf), F.col("episode") == F.col("render_id"))
    made = rows.groupBy("episode", "title", "given", "segment_id", source.alias("subtitle_source")).agg(F.count(F.lit(1)).alias("n_clips"))
    files = [F.concat("title", F.lit(end)).alias(name) for name, end in (("file_name", ".mp4"), ("narration_file", ".narration.srt"))]
    return made.select("episode", "title", *files, "segment_id", "subtitle_source", F.coalesce("given", F.lit("UNVERIFIED")).alias("rights"), "n_clips")
