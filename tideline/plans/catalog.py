"""Queries over the voice catalog and projects: filters, preferences, labels, progress, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import intervals as iv
from tideline.operators import lookup, scan
from tideline.sources import adapters as ad

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None, *parts: str):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ctes = ",".join(ad.SQL[p] for p in parts)
            ORACLES[name] = f"WITH {ctes} {oracle}" if ctes else oracle
        return function

    return add


@query("p7_curated_voices", "SELECT voice_id, engine, name FROM voices WHERE engine IN ('Brand#1', 'Brand#2', 'Brand#3') AND name LIKE 'red%' AND style <> 'PROMO' AND size >= 5", "voices")
def p7_curated_voices(spark: SparkSession, sf: str) -> DataFrame:
    return ad.voices(spark, sf).where(F.col("engine").isin("Brand#1", "Brand#2", "Brand#3") & F.col("name").startswith("red") & (F.col("style") != "PROMO") & (F.col("size") >= 5)).select("voice_id", "engine", "name")


@query("p8_facet_search", "SELECT voice_id FROM voices WHERE lower(concat_ws(' ', name, engine, style)) LIKE '%widget brand#1%' AND size BETWEEN 10 AND 30", "voices")
def p8_facet_search(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "name", "engine", "style"))
    return ad.voices(spark, sf).where(text.contains("widget brand#1") & F.col("size").between(10, 30)).select("voice_id")


@query("p9_native_or_all", "SELECT engine, voice_id FROM (SELECT *, size > 45 AS native, bool_or(size > 45) OVER (PARTITION BY engine) AS any_native FROM voices) WHERE native OR NOT any_native", "voices")
def p9_native_or_all(spark: SparkSession, sf: str) -> DataFrame:
    """Native voices of an engine if it has any, else all of its voices."""
    native = F.col("size") > 45
    some = F.bool_or(native).over(W.partitionBy("engine"))
    return ad.voices(spark, sf).withColumn("_s", some).where(native | ~F.col("_s")).select("engine", "voice_id")


@query("p10_preferred_voice", "SELECT engine, voice_id FROM (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY CASE WHEN style = 'STANDARD' THEN 0 WHEN style = 'ECONOMY' THEN 1 ELSE 2 END, voice_id) AS k FROM voices) WHERE k = 1", "voices")
def p10_preferred_voice(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("style") == "STANDARD", 0).when(F.col("style") == "ECONOMY", 1).otherwise(2)
    return ad.voices(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("engine").orderBy(rank, "voice_id"))).where("k = 1").select("engine", "voice_id")


@query("w13_unique_labels", "SELECT voice_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || engine || ')' ELSE name END AS label FROM voices", "voices")
def w13_unique_labels(spark: SparkSession, sf: str) -> DataFrame:
    many = F.count(F.lit(1)).over(W.partitionBy("name")) > 1
    return ad.voices(spark, sf).select("voice_id", F.when(many, F.concat("name", F.lit(" ("), "engine", F.lit(")"))).otherwise(F.col("name")).alias("label"))


@query("o4_catalog_order", "SELECT voice_id, row_number() OVER (ORDER BY style <> 'STANDARD', lower(name), engine, voice_id) AS pos FROM voices", "voices")
def o4_catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every voice's place in the catalog. The whole catalog is one line: up to a million voices
    take a window, more are dealt into ranges of the order."""
    rows = ad.voices(spark, sf).select("voice_id", "engine", F.lit(0).alias("catalog"), (F.col("style") != "STANDARD").alias("special"), F.lower("name").alias("name"))
    placed = scan.running(rows, "catalog", ["special", "name", "engine", "voice_id"], number="before")
    return placed.select("voice_id", (F.col("before") + 1).alias("pos"))


@query("g13_engine_counts", "SELECT style, count(*) AS n, count(DISTINCT engine) AS engines, array_to_string(list_sort(list(DISTINCT engine)), ',') AS names FROM voices GROUP BY 1", "voices")
def g13_engine_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ad.voices(spark, sf).groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("engine").alias("engines"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("names"))


@query("j15_source_cascade", """WITH files AS (SELECT c_custkey AS file, lower(c_name) AS stem, lower(c_name || '.mp4') AS name FROM customer),
want AS (SELECT s_suppkey, lower('CUSTOMER#' || lpad((s_suppkey * 37)::VARCHAR, 9, '0') || '.MP4') AS name, lpad((s_suppkey * 13)::VARCHAR, 6, '0') AS episode FROM supplier),
exact AS (SELECT name, min(file) AS file FROM files GROUP BY 1 HAVING count(*) = 1),
loose AS (SELECT episode, min(file) AS file FROM (SELECT DISTINCT episode FROM want) JOIN files ON contains(stem, episode) GROUP BY 1 HAVING count(*) = 1)
SELECT s_suppkey, coalesce(exact.file, loose.file) AS source, CASE WHEN exact.file IS NOT NULL THEN 'exact' WHEN loose.file IS NOT NULL THEN 'contains' ELSE 'none' END AS found
FROM want LEFT JOIN exact USING (name) LEFT JOIN loose USING (episode)""")
def j15_source_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The source of an episode: the one file of its exact name, else the only one whose stem contains the
    episode's number, else none."""
    stem = F.lower("c_name")
    files = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("file"), stem.alias("stem"), F.concat(stem, F.lit(".mp4")).alias("name"))
    number = lambda by, n: F.lpad((F.col("s_suppkey") * by).cast("string"), n, "0")
    want = ad.table(spark, sf, "supplier").select("s_suppkey", F.lower(F.concat(F.lit("CUSTOMER#"), number(37, 9), F.lit(".MP4"))).alias("name"), number(13, 6).alias("episode"))
    exact = lookup.only_named(files, "name", "file").withColumnRenamed("file", "exact")
    loose = lookup.only_containing(want, files, "episode", "stem", "file").withColumnRenamed("file", "loose")
    found = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "contains").otherwise("none")
    return want.join(exact, "name", "left").join(loose, "episode", "left").select("s_suppkey", F.coalesce("exact", "loose").alias("source"), found.alias("found"))


@query("j16_favourite_rank", "SELECT voice_id, coalesce(r, 999) AS rank FROM voices LEFT JOIN (SELECT voice_id, row_number() OVER (ORDER BY price DESC, voice_id) AS r FROM voices WHERE size = 7) f USING (voice_id)", "voices")
def j16_favourite_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank among the favourites (those of one size), 999 for the rest; ranks by whole prices, not in one task."""
    v = ad.voices(spark, sf)
    liked = iv.placed_by(v.where("size = 7"), [-F.floor("price")], [F.desc("price"), "voice_id"])
    ranked = liked.select("voice_id", F.col("_place").alias("r"))
    return v.select("voice_id").join(ranked, "voice_id", "left").select("voice_id", F.coalesce("r", F.lit(999)).alias("rank"))


@query("g7_mean_progress", "SELECT o_orderpriority, coalesce(avg(o_orderkey % 101) FILTER (o_orderstatus <> 'P'), 0)::INTEGER AS progress FROM (SELECT o_orderpriority, o_orderstatus, (o_orderkey % 101)::DOUBLE AS o_orderkey FROM orders) GROUP BY 1")
def g7_mean_progress(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.avg(F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 101).cast("double")))
    return ad.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.coalesce(mean, F.lit(0.0)).alias("m")).select("o_orderpriority", F.floor(F.col("m") + F.lit(0.5)).cast("int").alias("progress"))


@query("p11_enabled_subset", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND NOT o_orderstatus IN ('F', 'P')")
def p11_enabled_subset(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "orders").where((F.col("o_totalprice") > 1000) & ~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("m8_progress_bands", "SELECT o_orderkey, greatest(1, least(99, floor(r * 100)))::INTEGER AS pct, CASE WHEN r < 0.4::DOUBLE THEN 'voice' WHEN r < 0.75::DOUBLE THEN 'cut' ELSE 'encode' END AS stage FROM (SELECT o_orderkey, (o_orderkey % 1000) / 1000.0::DOUBLE AS r FROM orders)")
def m8_progress_bands(spark: SparkSession, sf: str) -> DataFrame:
    r = (F.col("o_orderkey") % 1000) / F.lit(1000.0)
    stage = F.when(r < 0.4, "voice").when(r < 0.75, "cut").otherwise("encode")
    return ad.table(spark, sf, "orders").select("o_orderkey", F.greatest(F.lit(1), F.least(F.lit(99), F.floor(r * 100).cast("int"))).alias("pct"), stage.alias("stage"))


@query("m1_seconds_to_ms", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round_even(o_totalprice * 1000, 0)::BIGINT END AS ms FROM orders")
def m1_seconds_to_ms(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 0, F.bround(F.col("o_totalprice") * 1000).cast("long")).alias("ms"))


@query("m2_confidence", "SELECT event_id, round(least(1, greatest(0, exp(value / 50 - 2))), 9) AS confidence FROM events")
def m2_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "events").select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(F.col("value") / 50 - 2))), 9).alias("confidence"))


@query("m3_proxy_size", """SELECT p_partkey, greatest(2, (CASE WHEN h > 720 THEN w * 720 // h ELSE w END) // 2 * 2) AS width, greatest(2, least(h, 720) // 2 * 2) AS height FROM (
SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN b ELSE a END AS w, CASE WHEN p_size % 2 = 1 THEN a ELSE b END AS h FROM (SELECT p_partkey, p_size, 640 + p_size * 32 AS a, 360 + p_size * 16 AS b FROM part))""")
def m3_proxy_size(spark: SparkSession, sf: str) -> DataFrame:
    """Even proxy dimensions, sides swapped for rotated video, height at most 720."""
    part = ad.table(spark, sf, "part").select("p_partkey", (F.lit(640) + F.col("p_size") * 32).alias("a"), (F.lit(360) + F.col("p_size") * 16).alias("b"), (F.col("p_size") % 2 == 1).alias("turned"))
    sized = part.select("p_partkey", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("w"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("h"))
    return sized.selectExpr("p_partkey", "int(greatest(2L, if(h > 720, w * 720 div h, w) div 2 * 2)) AS width", "int(greatest(2L, least(h, 720) div 2 * 2)) AS height")


@query("m4_aspect_ratio", "SELECT p_partkey, ((640 + p_size * 32) // gcd(640 + p_size * 32, 360 + p_size * 10)) || ':' || ((360 + p_size * 10) // gcd(640 + p_size * 32, 360 + p_size * 10)) AS ratio FROM part")
def m4_aspect_ratio(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.lit(640) + F.col("p_size") * 32, F.lit(360) + F.col("p_size") * 10
    step = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))))
    divided = ad.table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"), step["x"].alias("g"))
    return divided.select("p_partkey", F.concat_ws(":", F.floor(F.col("a") / F.col("g")).cast("string"), F.floor(F.col("b") / F.col("g")).cast("string")).alias("ratio"))


@query("m11_rotation", "SELECT p_partkey, ((p_size * 90 - 450) % 360 + 360) % 360 AS rotation, CASE WHEN p_size % 4 = 0 THEN NULL ELSE round(30000.0::DOUBLE / (p_size % 4 * 1001), 6) END AS rate FROM part")
def m11_rotation(spark: SparkSession, sf: str) -> DataFrame:
    below = F.col("p_size") % 4 * 1001
    return ad.table(spark, sf, "part").select("p_partkey", F.pmod(F.col("p_size") * 90 - 450, F.lit(360)).alias("rotation"), F.round(F.try_divide(F.lit(30000.0), below), 6).alias("rate"))


@query("f6_short_component", r"""SELECT voice_id, CASE WHEN c <> '' AND length(c) <= 12 THEN c ELSE left(c, 1) || '-' || left(sha256(raw), 10) END AS part FROM (
SELECT voice_id, name || ' ' || engine AS raw, trim(regexp_replace(trim(name || ' ' || engine), '[^A-Za-z0-9._-]+', '-', 'g'), '-._') AS c FROM voices)""", "voices")
def f6_short_component(spark: SparkSession, sf: str) -> DataFrame:
    return ad.voices(spark, sf).select("voice_id", T.short_component(F.concat_ws(" ", "name", "engine"), 12).alias("part"))


@query("f17_content_types", "SELECT event_id, CASE upper(event_type) WHEN 'CLICK' THEN 'TV' WHEN 'VIEW' THEN 'SOAP' ELSE 'OTHER' END AS content_type FROM events")
def f17_content_types(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(F.lit("CLICK"), F.lit("TV"), F.lit("VIEW"), F.lit("SOAP"))
    return ad.table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(names, F.upper("event_type")), F.lit("OTHER")).alias("content_type"))


@query("x15_favourite_sets", """SELECT o_custkey, coalesce(string_agg(p, ',' ORDER BY p) FILTER (added AND NOT removed), '') AS favourites FROM (
SELECT o_custkey, o_orderpriority AS p, bool_or(o_orderstatus <> 'P') AS added, bool_or(o_orderstatus = 'P') AS removed FROM orders GROUP BY 1, 2) GROUP BY 1""")
def x15_favourite_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Favourites kept and added (finished and open orders' priorities) without those removed
    (partial ones'), sorted; a set has one entry for each priority at most."""
    of = lambda status: F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))
    left = F.array_except(F.array_union(of("F"), of("O")), of("P"))
    return ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(left), ",").alias("favourites"))


@query("o6_first_messages", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:12], ',') AS first_orders FROM orders GROUP BY 1")
def o6_first_messages(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 12)
    return ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x.cast("string")), ",").alias("first_orders"))


@query("o8_newest_snapshot", "SELECT l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS newest FROM (SELECT *, count(DISTINCT l_returnflag) OVER (PARTITION BY l_suppkey) AS k FROM lineitem) WHERE k = 3 GROUP BY 1")
def o8_newest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    lines = ad.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("newest"), F.count_distinct("l_returnflag").alias("k"))
    return lines.where("k = 3").select("l_suppkey", "newest")
